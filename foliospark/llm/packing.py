"""Best-fit packing of token sequences by exact-complement hashing.

Only the number of pieces of each length matters to the plan, and there are at most `capacity` lengths, so the plan is
made on the driver from that bounded histogram, whatever the corpus holds. For the longest length left, the gap up to
the capacity is looked up among the sums of one, two and three available lengths; a combination that fills it exactly
is consumed as often as the counts allow. What finds no exact complement is filled best-fit: the longest length that
still fits, again and again. Pieces then get their places by their rank among the pieces of their length.

Defined cases: null and empty texts are the end token alone; repeated rows are packed each; null ids pass through;
longer documents are cut into pieces of `capacity`, the last may be shorter; an empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.shared import Written, arrow_rows, slices, strings
from foliospark.llm.textcore import GOLD, U64, Words

CAPACITY, END = 4096, 1
#: Rows of one rank group (length, salt) at most, about.
RANKED = 1 << 20
#: Slots of a Python worker's memory of units (32 bytes each; half of them are used), and the ids it keeps before it starts afresh.
SLOTS, REMEMBERED = 1 << 20, 1 << 21
#: Longer units aren't remembered.
SHORT = 64
#: Texts are cut at spaces and newlines.
NOT_CUT = np.ones(256, bool)
NOT_CUT[[10, 32]] = False
#: 0 for letters, 1 for ASCII signs, 65536 for others.
_KIND = np.full(256, 1 << 16, np.uint32)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 0
NO_RANK = 1 << 62


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What lets texts be cut at spaces and newlines: they separate words, are dropped, and no composition spans them. Fixed values.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def cuts_at_spaces(definition: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its chunks between spaces and newlines, in turn, and those of a word
    of letters are plain byte pair merges of its bytes."""
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not set(t["content"]) & {" ", "\n"} for t in definition["added_tokens"])
    normal, pre = definition["normalizer"] or {}, definition["pre_tokenizer"] or {}
    split, *rest = pre.get("pretokenizers") or [{}]
    words = split.get("type") == "Split" and split["pattern"] == {"Regex": _PATTERN} and split["behavior"] == "Removed" and split["invert"]
    bytes_ = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
    merges = all(definition["model"].get(k) == v for k, v in _MODEL.items())
    return plain and definition["truncation"] is None and normal.get("normalizers") == _NORMALIZERS and words and bytes_ and merges


class Merges:
    """Byte pair merges of many words at once. Words of as many bytes are rows of a matrix; in each step every row that has a
    mergeable pair merges its first pair of the lowest rank, so rows stay equally long until they are done."""

    def __init__(self, model: dict):
        vocabulary = model["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, the rest for 256 on
        others = iter(range(256, 512))
        shown = [chr(b) if b in visible else chr(next(others)) for b in range(256)]
        self.inner = np.array([vocabulary[c] for c in shown], np.int64)
        self.final = np.array([vocabulary[c + "</w>"] for c in shown], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        into = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.width = 1 << 19
        self.keys, self.values = np.full(self.width, -1, np.int64), np.full(self.width, NO_RANK, np.int64)
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), (np.arange(len(keys)) << 20 | into).tolist(), strict=True):
            while self.keys[slot] not in (-1, key):
                slot = slot + 1 & self.width - 1
            if self.keys[slot] == -1:
                self.keys[slot], self.values[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(U64) * GOLD >> U64(45)).view(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, NO_RANK if it has none."""
        keys = a << 20 | b
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NO_RANK)
        on = np.flatnonzero((held != keys) & (held != -1))
        while len(on):
            slot[on] = slot[on] + 1 & self.width - 1
            held = self.keys[slot[on]]
            hit = held == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (held != -1)]
        return out

    def _same_length(self, rows: np.ndarray):
        """(row numbers, their ids as a matrix) for a matrix of bytes."""
        ids = self.inner[rows]
        ids[:, -1] = self.final[rows[:, -1]]
        who = np.arange(len(ids))
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while ids.shape[1] > 1 and len(who):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(at)), at]
            done = best == NO_RANK
            if done.any():
                yield who[done], ids[done]
                who, ids, ranks, at, best = who[~done], ids[~done], ranks[~done], at[~done], best[~done]
            each = np.arange(len(who))
            ids[each, at] = best & (1 << 20) - 1
            n = ids.shape[1] - 1
            after = np.arange(n) > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 1)
            ranks[left, at[left] - 1] = self._ranks(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self._ranks(ids[right, at[right]], ids[right, at[right] + 1])
        yield who, ids

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has."""
        done = []
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            done += [(own[who], ids) for who, ids in self._same_length(data[starts[own][:, None] + np.arange(n)])]
        counts = np.zeros(len(starts), np.int64)
        for who, ids in done:
            counts[who] = ids.shape[1]
        ends = np.cumsum(counts)
        out = np.zeros(counts.sum(), np.uint32)
        for who, ids in done:
            out[(ends[who] - counts[who])[:, None] + np.arange(ids.shape[1])] = ids
        return out, counts


class Encoder:
    """Ids of whole texts, as the library gives them. If the tokenizer's own definition says that texts may be cut at spaces
    and newlines, they are, and what follows a word of letters, if that is signs only, is a unit of its own, as the
    definition's pattern has it. Each distinct unit is encoded once and its ids are remembered, in an open hash table with
    bounded slots and ids; a unit is known by its hash, its length and its first and last eight bytes. Words of letters, put
    into lower case, are merged here, all other units go to the library. Other tokenizers get whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        self.cuts = cuts_at_spaces(definition)
        if self.cuts:
            self.merges = Merges(definition["model"])
            self._forget()

    def _forget(self) -> None:
        self.table = np.zeros((SLOTS, 4), np.int64)  # two marks, and the place among the ids << 16 | count, 0 if free
        self.ids, self.size, self.held = np.zeros(1 << 16, np.uint32), 1, 0

    def _keep(self, ids: np.ndarray) -> int:
        at, self.size = self.size, self.size + len(ids)
        while self.size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : self.size] = ids
        return at

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(lists)), np.uint32), np.array([len(x) for x in lists], np.int64)

    def _learned(self, w: Words, units: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the ids of new units."""
        at, counts = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        starts, ends = w.starts[units], w.ends[units]
        merged = letters & (ends - starts <= SHORT)
        for own in (np.flatnonzero(merged), np.flatnonzero(~merged)):
            if len(own):
                if merged[own[0]]:
                    ids, n = self.merges(w.data, starts[own], (ends - starts)[own])
                else:
                    ids, n = self._encoded([w.data[a:b].tobytes().decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
                counts[own] = n
                at[own] = self._keep(ids) + np.cumsum(n) - n
        return at, counts

    @staticmethod
    def _slots(hashes: np.ndarray):
        slot = hashes.view(np.int64)
        for step in range(8):
            yield slot + step & SLOTS - 1

    @staticmethod
    def _units(w: Words) -> np.ndarray:
        """Cuts trailing ASCII signs off words of letters, and puts those into lower case; returns which units are words of
        letters: A to Z and U+00C0 to U+00FF, but for the two signs among these."""
        data = w.data
        kinds = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kinds[lead] = kinds[lead + 1] = 0
        before = np.zeros(len(data) + 1, np.uint32)
        np.cumsum(kinds, out=before[1:], dtype=np.uint32)
        lengths = w.ends - w.starts
        signs = (before[w.ends] - before[w.starts]).astype(np.int64)  # from 65536 on: other bytes too
        plain = (signs < lengths) & (lengths <= SHORT)
        plain &= before[w.ends] - before[np.where(plain, w.ends - signs, w.ends)] == signs
        cut = plain & (signs > 0)
        heads = np.arange(len(cut)) + np.cumsum(cut) - cut
        tails = heads[cut] + 1
        letters = np.zeros(len(cut) + len(tails), bool)
        letters[heads] = plain
        starts, ends = np.empty(len(letters), np.int64), np.empty(len(letters), np.int64)
        starts[heads], ends[heads] = w.starts, w.ends - np.where(cut, signs, 0)
        starts[tails], ends[tails] = ends[heads[cut]], w.ends[cut]
        w.ptr = w.ptr + np.concatenate([[0], np.cumsum(cut)])[w.ptr]
        w.starts, w.ends = starts, ends
        w.data = data.copy()
        capital = np.flatnonzero(data - np.uint8(65) < 26)
        w.data[capital[letters[np.searchsorted(starts, capital, "right") - 1]]] += np.uint8(32)
        # Of U+00C0 to U+00DE the capitals are 32 below the others, in UTF-8 too; U+00DF is a small letter.
        capital = lead[data[lead + 1] < 0x9F]
        w.data[capital[letters[np.searchsorted(starts, capital, "right") - 1]] + 1] += np.uint8(32)
        return letters

    def _ids(self, w: Words, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the ids of every unit."""
        lengths = w.ends - w.starts
        first, last = w.block(w.starts, np.minimum(lengths, 8)), w.block(np.maximum(w.starts, w.ends - 8), np.minimum(lengths, 8))
        marks = first.view(np.int64), (last ^ lengths.astype(U64) << U64(56) ^ w.hashes >> U64(8)).view(np.int64)
        near = self.table.take(next(self._slots(w.hashes)), 0)
        found = np.where((near[:, 0] == marks[0]) & (near[:, 1] == marks[1]), near[:, 2], 0)
        seek = np.flatnonzero((found == 0) & (near[:, 2] != 0))
        for slot in self._slots(w.hashes[seek]):
            near = self.table.take(slot, 0)
            same = (near[:, 0] == marks[0][seek]) & (near[:, 1] == marks[1][seek])
            found[seek[same]] = near[same, 2]
        at, counts = found >> 16, found & 0xFFFF
        new = np.flatnonzero(found == 0)
        if len(new):
            _, one, which = np.unique(w.hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            own_at, own_counts = self._learned(w, one, letters[one])
            at[new], counts[new] = own_at[which], own_counts[which]
            put = np.flatnonzero((lengths[one] <= SHORT) & (own_counts > 0))
            values = own_at << 16 | own_counts
            for slot in self._slots(w.hashes[one]):
                free = self.table[slot[put], 2] == 0
                self.table[slot[put[free]], 2] = values[put[free]]
                won = self.table[slot[put], 2] == values[put]  # of several at one slot, one stays
                own, at_slot = put[won], slot[put[won]]
                self.table[at_slot, 0], self.table[at_slot, 1] = marks[0][one[own]], marks[1][one[own]]
                self.held += len(own)
                put = put[~won]
        return at, counts

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        texts = strings(column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column, pa.large_string()))
        if not self.cuts:
            return self._encoded(texts.to_pylist())
        if self.size > REMEMBERED or 2 * self.held > SLOTS:
            self._forget()
        w = Words(texts, NOT_CUT)
        at, counts = self._ids(w, self._units(w))
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(at - ends + counts, counts) + np.arange(counts.sum())]
        return ids, np.diff(np.concatenate([[0], ends])[w.ptr])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder, which lives as long as the worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("turn", pa.int64()), ("ids", pa.binary())])


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each (doc_id, text); `turn` numbers a task's pieces, `ids` is null unless asked for."""
    arrow_rows(docs.sparkSession)

    def run(batches):
        encode, turn = encoder(path), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encode(part.column("text"))
                raw = memoryview(np.insert(ids, np.cumsum(counts), END).astype("<u4", copy=False)).cast("B")
                sizes = counts + 1
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                first = (np.cumsum(sizes) - sizes)[owner] + start
                bounds = list(zip((4 * first).tolist(), (4 * (first + length)).tolist(), strict=True))
                columns = [
                    part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64()),
                    pa.array(turn + np.arange(len(owner))), pa.array([bytes(raw[a:b]) for a, b in bounds], pa.binary()) if keep_ids else pa.nulls(len(owner), pa.binary()),
                ]
                turn += len(owner)
                yield pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, turn long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), using up exactly `counts`."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {capacity}")
        left[length] += n
    out: list[tuple[list[int], int]] = []

    def pair(gap: int, longest: int) -> list[int] | None:
        """Two available lengths of that sum, the first as long as can be."""
        a = np.arange(min(gap - 1, longest), (gap + 1) // 2 - 1, -1)
        b = gap - a
        fits = (left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1)) if len(a) else np.zeros(0, bool)
        return [int(a[k := int(fits.argmax())]), int(b[k])] if fits.any() else None

    def complement(gap: int) -> list[int] | None:
        if left[gap]:
            return [gap]
        if found := pair(gap, capacity):
            return found
        for a in np.flatnonzero(left[:gap])[::-1]:  # the longest of the three first
            if 3 * a < gap:
                break
            left[a] -= 1
            found = pair(gap - int(a), int(a))
            left[a] += 1
            if found:
                return [int(a), *found]
        return None

    def take(lengths: list[int]) -> None:
        n = min(int(left[x]) // m for x, m in Counter(lengths).items())
        for x in lengths:
            left[x] -= n
        out.append((lengths, n))

    if left[capacity]:
        take([capacity])
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            found = complement(capacity - length)
            if found is None:
                found, gap = [], capacity - length
                used: Counter = Counter()
                while gap:
                    fits = left[: gap + 1].copy()
                    for x, m in used.items():
                        if x <= gap:
                            fits[x] -= m
                    best = np.flatnonzero(fits > 0)
                    if not len(best):
                        break
                    found.append(int(best[-1]))
                    used[found[-1]] += 1
                    gap -= found[-1]
            left[length] += 1
            take([length, *found])
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each row of a written table with `length` and `turn` its sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    base, rank, slots = 0, Counter(), []
    for lengths, n in plan(counts, capacity):
        at = 0
        for length in lengths:
            slots.append((length, rank[length], base, at))
            rank[length] += n
            at += length
        base += n
    slots.sort()
    # Bounded by the capacity: a pattern uses up a length's count, or is one of a few for a length.
    table = np.array(slots, np.int64).reshape(-1, 4)
    starts = table[:, 0] << 48 | table[:, 1]
    salts = sum(counts.values()) // RANKED + 32
    columns = pieces.columns
    salted = pieces.withColumn("salt_", F.pmod(F.col("turn"), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_salt.select("length", "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    within = Window.partitionBy("length", "salt_").orderBy("turn", "doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank_", F.row_number().over(within).cast("long") - 1).join(firsts, ["length", "salt_"]).select(*columns, (F.col("rank_") + F.col("first_")).alias("rank_"))

    def place(batches):
        for batch in batches:
            length, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank_"))
            k = np.searchsorted(starts, length << 48 | r, "right") - 1
            new = [pa.array(table[k, 2] + r - table[k, 1]), pa.array(table[k, 3])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + new, names=columns + ["sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    pieces = Written(tokenized(docs, path or tokenizer_file(), capacity, keep_ids), "pieces")
    packed = pack(pieces.df, capacity).drop("turn")
    return packed if keep_ids else packed.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from packed pieces that kept theirs; a sequence has `capacity` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.concat_ws("", F.transform(parts, lambda p: F.hex(p.ids))).alias("hex_")).select("sequence_id", F.unhex("hex_").alias("ids"))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
