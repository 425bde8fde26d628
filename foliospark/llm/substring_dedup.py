"""Substring dedup: prefix-partitioned suffix trees over the corpus's words.

A suffix is the word sequence from one place of a document to its end. A window of `min_words` words is repeated if
another suffix begins with it, that is, if its suffix hangs under an internal node of that depth or more. The corpus's
suffixes are split by prefixes into groups that fit a task's memory, and each group gets a tree of its own:

1. Documents are packed into chunk rows (compressed Arrow batches), dealt by chunk number and checkpointed, so later
   steps join small tables to chunks without moving the texts again.
2. Every window names its anchor, the ten words of the smallest hash in it. Windows beside each other that name the same
   place form a segment; all suffixes that share a window's words share its anchor, so the anchor's ten words are the
   prefix that groups are made by. Anchors that stand once in the corpus hold no repeat and drop out, without loss.
3. Segments whose words are equal (128-bit BLAKE2b digests) are one, counted natively; several make all their windows repeated.
   Only anchors with different segments need a tree, of one text for each.
4. A group of anchors numbers its words exactly, ranks all its suffixes by prefix doubling over these numbers, and takes
   the longest common prefixes of neighbours in that order. Runs of common prefixes of `min_words` words or more are its
   deep internal nodes; all suffixes under one are repeats.
5. An anchor with over GROUP different segments gets a longer prefix: the whole window, and is split into groups by that;
   suffixes that share it are counted natively.

Adjacent repeated windows of a document add up to the ranges that are removed.

Defined cases: null and empty texts have no words and stay as they are; a text of any length is one row of a chunk of its
own beyond 4 MB; repeated rows (equal ids too) are occurrences of their own, so texts of `min_words` words or more lose
all words in every copy; other columns pass through with their nulls; an empty table gives an empty result; added columns
replace input columns of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import Written, arrow_rows, checkpointed, join_hot, slices
from foliospark.llm.textcore import U64, Words, rolling, sliding_min

MIN_WORDS = 35
ANCHOR = 10
#: Segments of a tree, about: 60 words each at most, so a group takes some 10 MB.
GROUP = 1 << 11
#: Windows of a segment at most: bits of a long.
MOST = 62
ADDED = "dedup_text string, n_words long, n_removed long, removed_spans array<struct<first:int,last:int>>, kept_sha256 string"


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(payload) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(pa.py_buffer(payload))))


class _Segments:
    """A chunk's segments: their first windows, how many windows each has, and their anchors' hashes."""

    def __init__(self, column: pa.Array, k: int):
        self.k = k
        self.words = w = Words(column)
        anchor = max(min(ANCHOR, k), k - MOST + 1)
        hashes = rolling(w.hashes, anchor)
        at = np.flatnonzero(w.left() >= k)
        # The first of the places with the smallest hash: equal windows name equal places in themselves.
        bits = max(1, len(hashes).bit_length())
        place = (sliding_min(hashes >> U64(bits) << U64(bits) | np.arange(len(hashes), dtype=U64), k - anchor + 1)[at] & U64((1 << bits) - 1)).astype(np.int64)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > 1) | (np.diff(place) != 0)
        begin = np.flatnonzero(fresh)
        self.first, self.anchors = at[begin], hashes[place[begin]].view(np.int64)
        self.windows = np.diff(np.append(begin, len(at)))
        self.spaced = np.cumsum(np.concatenate([[0], w.ends - w.starts + 1]))

    def text(self, i: int) -> bytes:
        """The words of segment i, joined by single spaces."""
        a, b = int(self.first[i]), int(self.first[i] + self.windows[i] + self.k - 2)
        raw = self.words.data[self.words.starts[a] : self.words.ends[b]].tobytes()
        return raw.translate(_PLAIN) if len(raw) + 1 == self.spaced[b + 1] - self.spaced[a] else b" ".join(raw.split())


_PLAIN = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def _digest(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _longs(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def ranks(codes: np.ndarray, depth: int) -> list[np.ndarray]:
    """Prefix doubling: the ranks of all sequences of 1, 2, 4 ... codes up to at least `depth`; zeros follow the last code."""
    out = [codes]
    while 1 << len(out) - 1 < depth:
        half, now = 1 << len(out) - 1, out[-1].astype(np.int64)
        pairs = now * (int(now.max(initial=0)) + 1)
        pairs[:-half] += now[half:]
        out.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32) if len(pairs) > half else now)
    return out


def deep_suffixes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset in words) of all suffixes of these texts (words joined by single spaces) that share their first k words
    with another suffix: those under the deep internal nodes of the texts' suffix tree."""
    w = Words(texts)
    lengths = w.ends - w.starts
    plain = w.data[w.data != 32] if len(lengths) else w.data
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(plain)])
    numbers = words.dictionary_encode().indices.to_numpy() + 1
    # A zero after each text, and enough of them at the end to read past it.
    owner = np.repeat(np.arange(len(texts)), w.counts)
    codes = np.zeros(len(numbers) + len(texts) + 4 * k + 64, np.int64)
    place = np.arange(len(numbers)) + owner
    codes[place] = numbers
    left = w.left()
    levels = ranks(codes, int(w.counts.max(initial=1)) + 1)
    suffixes = np.flatnonzero(left >= k)
    at, room = place[suffixes], left[suffixes]
    order = np.argsort(levels[-1][at], kind="stable")
    suffixes, at, room = suffixes[order], at[order], room[order]
    x, y = at[:-1], at[1:]
    common = np.zeros(len(x), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][np.minimum(x + common, len(codes) - 1)] == levels[level][np.minimum(y + common, len(codes) - 1)]
        common += same * (1 << level)
    deep = np.minimum(common, np.minimum(room[:-1], room[1:])) >= k
    under = np.zeros(len(suffixes), bool)
    under[:-1] |= deep
    under[1:] |= deep
    found = suffixes[under]
    return owner[found], found - w.ptr[owner[found]]


def remove_repeats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, digest: bool = False) -> DataFrame:
    """`docs` with ADDED columns: the text without its repeated words (what stands between stays as it was), word
    counts, the removed word ranges (last excluded), and with `digest` the SHA-256 of the kept words joined by single
    spaces (else null)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    k = min_words
    own = [f for f in docs.schema.fields]
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches):
        parts, held, seq = [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def row():
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([_ipc(batch)], pa.binary())], names=["chunk", "payload"])

        for batch in batches:
            for part in slices(batch, text):
                parts.append(part)
                held += part.column(text).nbytes
                if held >= 4 << 20:
                    yield row()
                    parts, held, seq = [], 0, seq + 1
        if parts and sum(p.num_rows for p in parts):
            yield row()

    chunks = checkpointed(docs.mapInArrow(pack, "chunk long, payload binary").repartition(width, "chunk"))

    def on_chunks(df: DataFrame, f, schema: str | T.StructType) -> DataFrame:
        """f(chunk number, its rows, the other columns' values) for each chunk, a batch or none each."""
        extra = [c for c in df.columns if c not in ("chunk", "payload")]

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    given = [batch.column(c)[i].as_py() or [] for c in extra]
                    yield f(batch.column("chunk")[i].as_py(), _unpack(batch.column("payload")[i].as_buffer()), *given)

        return df.mapInArrow(run, schema)

    def by_chunk(rows: DataFrame, column, how: str = "inner") -> DataFrame:
        """The chunks with a list of what `rows` say of each; bounded by a chunk's segments. The texts aren't shuffled."""
        lists = rows.groupBy("chunk").agg(F.collect_list(column).alias("lists"))
        return chunks.join(lists.hint("merge"), "chunk", how)

    def anchors(chunk, rows):
        s = _Segments(rows.column(text), k)
        values, times = np.unique(s.anchors, return_counts=True)
        return _longs(anchor=values, chunk=np.full(len(values), chunk), times=np.minimum(times, 2))

    named = Written(on_chunks(chunks, anchors, "anchor long, chunk long, times long"), "anchors")
    twice = named.df.groupBy("anchor").agg(F.sum("times").alias("times_"), F.count("*").alias("n_")).filter("times_ > 1").drop("times_")
    twice = Written(twice, "repeated")
    again = join_hot(named.df.select("anchor", "chunk"), twice.df, ["anchor"], named.df.count()).select("chunk", "anchor")

    def segments(chunk, rows, repeated):
        s = _Segments(rows.column(text), k)
        which = np.flatnonzero(np.isin(s.anchors, np.array(repeated, np.int64)))
        keys = np.array([_digest(s.text(i)) for i in which.tolist()], np.int64).reshape(-1, 2)
        return _longs(chunk=np.full(len(which), chunk), idx=which, windows=s.windows[which], anchor=s.anchors[which], k1=keys[:, 0], k2=keys[:, 1])

    found = Written(on_chunks(by_chunk(again, "anchor"), segments, "chunk long, idx long, windows long, anchor long, k1 long, k2 long"), "segments")
    one = found.df.groupBy("anchor", "k1", "k2").agg(F.count("*").alias("n_"), F.min(F.struct("chunk", "idx")).alias("place"), F.first("windows").alias("windows"))
    different = Written(one.select("anchor", "k1", "k2", "n_", "place.*", "windows"), "different")
    several = different.df.groupBy("anchor").agg(F.count("*").alias("d_")).filter("d_ > 1")
    in_trees = join_hot(different.df.drop("n_"), several.withColumn("n_", F.col("d_")), ["anchor"], different.df.count())
    in_trees = Written(in_trees.select("chunk", "idx", "anchor", "k1", "k2", (F.col("d_") > GROUP).alias("heavy")), "trees")
    groups = max(width, 2 * in_trees.df.count() // GROUP + 1)

    def suffixes(chunk, rows, wanted):
        s = _Segments(rows.column(text), k)
        part, k1, k2, offset, words, w1, w2 = ([] for _ in range(7))
        for x in wanted:
            words_ = s.text(x["idx"])
            if not x["heavy"]:
                pieces = [(x["anchor"] % groups, -1, words_, 0, 0)]
            else:  # each window is a prefix of its own
                own = words_.split(b" ")
                pieces = [(0, i, None, *_digest(b" ".join(own[i : i + k]))) for i in range(len(own) - k + 1)]
            for p, o, t, a, b in pieces:
                for column, value in zip((part, k1, k2, offset, words, w1, w2), (p, x["k1"], x["k2"], o, t, a, b), strict=True):
                    column.append(value)
        batch = _longs(part=part, k1=k1, k2=k2, offset=offset, w1=w1, w2=w2)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.binary())], names=[*batch.schema.names, "words"])

    wanted = by_chunk(in_trees.df, F.struct("idx", "anchor", "k1", "k2", "heavy"))
    dealt = Written(on_chunks(wanted, suffixes, "part long, k1 long, k2 long, offset long, w1 long, w2 long, words binary"), "suffixes")

    def tree(table: pa.Table) -> pa.Table:
        who, offset = deep_suffixes(table.column("words").combine_chunks().cast(pa.large_binary()).view(pa.large_string()), k)
        masks = np.zeros(table.num_rows, np.int64)
        np.bitwise_or.at(masks, who, np.int64(1) << offset)
        deep = np.flatnonzero(masks)
        return pa.table({"k1": table.column("k1").take(pa.array(deep)), "k2": table.column("k2").take(pa.array(deep)), "mask": pa.array(masks[deep])})

    light = dealt.df.filter("offset < 0").groupBy("part").applyInArrow(tree, "k1 long, k2 long, mask long")
    windows = dealt.df.filter("offset >= 0").select("w1", "w2", "k1", "k2", "offset")
    shared = windows.groupBy("w1", "w2").agg(F.count("*").alias("n_")).filter("n_ > 1")
    heavy = windows.join(shared, ["w1", "w2"]).select("k1", "k2", F.expr("shiftleft(1L, cast(offset as int))").alias("mask"))
    whole = different.df.filter("n_ > 1").select("k1", "k2", F.expr("shiftleft(1L, cast(windows as int)) - 1").alias("mask"))
    masks = light.unionByName(heavy).unionByName(whole).groupBy("k1", "k2").agg(F.expr("bit_or(mask)").alias("mask"))
    masks = Written(masks.join(different.df.select("k1", "k2", "n_"), ["k1", "k2"]), "masks")
    reply = join_hot(found.df.select("chunk", "idx", "k1", "k2"), masks.df, ["k1", "k2"], found.df.count()).select("chunk", "idx", "mask")
    last = Written(reply, "reply")
    for table in (named, twice, found, different, in_trees, dealt, masks):
        table.drop()
    added = T._parse_datatype_string(ADDED)
    kept = [f for f in own if f.name not in added.names]
    out_schema = T.StructType(kept + added.fields)

    def strip(chunk, rows, repeated):
        return _stripped(rows, text, k, repeated, digest, [f.name for f in kept])

    return on_chunks(by_chunk(last.df, F.struct("idx", "mask"), "left"), strip, out_schema)


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _stripped(rows: pa.RecordBatch, text: str, k: int, repeated: list[dict], digest: bool, keep: list[str]) -> pa.RecordBatch:
    s = _Segments(rows.column(text), k)
    words = s.words
    idx, mask = np.array([r["idx"] for r in repeated], np.int64), np.array([r["mask"] for r in repeated], np.int64)
    hit = np.concatenate([np.zeros(0, np.int64), *[s.first[idx[mask >> b & 1 == 1]] + b for b in range(MOST)]])
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    gone = np.cumsum(edge)[:-1] > 0
    counts = words.counts
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[words.ptr[1:]] - total[words.ptr[:-1]]
    texts, spans, digests = [], [], []
    for d in range(rows.num_rows):
        a, b = words.ptr[d], words.ptr[d + 1]
        raw = words.data[words.offs[d] : words.offs[d + 1]].tobytes()
        own: list[dict] = []
        if removed[d]:
            mine = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
            own = [{"first": int(x), "last": int(y)} for x, y in zip(mine[::2], mine[1::2], strict=True)]
            out, at = [], 0
            for s in own:
                left = raw[at : words.starts[a + s["first"]] - words.offs[d]].rstrip()
                out.append(left if any(out) else left.lstrip() if out else left)
                at = words.ends[a + s["last"] - 1] - words.offs[d]
            out.append(raw[at:])
            text_left = b"".join(out)
            texts.append(text_left if any(out[:-1]) else text_left.lstrip())
        else:
            texts.append(raw)
        spans.append(own)
        digests.append(hashlib.sha256(b" ".join(texts[-1].split())).hexdigest() if digest else None)
    missing = rows.column(text).is_null().to_pylist()
    new = [
        pa.array([None if m else t.decode() for m, t in zip(missing, texts, strict=True)], pa.string()),
        pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(digests, pa.string()),
    ]
    return pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + new, names=keep + ["dedup_text", "n_words", "n_removed", "removed_spans", "kept_sha256"])


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
