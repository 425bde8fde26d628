"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks.

Words are lower-cased (A-Z) runs of letters and digits; features are five-word shingles. For every benchmark item of L
words, windows of L words of a document get a 128-bit SimHash of their shingles, weighted by how often they occur. The
fingerprint is cut into eight 16-bit blocks; an item within RADIUS (31) bits of a window agrees with it in some block up
to 3 bits, as 8 * 4 > 31, so an index of all block values within 3 bits of each item's guarantees every item in the
radius. Candidates are verified by the exact weighted Jaccard similarity of the shingles (0.8 or more).

A document with fewer words than an item is its only window for that item. Its similarity is at most the part of its
shingles that items of that size have; where this reaches the threshold, all of these items are verified exactly.

Only windows that hold a shingle of an item of their size are fingerprinted: others have similarity 0. Items are
handled in blocks of ITEMS (and ITEM_BYTES), one after another, each a pass over the documents whose result is written
before the next begins, so a worker holds one block's index, however large the benchmark. The documents aren't shuffled.

Defined cases: null and empty texts, and items of fewer than five words, match nothing; repeated rows are judged alike;
items with equal words are all reported; texts and items of any length are judged whole; ties between windows go to the first; null ids pass through; empty tables give
an empty result (no hits).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import Written, arrow_rows, slices
from foliospark.llm.textcore import ALNUM, GOLD, U64, Words, mix, rolling

SHINGLE, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 8, 31
ITEMS, ITEM_BYTES = 2000, 8 << 20
HIT = "array<struct<item_id:bigint,similarity:double,first_word:int,n_words:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of each shingle."""
    halves = np.stack([mix(shingles ^ GOLD), mix(shingles + GOLD)], axis=1)
    return np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    """Eight 16-bit blocks from the sums of the signs."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


_NEAR = np.array([sum(1 << b for b in c) for d in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), d)], np.uint16)


class Index:
    """Items of a benchmark: their shingles, and for every block value the items within 3 bits of it there."""

    def __init__(self, items: list[tuple[int, str]]):
        w = Words(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        shingles = rolling(w.hashes, SHINGLE)
        own = [(i, shingles[a : b - SHINGLE + 1]) for (i, _), a, b in zip(items, w.ptr[:-1], w.ptr[1:], strict=True) if b - a >= SHINGLE]
        self.ids = [i for i, _ in own]
        self.sizes = np.array([len(s) for _, s in own], np.int64)
        self.of_size: dict[int, list[int]] = {}
        for item, size in enumerate(self.sizes.tolist()):
            self.of_size.setdefault(size, []).append(item)
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)), strict=True)) for _, s in own]
        pairs = np.unique(np.array([(s, len(x)) for _, x in own for s in x.tolist()], U64).reshape(-1, 2), axis=0)
        self.shingles, self.widths = pairs[:, 0], pairs[:, 1].astype(np.int64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.shingles & U64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.stack([_prints(_signs(s).sum(0)[None])[0] for _, s in own]) if own else np.zeros((0, BLOCKS), np.uint16)
        self.blocks = []
        for b in range(BLOCKS):
            near = (self.prints[:, b, None] ^ _NEAR).ravel()
            order = np.argsort(near, kind="stable")
            self.blocks.append((np.searchsorted(near[order], np.arange((1 << 16) + 1)), (order // len(_NEAR)).astype(np.int32)))

    def found(self, prints: np.ndarray, size: int) -> list[list[int]]:
        """For each fingerprint of a window with `size` shingles, all items of that size within RADIUS."""
        out = []
        for p in prints:
            near = np.unique(np.concatenate([items[at[v] : at[v + 1]] for (at, items), v in zip(self.blocks, p.astype(np.int64), strict=True)]))
            near = near[self.sizes[near] == size]
            far = np.bitwise_count(self.prints[near] ^ p).sum(1)
            out.append(near[far <= RADIUS].tolist())
        return out

    def hits(self, column: pa.Array) -> list[list[tuple]]:
        w = Words(column, ALNUM, lower=True)
        shingles = rolling(w.hashes, SHINGLE)
        maybe = np.flatnonzero(self.bitmap[(shingles & U64((1 << 20) - 1)).astype(np.int64)])
        maybe = maybe[w.left()[maybe] >= SHINGLE]
        first, last = np.searchsorted(self.shingles, shingles[maybe]), np.searchsorted(self.shingles, shingles[maybe], "right")
        real = np.flatnonzero(last > first)
        owner = np.searchsorted(w.ptr, maybe[real], "right") - 1
        out: list[list[tuple]] = [[] for _ in w.counts]
        for d in np.unique(owner):
            mine = real[owner == d]
            starts, end = w.ptr[d], w.ptr[d + 1] - SHINGLE + 1
            own = shingles[starts:end]
            by_size: dict[int, list[int]] = {}
            for k in mine:
                for size in np.unique(self.widths[first[k] : last[k]]).tolist():
                    by_size.setdefault(size, []).append(int(maybe[k] - starts))
            best: dict[int, tuple] = {}
            for size, places in by_size.items():
                if size > len(own):  # the whole text is the window; no more than `places` of its shingles are an item's
                    if len(places) / (len(own) + size - len(places)) >= THRESHOLD:
                        for item in self.of_size[size]:
                            s = self._similarity(own, item)
                            if s >= THRESHOLD:
                                best[item] = (s, 0, len(own) + SHINGLE - 1)
                    continue
                touched = np.zeros(len(own) + 1, np.int64)
                for p in places:  # windows that hold the shingle at p
                    touched[max(0, p - size + 1)] += 1
                    touched[p + 1] -= 1
                at = np.flatnonzero(np.cumsum(touched)[: len(own) - size + 1])
                for piece in np.array_split(at, len(at) // 4096 + 1):
                    if not len(piece):
                        continue
                    low, high = piece[0], piece[-1] + size
                    # A window of repeated shingles weighs each as often as it occurs.
                    for a, near in zip(piece, self.found(self._window_prints(own, piece, size, low, high), size), strict=True):
                        for item in near:
                            s = self._similarity(own[a : a + size], item)
                            if s >= THRESHOLD and s > best.get(item, (0.0,))[0]:
                                best[item] = (s, int(a), size + SHINGLE - 1)
            out[d] = [(self.ids[i], *best[i]) for i in sorted(best, key=lambda i: (self.ids[i], i))]
        return out

    @staticmethod
    def _window_prints(own, piece, size, low, high) -> np.ndarray:
        if high - low <= 4 * (len(piece) + size):
            sums = np.zeros((high - low + 1, BITS), np.int32)
            np.cumsum(_signs(own[low:high]), axis=0, out=sums[1:])
            return _prints(sums[piece - low + size] - sums[piece - low])
        return np.concatenate([_prints(_signs(own[a : a + size]).sum(0)[None]) for a in piece])

    def _similarity(self, window: np.ndarray, item: int) -> float:
        mine = dict(zip(*(x.tolist() for x in np.unique(window, return_counts=True)), strict=True))
        theirs = self.counts[item]
        both = sum(min(n, theirs.get(s, 0)) for s, n in mine.items())
        return both / (len(window) + int(self.sizes[item]) - both)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", to: str = "leaks") -> DataFrame:
    """`docs` with the column `to`: the items found in each text, with their best window. It replaces one of that name."""
    spark = docs.sparkSession
    arrow_rows(spark)
    names = [c for c in docs.columns if c != to]
    out = docs.select(*[f"`{c}`" for c in names]).withColumn(to, F.array().cast(HIT))
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != to], T.StructField(to, T._parse_datatype_string(HIT))])

    def with_block(df: DataFrame, held: list[tuple[int, str]]):
        sent = spark.sparkContext.broadcast(held)  # ITEMS texts of ITEM_BYTES, or one longer text

        def run(batches):
            index = Index(sent.value)
            for batch in batches:
                for part in slices(batch, text):
                    new = [a + [dict(zip(("item_id", "similarity", "first_word", "n_words"), h, strict=True)) for h in b] for a, b in zip(part.column(to).to_pylist(), index.hits(part.column(text)), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(new, _HIT)], names=[*names, to])

        return df.mapInArrow(run, schema), sent

    block: list[tuple[int, str]] = []
    size, before = 0, None
    for row in items.toLocalIterator():  # a block at a time, never the whole benchmark
        if block and (len(block) == ITEMS or size + len(row.text) > ITEM_BYTES):
            found, sent = with_block(out, block)
            done = Written(found, "leaks")
            sent.destroy()
            if before is not None:
                before.drop()
            out, before, block, size = done.df, done, [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    return with_block(out, block)[0] if block else out


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("size(leaks) > 0").select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
