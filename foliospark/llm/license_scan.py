"""License scans by diagonal voting, beside an exact scan for three base phrases.

Words are runs of digits, letters and everything above 0x7F, lower-cased (A-Z). All rolling three-word hashes of every
text are joined to the places of the templates' three-word hashes. A hit votes for its diagonal, the difference of its
places in the text and the template: on one diagonal lie copies without insertions. Votes are counted by (document,
template, diagonal), and neighbouring diagonals merge into a run. A run whose hits could cover COVERED of the template's
words is verified: from each diagonal on, the hits whose diagonals differ by no more than the
template's slack (words inserted or left out in total: a fifth of its length, two at least) are aligned to the template in
order, so as to cover the most words of the template, and these must reach COVERED. Spans of a template don't overlap. A template of fewer than three words isn't allowed.

A hit is equality of a 64-bit hash; that the 4 * n / 5 words of a span are not the template's would take several chance
collisions at once. The template table is broadcast up to MOST places (checked); larger ones meet the texts in a shuffled
join, with the same result. Votes are summed before they are shuffled.

Defined cases: null and empty texts have no words, labels or hits (empty strings, score 0); texts of any length are
scanned whole; repeated rows are scanned alike and each returned; of overlapping spans the best stays, of equals the first; null ids pass through; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.license_texts import TEMPLATES
from foliospark.llm.shared import arrow_rows, slices
from foliospark.llm.textcore import ALNUM, Words, rolling

BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
K, COVERED, MOST = 3, 0.8, 100_000


def _words(text: str) -> np.ndarray:
    return Words(pa.array([text], pa.string()), ALNUM, lower=True).hashes


def slack(length: int) -> int:
    return max(2, length // 5)


def aligned(hits: list[tuple[int, int]], length: int) -> tuple[int, int, int]:
    """(words covered, first word, last word excluded) of the best chain of hits (place in the text, place in the template)
    that grows in both; a hit covers K words of the template."""
    best = [(0, 0)] * (length + K)  # by K + place in the template of a chain's last hit: words covered, minus the first word
    top = (0, 0, 0)
    for at, place in hits:  # by place in the text, and there from the template's end on
        mine = max([(K, -at), *((c + min(K, place - p + K), first) for p, (c, first) in enumerate(best[: place + K]) if c)])
        best[place + K] = max(best[place + K], mine)
        top = max(top, (mine[0], mine[1], -at - K))
    return top[0], -top[1], -top[2]


def spans_of(votes: list[tuple[int, list[int]]], length: int) -> list[tuple[int, int, float]]:
    """(first word, last word excluded, share) of the verified spans among (diagonal, places in the template)."""
    votes, need = sorted(votes), COVERED * length
    diagonals = [d for d, _ in votes]
    fit = []
    for n, diagonal in enumerate(diagonals):
        near = votes[n : bisect_right(diagonals, diagonal + slack(length))]
        if len({p + i for _, places in near for p in places for i in range(K)}) >= need:
            words, first, last = aligned(sorted(((d + p, p) for d, places in near for p in places), key=lambda h: (h[0], -h[1])), length)
            if words >= need:
                fit.append((-words, first, last))
    found: list[tuple[int, int, float]] = []
    for words, first, last in sorted(fit):
        if all(last <= a or b <= first for a, b, _ in found):
            found.append((first, last, -words / length))
    return sorted(found)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row."""
    spark = docs.sparkSession
    arrow_rows(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    phrases = [(_words(p), label) for p, label in BASE]

    def base(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, lower=True)
                left, n = w.left(), len(w.starts)
                found = []
                for words, label in phrases:
                    at = np.flatnonzero((w.hashes == words[0]) & (left >= len(words)))
                    for i in range(1, len(words)):
                        at = at[w.hashes[np.minimum(at + i, n - 1)] == words[i]]
                    found.append((np.searchsorted(w.ptr, at, "right") - 1, at, label))
                lists: list[list[int]] = [[] for _ in w.counts]
                labels: list[set[str]] = [set() for _ in w.counts]
                for owners, at, label in found:
                    for d, a in zip(owners.tolist(), (at - w.ptr[owners]).tolist(), strict=True):
                        lists[d].append(a)
                        labels[d].add(label)
                columns = [
                    pa.array(w.counts, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array([min(x, default=None) for x in lists], pa.int64()),
                    pa.array([max(x, default=None) for x in lists], pa.int64()), pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *columns], names=["doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base"])

    def grams(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"), ALNUM, lower=True)
                hashes = rolling(w.hashes, K).view(np.int64)
                lengths = np.maximum(w.counts - (K - 1), 0)
                valid = w.left()[: len(hashes)] >= K
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(hashes[valid]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), lists], names=["doc_id", "key", "grams"])

    places = []
    for t, (label, text) in enumerate(templates):
        words = _words(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        places += [(int(h), t, label, i, len(words)) for i, h in enumerate(rolling(words, K).view(np.int64))]
    table = spark.createDataFrame(places, "gram long, template int, label string, place int, length int")
    rows = source.mapInArrow(grams, "doc_id long, key long, grams array<bigint>").select("doc_id", "key", F.posexplode("grams").alias("at", "gram"))
    hits = rows.join(F.broadcast(table) if len(places) <= MOST else table.hint("merge"), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    # Distinct places of the template are few; where they lie in the text is known from the diagonal.
    voted = hits.groupBy("doc_id", "key", "template", "label", "length", "diagonal").agg(F.collect_set("place").alias("places"))
    by = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    room = F.greatest(F.lit(2), F.floor(F.col("length") / 5))
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= room, 0).otherwise(1)
    runs = voted.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    merged = runs.groupBy("doc_id", "key", "template", "label", "length", "run").agg(F.collect_list(F.struct("diagonal", "places")).alias("votes"))
    places_ = F.array_distinct(F.flatten(F.transform("votes", lambda v: v.places)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(places_, lambda p: F.sequence(p, p + (K - 1))))))
    maybe = merged.filter(covered >= COVERED * F.col("length")).select("doc_id", "key", "label", "length", "votes")

    def verify(batches):
        for batch in batches:
            rows = []
            for doc, key, label, length, votes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "label", "length", "votes")), strict=True):
                rows += [(doc, key, label, *span) for span in spans_of([(v["diagonal"], v["places"]) for v in votes], length)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "key", "label", "first", "last", "share"])

    spans = maybe.mapInArrow(verify, "doc_id long, key long, label string, first long, last long, share double")
    listed = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("label", "first", "last", "share"))).alias("spans"))
    heads = source.mapInArrow(base, "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")
    both = heads.alias("h").join(listed.alias("l"), F.expr("h.doc_id <=> l.doc_id and h.key = l.key"), "left").select("h.*", F.coalesce("spans", F.expr("cast(array() as array<struct<label:string,first:bigint,last:bigint,share:double>>)")).alias("spans"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s.label))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
