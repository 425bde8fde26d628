"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits (lower-cased A-Z) and runs of other visible characters; a word that repeats its
predecessor counts as one special word. Features are the counts of hashed unigrams and bigrams, scaled to length SCALE.
FTRL-proximal updates run over the training rows one by one, in an order fixed by a hash of the id. Scores are sparse
dot products of whole texts with the weights.

The training set is a bounded sample, as a parameter: the SAMPLE labelled rows with the smallest id hashes. So one task
can train, with bounded memory, whatever the corpus holds. Every document is scored.

Defined cases: null and empty texts score by the bias alone; texts of any length are scored whole; ties in the order of training go by id and label; null labels and null ids do not train; of rows that share
an id one trains, the first by its features; repeated rows score alike; without any training row every score is 0.5 (predicted 1); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import arrow_rows, slices
from foliospark.llm.textcore import PIECES, U64, Words, mix, rolling

SAMPLE = 12_000
BUCKETS = 1 << 18
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 3, 1.0, 0.1, 0.02, 0.02, 4.0
_REPEATED = U64(0x5851F42D4C957F2D)


def features_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: buckets and values of all texts, and how many of them each text has."""
    w = Words(column, PIECES, lower=True)
    t, left = w.hashes.copy(), w.left()
    again = np.zeros(len(t), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (left[1:] < left[:-1])
    t[again] = _REPEATED
    ones, two = mix(t), np.flatnonzero(left >= 2)
    pairs = rolling(t, 2)[two]
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    keys, docs = np.concatenate([ones, pairs]) % U64(BUCKETS - 1) + U64(1), np.concatenate([owner, owner[two]])
    cells, counts = np.unique(docs.astype(U64) * U64(BUCKETS) + keys, return_counts=True)
    docs, keys = (cells // U64(BUCKETS)).astype(np.int64), (cells % U64(BUCKETS)).astype(np.int64)
    lengths = np.sqrt(np.bincount(docs, counts.astype(np.float64) ** 2, len(w.counts)))
    return keys, SCALE * counts / lengths[docs], np.bincount(docs, minlength=len(w.counts))


def train_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by bucket from (label, buckets, values); bucket 0 is the bias."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for label, i, x in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            n_new = n[i] + g * g
            z[i] += g - (np.sqrt(n_new) - np.sqrt(n[i])) / ALPHA * w
            n[i] = n_new
    return weights(np.arange(BUCKETS)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from labelled rows (doc_id, quality) whose crc32 of the id as text, mod 3, is not 1."""
    spark = docs.sparkSession
    arrow_rows(spark)
    allowed = labels.filter("quality in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    order = F.xxhash64("doc_id")
    chosen = allowed.select("doc_id", F.col("quality").cast("int").alias("quality"), order.alias("order_")).orderBy("order_", "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, values, counts = features_of(part.column("text"))
                keys, values, ends = keys.astype("<i4"), values.astype("<f4"), np.cumsum(counts)
                packed = [(keys[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("order_"), part.column("quality"), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], names=["order_", "quality", "i", "x"])

    def train(batches):
        rows = []
        for batch in batches:
            for label, i, x in zip(*(batch.column(c).to_pylist() for c in ("quality", "i", "x")), strict=True):
                rows.append((label, np.append(np.frombuffer(i, "<i4"), 0), np.append(np.frombuffer(x, "<f4"), np.float32(1))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([train_ftrl(rows).tobytes()], pa.binary())], names=["w"])

    found = texts.mapInArrow(features, "order_ long, quality int, i binary, x binary")
    each = found.groupBy("order_", "quality").agg(F.min(F.struct("i", "x")).alias("f")).select("order_", "quality", "f.i", "f.x")  # `sample` rows at most
    one = each.repartition(1).sortWithinPartitions("order_", "quality")
    got = next(iter(one.mapInArrow(train, "w binary").collect()), None)  # one row of 1 MB
    return np.frombuffer(got.w, np.float32) if got else np.zeros(BUCKETS, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted`; these replace input columns of the same name."""
    spark = docs.sparkSession
    arrow_rows(spark)
    sent = spark.sparkContext.broadcast(weights)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]

    def run(batches):
        w = sent.value.astype(np.float64)
        for batch in batches:
            for part in slices(batch, "text"):
                keys, values, counts = features_of(part.column("text"))
                docs = np.repeat(np.arange(len(counts)), counts)
                s = w[0] + np.bincount(docs, w[keys] * values, len(counts))
                p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names + ["score", "predicted"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", "predicted")
