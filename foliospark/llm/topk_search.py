"""Exact top-k inner-product search by a three-phase uniform threshold.

Rows are packed into chunks, dealt to groups (the nodes); queries are packed into blocks of BYTES at most. Every
block meets every chunk of its dimension: blocks are copied to all groups and joined on the group, so a task streams pairs
of a block and a chunk and holds one of each; nothing is broadcast and the driver sees counts only. A score is the sum of
two local scores, of the first three quarters of the components and of the rest.

1. Each group gathers a local list: of one of its chunks, the k rows of each query with the best first local scores, whose
   scores are then summed in full. The k-th best of all groups' lists is a safe cutoff: k rows reach it.
2. The cutoffs go to all groups with the blocks. All rows' first local scores are computed; the rest of a score is at most
   the product of the norms of the remaining components, so where this can't reach the cutoff the row is left out, and its
   remaining components aren't looked at.
3. The rest of what is left is resolved exactly; of the rows that reach the cutoff, a task returns the k best of each query
   (ties may be many more), and of these the k best stay.

Components become floor(256 * x), sums are exact: in double precision below 2 ** 53, in 64-bit integers above, in Python's
integers where a product might not fit these; rows so large are packed apart and not pruned.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without id, take no part;
rows that share an id or a vector are rows of their own, a query's candidates are all rows but itself; vectors of any
length meet vectors of their own length only; ties go to the smaller id; fewer than k candidates give all of them; an
answer whose score doesn't fit a long raises an error, as in the SQL twin; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.shared import Written, arrow_rows

#: Of a chunk or block, about.
BYTES = 1 << 20
#: Queries of a block that are scored at once.
STEP = 128
#: Rows with 256 * x of this or more are packed apart.
LARGE = 2.0**24
LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of the rows that take part."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return whole.filter("vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


class Vectors:
    """Vectors of one length: row numbers, ids and quantised components, in the exact type that is smallest."""

    def __init__(self, data: bytes, dim: int):
        n = len(data) // (8 * dim + 16)
        self.rows, self.ids = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n)
        raw = np.frombuffer(data, np.float64, n * dim, 16 * n).reshape(n, dim)
        self.most = 256 * float(np.abs(raw).max(initial=0))
        if self.most < 2**53:
            self.v = np.floor(256 * raw)
        else:  # 256 * x may be infinite, so a large x, which is whole, is multiplied as an integer
            whole = lambda x: int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x)
            self.v = np.array([[whole(x) for x in row] for row in raw.tolist()], object).reshape(n, dim)
        self.head = max(1, 3 * dim // 4)
        self.rest = np.sqrt((self.v[:, self.head :].astype(np.float64) ** 2).sum(1)) if self.most < LARGE else None

    @staticmethod
    def packed(rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> bytes:
        return rows.astype(np.int64).tobytes() + ids.astype(np.int64).tobytes() + matrix.astype(np.float64).tobytes()


def _exact(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All scores, and where they don't fit a long (1 above, -1 below; the score is its end then)."""
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    s = whole(q) @ whole(rows).T
    over = np.sign((s > LONG.max).astype(np.int64) - (s < LONG.min).astype(np.int64))
    return np.where(over > 0, LONG.max, np.where(over < 0, LONG.min, s)).astype(np.int64), over


class Best:
    """The k best entries so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.over, self.ids = np.full((n, k), LONG.min), np.full((n, k), -2), np.full((n, k), LONG.max)

    def add(self, query: np.ndarray, score: np.ndarray, over: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -over, ~score, query))
        query, score, over, ids = query[order], score[order], over[order], ids[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        few = place < self.k
        whose, row = np.unique(query[few], return_inverse=True)
        new = [np.full((len(whose), self.k), x) for x in (LONG.min, -2, LONG.max)]
        for table, x in zip(new, (score, over, ids), strict=True):
            table[row, place[few]] = x[few]
        s, o, i = (np.concatenate([old[whose], x], axis=1) for old, x in zip((self.score, self.over, self.ids), new, strict=True))
        top = np.lexsort((i, -o, ~s), axis=1)[:, : self.k]
        self.score[whose], self.over[whose], self.ids[whose] = (np.take_along_axis(x, top, 1) for x in (s, o, i))

    def entries(self, block: int, query_ids: np.ndarray) -> pa.RecordBatch:
        q, r = np.nonzero(self.over > -2)
        columns = [np.full(len(q), block), q, query_ids[q], self.ids[q, r], self.score[q, r], self.over[q, r]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "i", "query_id", "vec_id", "score", "over"])


_ENTRIES = "block long, i long, query_id long, vec_id long, score long, over long"


def score_pair(q: Vectors, c: Vectors, best: Best, cutoff: np.ndarray | None) -> None:
    """Adds to `best` what a block's queries find in a chunk: all that may be answers under the cutoffs, or without these
    the k rows with the best first local scores."""
    k, d = best.k, q.v.shape[1]
    for at in range(0, len(q.ids), STEP):
        mine = np.arange(at, min(at + STEP, len(q.ids)))
        other = q.rows[mine][:, None] != c.rows
        if q.rest is None or c.rest is None or (q.most + 1) * (c.most + 1) * d >= 2**53:
            if (q.most + 1) * (c.most + 1) * d < 2**62:
                s = q.v[mine].astype(np.int64) @ c.v.astype(np.int64).T
                over = np.zeros_like(s)
            else:
                s, over = _exact(q.v[mine], c.v)
            a, b = np.nonzero(other)
            best.add(mine[a], s[a, b], over[a, b], c.ids[b])
            continue
        part = q.v[mine, : q.head] @ c.v[:, : c.head].T
        if cutoff is None:
            part[~other] = -np.inf
            few = min(k, len(c.ids))
            b = np.argpartition(part, len(c.ids) - few, axis=1)[:, len(c.ids) - few :].ravel()
            a = np.repeat(np.arange(len(mine)), few)
            able = other[a, b]
        else:
            least = np.maximum(cutoff[mine], np.where(best.over[mine, -1] == 0, best.score[mine, -1], LONG.min)).astype(np.float64)
            a, b = np.nonzero(part + (q.rest[mine][:, None] * c.rest) * (1 + 1e-9) + 1 >= least[:, None])
            able = other[a, b]
        a, b = a[able], b[able]
        s = part[a, b] + np.einsum("ij,ij->i", q.v[mine[a], q.head :], c.v[b, c.head :])
        if cutoff is not None:
            real = s >= least[a]
            a, b, s = a[real], b[real], s[real]
        if len(a):
            best.add(mine[a], s.astype(np.int64), np.zeros(len(a), np.int64), c.ids[b])


def search(vectors: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row that is a query."""
    spark = vectors.sparkSession
    arrow_rows(spark)
    table = Written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, bool], list[list]] = {}

        def packed(dim: int, large: bool, parts: list[list]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            data = Vectors.packed(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["dim", "number", "data"])

        for batch in batches:
            flat = batch.column("e").flatten().to_numpy(zero_copy_only=False)
            dims = np.diff(np.append(batch.column("e").offsets.to_numpy()[:-1], batch.column("e").offsets.to_numpy()[-1]))
            ends = np.cumsum(dims)
            rows, ids = (batch.column(c).to_numpy() for c in ("row", "vec_id"))
            big = 256 * np.maximum.reduceat(np.abs(flat), ends - dims) >= LARGE if len(dims) else dims > 0
            for dim in np.unique(dims).tolist():
                for large in (False, True):
                    own = np.flatnonzero((dims == dim) & (big == large))
                    most = max(1, BYTES // (8 * dim + 16))
                    for piece in np.array_split(own, -(-len(own) // most)) if len(own) else ():
                        parts = held.setdefault((dim, large), [])
                        parts.append([rows[piece], ids[piece], flat[(ends[piece] - dim)[:, None] + np.arange(dim)]])
                        if sum(len(p[0]) for p in parts) >= most:
                            yield packed(dim, large, held.pop((dim, large)))
        for (dim, large), parts in held.items():
            yield packed(dim, large, parts)

    packs = "dim long, number long, data binary"
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = Written(table.df.mapInArrow(pack, packs), "chunks")
    blocks = Written(table.df.filter(is_query).mapInArrow(pack, packs).withColumnRenamed("number", "block"), "blocks")
    place = Window.partitionBy("dim").orderBy("number")  # a chunk is one row of a MB, so this sorts small keys only
    dealt = chunks.df.select("dim", "number", (F.row_number().over(place) - 1).alias("turn")).select("dim", "number", F.expr(f"turn % {groups}").alias("node"), (F.col("turn") < groups).alias("lists"))
    dealt = Written(dealt, "dealt")
    to_all = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("node")

    def met(asking: DataFrame, meeting: DataFrame, cutoffs: bool) -> DataFrame:
        def run(batches):
            now, best, q = None, None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    block, dim = batch.column("block")[i].as_py(), batch.column("dim")[i].as_py()
                    if block != now:
                        if best is not None:
                            yield best.entries(now, q.ids)
                        q = Vectors(batch.column("data")[i].as_buffer(), dim)
                        now, best, cutoff = block, Best(len(q.ids), k), None
                        if cutoffs:
                            cutoff = np.full(len(q.ids), LONG.min)
                            for x in batch.column("cuts")[i].as_py() or ():
                                cutoff[x["i"]] = x["cutoff"]
                    score_pair(q, Vectors(batch.column("chunk")[i].as_buffer(), dim), best, cutoff)
            if best is not None:
                yield best.entries(now, q.ids)

        held = meeting.join(chunks.df.withColumnRenamed("data", "chunk"), ["dim", "number"]).drop("number")
        pairs = asking.select("*", to_all).join(held.hint("merge"), ["dim", "node"])
        return pairs.select("block", "dim", "data", *(["cuts"] if cutoffs else []), "chunk").mapInArrow(run, _ENTRIES)

    order = Window.partitionBy("block", "i").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    lists = met(blocks.df, dealt.df.filter("lists").drop("lists"), False).withColumn("rank", F.row_number().over(order))
    cuts = lists.filter((F.col("rank") == k) & (F.col("over") == 0)).groupBy("block").agg(F.collect_list(F.struct("i", F.col("score").alias("cutoff"))).alias("cuts"))
    asking = Written(blocks.df.join(cuts.hint("merge"), "block", "left"), "asking")
    found = met(asking.df, dealt.df.drop("lists"), True).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.expr("if(over = 0, score, raise_error('the score of an answer doesn''t fit a long'))").cast("long")
    out = found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
    table.drop()
    blocks.drop()
    return out


def op9_exact_top_k_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS q, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.v) = len(q.v)),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
