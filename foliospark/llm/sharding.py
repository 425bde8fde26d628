"""Sharding by a K-d tree over document metadata, under the law `bytes`: shards of near equal size.

A document is a point in what is known of its text: its size, its characters per byte (which tells scripts apart) and its
lines per byte (which tells prose from lists). A node that has to become n shards is split at the weighted median (by bytes; at the share floor(n / 2) / n) along
its widest dimension, as a share of the whole table's extent, until every leaf is one shard, so leaves reach the target
of total bytes / shards. Medians are found in distributed histograms of BINS bins, narrowed until a bin outweighs EVEN of
a side no more; the driver holds the bins of the nodes of one level, whatever the table's size.

Ties of a coordinate are broken by the text's CRC-32, which adds nothing to its extent; so equal texts share every coordinate
and stay together. Where one group of equal texts straddles the median, the split moves to its nearer edge if that shifts at most
EVEN of a side, else the node's next widest dimension is tried; only if all fail is the group itself divided, by a hash
of doc_id, so a group that holds a third of all bytes doesn't unbalance the shards.

Texts are read once, for their metadata; only that is written and shuffled.

Defined cases: a null text has no bytes (size 1) and CRC 0; texts of any length are one row; null ids hash alike; repeated rows are rows of their own;
if fewer distinct points than shards exist some shards stay empty; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.shared import Written

SHARDS, BINS, EVEN = 8, 4096, 0.01
#: Rows of one rank group at most, about.
RANKED = 1 << 20
#: Each dimension's value; its key is that and the text's CRC-32.
DIMENSIONS = ("size", "density", "lines")


def _key(dim: str) -> Column:
    return F.expr(f"{dim} * 4294967296 + text_crc32")


@dataclass
class Node:
    """Rows with bits of `path`; it becomes `shards` shards, the first of them `base`."""

    path: str
    base: int
    shards: int
    dims: list[str] = field(default_factory=list)
    cut: tuple | None = None  # (dimension, coordinate, hash of the id): rows up to it go left


def metadata(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    bytes_ = F.octet_length(raw).cast("long")
    density = F.when(bytes_ > 0, F.floor(F.length("text").cast("long") * 65535 / bytes_)).otherwise(0).cast("long")
    breaks = F.length("text") - F.length(F.translate(F.col("text").cast("string"), "\n", ""))
    lines = F.when(bytes_ > 0, F.floor(breaks.cast("long") * 65535 / bytes_)).otherwise(0).cast("long")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bytes_ + 1).alias("size"), F.crc32(raw).alias("text_crc32"), density.alias("density"), lines.alias("lines"))
    return out.withColumn("id_hash", F.shiftrightunsigned(F.xxhash64("doc_id"), 2))


def _left(cut: tuple) -> Column:
    dim, at, sub = cut
    key = _key(dim)
    return (key < at) | ((key == at) & (F.col("id_hash") <= sub))


def _node_path(done: list[Node]) -> Column:
    """The path of the node a row is in: one expression over the cuts so far, of which there are fewer than shards."""
    by_path = {n.path: n for n in done if n.cut}

    def walk(path: str) -> Column:
        if path not in by_path:
            return F.lit(path)
        return F.when(_left(by_path[path].cut), walk(path + "0")).otherwise(walk(path + "1"))

    return walk("")


@dataclass
class Search:
    """A median being narrowed: the answer lies in [low, high] of the key; `before` bytes lie under low."""

    node: Node
    dim: str
    total: int
    low: int
    high: int
    before: int = 0
    within: int | None = None  # set: the coordinate whose group is being divided by id_hash

    @property
    def want(self) -> float:
        return self.total * (self.node.shards // 2) / self.node.shards

    @property
    def slack(self) -> float:
        return EVEN * min(self.want, self.total - self.want)


def _histograms(rows: DataFrame, searches: list[Search]) -> list[dict[int, int]]:
    """For each search the bytes of its bins; BINS rows for each come to the driver."""
    out: list[dict[int, int]] = [{} for _ in searches]
    if not searches:
        return out
    picked = F.lit(None)
    for i, s in enumerate(searches):
        key = F.col("id_hash") if s.within is not None else _key(s.dim)
        inside = (F.col("node") == s.node.path) & key.between(s.low, s.high)
        if s.within is not None:
            inside &= _key(s.dim) == s.within
        width = (s.high - s.low) // BINS + 1
        offset = key - F.lit(s.low)
        picked = F.when(inside, F.struct(F.lit(i).alias("i"), F.call_function("div", offset, F.lit(width)).alias("bin"))).otherwise(picked)
    bins = rows.select(picked.alias("b"), "size").filter("b is not null").groupBy("b").agg(F.sum("size").alias("bytes"))
    for r in bins.collect():
        out[r.b.i][r.b.bin] = r.bytes
    return out


def _narrow(s: Search, bins: dict[int, int]) -> tuple[str, object]:
    """("cut", (key, bytes to the left)), ("group", key) or ("on", a narrower search)."""
    width = (s.high - s.low) // BINS + 1
    at = s.before
    for b in sorted(bins):
        first, last = s.low + b * width, min(s.high, s.low + (b + 1) * width - 1)
        if at + bins[b] >= s.want:
            under, over = s.want - at, at + bins[b] - s.want
            if min(under, over) <= s.slack / 8 or (width == 1 and min(under, over) <= s.slack):
                return "cut", (last if over <= under else first - 1)
            if width == 1:
                return "group", (first, at, bins[b])
            return "on", Search(s.node, s.dim, s.total, first, last, at, s.within)
        at += bins[b]
    return "cut", s.high


def kd_tree(rows: DataFrame, shards: int) -> list[Node]:
    """The cuts of the tree over written metadata."""
    done: list[Node] = []
    level = [Node("", 0, shards)] if shards > 1 else []
    extents: dict[str, int] = {}
    while level:
        here = rows.withColumn("node", _node_path(done)).filter(F.col("node").isin([n.path for n in level]))
        stats = [F.sum("size").alias("total")] + [f(_key(d)).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
        found = {r.node: r for r in here.groupBy("node").agg(*stats).collect()}  # a row for each node of the level
        if not done and "" in found:
            extents = {d: max(1, (found[""][f"high_{d}"] >> 32) - (found[""][f"low_{d}"] >> 32)) for d in DIMENSIONS}
        searches = []
        for n in level:
            if r := found.get(n.path):
                span = lambda d: ((r[f"high_{d}"] >> 32) - (r[f"low_{d}"] >> 32)) / extents[d]  # noqa: B023, E731
                n.dims = sorted(DIMENSIONS, key=span, reverse=True)
                searches.append(Search(n, n.dims[0], r.total, r[f"low_{n.dims[0]}"], r[f"high_{n.dims[0]}"]))
        groups: dict[str, list] = {}
        while searches:
            on = []
            for s, bins in zip(searches, _histograms(here, searches), strict=True):
                what, value = _narrow(s, bins)
                if what == "on":
                    on.append(value)
                elif s.within is not None:
                    s.node.cut = (s.dim, s.within, value if what == "cut" else value[0])
                elif what == "cut":
                    s.node.cut = (s.dim, value, (1 << 62) - 1)
                else:
                    key, before, size = value
                    groups.setdefault(s.node.path, []).append((s, key, before))
                    rest = s.node.dims[s.node.dims.index(s.dim) + 1 :]
                    r = found[s.node.path]
                    if rest:
                        on.append(Search(s.node, rest[0], s.total, r[f"low_{rest[0]}"], r[f"high_{rest[0]}"]))
                    else:  # the widest dimension's group is divided
                        first, key, before = groups[s.node.path][0]
                        on.append(Search(s.node, first.dim, s.total, 0, (1 << 62) - 1, before, key))
            searches = on
        done += level
        level = [m for n in level if n.cut for m in (Node(n.path + "0", n.base, n.shards // 2), Node(n.path + "1", n.base + n.shards // 2, n.shards - n.shards // 2)) if m.shards > 1]
    return done


def _shard(done: list[Node], shards: int) -> Column:
    by_path = {n.path: n for n in done if n.cut}

    def walk(path: str, base: int, n: int) -> Column:
        if path not in by_path:
            return F.lit(base)
        return F.when(_left(by_path[path].cut), walk(path + "0", base, n // 2)).otherwise(walk(path + "1", base + n // 2, n - n // 2))

    return walk("", 0, shards)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard (int), slot (gapless from 0 in the shard) for each row of (doc_id, text)."""
    rows = Written(metadata(docs), "metadata").df
    dealt = rows.select("doc_id", "size", "text_crc32", _shard(kd_tree(rows, shards), shards).cast("int").alias("shard"), F.monotonically_increasing_id().alias("row"))
    dealt = Written(dealt, "dealt").df
    salts = dealt.count() // RANKED // shards + 16
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("row")) - 1
    out = salted.withColumn("within", within).join(firsts, ["shard", "salt"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("within") + F.col("first")).alias("slot"))


def op5_kd_tree_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
