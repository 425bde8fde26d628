"""MinHash near-dedup with SuperMinHash signatures, banding, verification on full sets, and union-find grouping.

A document's set holds its distinct word shingles (64-bit hashes); a shorter text's whole sequence is one shingle.
Documents with equal sets form one class at once and go on as one, so groups of copies cost a row. SuperMinHash gives
each shingle one random permutation of the signature's slots, walked step by step; the walk ends early, once no slot can
still fall. Bands of the signature name buckets; in a bucket, members are paired with one of them, first the one of the
smallest id, not with each other. Pairs are confirmed on full sets and grouped, and buckets that span several groups are
paired with other members, STARS times in all. Then the members of buckets that
still span several groups meet in an exact join: a set's partner shares one of its rarest shingles (a prefix in the order
of how many of these sets hold a shingle, as long as the threshold asks), so sets of different groups that share such a
shingle are paired and confirmed, and no link whose ends both miss a bucket's centres is lost. Large groups of copies
that differ too much from each other have rare shingles enough, and make few pairs. With 20 bands of 4, a pair at
similarity 0.85 shares no bucket with probability 4e-7, one at 0.8 with 3e-5.

A set's shingles are 64-bit hashes that nothing is known to collide in; that any two of the n shingles of two documents do
so by chance has odds of n * n / 2**65, for 20,000 words each 4e-11.

Hot keys: of a document that is paired with many, as the smallest of a large bucket, the full set goes to one task for each
FAN of its pairs; a shingle that many sets hold among their rarest is salted alike; the classes of over a 2000th of all
rows are broadcast to their rows, and there are fewer than 2000 of these.

Grouping is union-find over bounded parts of the edges, then alternating large-star and small-star steps over
written tables until nothing changes; the driver sees counts only.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; texts of any length have their full
set; a row without id isn't linked, its component is null and it is kept; repeated rows and ties are equal sets; rows that
share an id but not their set are documents of their own, each in its set's group (`text_key` tells them apart); an empty
table gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.shared import Written, arrow_rows, join_hot, slices
from foliospark.llm.textcore import GOLD, U64, Words, ladder, mix

BANDS, ROWS = 20, 4
#: How often the members of a bucket that spans several groups are paired with one of them.
STARS = 2
#: Rows of one key that meet in one task, about.
FAN = 512
#: Nodes that a union-find holds before it hands on what it knows.
UNION = 1 << 20


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text."""
    w = Words(column, lower=True)
    rungs = ladder(w.hashes, list(range(1, size + 1)))
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
        k = min(size, b - a)
        yield np.unique(rungs[k][a : b - k + 1]) if k else np.zeros(0, U64)


def super_min_hash(shingles: np.ndarray, m: int) -> np.ndarray:
    """m slots; each holds the step in its high bits and 40 random bits below."""
    out = np.full(m, m << 40, U64)
    steps = np.arange(m, dtype=np.uint16)
    for low in range(0, len(shingles), 1 << 14):
        part = shingles[low : low + (1 << 14)]
        rows = np.arange(len(part))
        order = np.tile(steps, (len(part), 1))
        for j in range(m):
            if j > int(out.max() >> U64(40)):
                break
            u = mix(part + U64((j + 1) * int(GOLD) & (1 << 64) - 1))
            k = j + (u >> U64(40)).astype(np.int64) % (m - j)
            slot = order[rows, k]
            order[rows, k] = order[:, j]
            np.minimum.at(out, slot, U64(j << 40) | (u & U64((1 << 40) - 1)))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = mix(np.arange(1, bands + 1, dtype=U64) * GOLD)
    for column in signature.reshape(bands, rows).T:
        keys = mix(keys ^ column)
    return keys.view(np.int64)


def _union(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest of its group) for every node that isn't that itself."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in parent]


def components(edges: DataFrame) -> Written:
    """(node, component) for every node of the edges (a, b) that isn't the smallest of its component."""

    def local(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            pairs = _union(*(np.concatenate(p) for p in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= UNION:
                yield merged()
        if held:
            yield merged()

    now = Written(edges.filter("a <> b").select("a", "b").mapInArrow(local, "a long, b long"), "edges")
    before = None
    while True:
        e = now.df
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = Written(small, "edges")
        now.drop()
        now = after
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            now.df = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return now
        before = mark


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for each row of (doc_id, text). Linked: intersection / union >=
    threshold. text_key: xxhash64 of the text."""
    arrow_rows(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))
    num, den = threshold

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), shingle))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                banded = [band_keys(super_min_hash(s, bands * rows), bands, rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    signed = Written(source.mapInArrow(sign, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<bigint>"), "signed")
    linkable = signed.df.filter("n_shingles > 0 and doc_id is not null")
    # A class is a node; its numbers say nothing, so rows that share an id do no harm. One of its rows stands for its text.
    one = linkable.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    classes = Written(one.select(F.monotonically_increasing_id().alias("node"), "set_key", "row.doc_id", "row.text_key", "n", "bands", "rows"), "classes")
    banded = Written(classes.df.select("node", "doc_id", "n", F.explode("bands").alias("band")), "bands")
    members, entries = banded.df, banded.df.count()
    written = [signed, classes, banded]

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text) of some nodes, once each; the join and the grouping are one shuffle of these texts."""
        rows = classes.df.join(nodes, "node").select("node", "doc_id", "text_key")
        found = source.join(rows.hint("merge"), ["doc_id", "text_key"]).groupBy("doc_id", "text_key", "node").agg(F.first("text").alias("text"))
        return found.select("node", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of a written table that are links."""

        def full(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), shingle)], pa.binary())], names=["node", "set_"])

        ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = Written(texts_of(ids).mapInArrow(full, "node long, set_ binary"), "sets")
        written.append(sets)
        fans = pairs.groupBy("a").agg(F.count("*").alias("n_")).withColumn("salts", F.expr(f"cast(ceil(n_ / {FAN}) as int)"))
        salted = join_hot(pairs, fans, ["a"], pairs.count()).select("a", "b", F.expr("cast(pmod(xxhash64(b), salts) as int)").alias("salt"))
        with_b = salted.join(sets.df.select(F.col("node").alias("b"), F.col("set_").alias("y")), "b")
        centres = sets.df.join(fans.select(F.col("a").alias("node"), "salts"), "node").select(F.col("node").alias("a"), F.col("set_").alias("x"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
        with_both = with_b.join(centres, ["a", "salt"])

        def confirm(batches):
            for batch in batches:
                yes = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                    x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                    if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        yes[i] = den * both >= num * (len(x) + len(y) - both)
                yield batch.select(["a", "b"]).filter(pa.array(yes))

        return with_both.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")

    def mixed(grouped: DataFrame, centre) -> DataFrame:
        """Members of buckets that span several components, with the bucket's centre and that one's component."""
        of = grouped.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_"), F.min_by(F.struct("node", "component"), centre).alias("centre"))
        return join_hot(grouped, of.filter("low < high").select("band", "n_", "centre"), ["band"], entries)

    tried = linked = groups = None
    grouped = members.withColumn("component", F.col("node"))
    for turn in range(STARS):
        # The smallest document first: others are often copies of it. Then others, by chance.
        centre = F.struct("doc_id", "node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        ends = F.array_sort(F.array("node", "centre.node"))
        star = mixed(grouped, centre).filter("component <> centre.component").select(ends[0].alias("a"), ends[1].alias("b")).distinct()
        star = Written(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), "stars")
        links = Written(verified(star.df), "links")
        written += [star, links]
        tried, linked = (star.df, links.df) if tried is None else (tried.union(star.df), linked.union(links.df))
        groups = components(linked)
        written.append(groups)
        joined = members.join(groups.df, "node", "left").select("node", "doc_id", "n", "band", F.coalesce("component", "node").alias("component"))
        again = Written(joined, "grouped")
        written.append(again)
        grouped = again.df
    apart = Written(mixed(grouped, F.col("node")).select("node", "n", "component").distinct(), "apart")

    def listed(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lists = pa.array([s.view(np.int64) for s in shingle_sets(part.column("text"), shingle)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "tokens"])

    own = texts_of(apart.df.select("node")).mapInArrow(listed, "node long, tokens array<bigint>")
    tokens = Written(own.join(apart.df, "node").select("node", "n", "component", F.explode("tokens").alias("token")), "tokens")
    shared = tokens.df.groupBy("token").agg(F.count("*").alias("n_"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).filter("n_ > 1")
    seen = join_hot(tokens.df, shared, ["token"], tokens.df.count()).withColumnRenamed("n_", "df")
    per_set = Window.partitionBy("node")
    # A partner shares at least ceil(n * threshold) shingles, so one of the rarest n - ceil(n * threshold) + 1; those that no
    # other set has come first.
    rank = F.row_number().over(per_set.orderBy("df", "token")) + F.col("n") - F.count("*").over(per_set)
    # Two sets whose first common shingle has these ranks have at most that and the smaller rest in common.
    reach = f"(1 + n - rank) * {num + den} >= {num} * (n + least)"
    prefix = Written(seen.withColumn("rank", rank).filter(F.expr(f"rank <= n - ceil(n * {num} / {den}) + 1 and low < high and {reach}")).select("token", "node", "n", "component", "rank"), "prefix")
    often = prefix.df.groupBy("token").agg(F.count("*").alias("n_")).filter("n_ > 1")
    sized = Written(join_hot(prefix.df, often, ["token"], prefix.df.count()).withColumn("salts", F.expr(f"cast(ceil(n_ / {FAN}) as int)")), "sized")
    x = sized.df.withColumn("salt", F.expr("cast(pmod(xxhash64(node), salts) as int)")).alias("x")
    y = sized.df.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).alias("y")
    fits = F.expr(f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and (1 + least(x.n - x.rank, y.n - y.rank)) * {num + den} >= {num} * (x.n + y.n)")
    cross = x.join(y, F.expr("x.token = y.token and x.salt = y.salt and x.component < y.component") & fits)
    pairs = Written(cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "cross")
    more = Written(verified(pairs.df), "links")
    links = components(linked.union(more.df))
    grown = classes.df.select("node", "set_key", "doc_id", F.col("rows").alias("rows_")).join(links.df, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grown.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_"))
    by_set = Written(join_hot(grown.drop("doc_id"), least, ["component"], classes.df.count()).select("set_key", "component_id", F.col("rows_").alias("n_")), "components")
    plain = Written(signed.df.drop("bands"), "rows").df
    for table in (*written, apart, tokens, prefix, sized, pairs, more, links):
        table.drop()
    out = join_hot(plain.filter("n_shingles > 0 and doc_id is not null"), by_set.df, ["set_key"], plain.count())
    alone = plain.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_key", "n_shingles", "component_id"]
    return out.select(columns).unionByName(alone.select(columns)).withColumn("kept", F.expr("doc_id <=> component_id"))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, threshold=(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")
