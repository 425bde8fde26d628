"""Chat formatting as a prefix tree: turns that conversations share from their start on are emitted once, depth-first.

A turn reads `<|im_start|>role newline text<|im_end|> newline`. Control strings inside roles and texts get a backslash after
their first character, one more than they had, which unescape() takes out again; newlines in roles are escaped too. Control
strings are `<|...|>` and `<...>` of up to 40 letters, digits, `_`, `-`, `:`, `.` and `/` (so `<<SYS>>` too), and `[INST]` and
other names in capitals in brackets: those of this template and of others in use, and some more.

The units of all positions are tokens if a tokenizer is named, else characters (code points). A turn's tokens are its own,
whatever its context, so a shared turn has the same ones in every conversation.

A node of the tree is a turn in its context. Conversations sort by the sequence of their turns' digests, which is the
depth-first order: of a conversation, the turns beyond those it shares with the one before are its new nodes. Each
range of the order is walked by itself; what the first conversation of a range shares with the last one before it is taken
out of the range then, and places and intervals follow. A conversation of n turns costs n digests, at any depth.
Nodes carry their number and place in the emitted stream, their position id (as if their conversation stood alone), the
loss mask inside them, and the intervals of the stream that they attend to besides themselves: their ancestors', merged
where these adjoin; the same as intervals of node numbers.

Defined cases: null texts and roles are empty; texts and conversations of any length are formatted whole, a conversation is one
row (it is one sequence); turns sort by (turn, role, text), nulls first; rows without conversation
id form one conversation of their own, with a null id; repeated rows are turns of their own; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.packing import encoder
from foliospark.llm.shared import Written, arrow_rows

DIGEST = 12
START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string; without `<`, `[` and backslashes, so escapes don't meet each other.
_TAIL = r"\|[^\s<>|\[\]\\]{1,40}\|>|[/\w.:｜▁-]{1,40}>|/?[A-Z_]{1,40}\]"
_RAW = re.compile(rf"([<\[])(\\*)(?={_TAIL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = f"{START}{_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(stream: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(stream)]


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = "array<struct<first:bigint,last:bigint>>"
_NODE = f"node long, depth int, segment string, ids array<int>, units long, position long, place long, loss {_SPANS}, attends {_SPANS}, above {_SPANS}, leaf binary"
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), _SPAN, _SPAN, _SPAN, pa.binary()]
_NAMES = ["node", "depth", "segment", "ids", "units", "position", "place", "loss", "attends", "above", "leaf"]
#: Nodes of one Arrow batch: a node's intervals may be many.
ROWS = 1024


def _shared(a: bytes, b: bytes) -> int:
    """How many turns two conversations share from their start on."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * DIGEST] == b[: middle * DIGEST] else (low, middle - 1)
    return low


def _joined(spans: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both in turn, merged where they adjoin."""
    if spans and more and spans[-1][1] == more[0][0]:
        return [*spans[:-1], (spans[-1][0], more[0][1]), *more[1:]]
    return spans + more


def _runs(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, ends, strict=True):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _walked(chats):
    """From (key, digests, segments, ids, spans) in order: the rows of the new nodes, as if nothing came before. The last row
    is a pickle of what the neighbours need: the first and the last digests, the number of nodes and units, and the
    last conversation's nodes, their starts and their ends."""
    first = last = b""
    nodes, starts, ends = [], [], []  # of the conversation at hand
    number = at = 0
    for key, digests, segments, ids, spans in chats:
        common = _shared(last, digests)
        first = first or digests
        del nodes[common:], starts[common:], ends[common:]
        said, over = _runs(starts, ends), _runs(nodes, [n + 1 for n in nodes])
        position, new, low = sum(b - a for a, b in said), at, number
        for depth in range(common, len(segments)):
            segment, own, span = segments[depth], ids and ids[depth], spans[depth]
            units = len(segment if own is None else own)
            above = _joined(over, [(low, number)] if number > low else [])
            yield (number, depth + 1, segment, own, units, position, at, [] if span is None else [span], _joined(said, [(new, at)] if at > new else []), above, key if depth + 1 == len(segments) else None)
            nodes.append(number)
            starts.append(at)
            position, at, number = position + units, at + units, number + 1
            ends.append(at)
        last = digests
    if first:
        yield pickle.dumps((first, last, number, at, nodes, starts, ends))


class _Shift:
    """Where a range's nodes and characters stand in the whole: those of the shared nodes `given`, the others from `base` on."""

    def __init__(self, starts: list[int], ends: list[int], base: int):
        self.given, self.base = list(zip(starts, ends, strict=True)), base
        self.cuts = [0]  # in the range
        for a, b in self.given:
            self.cuts.append(self.cuts[-1] + b - a)
        self.total = self.cuts[-1]

    def point(self, x: int) -> int:
        return x - self.total + self.base

    def spans(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ancestors' intervals: the shared nodes among them are the first ones."""
        if not spans or spans[0][0] >= self.total:
            return [(self.point(a), self.point(b)) for a, b in spans]
        b = spans[0][1]
        known = self.given[: bisect_right(self.cuts, min(b, self.total)) - 1]
        rest = ([(self.total, b)] if b > self.total else []) + spans[1:]
        return _joined(_runs([x for x, _ in known], [y for _, y in known]), [(self.point(x), self.point(y)) for x, y in rest])


def _shifts(edges) -> dict[int, tuple[int, _Shift, _Shift]]:
    """For each range, from its edges (part, pickle) in order: how many nodes it shares with those before, and the shifts."""
    out = {}
    before, number, at = b"", 0, 0
    own: tuple[list[int], list[int], list[int]] = ([], [], [])
    for part, edge in edges:
        first, last, n, chars, *mine = pickle.loads(edge)
        c = _shared(before, first)
        known = tuple(x[:c] for x in own)
        nodes, places = _Shift(known[0], [x + 1 for x in known[0]], number), _Shift(known[1], known[2], at)
        out[part] = c, nodes, places
        up = sum(x < c for x in mine[0])  # the last conversation's nodes that stand before the range
        own = (
            known[0][:up] + [nodes.point(x) for x in mine[0][up:]],
            known[1][:up] + [places.point(x) for x in mine[1][up:]],
            known[2][:up] + [places.point(x) for x in mine[2][up:]],
        )
        before, number, at = last, number + n - c, at + chars - places.total
    return out


def _batch(rows: list[tuple], types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _pairs(spans: list[dict]) -> list[tuple[int, int]]:
    return [(s["first"], s["last"]) for s in spans]


def _structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"first": a, "last": b} for a, b in spans]


def prefix_tree(conversations: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves). nodes: node (its number in the stream), depth, segment, ids (its tokens; null without tokenizer),
    units (how many tokens or characters it has), position (its first unit's; the others' follow), place (in the stream of
    units), loss (spans of characters inside the segment), attends (array of stream intervals, last excluded), above (the
    same of node numbers). leaves: conv_id and the node of its last turn. tokenizer: the path of a `tokenizers` file."""
    spark = conversations.sparkSession
    arrow_rows(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    # A conversation is one sequence: it has to meet in one row.
    grouped = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))

    def format_(batches):
        types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), _SPAN]
        encode = encoder(tokenizer) if tokenizer else None
        for batch in batches:
            rows = []
            for conv, own in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                pieces = [formatted(t["role"], t["text"]) for t in own]
                digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=DIGEST).digest() for p, _, _ in pieces)
                spans = [{"first": a, "last": b} if t["role"] == "assistant" else None for t, (_, a, b) in zip(own, pieces, strict=True)]
                ids = None
                if encode:
                    flat, counts = encode([p for p, _, _ in pieces])
                    ids = np.split(flat.astype(np.int32), np.cumsum(counts)[:-1])
                rows.append((conv, hashlib.blake2b(digests, digest_size=16).digest(), digests, [p for p, _, _ in pieces], ids, spans))
            yield _batch(rows, types, ["conv_id", "leaf", "digests", "segments", "ids", "spans"])

    turned = Written(grouped.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(format_, f"conv_id long, leaf binary, digests binary, segments array<string>, ids array<array<int>>, spans {_SPANS}"), "turns").df
    unique = turned.groupBy("leaf").agg(*[F.first(c).alias(c) for c in ("digests", "segments", "ids", "spans")])
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types, names = [*_TYPES, pa.int32(), pa.binary()], [*_NAMES, "part", "edge"]

        def chats():
            for batch in batches:
                for row in zip(*[batch.column(c) for c in ("leaf", "digests", "segments", "ids", "spans")], strict=True):
                    key, digests, segments, ids, spans = (x.as_py() for x in row)
                    yield key, digests, segments, ids, [s and (s["first"], s["last"]) for s in spans]

        rows = []
        for row in _walked(chats()):
            if isinstance(row, bytes):
                rows.append((*[None] * len(_NAMES), part, row))
            else:
                rows.append((*row[:7], *[_structs(x) for x in row[7:10]], row[10], part, None))
            if len(rows) == ROWS:
                yield _batch(rows, types, names)
                rows = []
        if rows:
            yield _batch(rows, types, names)

    order = unique.repartitionByRange(width, "digests").sortWithinPartitions("digests").select("leaf", "digests", "segments", "ids", "spans")
    walked = Written(order.mapInArrow(walk, _NODE + ", part int, edge binary"), "walked").df
    # A row for each range, of one conversation's digests and places.
    edges = walked.filter("edge is not null").select("part", "edge").orderBy("part").toLocalIterator()
    sent = spark.sparkContext.broadcast(_shifts((r.part, bytes(r.edge)) for r in edges))

    def shift(batches):
        for batch in batches:
            rows = []
            for row in zip(*[batch.column(c).to_pylist() for c in [*_NAMES, "part"]], strict=True):
                node, depth, segment, ids, units, position, place, loss, attends, above, leaf, part = row
                c, nodes, places = sent.value[part]
                if node >= c:
                    rows.append((nodes.point(node), depth, segment, ids, units, position, places.point(place), loss, _structs(places.spans(_pairs(attends))), _structs(nodes.spans(_pairs(above))), leaf))
            yield _batch(rows, _TYPES, _NAMES)

    placed = Written(walked.filter("edge is null").drop("edge").mapInArrow(shift, _NODE), "nodes").df
    leaves = turned.select("conv_id", "leaf").join(placed.filter("leaf is not null").select("leaf", "node"), "leaf").select("conv_id", "node")
    return placed.drop("leaf"), leaves


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """From the output alone: for each conversation its turns' and loss text's digests and sizes."""
    last = leaves.select("node").distinct().join(nodes.select("node", "above"), "node")
    chain = F.expr("concat(flatten(transform(above, s -> sequence(s.first, s.last - 1))), array(node))")
    wanted = last.select(F.col("node").alias("last"), F.explode(chain).alias("node"))
    parts = wanted.join(nodes.select("node", "segment", "loss"), "node")
    streams = parts.groupBy("last").agg(F.sort_array(F.collect_list(F.struct("node", "segment", "loss"))).alias("parts"))

    def digests(batches):
        for batch in batches:
            rows = []
            for node, own in zip(batch.column("last").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                stream = "".join(p["segment"] for p in own)
                turns = parsed(stream)
                loss = "".join(unescape(p["segment"][s["first"] : s["last"]]) for p in own for s in p["loss"])
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((node, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(stream)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield _batch(rows, types, ["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = streams.mapInArrow(digests, "node long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return leaves.join(read, "node").drop("node")


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -1L as conv_id, cast(t as bigint) as turn, r as role, '{text}' as text from values (0, 'user'), (1, 'assistant') as x(t, r)")
    return read_back(*prefix_tree(chats.unionByName(extra))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
