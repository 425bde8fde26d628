"""Reading chapter markers back out of Markdown: one pass over a book's lines.

A chapter is open where the last marker before a line is a start. It counts if the next marker is an end; a second start
or the end of the text loses it and is the book's error. Text between an end and the next start is dropped; an end without
a start is ignored. Markers of any prefix are read. Each row is a book of its own, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.plain import lines, trim
from foliospark.shipping import arrow_rows, pieces

_MARKER = re.compile(r"<!-- \w+:chapter-(start|end) ", re.A)
_ATTR = {name: re.compile(f'{name}="([^"]*)"') for name in ("id", "title", "src")}
PARSED = "frontmatter string, preamble string, error string, chapters array<struct<index:int,chapter_id:string,title:string,src:string,body:string>>"
_CHAPTER = pa.struct([("index", pa.int32()), ("chapter_id", pa.string()), ("title", pa.string()), ("src", pa.string()), ("body", pa.string())])
_PARSED = pa.struct([("frontmatter", pa.string()), ("preamble", pa.string()), ("error", pa.string()), ("chapters", pa.list_(_CHAPTER))])


def _attr(t: str, name: str) -> str:
    m = _ATTR[name].search(t)
    return m[1] if m else ""


def parse(markdown: str) -> dict:
    front, before, chapters, error = [], [], [], None
    fences, fenced, started = 0, False, False
    opened: tuple[str, str, str] | None = None
    body: list[str] = []
    for n, line in enumerate(lines(markdown)):
        t = trim(line)
        fences += t == "---"
        fenced = t == "---" if n == 0 else fenced
        if fenced and (fences == 1 or (fences == 2 and t == "---")):
            if t != "---":
                front.append(line + "\n")
            continue
        m = _MARKER.match(t) if t.startswith("<!-- ") else None
        if m is None:
            if opened is not None:
                body.append(line + "\n")
            elif not started:
                before.append(line + "\n")
            continue
        if error is None and m[1] == "start" and opened is not None:
            error = f'chapter "{opened[0]}" has no matching chapter-end'
        if error is None and t.count('"') % 2:
            error = f"malformed chapter-{m[1]} marker: {t}"
        if m[1] == "start":
            opened, body, started = (_attr(t, "id"), _attr(t, "title"), _attr(t, "src")), [], True
        elif opened is not None:
            chapters.append({"index": len(chapters) + 1, "chapter_id": opened[0], "title": opened[1], "src": opened[2], "body": "".join(body)})
            opened = None
    if error is None and opened is not None:
        error = f'chapter "{opened[0]}" has no matching chapter-end'
    return {"frontmatter": "".join(front), "preamble": trim("".join(before)), "error": error, "chapters": chapters}


def _parser():
    @F.arrow_udf(PARSED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (texts,) in pieces(batch):
                yield pa.array([parse(t) for t in texts], _PARSED)

    return run


def parsed(books: DataFrame) -> DataFrame:
    """(book, markdown) to book, frontmatter, preamble, error, chapters (index, chapter_id, title, src, body). Map-only."""
    arrow_rows(books.sparkSession)
    found = books.filter(F.col("markdown").isNotNull()).select("book", _parser()("markdown").alias("p"))
    return found.select("book", "p.frontmatter", "p.preamble", "p.error", "p.chapters")


def parse_chapters(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book, markdown) to (books: book, frontmatter, preamble, error), (chapters: book, index, chapter_id, title, src, body)."""
    found = parsed(books)
    return found.drop("chapters"), found.select("book", F.explode("chapters").alias("c")).select("book", "c.*")
