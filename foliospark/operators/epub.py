"""ePub to Markdown as a relational pipeline over the files of all books.

One Arrow function opens an archive, once; from there reading order, navigation labels, heading levels, chapter numbers
and assembly are Column work. A row for each file of a book, and one for the book itself, are dealt to tasks by book and
file, so a long book is walked by many. One more shuffle, by book, puts the chapters together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.config import Config
from foliospark.errors import ExtractFailure
from foliospark.functions import text as X
from foliospark.operators.extract import RECURSION, finished
from foliospark.shipping import arrow_rows, pieces

NAV = "array<struct<ord:int,parent_ord:int,depth:int,label:string,href:string,fragment:string>>"
BOOK = f"title string, authors array<string>, doi string, publisher string, files array<struct<path:string,xhtml:string>>, nav {NAV}, classes array<string>, reason string"
_NAV = pa.list_(pa.struct([("ord", pa.int32()), ("parent_ord", pa.int32()), ("depth", pa.int32()), ("label", pa.string()), ("href", pa.string()), ("fragment", pa.string())]))
_BOOK = pa.struct([("title", pa.string()), ("authors", pa.list_(pa.string())), ("doi", pa.string()), ("publisher", pa.string()), ("files", pa.list_(pa.struct([("path", pa.string()), ("xhtml", pa.string())]))), ("nav", _NAV), ("classes", pa.list_(pa.string())), ("reason", pa.string())])
BOOK_FILES = 5


def _opened(content: bytes | None) -> dict:
    from foliospark.operators.epub_package import read_book

    try:
        if content is None:
            raise ExtractFailure("no content")
        return {k: v for k, v in read_book(content).items() if k in ("title", "authors", "doi", "publisher", "files", "nav", "classes")}
    except ExtractFailure as e:
        return {"reason": str(e), "authors": [], "files": [], "nav": [], "classes": []}


def open_book():
    @F.arrow_udf(BOOK)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION))
        for batch in batches:
            for (contents,) in pieces(batch):
                yield pa.array([_opened(c) for c in contents], _BOOK)

    return run


def _mapped(entries: list | None) -> dict:
    return {e["key"]: e["value"] for e in entries or ()}


_PAPER = pa.struct([("title", pa.string()), ("authors", pa.list_(pa.string())), ("doi", pa.string()), ("journal", pa.string()), ("walked", pa.string())])
_WALKED = pa.struct([("md", pa.string()), ("headed", pa.bool_()), ("paper", _PAPER)])


def walk_rows():
    """A chapter's file to its Markdown, or the files of a paper to the paper; rows have one of them, or neither."""

    @F.arrow_udf("md string, headed boolean, paper struct<title:string,authors:array<string>,doi:string,journal:string,walked:string>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from foliospark.operators.epub_package import chapter, paper

        sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION))
        for batch in batches:
            for columns in pieces(*batch):
                rows = []
                for page, own, by_class, cs, pages in zip(*columns, strict=True):
                    md, headed = ("", False) if page is None else chapter(page, _mapped(own), _mapped(by_class), cs or [])
                    rows.append({"md": md, "headed": headed, "paper": None if pages is None else paper(pages)})
                yield pa.array(rows, _WALKED)

    return run


def nav_label(nav, path) -> Column:
    """The label of the first entry, in reading order, that points at a file."""
    return F.get(F.filter(nav, lambda n: (n.href != "") & (n.href == path)), 0).label


def toc_levels(nav, path) -> Column:
    """Fragment to heading level in one file: its depth below the file's shallowest entry, 1 to 6; the first entry wins."""
    own = F.filter(nav, lambda n: n.href == path)
    top = F.array_min(F.transform(own, lambda n: n.depth))
    named = F.filter(own, lambda n: n.fragment.isNotNull())
    names = F.transform(named, lambda n: n.fragment)
    first = F.filter(named, lambda n, i: F.array_position(names, n.fragment) == i + 1)
    return F.map_from_entries(F.transform(first, lambda n: F.struct(n.fragment, F.least(F.lit(6), n.depth - top + 1))))


def kept_file(path, label) -> Column:
    """False for covers, wrappers, title pages, contents pages and licence pages."""
    name = F.lower(X.file_name(path))
    cruft = F.coalesce(X.structural_label(label) | F.lower(label).contains("project gutenberg"), F.lit(False))
    return ~(name.startswith("cover") | name.startswith("wrap") | cruft)


def contents_list(nav) -> Column:
    """The table of contents with links; an excluded entry takes the entries below it along."""
    cruft = lambda n: X.structural_label(n.label) | F.lower(n.label).contains("project gutenberg")
    start = F.struct(F.lit("").alias("text"), F.lit(2**31 - 1).alias("under"))

    def step(done, n):
        under = F.when(n.depth > done.under, done.under).when(cruft(n), n.depth).otherwise(F.lit(2**31 - 1))
        line = F.concat(F.repeat(F.lit("  "), n.depth), F.lit("- ["), n.label, F.lit("](#"), X.heading_slug(n.label), F.lit(")\n"))
        return F.struct(F.concat(done.text, F.when(under == 2**31 - 1, line).otherwise("")).alias("text"), under.cast("int").alias("under"))

    return F.concat(F.lit("## Contents\n\n"), F.aggregate(nav, start, step, lambda done: done.text))


def opened(raw: DataFrame) -> DataFrame:
    """(id, content) to id and `book`."""
    arrow_rows(raw.sparkSession)
    return raw.select("id", open_book()("content").alias("book"))


def is_book() -> Column:
    return (F.size("book.files") > BOOK_FILES) & (F.size("book.nav") > 0)


def walked(books: DataFrame, config: Config) -> DataFrame:
    """A row for each book (n 0; `head`, and in `w.paper` what a paper's files give) and, of book-length ones, for each file that
    is kept (n from 1, in reading order): id, n, head, src, label, w."""
    levels = F.lit(None).cast("map<string,int>")
    for publisher, classes in sorted(config.heading_classes.items()):
        pairs = F.create_map(*[F.lit(v) for kv in sorted(classes.items()) for v in kv]) if classes else levels
        levels = F.when(F.col("book.publisher") == publisher, pairs.cast("map<string,int>")).otherwise(levels)
    good = F.col("book.reason").isNull()
    kind = F.when(~good, "failed").when(is_book(), "book").otherwise("paper")
    nav = F.col("book.nav")
    known = F.transform("book.files", lambda f: F.struct(f.path.alias("src"), f.xhtml.alias("xhtml"), nav_label(nav, f.path).alias("label")))
    kept = F.filter(known, lambda p: p.xhtml.isNotNull() & kept_file(p.src, p.label))
    none = F.lit(None).cast("string")
    itself = F.array(F.struct(none.alias("src"), none.alias("xhtml"), none.alias("label")))
    pages = F.when(kind == "paper", F.transform(F.filter("book.files", lambda f: f.xhtml.isNotNull()), lambda f: F.concat(f.xhtml, F.lit("\n<!-- epub-part: "), f.path, F.lit(" -->\n"))))
    head = F.struct(kind.alias("kind"), "book.title", "book.authors", "book.doi", "book.reason", F.when(kind == "book", contents_list(nav)).alias("contents"))
    one = books.select("id", head.alias("head"), pages.alias("pages"), F.when(kind == "book", nav).alias("nav"), F.col("book.classes").alias("classes"), levels.alias("class_levels"), F.when(kind == "book", F.concat(itself, kept)).otherwise(itself).alias("files"))
    first = lambda c: F.when(F.col("n") == 0, F.col(c)).alias(c)
    rows = one.select("id", "head", "pages", "nav", "classes", "class_levels", F.posexplode("files").alias("n", "file"))
    rows = rows.select("id", "n", first("head"), first("pages"), "file.*", F.when(F.col("n") > 0, F.map_entries(toc_levels(F.col("nav"), F.col("file.src")))).alias("levels"), F.map_entries("class_levels").alias("class_levels"), "classes")
    dealt = rows.repartition("id", "n")
    return dealt.select("id", "n", "head", "src", "label", walk_rows()("xhtml", "levels", "class_levels", "classes", "pages").alias("w"))


def _body(label, w) -> Column:
    heading = F.when(w.headed | label.isNull(), "").otherwise(X.nav_heading(label))
    return F.concat(F.when(heading != "", F.concat(heading, F.lit("\n\n"))).otherwise(""), w.md)


def _title(label, body) -> Column:
    return F.coalesce(label, X.first_heading_text(body), F.lit(""))


def chapters(books: DataFrame, config: Config | None = None) -> DataFrame:
    """id, index, chapter_id, title, src, body of the chapters of book-length ePubs."""
    titled = walked(books, config or Config()).filter("n > 0 and w.md <> ''").select("id", "n", "src", "label", _body(F.col("label"), F.col("w")).alias("body"))
    index = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    return titled.withColumn("index", index).select("id", "index", X.chapter_id("index").alias("chapter_id"), _title(F.col("label"), F.col("body")).alias("title"), "src", "body")


def extract_books(raw: DataFrame, config: Config | None = None) -> DataFrame:
    """(id, content) rows to the columns of extract_documents()."""
    config = config or Config()
    none = F.lit(None).cast("string")
    rows = walked(opened(raw), config).withColumn("body", F.when((F.col("n") > 0) & (F.col("w.md") != ""), _body(F.col("label"), F.col("w"))))
    chapter = F.when(F.col("body").isNotNull(), F.struct("n", _title(F.col("label"), F.col("body")).alias("title"), "src", "body"))
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list(chapter)).alias("chapters"), F.first("head", True).alias("head"), F.first("w.paper", True).alias("paper"))

    def part(c, i):
        name = X.chapter_id(i + 1)
        return F.concat(X.start_marker(name, c.title, c.src, config.marker), F.lit("\n\n"), c.body, F.lit("\n\n"), X.end_marker(name, config.marker), F.lit("\n\n"))

    title_line = lambda t: F.when(t.isNotNull(), F.concat(F.lit("# "), t, F.lit("\n\n"))).otherwise("")
    kind, p = F.col("head.kind"), F.col("paper")
    book = F.concat(title_line(F.col("head.title")), F.col("head.contents"), F.lit("\n"), F.array_join(F.transform("chapters", part), ""))
    better = F.when(p.title.isNull() | X.junk_title(p.title), F.col("head.title")).otherwise(p.title)
    title = F.when(kind == "paper", better).otherwise(F.col("head.title"))
    authors = F.when((kind == "paper") & (F.size(p.authors) > 0), p.authors).otherwise(F.col("head.authors"))
    text = F.when(kind == "book", book).when(kind == "paper", F.concat(title_line(title), p.walked))
    reason = F.when((kind == "book") & (F.size("chapters") == 0), "no body content found in ePub").otherwise(F.col("head.reason"))
    # The body is a column of its own before its blank lines go: a rule that names it twice doesn't build it twice.
    whole = whole.withColumns({"body_": text, "reason_": reason, "title_": title, "authors_": authors})
    every = whole.select("id", F.lit("epub").alias("source_format"), F.col("reason_").alias("reason"), F.col("title_").alias("title"), F.coalesce("authors_", F.array().cast("array<string>")).alias("authors"), F.when(kind == "paper", F.coalesce(p.doi, "head.doi")).otherwise(F.col("head.doi")).alias("doi"), F.when(kind == "paper", p.journal).otherwise(none).alias("journal"), X.collapse_blanks("body_").alias("body"))
    empty = {"references": F.array().cast("array<struct<label:string,text:string>>"), "tables": F.array().cast("array<struct<head:boolean,cells:array<string>>>")}
    return finished(every.withColumns(empty).select("id", "source_format", "reason", "title", "authors", "doi", "journal", "body", "references", "tables"))
