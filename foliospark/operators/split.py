"""Books to a file for each chapter: names from templates, contents with inherited frontmatter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import SplitConfig
from foliospark.errors import EngineError
from foliospark.functions.text import escape_yaml, heading_slug, pad_number, source_stem, trim_white
from foliospark.operators.chapters import parsed
from foliospark.shipping import arrow_rows, pieces


@dataclass(frozen=True)
class Values:
    book: Column
    n: Column
    slug: Column
    title: Column
    src: Column
    pad: int


def compile_template(template: str, values: Values) -> Column:
    """One concat; mistakes in a template show before anything runs. A slash or NUL inside a value becomes a hyphen, and a
    value of dots alone is emptied, so no value leaves its folder."""
    parts, at = [], 0
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"[/\x{00}\\]", "-"), r"^\.+$", "")
    known = {"book": safe(values.book), "slug": values.slug, "title": safe(values.title), "src": safe(values.src), "n": pad_number(values.n, values.pad)}
    while at < len(template):
        open_ = template.find("{", at)
        if open_ < 0:
            parts.append(F.lit(template[at:]))
            break
        parts.append(F.lit(template[at:open_]))
        close = template.find("}", open_)
        if close < 0:
            raise EngineError("config_error", f"unterminated {{ in template: {template}")
        name = template[open_ + 1 : close]
        if name not in known:
            raise EngineError("config_error", f"unknown token {{{name}}} in template: {template}", f"known tokens: {', '.join(sorted(known))}")
        parts.append(known[name])
        at = close + 1
    return F.concat(*parts) if parts else F.lit("")


def free_name(path: str, n: int, used) -> str:
    """The path itself, or with its chapter's number, or with a further number: the first that is free."""
    p, k, candidate = PurePosixPath(path), 1, path
    while candidate in used:
        candidate = str(p.with_name(f"{p.stem}-{n}{'' if k == 1 else f'-{k}'}{p.suffix or '.md'}"))
        k += 1
    return candidate


def renamed():
    """Arrow function (paths, numbers) of a book to its paths without collisions; null stays null."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for columns in pieces(*batch):
                rows = []
                for own, ns in zip(*columns, strict=True):
                    if own is not None and len(set(own)) < len(own):
                        used: dict[str, None] = {}
                        for path, n in zip(own, ns, strict=True):
                            used[free_name(path, n, used)] = None
                        own = list(used)
                    rows.append(own)
                yield pa.array(rows, pa.list_(pa.string()))

    return run


def split_files(books: DataFrame, config: SplitConfig | None = None, outdir: str = "") -> DataFrame:
    """(book, markdown) to book, index (0: front file), title, path, bytes, content. Books with an error or without chapters
    give no rows; split_errors() has them. Each book is parsed once."""
    config = config or SplitConfig()
    arrow_rows(books.sparkSession)
    good = parsed(books).filter(F.col("error").isNull() & (F.size("chapters") > 0))
    base = f"{outdir.rstrip('/')}/" if outdir else ""
    blank = F.lit("")
    values = lambda **v: Values(**({"book": F.col("book"), "n": F.lit(0), "slug": blank, "title": blank, "src": blank, "pad": config.pad} | v))
    sub = F.concat(F.lit(base), compile_template(config.subdir, values()), F.lit("/")) if config.subdir else F.lit(base)
    # Names come first, from the short columns; each file's text is put together once, after it has its row.
    named = lambda c: F.concat(sub, compile_template(config.file, values(n=c.index, slug=heading_slug(c.title), title=c.title, src=source_stem(c.src))))
    item = lambda index, title, src, body: F.struct(index.alias("index"), title.alias("title"), src.alias("src"), body.alias("body"))
    paths, numbers = F.transform("chapters", named), F.transform("chapters", lambda c: c.index)
    items = F.transform("chapters", lambda c: item(c.index, c.title, c.src, c.body))
    if config.front:
        front = compile_template(config.front, values(slug=F.lit("frontmatter"), title=F.lit("frontmatter")))
        paths, numbers = F.concat(F.array(F.concat(sub, front)), paths), F.concat(F.array(F.lit(0)), numbers)
        items = F.concat(F.array(item(F.lit(0), F.col("book"), blank, F.col("preamble"))), items)
    each = good.select("book", "frontmatter", items.alias("items"), renamed()(paths, numbers).alias("paths")).select("book", "frontmatter", "paths", F.posexplode("items").alias("at", "f"))
    each = each.select("book", "f.*", F.get("paths", "at").alias("path"), "frontmatter")
    head = F.when(F.col("frontmatter") != "", F.concat(F.lit("---\n"), "frontmatter", F.lit("---\n\n"))).otherwise("")
    source = F.when(F.col("src") != "", F.concat(F.lit('source: "'), escape_yaml("src"), F.lit('"\n'))).otherwise("")
    text = F.concat(F.lit("---\n"), "frontmatter", F.lit("chapter: "), F.col("index").cast("string"), F.lit('\nchapter_title: "'), escape_yaml("title"), F.lit('"\n'), source, F.lit("---\n\n"), trim_white("body"), F.lit("\n"))
    content = F.when(F.col("index") == 0, F.concat(head, "body", F.lit("\n"))).otherwise(text)
    out = each.select("book", "index", "title", "path", content.alias("content"))
    return out.select("book", "index", "title", "path", F.octet_length("content").cast("long").alias("bytes"), "content")


def split_errors(books: DataFrame) -> DataFrame:
    """book, kind, message for books that can't be split."""
    found = parsed(books).filter(F.col("error").isNotNull() | (F.size("chapters") == 0))
    kind = F.when(F.col("error").isNotNull(), "extraction_failed").otherwise("no_chapters")
    return found.select("book", kind.alias("kind"), F.coalesce("error", F.concat(F.lit("no chapter markers in "), "book")).alias("message"))
