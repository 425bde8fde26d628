"""Documents to Markdown, as DataFrame transformations.

One Arrow function per family returns a struct, so no projection runs a parser twice; detection, preflight, frontmatter
and the choice of columns are native. The whole path is map-only: no shuffle, whatever the collection's size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.errors import ExtractFailure
from foliospark.functions import detect as D
from foliospark.functions import text as X
from foliospark.shipping import arrow_rows, pieces

FOUND = (
    "title string, authors array<string>, doi string, journal string, body string, reason string,"
    " `references` array<struct<label:string,text:string>>, tables array<struct<head:boolean,cells:array<string>>>"
)
_REF = pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())]))
_TABLE = pa.list_(pa.struct([("head", pa.bool_()), ("cells", pa.list_(pa.string()))]))
_FOUND = pa.struct([("title", pa.string()), ("authors", pa.list_(pa.string())), ("doi", pa.string()), ("journal", pa.string()), ("body", pa.string()), ("reason", pa.string()), ("references", _REF), ("tables", _TABLE)])
RECURSION = 8000


def _row(extract, *args) -> dict:
    try:
        found = extract(*args)
    except ExtractFailure as e:
        found = {"reason": str(e), "authors": []}
    return {"references": [], "tables": []} | found


def text_extractor(config: Config, strip_refs: bool = False):
    """arrow function (format, profile, text) -> FOUND."""

    @F.arrow_udf(FOUND)
    def extract(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from foliospark.operators.document import extract_text

        sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION))
        for batch in batches:
            for columns in pieces(*batch):
                yield pa.array([None if t is None else _row(extract_text, k, p, t, config, strip_refs) for k, p, t in zip(*columns, strict=True)], _FOUND)

    return extract


def with_format(docs: DataFrame, config: Config, ext: str = "ext", text: str = "text") -> DataFrame:
    """Adds profile (of HTML pages), format and reason (null where nothing speaks against extraction). A reason that rows
    bring along, such as bytes that aren't UTF-8, stays; a null text is a reason too."""
    is_page = F.col(ext) == "html"
    out = docs.withColumn("profile", F.when(is_page, D.profile_of(F.col(text), config)))
    kind = F.when(F.col(ext) == "epub", "epub").when(F.col(ext) == "xml", D.xml_format(F.col(text))).when(is_page, D.format_name(F.col("profile"))).otherwise("unknown")
    out = out.withColumn("format", kind)
    given = F.col("reason") if "reason" in docs.columns else F.lit(None).cast("string")
    here = F.when(F.col(text).isNull(), "no text").when(F.col("format") == "unknown", "unknown format").when(is_page, D.preflight(F.col("profile"), F.col(text), config))
    return out.withColumn("reason", F.coalesce(given, here))


def extract_documents(docs: DataFrame, config: Config | None = None, strip_refs: bool = False) -> DataFrame:
    """(id, ext, text, and a reason if the source gives one) rows to id, source_format, title, authors, doi, journal, body, references, tables, markdown, bytes,
    status, reason. Failed rows have a reason and no Markdown."""
    config = config or Config()
    arrow_rows(docs.sparkSession)
    known = with_format(docs.select("id", "ext", "text", *[c for c in docs.columns if c == "reason"]), config)
    sent = F.when(F.col("reason").isNull(), F.col("text"))
    found = known.select("id", F.col("format").alias("source_format"), F.col("reason").alias("early"), text_extractor(config, strip_refs)("format", "profile", sent).alias("found"))
    flat = found.select("id", "source_format", F.coalesce("early", "found.reason").alias("reason"), "found.title", F.coalesce("found.authors", F.array().cast("array<string>")).alias("authors"), "found.doi", "found.journal", "found.body", "found.references", "found.tables")
    return finished(flat)


def finished(flat: DataFrame) -> DataFrame:
    md = F.when(F.col("reason").isNull(), X.document(F.col("id"), F.col("source_format"), F.col("title"), F.col("authors"), F.col("doi"), F.col("journal"), F.col("body")))
    out = flat.withColumn("markdown", md)
    return out.withColumns({"bytes": F.coalesce(F.octet_length("markdown"), F.lit(0)).cast("long"), "status": F.when(F.col("reason").isNull(), "ok").otherwise("failed")})


def detect_documents(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """(id, path, ext, text) rows to id, path, format, status, reason; no Python runs."""
    config = config or Config()
    kind = D.detect_format(F.col("ext"), F.col("text"), config)
    return docs.select("id", "path", kind.alias("format"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))


