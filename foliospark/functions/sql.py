"""The engine's functions for SQL: register(spark) once, then SELECT foliospark_extract(ext, text).markdown FROM ..."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators.extract import RECURSION
from foliospark.shipping import ship

EXTRACTED = "format string, title string, authors array<string>, doi string, journal string, body string, reason string"


def register(spark: SparkSession, config: Config | None = None) -> list[str]:
    """Registers foliospark_detect(ext, text), foliospark_extract(ext, text), and the table function
    foliospark_epub_files(content) of (ord, path, xhtml); returns their names."""
    config = config or Config()
    ship(spark)

    @F.arrow_udf("string")
    def foliospark_detect(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from foliospark.operators.document import detect

        for exts, texts in batches:
            yield pa.array([detect(e or "", t or "", config)[0] for e, t in zip(exts.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    @F.arrow_udf(EXTRACTED)
    def foliospark_extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from foliospark.errors import ExtractFailure
        from foliospark.operators.document import detect, extract_text

        sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION))
        names = ("title", "authors", "doi", "journal", "body", "reason")
        kind = pa.struct([("format", pa.string()), *[(n, pa.list_(pa.string()) if n == "authors" else pa.string()) for n in names]])
        for exts, texts in batches:
            rows = []
            for ext, text in zip(exts.to_pylist(), texts.to_pylist(), strict=True):
                form, profile = detect(ext or "", text or "", config)
                try:
                    if text is None:
                        raise ExtractFailure("no text")
                    found = extract_text(form, profile, text, config)
                except ExtractFailure as e:
                    found = {"reason": str(e)}
                rows.append({"format": form} | {n: found.get(n) for n in names})
            yield pa.array(rows, kind)

    @F.udtf(returnType="ord int, path string, xhtml string")
    class foliospark_epub_files:  # noqa: N801 its name in SQL
        def eval(self, content: bytes):
            from foliospark.errors import ExtractFailure
            from foliospark.operators.epub_package import read_book

            try:
                files = [] if content is None else read_book(bytes(content))["files"]
            except ExtractFailure:
                files = []
            for i, f in enumerate(files):
                yield i, f["path"], f["xhtml"]

    spark.udf.register("foliospark_detect", foliospark_detect)
    spark.udf.register("foliospark_extract", foliospark_extract)
    spark.udtf.register("foliospark_epub_files", foliospark_epub_files)
    return ["foliospark_detect", "foliospark_extract", "foliospark_epub_files"]
