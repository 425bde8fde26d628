"""Result rows as people and programs read them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(report: DataFrame) -> DataFrame:
    """One row: ok, skipped, failed, any_failed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return report.agg(count("ok"), count("skipped"), count("failed"), F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("any_failed"))


def missing_rows(missing: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return missing.select("id", F.lit("unknown").alias("source_format"), none.alias("output_path"), F.lit(0).cast("long").alias("bytes"), F.lit("failed").alias("status"), F.lit("not found").alias("reason"))


def text_row(id_: str, status: str, bytes_: int, reason: str | None) -> str:
    if status == "ok":
        return f"  OK   {id_}.md ({bytes_ // 1024}KB)"
    return f"  SKIP {id_}.md (exists; use --force)" if status == "skipped" else f"  FAIL {id_}: {reason}"


def summary(ok: int, skipped: int, failed: int) -> str:
    return f"Done: {ok} extracted, {skipped} skipped, {failed} failed"


def envelope(rows: list[dict], drop_null: tuple[str, ...] = ("reason",)) -> str:
    """{"items": [...]}; a null reason is left out, other nulls are written."""
    return json.dumps({"items": [{k: v for k, v in r.items() if not (k in drop_null and v is None)} for r in rows]}, ensure_ascii=False)
