"""Every registered query of the engine against its SQL twin."""

from pathlib import Path

import pytest

from foliospark.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def rows(frame):
    k = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return k, sorted(([plain(v) for v in r] for r in frame[k].astype(object).where(frame[k].notna(), None).values.tolist()), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.sql(f"create view {t.stem} as select * from '{t}'")
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_detection_runs_no_python_and_prunes(spark):
    plan = QUERIES["detect_counts"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<html:string>" in plan


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_byte_prefix_reads_all_documents(spark):
    got = QUERIES["byte_prefix"](spark, str(DATA)).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    assert len(got) == len(texts) and any(r.head.endswith("\ufffd") for r in got)
    assert all((r.head, r.bytes) == (texts[r.doc_id][:64].decode(errors="replace"), len(texts[r.doc_id])) for r in got)
