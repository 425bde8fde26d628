"""The registered queries: SQL twins, and what their contracts say of the rows."""

from pathlib import Path

import pytest

from foliospark.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.sql(f"create view {t.stem} as select * from '{t}'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    k = sorted(got.columns)
    plain = lambda f: sorted(map(str, f[k].astype(object).where(f[k].notna(), None).values.tolist()))
    assert k == sorted(want.columns) and plain(got) == plain(want)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_entry_lists_them_and_needs_no_session():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) < set(names) and "pipeline" in names and set(__spark_entry__.oracle_sql()) < set(names)


def test_quality_ranks_held_out_documents(spark):
    import duckdb

    folder = DATA.parent / "sf0.01"
    got = QUERIES["op6_quality_classifier"](spark, str(folder)).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").df()
    assert len(got) == duckdb.sql(f"select count(*) from '{folder}/documents.parquet'").fetchall()[0][0] and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(bad) >= 10 and (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.9
