"""What a worker holds and how work is dealt out doesn't depend on the size of a table."""

from pathlib import Path

import pyarrow as pa
import pytest

from foliospark.config import Config
from foliospark.dom import css, xml
from foliospark.operators import html_article
from foliospark.operators.epub import open_book
from foliospark.operators.extract import extract_documents, text_extractor
from foliospark.plans.catalog import QUERIES

DATA = Path("/root/testdata/sf0.001")
with_data = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_holds_few_rows_at_a_time(spark):
    batch = (pa.array(["jats-xml"] * 500), pa.nulls(500, pa.string()), pa.array(["<article/>"] * 500))
    sizes = [len(x) for x in text_extractor(Config()).func(iter([batch]))]
    assert sum(sizes) == 500 and max(sizes) <= 64
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    extract_documents(spark.createDataFrame([], "id string, ext string, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024


@with_data
def test_depth_guard_deals_its_narrow_table_to_all_cores(spark):
    got = QUERIES["depth_guard"](spark, str(DATA))
    assert "RepartitionByExpression [p_partkey" in got._jdf.queryExecution().optimizedPlan().toString()


def test_parsers_do_no_work_that_the_page_rules_out(monkeypatch):
    tried = []
    real = css.matches
    monkeypatch.setattr(css, "matches", lambda e, c: tried.append(e.tag) or real(e, c))
    found = html_article.extract("<article><nav><p>gone</p></nav>" + "<p>a <i>b</i></p>" * 50 + '<p class="x">c</p></article>', Config().profile("other"))
    assert found["body"] == "a *b*\n\n" * 50 + "c\n\n"
    assert "i" not in tried  # no attributes, and no selector names its type
    deep = "<a>" * 65 + "</a>" * 65
    assert xml.deeper_than(deep) and not xml.deeper_than(deep[3:]) and xml.deeper_than("<b/>" * 9 + deep)
    monkeypatch.setattr(xml, "_PART", None)  # 64 start tags can't nest deeper
    assert not xml.deeper_than("<a>" * 64 + "x</a></a>")


def test_books_are_opened_few_at_a_time(spark):
    batch = pa.array([b"no archive"] * 300, pa.binary())
    got = list(open_book().func(iter([batch])))
    assert sum(map(len, got)) == 300 and max(map(len, got)) <= 64
    assert got[0][0].as_py()["reason"].startswith("opening ePub")


@with_data
def test_a_books_body_is_put_together_before_its_blank_lines_go(spark):
    assert "regexp_replace(body_" in plan(spark, "epub_roundtrip")


@with_data
def test_rows_of_files_take_no_pages_along(spark):
    assert "Generate explode(paths" in plan(spark, "epub_spine_roles")


@with_data
def test_chapters_are_parsed_in_place_and_written_once(spark):
    shown = plan(spark, "split_files")
    assert "Window" not in shown and "Aggregate" not in shown and shown.count("chapter_title") == 1
