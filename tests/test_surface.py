"""Errors, settings, reports, sources, sinks, the command line and streaming."""

import json

import pytest

from foliospark import cli, report
from foliospark import config as C
from foliospark.errors import KINDS, EngineError

PAGE = "<html><head><title>T</title></head><body><article><p>text</p></article></body></html>"


def test_error_kinds():
    assert {k: v[0] for k, v in KINDS.items()} == {"usage": 2, "not_found": 3, "extraction_failed": 5, "output_exists": 6, "io_error": 7, "no_chapters": 8, "config_error": 9}
    assert [k for k, v in KINDS.items() if v[1]] == ["io_error"]
    assert json.loads(EngineError("not_found", "m", "h").to_json()) == {"kind": "not_found", "message": "m", "hint": "h"}
    assert json.loads(EngineError("usage", "m").to_json()) == {"kind": "usage", "message": "m"}


def test_config_layers(tmp_path):
    (tmp_path / "a.yaml").write_text("publishers:\n  acs:\n    detect_any: [x]\n  mine:\n    detect: [y]\nsplit:\n  pad: 3\n")
    (tmp_path / "b.toml").write_text('[publishers.mine]\nbody_selectors = ["main"]\n')
    c = C.load(tmp_path / "a.yaml", tmp_path / "b.toml")
    assert c.publishers["acs"].detect_any == ("x",) and c.publishers["acs"].body_selectors and c.split.pad == 3
    assert c.publishers["mine"].detect == ("y",) and c.publishers["mine"].body_selectors == ("main",)
    assert [k for k, _ in c.ordered] == sorted(c.publishers)
    (tmp_path / "c.json").write_text('{"nope": 1}')
    for bad in ("c.json", "missing.yaml"):
        with pytest.raises(EngineError):
            C.load(tmp_path / bad)


def test_report_rows():
    assert report.envelope([{"id": "a", "output_path": None, "reason": None}]) == '{"items": [{"id": "a", "output_path": null}]}'
    assert report.text_row("a", "ok", 2050, None) == "  OK   a.md (2KB)" and report.text_row("a", "failed", 0, "r") == "  FAIL a: r"
    assert report.summary(1, 2, 3) == "Done: 1 extracted, 2 skipped, 3 failed"


def test_command_line(spark, tmp_path, capsys):
    inputs, out = tmp_path / "in", tmp_path / "out"
    inputs.mkdir()
    (inputs / "a.html").write_text(PAGE)
    (inputs / "b.xml").write_text("<x/>")
    (inputs / "c.txt").write_text("no")
    (inputs / "d.html").write_bytes(b"\xff\xfe<html>")
    run = lambda *a: (cli.main(["--format", "json", *a]), capsys.readouterr())
    code, said = run("detect", "--indir", str(inputs))
    assert code == 0 and {r["id"]: r["format"] for r in json.loads(said.out)["items"]}["a"] == "other-html"
    code, said = run("extract", "--indir", str(inputs), "-o", str(out))
    rows = {r["id"]: r for r in json.loads(said.out)["items"]}
    assert code == 1 and rows["a"]["status"] == "ok" and rows["b"]["reason"] == "unknown format" and rows["d"]["reason"] == "not UTF-8" and len(rows) == 3
    assert (out / "a.md").read_text().endswith("# T\n\ntext\n\n") and rows["a"]["bytes"] == (out / "a.md").stat().st_size
    code, said = run("extract", str(inputs / "a.html"), "zz", "--indir", str(inputs), "-o", str(out))
    rows = {r["id"]: r for r in json.loads(said.out)["items"]}
    assert code == 1 and rows["a"]["status"] == "skipped" and rows["zz"]["reason"] == "not found"
    assert run("extract", "a", "--indir", str(inputs), "-o", str(out), "--force")[0] == 0
    code, said = run("extract", "--indir", str(tmp_path / "none"))
    assert code == 3 and json.loads(said.err)["kind"] == "not_found"
    code, said = run("split", str(out / "a.md"), "-o", str(tmp_path / "s"))
    assert code == 8 and json.loads(said.err)["kind"] == "no_chapters"
    book = tmp_path / "book.md"
    book.write_text('pre\n<!-- book:chapter-start id="ch01" title="One" src="a.html" -->\nx\n<!-- book:chapter-end id="ch01" -->\n')
    code, said = run("split", str(book), "-o", str(tmp_path / "s"))
    assert code == 0 and sorted(p.name for p in (tmp_path / "s" / "book").iterdir()) == ["00-frontmatter.md", "01-one.md"]
    code, said = run("split", str(book), "-o", str(tmp_path / "s"))
    assert code == 6 and json.loads(said.err)["kind"] == "output_exists"
    assert run("split", str(book), "-o", str(tmp_path / "s"), "--force", "--no-front")[0] == 0


def test_stem_collisions(spark):
    from foliospark.sources.files import one_per_id

    files = spark.createDataFrame([("a", "d/a.epub"), ("a", "d/a.xml")], "id string, path string")
    assert one_per_id(files).first().path == "d/a.epub" and one_per_id(files, True).first().path == "d/a.xml"


def test_stream(spark, tmp_path):
    from foliospark.streaming.ingest import extract_stream

    inputs = tmp_path / "in"
    inputs.mkdir()
    for round_, name in enumerate(("a", "b"), 1):
        (inputs / f"{name}.html").write_text(PAGE)
        extract_stream(spark, str(inputs), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "t")).filter("status = 'ok'").count() == round_


def test_settings_layers(tmp_path):
    home, project = tmp_path / "home", tmp_path / "project" / "sub"
    (home / ".config" / "foliospark").mkdir(parents=True)
    project.mkdir(parents=True)
    (home / ".config" / "foliospark" / "config.yaml").write_text("input_dir: user\noutput_dir: user\nmarker: user\nsplit:\n  pad: 5\n")
    (tmp_path / "project" / ".foliospark.toml").write_text('output_dir = "project"\nmarker = "project"\n')
    (tmp_path / "c.json").write_text('{"marker": "named"}')
    layers = lambda *p, **e: C.layered(*p, folder=project, home=home, environment=e)
    c = layers()
    assert (c.input_dir, c.output_dir, c.marker, c.split.pad) == ("user", "project", "project", 5)
    c = layers(tmp_path / "c.json", FOLIOSPARK_OUTPUT_DIR="env", FOLIOSPARK_MARKER="env")
    assert (c.input_dir, c.output_dir, c.marker) == ("user", "env", "named")


def test_rows_without_text_fail(spark):
    from foliospark.operators.extract import extract_documents

    rows = [("a", "html", None, None), ("b", "xml", None, None), ("c", "html", PAGE, None), ("d", "html", PAGE, "not UTF-8")]
    got = {r.id: (r.status, r.reason) for r in extract_documents(spark.createDataFrame(rows, "id string, ext string, text string, reason string")).collect()}
    assert got == {"a": ("failed", "no text"), "b": ("failed", "no text"), "c": ("ok", None), "d": ("failed", "not UTF-8")}


def test_sql_functions(spark):
    import io
    import zipfile

    from foliospark.functions.sql import register

    register(spark)
    got = spark.sql(f"select foliospark_detect('html', '{PAGE}') as f, foliospark_extract('html', '{PAGE}') as x, foliospark_extract('xml', null).reason as r").first()
    assert got.f == "other-html" and got.x.title == "T" and got.x.body.strip() == "# T\n\ntext" and got.r == "no text"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr("c.opf", '<package><metadata/><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", "<p>x</p>")
    spark.createDataFrame([(buffer.getvalue(),), (b"no zip",)], "content binary").createOrReplaceTempView("archives_")
    assert [tuple(r) for r in spark.sql("select f.* from archives_, lateral foliospark_epub_files(content) f").collect()] == [(0, "a.xhtml", "<p>x</p>")]


def test_stream_takes_epubs_and_reports_bad_files(spark, tmp_path):
    from foliospark.streaming.ingest import extract_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text(PAGE)
    (tmp_path / "in" / "b.html").write_bytes(b"<html>\xff\xfe</html>")
    (tmp_path / "in" / "c.epub").write_bytes(b"no zip")
    extract_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.id: (r.status, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a"] == ("ok", None) and got["b"] == ("failed", "not UTF-8") and got["c"][0] == "failed" and got["c"][1].startswith("opening ePub")
