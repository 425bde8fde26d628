"""Column rules against their plain twins, on the edges."""

import pytest
from pyspark.sql import functions as F

from foliospark.config import Profile
from foliospark.functions import detect as D
from foliospark.functions import text as X
from foliospark.operators import plain
from foliospark.operators.document import escaped, fits

TEXTS = ["", " ", "a", "a\n\n\nb", "\n\na\r\n \r\n \nb", "a\n", "a\n\n", "\x1ca\x1c", "a 　 b", "x\r", "\r\n", "a\n\n\n"]
TITLES = ["", "Cover", "cP", "Dedication", "sgPhz1", "a b", "naïve", "a-b", "Äöü", "nav", "Title Page", "c0 d"]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", make("v")).orderBy("i").collect()]


@pytest.mark.parametrize(("make", "twin"), [(X.normalize_text, plain.normalize), (X.collapse_blanks, plain.collapse_blanks), (X.trim_white, plain.trim), (X.escape_yaml, escaped)])
def test_text_twins(spark, make, twin):
    assert column(spark, TEXTS, make) == [twin(t) for t in TEXTS]


def test_blank_lines_are_collapsed_in_one_pass(spark):
    text = "a\n \n\n" * 50_000
    rows = spark.createDataFrame([(text,)], "v string").select(X.collapse_blanks("v").alias("v"))
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()  # looking at each line's neighbour split the text anew
    assert rows.first()[0] == plain.collapse_blanks(text) == "a\n\n" * 50_000


def test_junk_titles(spark):
    assert column(spark, TITLES, X.junk_title) == [plain.junk_title(t) for t in TITLES]


def test_names(spark):
    paths = ["d/a.b.html", ".html", "d/.html", "a", "d.x/a", "a.HTML"]
    assert column(spark, paths, X.file_stem) == ["a.b", ".html", ".html", "a", "a", "a"]
    assert column(spark, paths, X.file_extension) == ["html", "", "", "", "", "HTML"]
    assert column(spark, ["d/a.b.html", "a", "x/.html"], X.source_stem) == ["a.b", "", ""]


def test_headings_and_markers(spark):
    assert column(spark, ["Ä b--c!  D", "!!!", "a - b"], X.heading_slug) == ["ä-b-c-d", "", "a-b"]
    assert column(spark, ["x\n  ## T \n# U", "#\n# U", "x"], X.first_heading_text) == ["T", None, None]
    assert column(spark, ['a "b" -> c---d'], X.sanitize_attr) == ["a 'b' - c–-d"]
    assert column(spark, ["part 1", " Parts", "", "Part of it"], X.nav_heading) == ["# part 1", "## Parts", "", "# Part of it"]
    assert column(spark, ["p{font-size: 1.2em;x:2em}", "p{font-size:12px}"], X.em_size) == [pytest.approx(1.2), None]
    n = spark.createDataFrame([(7,), (123,)], "n int")
    assert [r[0] for r in n.select(X.pad_number("n", 2)).collect()] == ["07", "123"]


def test_byte_prefix_cuts_inside_a_code_point(spark):
    assert column(spark, ["aéb"], lambda v: X.byte_prefix(v, 2)) == ["a�"]


def test_profile_groups(spark):
    profiles = [Profile(), Profile(detect=("a", "b")), Profile(detect_any=("a", "b")), Profile(detect=("a",), detect_any=("b", "c"))]
    for p in profiles:
        got = column(spark, ["", "a", "ab", "ac"], lambda v, p=p: D.matches_profile(F.col(v), p))
        assert got == [fits(t, p) for t in ("", "a", "ab", "ac")]
