"""ePub archives, chapter markers, splitting: archives are built here."""

import io
import zipfile

import pytest

from foliospark import config as C
from foliospark.errors import EngineError, ExtractFailure
from foliospark.operators import epub_package as P
from foliospark.operators.chapters import parse_chapters
from foliospark.operators.epub import extract_books
from foliospark.operators.split import free_name, split_errors, split_files

CONTAINER = '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def package(items, spine, more=""):
    rows = "".join(f'<item id="{i}" href="{h}"{a}/>' for i, h, a in items)
    refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
    return f'<package xmlns="urn:o"><metadata xmlns:dc="urn:d"><dc:title>Old</dc:title><dc:title>Book</dc:title><dc:creator>An Author</dc:creator><dc:publisher> Pub </dc:publisher>{more}</metadata><manifest>{rows}</manifest><spine>{refs}</spine></package>'


def ncx_book():
    names = ["title", "contents", "part1", "one", "two", "part2", "three"]
    items = [("ncx", "t.ncx", f' media-type="{P.NCX}"'), *[(n, f"{n}.html", "") for n in names]]
    point = lambda label, src, inner="": f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{src}"/>{inner}</navPoint>'
    toc = "".join([
        point("Title Page", "title.html"), point("Contents", "contents.html"),
        point("PART I", "part1.html", point("Chapter 1", "one.html", point("A section", "one.html#s1")) + point("Chapter 2", "two.html")),
        point("PART II", "part2.html", point("Chapter 3", "three.html#top")),
    ])
    page = lambda b: f"<html><head><title>x</title></head><body>{b}</body></html>"
    return archive({
        "META-INF/container.xml": CONTAINER, "O/p.opf": package(items, names),
        "O/t.ncx": f'<!DOCTYPE ncx PUBLIC "-//NISO//DTD ncx 2005-1//EN" "http://x/ncx.dtd"><ncx><navMap>{toc}</navMap></ncx>',
        "O/title.html": page("<p>title</p>"), "O/contents.html": page("<p>toc</p>"), "O/part1.html": page("<p>opening</p>"),
        "O/one.html": page('<p class="sec1" id="s1"><b>A section</b></p><p>first</p>'), "O/two.html": page("<h1>Second chapter</h1><p>second</p>"),
        "O/part2.html": page("<p>middle</p>"), "O/three.html": page("<p>third</p>"),
    })


def extracted(spark, *contents, config=None):
    rows = spark.createDataFrame([(f"b{i}", bytearray(c)) for i, c in enumerate(contents)], "id string, content binary")
    return {r.id: r for r in extract_books(rows, config).collect()}


def test_book_with_ncx(spark):
    md = extracted(spark, ncx_book())["b0"].markdown
    titles = [line.split('title="')[1].split('"')[0] for line in md.splitlines() if "chapter-start" in line]
    assert titles == ["PART I", "Chapter 1", "Chapter 2", "PART II", "Chapter 3"]
    assert "# PART I\n\nopening" in md and "## Chapter 1\n\n## A section\n\nfirst" not in md
    assert "# A section\n\nfirst" in md  # the file's own shallowest entry is its first level less
    assert "  - [Chapter 1](#chapter-1)\n    - [A section](#a-section)" in md and "Contents](#" not in md
    assert md.startswith('---\nid: b0\nsource_format: epub\ntitle: "Book"\nauthors:\n  - "An Author"\n---\n\n# Book\n\n## Contents\n\n')


def test_class_levels_outrank_ids(spark):
    config = C.merged(C.Config(), {"epub": {"heading_classes": {"Pub": {"sec1": 5}}}})
    assert "##### A section" in extracted(spark, ncx_book(), config=config)["b0"].markdown


def test_paper_and_failures(spark):
    page = '<html><body><article><h1 property="name">Paper</h1><span property="author"><span property="givenName">A</span><span property="familyName">B</span></span><a href="https://doi.org/10.5/x">d</a><p>text</p></article></body></html>'
    paper = archive({"META-INF/container.xml": CONTAINER, "O/p.opf": package([("a", "a.xhtml", "")], ["a"]), "O/a.xhtml": page, "O/table1.xhtml": "<table><tbody><tr><td>1</td></tr></tbody></table>"})
    none = archive({"META-INF/container.xml": CONTAINER, "O/p.opf": package([], [])})
    got = extracted(spark, paper, b"no zip", none, archive({"x": "y"}))
    assert got["b0"].title == "Paper" and got["b0"].authors == ["A B"] and got["b0"].doi == "10.5/x" and "text" in got["b0"].markdown
    assert got["b1"].status == got["b2"].status == got["b3"].status == "failed"
    assert got["b1"].reason.startswith("opening ePub") and got["b2"].reason == "OPF spine contains no content items"


def test_entry_limits():
    z = zipfile.ZipFile(io.BytesIO(archive({"a": "x" * 100, "b": "ok"})))
    assert P.read_entry(z, "b", 50) == "ok"
    with pytest.raises(ExtractFailure):
        P.read_entry(z, "a", 50)
    z.getinfo("a").file_size = 10  # understated: the real size counts
    with pytest.raises(ExtractFailure):
        P.read_entry(z, "a", 50)


def test_nav_document():
    nav = '<nav><ol><li><a href="x">other</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="a.xhtml">A</a><ol><li><a href="a.xhtml#f">F</a></li></ol></li><li><span>none</span></li></ol></nav>'
    got = P.nav_entries(nav, "O/")
    assert [(e["label"], e["depth"], e["parent_ord"], e["href"], e["fragment"]) for e in got] == [("A", 0, -1, "O/a.xhtml", None), ("F", 1, 0, "O/a.xhtml", "f")]


def test_promotions():
    assert P.promote_paragraphs('<p id="a" title=">">x</p><pre></pre><p id=b>y</p><p id="a"/><p id="a">z', {"a": 9, "b": 0}, {}) == '<h6 id="a" title=">">x</h6><pre></pre><h1 id=b>y</h1><p id="a"/><p id="a">z'
    assert P.promote_paragraphs('<p class="q c" id="a">x</p>', {"a": 2}, {"c": 3}) == '<h3 class="q c" id="a">x</h3>'
    assert P.promote_subheadings('<p class="k">a</p><p class="k" id="x">b</p>', ["k"]) == '<h3>a</h3><p class="k" id="x">b</p>'
    style = ".class1{text-align:center;font-size:1.1em}.class2{text-align:center;font-size:1.5em}.class3{text-align:center;font-size:1.2em;font-weight:bold}.k{text-align:center;font-size:1.2em}"
    assert P.subheading_classes(style) == ["class1"]


def parsed(spark, md):
    state, chapters = parse_chapters(spark.createDataFrame([("b", md)], "book string, markdown string"))
    return state.first(), chapters.orderBy("index").collect()


S, E = '<!-- x:chapter-start id="{0}" title="T{0}" src="s.html" -->\n', '<!-- x:chapter-end id="{0}" -->\n'


def test_chapter_parser(spark):
    state, found = parsed(spark, "---\na: 1\n---\npre\n" + E.format(0) + "more\n" + S.format(1) + "body\n" + E.format(1) + "stray\n" + S.format(2) + E.format(2))
    assert (state.frontmatter, state.preamble, state.error) == ("a: 1\n", "pre\nmore", None)
    assert [(c["index"], c.chapter_id, c.title, c.src, c.body) for c in found] == [(1, "1", "T1", "s.html", "body\n"), (2, "2", "T2", "s.html", "")]
    state, found = parsed(spark, S.format(1) + "a\n" + S.format(2) + "b\n" + E.format(2) + S.format(3))
    assert state.error == 'chapter "1" has no matching chapter-end' and [c.chapter_id for c in found] == ["2"]
    assert parsed(spark, S.format(3) + "x")[0].error == 'chapter "3" has no matching chapter-end'
    assert parsed(spark, '<!-- x:chapter-start id="1 -->\n' + E.format(1))[0].error.startswith("malformed chapter-start marker: ")
    assert parsed(spark, "plain")[0].preamble == "plain" and parsed(spark, "")[1] == []
    assert parsed(spark, "---\nnever closed")[0].frontmatter == "never closed\n"


def test_split(spark):
    md = "Pre\n" + S.format(1).replace("T1", "one-2") + "x\n" + E.format(1) + S.format(2).replace("T2", "One!") + "y\n" + E.format(2) + S.format(3).replace("T3", "One") + E.format(3)
    books = spark.createDataFrame([("b", md), ("plain", "text"), ("bad", S.format(1))], "book string, markdown string")
    got = split_files(books, C.SplitConfig(file="{slug}.md"), "out").orderBy("index").collect()
    assert [r.path for r in got] == ["out/b/00-frontmatter.md", "out/b/one-2.md", "out/b/one.md", "out/b/one-3.md"]
    assert got[0].content == "Pre\n" and got[1].content.startswith('---\nchapter: 1\nchapter_title: "one-2"\nsource: "s.html"\n---\n\nx')
    assert {(r.book, r.kind) for r in split_errors(books).collect()} == {("plain", "no_chapters"), ("bad", "extraction_failed")}
    no_front = split_files(books, C.SplitConfig(front="", subdir="", file="{n}.md"), "o").orderBy("index").collect()
    assert [r.path for r in no_front] == ["o/01.md", "o/02.md", "o/03.md"]
    for bad in ("{nope}.md", "{n.md"):
        with pytest.raises(EngineError) as e:
            split_files(books, C.SplitConfig(file=bad))
        assert e.value.kind == "config_error"


def test_names_widen_until_free():
    assert free_name("d/a.md", 3, {"d/a.md", "d/a-3.md"}) == "d/a-3-2.md"
    assert free_name("d/a.md", 3, set()) == "d/a.md"
