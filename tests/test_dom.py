import sys

import pytest

from foliospark.config import Profile
from foliospark.dom import css, html5, xml
from foliospark.dom.html5 import Element
from foliospark.operators.html_article import Walker, extract, metadata, text_of


def shape(e):
    return e.tag + "(" + " ".join(repr(c) if isinstance(c, str) else shape(c) for c in e.children) + ")"


def body(html):
    return shape(next(e for e in html5.parse(html).descendants() if e.tag == "body"))[5:-1]


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<p>a<p>b", "p('a') p('b')"),
        ("<p><b>a<br><p>b", "p(b('a' br())) p(b('b'))"),
        ("<b><p>a</b>b</p>", "b() p(b('a') 'b')"),
        ("<a>1<a>2", "a('1') a('2')"),
        ("<ul><li>a<li>b</ul>c", "ul(li('a') li('b')) 'c'"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "table(tbody(tr(td('a') td('b')) tr(td('c'))))"),
        ("<table>x<tr><td>a</table>", "'x' table(tbody(tr(td('a'))))"),
        ("<h1>a<h2>b</h2>", "h1('a') h2('b')"),
        ("a<!-- c -->b&amp;&lt;1%", "'ab&<1%'"),
        ("y<script>if (a<b) '</p>'</script>x", "'y' script(\"if (a<b) '</p>'\") 'x'"),
        ("<div/>a</div>b", "div('a') 'b'"),
        ("<p>a</div>b", "p('ab')"),
        ("</p>a", "'a'"), ("x</p>a", "'x' p() 'a'"),
        ("<svg><path/><g>x</g></svg>y", "svg(path() g('x')) 'y'"),
        ("<body class=a>x<body class=b id=c>y", "'xy'"),
        ("<b><b><b><b>x</b></b></b></b>", "b(b(b(b('x'))))"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt('a') dd('b') dt('c'))"),
        ("<p>x<table><tr><td>y</table>", "p('x') table(tbody(tr(td('y'))))"),
    ],
)
def test_tree(html, tree):
    assert body(html) == tree


def test_head_and_implied_parts():
    d = html5.parse("<title>a &amp; <b>b</title><meta name=x content=1 content=2><p>c")
    assert shape(d) == "#document(html(head(title('a & <b>b') meta()) body(p('c'))))"
    assert next(e for e in d.descendants() if e.tag == "meta").attrs == {"name": "x", "content": "1"}
    assert shape(html5.parse("")) == "#document(html(head() body()))"


def test_noahs_ark_keeps_three():
    got = body("<p><b>1<p><b>2<p><b>3<p><b>4<p>5")
    assert got.endswith("p(b(b(b('5'))))")


def test_selectors():
    d = html5.parse('<main><div id=a class="x y"><p lang="en-GB">1</p><p data-k="v w">2</p></div></main>')
    pick = lambda s: [text_of(e) for e in css.every(d, css.compile_selector(s))]
    assert pick("div#a.x.y") == ["12"] and pick("main p") == ["1", "2"] and pick("main > p") == []
    assert pick('p[lang|="en"]') == ["1"] and pick('[data-k~="w"]') == ["2"] and pick("p + p, main") == ["12", "2"]
    assert pick('[data-k^="v"]') == pick('[data-k$="w"]') == pick('[data-k*=" "]') == ["2"] and pick("p ~ p") == ["2"]
    assert css.compile_selector("p:hover(") is None and css.compile_selector("a >") is None and css.compile_selector("") is None


def test_deep_pages_end_without_a_crash():
    sys.setrecursionlimit(8000)
    page = "<article>" + "<div>" * 20_000 + "<p>deep</p></article>"
    assert extract(page, Profile(body_selectors=("article",)))["body"] == ""
    assert "near" in extract("<article>" + "<div>" * 500 + "<p>near</p></article>", Profile(body_selectors=("article",)))["body"]


def test_walker_rules():
    def md(html):
        w = Walker(["aside"])
        w.block(next(e for e in html5.parse(html).descendants() if e.tag == "body"))
        return "".join(w.out)

    assert md("loose<aside><p>no</p></aside><h6>h</h6>") == "##### h\n\n"
    assert md("<ol><li> <li>b</ol>") == "2. b\n\n"
    assert md("<blockquote>a<br>b</blockquote>") == "> a b\n\n"
    assert md("<table><tr><td>b<th>h</table>") == "| b | h |\n\n"
    assert md("<p>a<script>x</script> <a href=u>l</a></p>") == "a l\n\n"


def test_title_rules():
    title = lambda h: metadata(html5.parse(h))["title"]
    assert title("<title> A | B - C</title>") == "A" and title("<title> | x</title>") == "| x"
    assert title('<meta name="dc.Title" content="D"><meta name="citation_title" content="C">') == "D"


def test_xml():
    assert not xml.deeper_than("<a>" * 64 + "</a>" * 64) and xml.deeper_than("<a>" * 65)
    assert not xml.deeper_than("<a><!-- " + "<b>" * 99 + " --><![CDATA[" + "<b>" * 99 + "]]></a>")
    n = xml.parse('<a xmlns:x="u">1<!-- c -->2<x:b k="v"/></a>')
    assert n.children[:2] == ["1", "2"] and n.children[2].name == "{u}b"
    for bad in ("<a>", "<!DOCTYPE a><a/>", "<a>&nbsp;</a>", ""):
        with pytest.raises(xml.XmlError):
            xml.parse(bad)
    assert xml.parse('<!DOCTYPE a SYSTEM "x"><a/>', dtd=True).name == "a"
    assert isinstance(html5.parse("x"), Element)
