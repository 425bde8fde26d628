"""The registered queries of the document engine and their DuckDB twins.

Text rules are compared with the same rule in SQL. Parsers are compared by round trip: a query builds markup from table
columns, runs the real extractor on it, and the SQL twin computes the expected Markdown from the columns alone.
"""

from __future__ import annotations

import io
import zipfile
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import config as C
from foliospark.functions import detect as D
from foliospark.functions import text as X
from foliospark.operators.extract import detect_documents, extract_documents, with_format
from foliospark.shipping import arrow_rows, pieces

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CONFIG = C.Config()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# SQL fragments
def norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{X.WS_CLASS}+', ' ', 'g'), ' ')"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^{X.WS_CLASS}+|{X.WS_CLASS}+$', '', 'g')"


def slug(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}} -]', '', 'g'), '[ -]+', '-', 'g'), '^-|-$', '', 'g')"


def quoted(x: str) -> str:
    return rf"replace(replace({x}, '\', '\\'), '" + "\"', '\\\"')"


def collapsed(x: str) -> str:
    """Of an SQL string without CR."""
    return f"""(CASE WHEN {x} = '' THEN '' ELSE (WITH l AS (SELECT unnest(string_split(regexp_replace({x}, '\\n$', ''), chr(10))) AS s, generate_subscripts(string_split(regexp_replace({x}, '\\n$', ''), chr(10)), 1) AS i),
 k AS (SELECT i, CASE WHEN {trimmed('s')} = '' THEN '' ELSE s END AS s, {trimmed('s')} = '' AND coalesce(lag({trimmed('s')}) OVER (ORDER BY i) = '', false) AS gone FROM l)
 SELECT string_agg(s, chr(10) ORDER BY i) || chr(10) FROM k WHERE NOT gone) END)"""


def markup(c):
    """A column as escaped text of HTML or XML."""
    out = F.col(c) if isinstance(c, str) else c
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def xml_safe(c):
    """Without the control characters that XML 1.0 has no way to write."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


XML_SAFE = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def s(name: str):
    return F.col(name).cast("string")


# Detection


@query("SELECT page_id, 'other-html' AS format FROM pages")
def detect_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", D.detect_format(F.lit("html"), F.col("html"), CONFIG).alias("format"))


@query("SELECT 'other-html' AS format, count(*) AS n FROM pages GROUP BY 1")
def detect_counts(spark, sf_dir):
    return detect_pages(spark, sf_dir).groupBy("format").agg(F.count("*").alias("n"))


_MARKERS = ["pubs.acs.org", "cambridge-org", "sd-article", "frontiersin.org", "ieeexplore-ieee-org", "mdpi.com", "chapter-title academic.oup.com", "academic-oup-com", "artText", "sagepub.com", "c-article-body", "hlFld-Abstract", "article__content", "nothing"]
_FORMATS = ["acs-html", "cambridge-html", "elsevier-html", "frontiers-html", "ieee-html", "mdpi-html", "oup-book-html", "oup-journal-html", "plos-html", "sage-html", "springer-html", "tandf-html", "wiley-html", "other-html"]


@query(f"SELECT page_id, {_FORMATS}[page_id % 14 + 1] AS format FROM pages")
def detect_synth_publishers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    marker = F.element_at(F.array(*[F.lit(m) for m in _MARKERS]), (F.col("page_id") % 14 + 1).cast("int"))
    rows = pages.select(s("page_id").alias("id"), F.col("page_id"), F.lit("html").alias("ext"), cat("<!-- ", marker, " -->", F.col("html")).alias("text"))
    return with_format(rows, CONFIG).select("page_id", "format")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'wiley-xml' WHEN 1 THEN 'jats-xml' ELSE 'unknown' END AS format FROM documents")
def detect_xml_kinds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    head = F.when(F.col("doc_id") % 3 == 0, '<component xmlns="http://www.wiley.com/namespaces/wiley"><p>').when(F.col("doc_id") % 3 == 1, "<article><p>").otherwise("<book><p>")
    rows = docs.select("doc_id", s("doc_id").alias("id"), s("doc_id").alias("path"), F.lit("xml").alias("ext"), cat(head, markup(F.coalesce("text", F.lit("")))).alias("text"))
    return detect_documents(rows, CONFIG).select(F.col("id").cast("long").alias("doc_id"), "format")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'abstract-only format' WHEN 1 THEN 'abstract-only (no fulltext)' WHEN 2 THEN 'no-content page (abstract only)' END AS reason FROM pages""")
def preflight_bails(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    marker = F.element_at(F.array(*[F.lit(m) for m in ("sagepub.com", "tandfonline.com", "cambridge.org no-content", "cambridge.org no-content scrollspy-content", "tandfonline.com hlFld-Fulltext")]), (F.col("page_id") % 5 + 1).cast("int"))
    rows = pages.select("page_id", F.lit("html").alias("ext"), cat("<!-- ", marker, " -->", F.col("html")).alias("text"))
    return with_format(rows, CONFIG).select("page_id", "reason")


# Text rules


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, strlen(t) AS n, left(t, 64) AS c FROM d),
k AS (SELECT doc_id, n, left(c, CAST(list_max(list_filter(range(0, 65), lambda i: strlen(left(c, i)) <= 64)) AS BIGINT)) AS whole FROM h)
SELECT doc_id, CASE WHEN strlen(whole) < least(n, 64) THEN whole || chr(65533) ELSE whole END AS head, CAST(n AS BIGINT) AS bytes FROM k""")
def byte_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", X.byte_prefix("text", 64).alias("head"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.normalize_text("text").alias("normalized"))


_SPACED = "replace(text, '. ', '.' || chr(10) || ' ' || chr(10) || chr(10))"


@query(f"WITH d AS (SELECT doc_id, {_SPACED} AS t FROM documents) SELECT doc_id, {collapsed('t')} AS collapsed FROM d")
def collapse_blanks(spark, sf_dir):
    spaced = F.replace("text", F.lit(". "), F.lit(".\n \n\n"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.collapse_blanks(spaced).alias("collapsed"))


@query(f"SELECT p_partkey, {slug('p_name')} AS slug FROM part")
def heading_slug(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", X.heading_slug("p_name").alias("slug"))


_ATTR = "'A \"' || text || '\" --> b---c'"


@query(f"SELECT item_id, {trimmed('replace(replace(replace(' + norm(_ATTR) + ', chr(62), chr(0)), chr(34), chr(39)), chr(45) || chr(45), chr(8211))').replace('chr(0)', repr(''))} AS attr FROM benchmark")
def sanitize_attr(spark, sf_dir):
    return table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", X.sanitize_attr(cat('A "', F.col("text"), '" --> b---c')).alias("attr"))


@query(f"SELECT doc_id, {quoted('text')} AS escaped FROM documents")
def yaml_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.escape_yaml("text").alias("escaped"))



@query("""WITH w AS (SELECT item_id, unnest(list_distinct(string_split(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'), ' '))) AS t FROM benchmark)
SELECT item_id, count(*) AS n, count(*) FILTER (t = '' OR lower(t) IN ('cover', 'nav') OR regexp_matches(t, '[0-9]') OR strlen(t) <= 3) AS junk FROM w GROUP BY 1""")
def junk_title(spark, sf_dir):
    words = F.array_distinct(F.split(F.regexp_replace("text", "[^a-zA-Z0-9 ]", ""), " ", -1))
    each = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.explode(words).alias("t"))
    return each.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(X.junk_title("t")).alias("junk"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN '0' || p_size ELSE CAST(p_size AS VARCHAR) END AS padded,
'ch' || CASE WHEN p_partkey < 10 THEN '0' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS chapter,
repeat('#', least(6, p_size % 9 + 1)) || ' ' || p_name AS heading FROM part""")
def numbers(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_name")
    return parts.select("p_partkey", X.pad_number("p_size", 2).alias("padded"), X.chapter_id("p_partkey").alias("chapter"), X.heading((F.col("p_size") % 9 + 1).cast("int"), "p_name").alias("heading"))


@query(f"SELECT p_partkey, {trimmed('split_part(split_part(t, chr(32) || chr(124) || chr(32), 1), chr(32) || chr(45) || chr(32), 1)')} AS title FROM (SELECT p_partkey, p_name || ' - ' || p_brand || ' | ' || p_type AS t FROM part)")
def title_suffix(spark, sf_dir):
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return parts.select("p_partkey", X.title_before_suffix(cat(F.col("p_name"), " - ", F.col("p_brand"), " | ", F.col("p_type"))).alias("title"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(url, '([^/]*)$', 1) LIKE '%.html' THEN 'html' WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^.+\\.') THEN regexp_extract(url, '\\.([^./]*)$', 1) ELSE '' END AS ext, replace('https://doi.org/10.' || page_id, 'https://doi.org/', '') AS doi FROM pages")
def file_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return pages.select("page_id", X.file_name("url").alias("name"), X.file_extension("url").alias("ext"), X.doi_from_url(cat("https://doi.org/10.", s("page_id"))).alias("doi"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '# Part ' || n_name ELSE '## ' || n_name END AS heading,
n_nationkey % 5 = 0 AS structural, '<!-- book:chapter-start id="ch01" title="' || n_name || '" src="a.xhtml" -->' AS marker FROM nation""")
def nav_headings(spark, sf_dir):
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    label = F.when(F.col("n_nationkey") % 2 == 0, cat("Part ", F.col("n_name"))).otherwise(F.col("n_name"))
    kind = F.when(F.col("n_nationkey") % 5 == 0, "Table of Contents").otherwise(F.col("n_name"))
    return n.select("n_nationkey", X.nav_heading(label).alias("heading"), X.structural_label(kind).alias("structural"), X.start_marker(F.lit("ch01"), F.col("n_name"), F.lit("a.xhtml"), "book").alias("marker"))


# Extraction


def _extracted(rows: DataFrame, id_column: str = "id") -> DataFrame:
    return extract_documents(rows.withColumnRenamed(id_column, "id") if id_column != "id" else rows)


_UNESCAPED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TITLE = norm(_UNESCAPED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))


@query(f"SELECT page_id, nullif({trimmed(f'split_part(split_part({_TITLE}, chr(32) || chr(124) || chr(32), 1), chr(32) || chr(45) || chr(32), 1)')}, '') AS title, 'ok' AS status FROM pages")
def page_titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return _extracted(pages.select(s("page_id").alias("id"), F.lit("html").alias("ext"), F.col("html").alias("text"))).select(F.col("id").cast("long").alias("page_id"), "title", "status")


#: An article's paragraphs: each that opens with a never-closed <b> wraps all later text once more, three times at most.
_PAGE = f"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS art,
  {trimmed(f'split_part(split_part({_TITLE}, chr(32) || chr(124) || chr(32), 1), chr(32) || chr(45) || chr(32), 1)')} AS title FROM pages),
p AS (SELECT page_id, unnest(string_split(art, '<p>')) AS x, generate_subscripts(string_split(art, '<p>'), 1) AS i FROM a),
q AS (SELECT page_id, i, starts_with(x, '<b>') AS opens,
  regexp_replace(regexp_replace(regexp_replace(x, '(?s)</p>.*$', ''), '<br>', chr(10), 'g'), '<[^>]*>', '', 'g') AS raw FROM p WHERE i > 1),
r AS (SELECT page_id, i, raw, opens, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) - CASE WHEN opens THEN 1 ELSE 0 END AS before FROM q),
t AS (SELECT page_id, i, CAST(least(3, before) + CASE WHEN opens THEN 1 ELSE 0 END AS INTEGER) AS depth, {_UNESCAPED.format('raw')} AS raw FROM r),
u AS (SELECT page_id, i, {norm("repeat('**', depth) || raw || repeat('**', depth)")} AS line FROM t),
b AS (SELECT page_id, string_agg(line || chr(10) || chr(10), '' ORDER BY i) FILTER (line <> '') AS lines FROM u GROUP BY 1),
h AS (SELECT page_id, title, {norm(_UNESCAPED.format("regexp_extract(art, '(?s)<h1[^>]*>(.*?)</h1>', 1)"))} AS h1 FROM a)
SELECT h.page_id, '---' || chr(10) || 'id: ' || h.page_id || chr(10) || 'source_format: other-html' || chr(10) || CASE WHEN title <> '' THEN 'title: "' || {quoted('title')} || '"' || chr(10) ELSE '' END || '---' || chr(10) || chr(10)
  || rtrim(CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END || CASE WHEN h1 <> '' THEN '# ' || h1 || chr(10) || chr(10) ELSE '' END || coalesce(lines, ''), chr(10)) || chr(10) || chr(10) AS markdown
FROM h LEFT JOIN b ON h.page_id = b.page_id
"""


@query(_PAGE)
def page_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return _extracted(pages.select(s("page_id").alias("id"), F.lit("html").alias("ext"), F.col("html").alias("text"))).select(F.col("id").cast("long").alias("page_id"), "markdown")


_N = norm("coalesce(text, '')")
_FRONT = "'---' || chr(10) || 'id: ' || doc_id || chr(10) || 'source_format: {kind}' || chr(10) || 'title: \"T ' || doc_id || '\"' || chr(10) || 'authors:' || chr(10) || '  - \"A ' || source || '\"' || chr(10) || 'doi: \"10.1/' || doc_id || '\"' || chr(10) || 'journal: \"J ' || lang || '\"' || chr(10) || '---' || chr(10) || chr(10) || '# T ' || doc_id || chr(10) || chr(10)"
_PARA = f"CASE WHEN {_N} = '' THEN '' ELSE {_N} || chr(10) || chr(10) END"


@query(f"""SELECT doc_id, {_FRONT.format(kind='other-html')} || '## S ' || lang || chr(10) || chr(10) || {_PARA}
|| '- *' || source || '* ^' || lang || chr(10) || '- **x** _2' || chr(10) || chr(10) || '1. ' || lang || chr(10) || '2. ' || source || chr(10) || chr(10)
|| '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || source || ' |' || chr(10) || chr(10)
|| '> q ' || source || chr(10) || chr(10) || '*f ' || lang || '*' || chr(10) || chr(10) AS markdown FROM documents""")
def html_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    page = cat(
        '<!DOCTYPE html><html><head><meta name="citation_title" content="T ', s("doc_id"), '"><meta name="citation_author" content="A ', F.col("source"),
        '"><meta name="citation_doi" content="10.1/', s("doc_id"), '"><meta name="citation_journal_title" content="J ', F.col("lang"),
        '"></head><body><nav><p>menu</p></nav><article><header><p>gone</p></header>loose<h2>S ', F.col("lang"), "</h2><p>", markup("text"), "<ul><li><em>", F.col("source"),
        "</em> <sup>", F.col("lang"), "</sup><li><b>x</b> <sub>2</sub></ul><ol><li>", F.col("lang"), "<li>", F.col("source"), "</ol><table><thead><tr><th>k<th>v</thead><tr><td>v</td></tr></table>",
    )
    page = F.replace(page, F.lit("<tr><td>v</td></tr>"), cat("<tbody><tr><th>", F.col("source"), "</th><td>", F.col("lang"), "</td></tr></tbody>"))
    page = cat(page, "<blockquote><p>q ", F.col("source"), "</blockquote><figure><img src=x><figcaption>f ", F.col("lang"), "</figcaption></figure><script>var a = '</p>';</script></article><footer>end</footer></body></html>")
    return _extracted(docs.select(s("doc_id").alias("id"), F.lit("html").alias("ext"), page.alias("text"))).select(F.col("id").cast("long").alias("doc_id"), "markdown")


_XN = norm(XML_SAFE)
_XPARA = f"CASE WHEN {_XN} = '' THEN '' ELSE {_XN} || chr(10) || chr(10) END"


def _jats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", xml_safe(F.coalesce("text", F.lit(""))).alias("text"), "lang", "source")
    page = cat(
        '<?xml version="1.0" encoding="utf-16"?><!DOCTYPE article SYSTEM "x.dtd"><article><front><journal-meta><journal-title>J ', F.col("lang"), "</journal-title></journal-meta><article-meta>",
        '<article-id pub-id-type="doi">10.0/old</article-id><article-id pub-id-type="doi">10.1/', s("doc_id"), "</article-id><title-group><article-title>T <italic>", s("doc_id"), "</italic></article-title></title-group>",
        '<contrib-group><contrib contrib-type="author"><name><surname>', F.col("source"), '</surname><given-names>A</given-names></name></contrib><contrib contrib-type="editor"><name><surname>E</surname></name></contrib></contrib-group>',
        "<abstract><sec><title>Aim</title><p>a ", F.col("lang"), "</p></sec></abstract></article-meta></front><body><sec><title>One</title><p>", markup("text"), "</p><list><list-item><p>lost</p></list-item></list>",
        "<sec><title>Two</title><p>x<sup>2</sup> <bold>b</bold> <xref><italic>r</italic></xref></p></sec><table-wrap><label>Table 1</label><caption><p>c ", F.col("lang"), "</p></caption><table><thead><tr><th>k</th><td>v</td></tr></thead><tbody><tr><th>",
        F.col("source"), "</th><td>", s("doc_id"), "</td></tr><tr/></tbody></table></table-wrap><fig><label>Fig</label></fig></sec></body><back><ref-list><ref><label>1</label><mixed-citation>R ", F.col("source"), "</mixed-citation></ref><ref><element-citation>S</element-citation></ref></ref-list></back></article>",
    )
    return _extracted(docs.select(s("doc_id").alias("id"), F.lit("xml").alias("ext"), page.alias("text")))


@query(f"""SELECT doc_id, {_FRONT.format(kind='jats-xml')} || '## Abstract' || chr(10) || chr(10) || '**Aim** a ' || lang || chr(10) || chr(10) || '## One' || chr(10) || chr(10) || {_XPARA}
|| '### Two' || chr(10) || chr(10) || 'x^2 **b** r' || chr(10) || chr(10) || '**Table 1** c ' || lang || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || source || ' | ' || doc_id || ' |' || chr(10) || '|  |' || chr(10) || chr(10)
|| '**Fig** ' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '1. R ' || source || chr(10) || '- S' || chr(10) || chr(10) AS markdown FROM documents""")
def jats_roundtrip(spark, sf_dir):
    return _jats(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), "markdown")


@query("SELECT doc_id, i AS n, CASE i WHEN 1 THEN '1' ELSE '' END AS label, CASE i WHEN 1 THEN 'R ' || source ELSE 'S' END AS text FROM documents, (VALUES (1), (2)) AS v(i)")
def jats_refs(spark, sf_dir):
    refs = _jats(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), F.posexplode("references").alias("n", "r"))
    return refs.select("doc_id", (F.col("n") + 1).alias("n"), "r.label", "r.text")


@query("SELECT doc_id, 3 AS n_rows, source || ',' || doc_id AS cells FROM documents")
def jats_tables(spark, sf_dir):
    rows = _jats(spark, sf_dir)
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.size("tables").alias("n_rows"), F.array_join(F.get("tables", 1).cells, ",").alias("cells"))


@query(f"""SELECT doc_id, {_FRONT.format(kind='wiley-xml')} || '## Abstract' || chr(10) || chr(10) || 'a ' || lang || chr(10) || chr(10) || '## One' || chr(10) || chr(10) || {_XPARA}
|| 'x_2 *i* by' || chr(10) || chr(10) || '**Table 1** c ' || lang || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || source || ' | ' || doc_id || ' |' || chr(10) || chr(10)
|| '## References' || chr(10) || chr(10) || '- F, G, H, I. (2001). Title ' || lang || '. *J ' || source || '*. 7, 1-9.' || chr(10) || '- (). Book.' || chr(10) || '- plain' || chr(10) || chr(10) AS markdown FROM documents""")
def wml_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", xml_safe(F.coalesce("text", F.lit(""))).alias("text"), "lang", "source")
    page = cat(
        '<component xmlns="http://www.wiley.com/namespaces/wiley"><header><publicationMeta level="product"><titleGroup><title type="main">J ', F.col("lang"), '</title></titleGroup></publicationMeta><publicationMeta level="unit"><doi>10.1/',
        s("doc_id"), '</doi></publicationMeta><contentMeta><titleGroup><title type="short">s</title><title type="main">old</title><title type="main">T ', s("doc_id"), '</title></titleGroup><creators><creator creatorRole="author"><personName><givenNames>A</givenNames><familyName>',
        F.col("source"), '</familyName></personName></creator></creators></contentMeta></header><body><abstractGroup><abstract><p>a ', F.col("lang"), "</p></abstract></abstractGroup><section><title>One</title><p>", markup("text"), '</p><p>x<sub>2</sub> <i>i</i> by<link href="#b">gone</link></p>',
        "<tabular><label>Table 1</label><title>c ", F.col("lang"), "</title><table><tgroup><thead><row><entry>k</entry><entry>v</entry></row></thead><tbody><row><entry>", F.col("source"), "</entry><entry>", s("doc_id"), "</entry></row></tbody></tgroup></table></tabular></section>",
        '<bibliography><bib><citation><author><familyName>F</familyName><givenNames>G</givenNames></author><author><familyName>H</familyName><givenNames>I</givenNames></author><pubYear year="2001"/><articleTitle>Title ', F.col("lang"), "</articleTitle><journalTitle>J ", F.col("source"),
        "</journalTitle><vol>7</vol><pageFirst>1</pageFirst><pageLast>9</pageLast></citation></bib><bib><citation><pubYear/><bookTitle>Book</bookTitle></citation></bib><bib>plain</bib></bibliography></body></component>",
    )
    return _extracted(docs.select(s("doc_id").alias("id"), F.lit("xml").alias("ext"), page.alias("text"))).select(F.col("id").cast("long").alias("doc_id"), "markdown")


@query("SELECT p_partkey, CASE WHEN p_partkey % 100 + 1 > 64 THEN 'JATS XML nests deeper than 64 elements; refusing to parse' END AS reason FROM part")
def depth_guard(spark, sf_dir):
    # The table is narrow and its file small, so few tasks read it; the pages are made and parsed by all cores.
    parts = table(spark, sf_dir, "part", "p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    n = (F.col("p_partkey") % 100).cast("int")
    page = cat("<article>", F.repeat(F.lit("<a>"), n), F.repeat(F.lit("</a>"), n), "</article>")
    return _extracted(parts.select(s("p_partkey").alias("id"), F.lit("xml").alias("ext"), page.alias("text"))).select(F.col("id").cast("long").alias("p_partkey"), "reason")


# ePub, chapters, split


def _archive(entries: list[dict]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for e in entries:
            z.writestr(e["name"], e["text"])
    return buffer.getvalue()


def _zipped(entries):
    # Made here and not at import: a type's name is parsed by the JVM, which needs a session. A function takes along what was shipped before it.
    arrow_rows(SparkSession.active())

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array((_archive(own) for (entries,) in pieces(column) for own in entries), pa.binary())

    return run(entries)


_CONTAINER = '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>'


def _books(spark, sf_dir) -> DataFrame:
    """A book for each document: a cover, five chapters, a short page and the licence; a nav document."""
    docs = table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    names = ["cover", "c1", "c2", "c3", "c4", "empty", "legal"]
    opf = cat(
        '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>B ', s("doc_id"), "</dc:title><dc:creator>", F.col("source"), "</dc:creator><dc:identifier>10.1/", s("doc_id"),
        '</dc:identifier><dc:publisher>P</dc:publisher></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav"/>' + "".join(f'<item id="{n}" href="{n}.xhtml"/>' for n in names) + "</manifest><spine>"
        + "".join(f'<itemref idref="{n}"/>' for n in ["nav", *names]) + "</spine></package>",
    )
    nav = cat(
        '<html><body><nav epub:type="toc"><ol><li><a href="cover.xhtml">Cover</a></li><li><a href="c1.xhtml">Part ', F.col("lang"), '</a><ol><li><a href="c2.xhtml">Second</a><ol><li><a href="c2.xhtml#s1">Inner</a></li></ol></li></ol></li>',
        '<li><a href="c3.xhtml">Three</a></li><li><a href="legal.xhtml">Project Gutenberg License</a></li></ol></nav></body></html>',
    )
    page = lambda body: cat("<html><head><title>x</title></head><body>", body, "</body></html>")
    pages = {
        "cover": page("<p>cover</p>"), "c1": page(cat("<p>", markup("text"), "</p>")), "c2": page('<h2>Second</h2><p id="s1">Inner</p><p>two</p>'), "c3": page(cat("<p class=\"head\">Styled</p><p>", F.col("source"), "</p>")),
        "c4": page(cat("<h3>Four ", F.col("lang"), "</h3><p>four</p>")), "empty": page("<p> </p>"), "legal": page("<p>legal</p>"),
    }
    entry = lambda name, text: F.struct(F.lit(name).alias("name"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    entries = F.array(entry("META-INF/container.xml", _CONTAINER), entry("O/c.opf", opf), entry("O/nav.xhtml", nav), *[entry(f"O/{n}.xhtml", t) for n, t in pages.items()])
    return docs.select(s("doc_id").alias("id"), _zipped(entries).alias("content"))


_BOOK_CONFIG = replace(CONFIG, heading_classes={"P": {"head": 4}})
_HEAD = norm("coalesce(text, '')")
_CH = lambda n, title, src, body: f"'<!-- book:chapter-start id=\"{n}\" title=\"' || {title} || '\" src=\"O/{src}.xhtml\" -->' || chr(10) || chr(10) || {body} || chr(10) || chr(10) || '<!-- book:chapter-end id=\"{n}\" -->' || chr(10) || chr(10)"
_HAS = f"{_HEAD} <> ''"


def _number(k: int) -> str:
    return f"ch0' || (CASE WHEN {_HAS} THEN {k} ELSE {k - 1} END) || '"


@query(f"""SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'source_format: epub' || chr(10) || 'title: "B ' || doc_id || '"' || chr(10) || 'authors:' || chr(10) || '  - "' || source || '"' || chr(10) || 'doi: "10.1/' || doc_id || '"' || chr(10) || '---' || chr(10) || chr(10)
|| '# B ' || doc_id || chr(10) || chr(10) || '## Contents' || chr(10) || chr(10) || '- [Part ' || lang || '](#part-' || lang || ')' || chr(10) || '  - [Second](#second)' || chr(10) || '    - [Inner](#inner)' || chr(10) || '- [Three](#three)' || chr(10) || chr(10)
|| CASE WHEN {_HAS} THEN {_CH('ch01', "'Part ' || lang", 'c1', f"'# Part ' || lang || chr(10) || chr(10) || {_HEAD}")} ELSE '' END
|| {_CH(_number(2), "'Second'", 'c2', "'## Second' || chr(10) || chr(10) || '## Inner' || chr(10) || chr(10) || 'two'")}
|| {_CH(_number(3), "'Three'", 'c3', "'## Three' || chr(10) || chr(10) || '#### Styled' || chr(10) || chr(10) || source")}
|| {_CH(_number(4), "'Four ' || lang", 'c4', "'### Four ' || lang || chr(10) || chr(10) || 'four'")} AS markdown FROM documents""")
def epub_roundtrip(spark, sf_dir):
    from foliospark.operators.epub import extract_books

    return extract_books(_books(spark, sf_dir), _BOOK_CONFIG).select(F.col("id").cast("long").alias("doc_id"), "markdown")


@query(f"""WITH c AS (SELECT doc_id, unnest([CASE WHEN {_HAS} THEN 'Part ' || lang END, 'Second', 'Three', 'Four ' || lang]) AS title, unnest(['c1', 'c2', 'c3', 'c4']) AS f FROM documents)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f) AS INTEGER) AS index, title, 'O/' || f || '.xhtml' AS src FROM c WHERE title IS NOT NULL""")
def epub_chapters(spark, sf_dir):
    from foliospark.operators.epub import chapters, opened

    return chapters(opened(_books(spark, sf_dir)), _BOOK_CONFIG).select(F.col("id").cast("long").alias("doc_id"), "index", "title", "src")


@query("""SELECT doc_id, o AS ord, p AS parent_ord, d AS depth, CASE o WHEN 1 THEN 'Part ' || lang ELSE l END AS label, h AS href, f AS fragment FROM documents,
(VALUES (0, -1, 0, 'Cover', 'O/cover.xhtml', NULL), (1, -1, 0, '', 'O/c1.xhtml', NULL), (2, 1, 1, 'Second', 'O/c2.xhtml', NULL), (3, 2, 2, 'Inner', 'O/c2.xhtml', 's1'), (4, -1, 0, 'Three', 'O/c3.xhtml', NULL), (5, -1, 0, 'Project Gutenberg License', 'O/legal.xhtml', NULL)) AS v(o, p, d, l, h, f)""")
def epub_toc(spark, sf_dir):
    from foliospark.operators.epub import opened

    nav = opened(_books(spark, sf_dir)).select(F.col("id").cast("long").alias("doc_id"), F.explode("book.nav").alias("n"))
    return nav.select("doc_id", "n.*")


@query("""SELECT doc_id, p AS src, k AS kept, CASE p WHEN 'O/c1.xhtml' THEN 'Part ' || lang ELSE l END AS label, v AS level FROM documents,
(VALUES ('O/c1.xhtml', true, NULL, NULL), ('O/c2.xhtml', true, 'Second', 2), ('O/c3.xhtml', true, 'Three', NULL), ('O/c4.xhtml', true, NULL, NULL), ('O/empty.xhtml', true, NULL, NULL), ('O/legal.xhtml', false, 'Project Gutenberg License', NULL)) AS t(p, k, l, v)""")
def epub_spine_roles(spark, sf_dir):
    from foliospark.operators import epub as E

    # A row for each file takes the navigation along, not the pages of its whole book.
    files = E.opened(_books(spark, sf_dir)).select(F.col("id").cast("long").alias("doc_id"), F.col("book.nav").alias("nav"), F.transform("book.files", lambda f: f.path).alias("paths"))
    files = files.select("doc_id", "nav", F.explode("paths").alias("src"))
    known = files.select("doc_id", "src", E.nav_label(F.col("nav"), F.col("src")).alias("label"), F.try_element_at(E.toc_levels(F.col("nav"), F.col("src")), F.lit("s1")).alias("level"))
    return known.select("doc_id", "src", E.kept_file(F.col("src"), F.col("label")).alias("kept"), "label", "level")


def _marked(spark, sf_dir) -> DataFrame:
    """A book of two chapters for each document; every seventh lacks the second end marker, every eleventh has no markers."""
    docs = table(spark, sf_dir, "documents", "doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("text"), "lang", "source")
    start = lambda n, t: cat(f'<!-- book:chapter-start id="ch0{n}" title="', t, f'" src="d/f{n}.xhtml" -->\n')
    front = cat("---\nid: ", s("doc_id"), "\n---\n\nPre ", F.col("source"), "\n\n")
    last = F.when(F.col("doc_id") % 7 == 0, "").otherwise('<!-- book:chapter-end id="ch02" -->\n')
    body = cat(start(1, cat("One ", F.col("lang"))), F.col("text"), '\n<!-- book:chapter-end id="ch01" -->\nstray\n', start(2, cat("One ", F.col("lang"))), "two\n", last)
    return docs.select(s("doc_id").alias("book"), cat(front, F.when(F.col("doc_id") % 11 == 0, "").otherwise(body)).alias("markdown"))


_CLEAN = "replace(coalesce(text, ''), chr(13), '')"


@query(f"""SELECT doc_id, i AS index, 'ch0' || i AS chapter_id, 'One ' || lang AS title, 'd/f' || i || '.xhtml' AS src, CASE i WHEN 1 THEN {_CLEAN} || chr(10) ELSE 'two' || chr(10) END AS body
FROM documents, (VALUES (1), (2)) AS v(i) WHERE doc_id % 11 <> 0 AND (i = 1 OR doc_id % 7 <> 0)""")
def chapter_parse(spark, sf_dir):
    from foliospark.operators.chapters import parse_chapters

    return parse_chapters(_marked(spark, sf_dir))[1].select(F.col("book").cast("long").alias("doc_id"), "index", "chapter_id", "title", "src", "body")


@query("""SELECT doc_id, 'id: ' || doc_id || chr(10) AS frontmatter, 'Pre ' || source AS preamble, CASE WHEN doc_id % 7 = 0 AND doc_id % 11 <> 0 THEN 'chapter "ch02" has no matching chapter-end' END AS error FROM documents""")
def chapter_state(spark, sf_dir):
    from foliospark.operators.chapters import parse_chapters

    return parse_chapters(_marked(spark, sf_dir))[0].select(F.col("book").cast("long").alias("doc_id"), "frontmatter", "preamble", "error")


@query(f"""WITH f AS (SELECT doc_id, i, lang, source, CASE i WHEN 1 THEN {_CLEAN} ELSE 'two' END AS body FROM documents, (VALUES (0), (1), (2)) AS v(i) WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0),
g AS (SELECT doc_id, i, CASE i WHEN 0 THEN CAST(doc_id AS VARCHAR) ELSE 'One ' || lang END AS title,
 'out/' || doc_id || '/' || CASE i WHEN 0 THEN '00-frontmatter.md' WHEN 1 THEN 'one-' || lang || '.md' ELSE 'one-' || lang || '-2.md' END AS path,
 CASE i WHEN 0 THEN '---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || chr(10) || 'Pre ' || source || chr(10)
 ELSE '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'chapter: ' || i || chr(10) || 'chapter_title: "One ' || lang || '"' || chr(10) || 'source: "d/f' || i || '.xhtml"' || chr(10) || '---' || chr(10) || chr(10) || {trimmed('body')} || chr(10) END AS content FROM f)
SELECT doc_id, i AS index, title, path, CAST(strlen(content) AS BIGINT) AS bytes, content FROM g""")
def split_files(spark, sf_dir):
    from foliospark.operators import split

    out = split.split_files(_marked(spark, sf_dir), C.SplitConfig(file="{slug}.md"), "out")
    return out.select(F.col("book").cast("long").alias("doc_id"), "index", "title", "path", "bytes", "content")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'no_chapters' ELSE 'extraction_failed' END AS kind, CASE WHEN doc_id % 11 = 0 THEN 'no chapter markers in ' || doc_id ELSE 'chapter "ch02" has no matching chapter-end' END AS message
FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0""")
def split_errors(spark, sf_dir):
    from foliospark.operators import split

    return split.split_errors(_marked(spark, sf_dir)).select(F.col("book").cast("long").alias("doc_id"), "kind", "message")


# Inputs and reports


def _listing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    kinds = docs.select("doc_id", F.explode(F.array(F.lit("epub"), F.lit("html"), F.lit("xml"))).alias("ext"))
    have = kinds.filter(((F.col("ext") == "xml") & (F.col("doc_id") % 2 == 0)) | ((F.col("ext") == "html") & (F.col("doc_id") % 3 == 0)) | ((F.col("ext") == "epub") & (F.col("doc_id") % 5 == 0)))
    return have.select(s("doc_id").alias("id"), "ext", cat("in/", s("doc_id"), ".", F.col("ext")).alias("path"))


_FIRST = "CASE WHEN doc_id % 2 = 0 THEN 'xml' WHEN doc_id % 3 = 0 THEN 'html' WHEN doc_id % 5 = 0 THEN 'epub' END"


@query(f"SELECT DISTINCT doc_id, {_FIRST} AS ext FROM documents WHERE {_FIRST} IS NOT NULL")
def resolve_priority(spark, sf_dir):
    from foliospark.sources.files import lookup

    ids = table(spark, sf_dir, "documents", s("doc_id").alias("id"))
    return lookup(ids, _listing(spark, sf_dir))[0].select(F.col("id").cast("long").alias("doc_id"), "ext")


@query(f"SELECT DISTINCT doc_id FROM documents WHERE {_FIRST} IS NULL")
def resolve_missing(spark, sf_dir):
    from foliospark.sources.files import lookup

    ids = table(spark, sf_dir, "documents", s("doc_id").alias("id"))
    return lookup(ids, _listing(spark, sf_dir))[1].select(F.col("id").cast("long").alias("doc_id"))


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS ok, count(*) FILTER (doc_id % 3 = 1) AS skipped, count(*) FILTER (doc_id % 3 = 2) AS failed, count(*) FILTER (doc_id % 3 = 2) > 0 AS any_failed FROM documents")
def status_report(spark, sf_dir):
    from foliospark.report import status_counts

    docs = table(spark, sf_dir, "documents", "doc_id")
    return status_counts(docs.select(F.element_at(F.array(F.lit("ok"), F.lit("skipped"), F.lit("failed")), (F.col("doc_id") % 3 + 1).cast("int")).alias("status")))


@query(f"""WITH d AS (SELECT doc_id, '# T ' || doc_id || chr(10) || chr(10) || {_N} AS md FROM documents),
l AS (SELECT doc_id, md, unnest(string_split(md, chr(10))) AS line FROM d)
SELECT doc_id, sha256(any_value(md)) AS sha256, CAST(strlen(any_value(md)) AS BIGINT) AS bytes, count(*) FILTER (starts_with(line, '#')) AS headings,
CAST(sum(CASE WHEN starts_with(line, '#') OR {norm('line')} = '' THEN 0 ELSE len(string_split({norm('line')}, ' ')) END) AS BIGINT) AS words FROM l GROUP BY doc_id""")
def skeleton(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    md = docs.select("doc_id", cat("# T ", s("doc_id"), "\n\n", X.normalize_text("text")).alias("md"))
    return md.select("doc_id", X.skeleton("md").alias("k")).select("doc_id", "k.sha256", "k.bytes", "k.headings", "k.words")


@query("""WITH v AS (SELECT doc_id, '# A ' || lang || chr(10) || 'x' || chr(10) || chr(10) || '## B' || chr(10) || 'one two ' || source || chr(10) || 'three' || chr(10) || '### C' AS md, lang, source FROM documents)
SELECT doc_id, n, heading, CAST(w AS BIGINT) AS words FROM v, LATERAL (VALUES (1, '# A ' || lang, 1), (2, '## B', 3 + len(string_split(trim(source), ' '))), (3, '### C', 0)) AS t(n, heading, w)""")
def skeleton_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    md = docs.select("doc_id", cat("# A ", F.col("lang"), "\nx\n\n## B\none two ", F.col("source"), "\nthree\n### C").alias("md"))
    found = md.select("doc_id", F.posexplode(X.skeleton("md").sections).alias("at", "section"))
    return found.select("doc_id", (F.col("at") + 1).alias("n"), "section.heading", "section.words")


@query("SELECT doc_id, p AS path FROM documents, (VALUES ('t/fig1.xhtml'), ('t/table2.xhtml')) AS v(p) WHERE p <> CASE WHEN doc_id % 2 = 0 THEN 't/fig1.xhtml' ELSE '' END")
def overflow_except(spark, sf_dir):
    from foliospark.operators.epub import opened

    docs = table(spark, sf_dir, "documents", "doc_id")
    ids = F.when(F.col("doc_id") % 2 == 0, '<itemref idref="a"/><itemref idref="f"/>').otherwise('<itemref idref="a"/>')
    opf = cat('<package><metadata/><manifest><item id="a" href="a.xhtml"/><item id="f" href="fig1.xhtml"/></manifest><spine>', ids, "</spine></package>")
    entry = lambda name, text: F.struct(F.lit(name).alias("name"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    container = _CONTAINER.replace("O/c.opf", "t/c.opf")
    entries = F.array(entry("META-INF/container.xml", container), entry("t/c.opf", opf), *[entry(n, "<p>x</p>") for n in ("t/a.xhtml", "t/fig1.xhtml", "t/table2.xhtml", "t/fig.css", "u/fig3.xhtml")])
    books = opened(docs.select(s("doc_id").alias("id"), _zipped(entries).alias("content")))
    files = books.select(F.col("id").cast("long").alias("doc_id"), F.posexplode("book.files").alias("at", "file"))
    return files.filter(F.col("at") >= F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).select("doc_id", F.col("file.path").alias("path"))


def _papers(spark, sf_dir) -> DataFrame:
    """A short ePub for each document: one page with metadata in its markup, a table beside it, an NCX and a style sheet."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    opf = cat(
        '<package><metadata><title>Package</title><creator>Nobody</creator></metadata><manifest><item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>',
    )
    page = cat(
        '<html><head><title>x</title></head><body><h1 property="name">Paper ', s("doc_id"), '</h1><span property="author"><span property="givenName">Ann</span> <span property="familyName">', F.col("source"), '</span></span>',
        '<a property="sameAs" href="https://doi.org/10.5/', s("doc_id"), '">d</a><span typeof="Periodical"><span property="name">J ', F.col("lang"), "</span></span><p>text</p></body></html>",
    )
    ncx = cat('<ncx><navMap><navPoint><navLabel><text>P ', F.col("lang"), '</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>In</text></navLabel><content src="a.xhtml#s"/></navPoint></navPoint><navPoint><navLabel><text>Last</text></navLabel></navPoint></navMap></ncx>')
    css = ".class1 { text-align: center; font-size: 2em }\n.class2 { text-align: center; font-size: 1.5em }\n.class3 { text-align: center; font-size: 1.4em; font-weight: bold }\n.class4 { text-align: left; font-size: 1.5em }\n.other { text-align: center; font-size: 1.2em }"
    entry = lambda name, text: F.struct(F.lit(name).alias("name"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    entries = F.array(entry("META-INF/container.xml", _CONTAINER), entry("O/c.opf", opf), entry("O/t.ncx", ncx), entry("O/s.css", css), entry("O/a.xhtml", page), entry("O/table1.xhtml", cat("<p>beside ", s("doc_id"), "</p>")))
    return docs.select(s("doc_id").alias("id"), _zipped(entries).alias("content"))


@query("SELECT doc_id, 'Paper ' || doc_id AS title, 'Ann ' || source AS authors, '10.5/' || doc_id AS doi, 'J ' || lang AS journal, true AS beside, 'ok' AS status FROM documents")
def epub_papers(spark, sf_dir):
    from foliospark.operators.epub import extract_books

    out = extract_books(_papers(spark, sf_dir))
    return out.select(F.col("id").cast("long").alias("doc_id"), "title", F.array_join("authors", ",").alias("authors"), "doi", "journal", F.col("body").contains(F.concat(F.lit("beside "), F.col("id"))).alias("beside"), "status")


@query("""SELECT doc_id, o AS ord, p AS parent_ord, d AS depth, CASE o WHEN 0 THEN 'P ' || lang ELSE l END AS label, h AS href, f AS fragment FROM documents,
(VALUES (0, -1, 0, '', 'O/a.xhtml', NULL), (1, 0, 1, 'In', 'O/a.xhtml', 's'), (2, -1, 0, 'Last', '', NULL)) AS v(o, p, d, l, h, f)""")
def epub_ncx(spark, sf_dir):
    from foliospark.operators.epub import opened

    return opened(_papers(spark, sf_dir)).select(F.col("id").cast("long").alias("doc_id"), F.explode("book.nav").alias("n")).select("doc_id", "n.*")


@query("SELECT doc_id, 'class2' AS classes FROM documents")
def epub_subheading_classes(spark, sf_dir):
    from foliospark.operators.epub import opened

    return opened(_papers(spark, sf_dir)).select(F.col("id").cast("long").alias("doc_id"), F.array_join("book.classes", ",").alias("classes"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'malformed chapter-start marker: <!-- book:chapter-start id="ch01" title="A" b" src="f" -->' WHEN doc_id % 3 = 1 THEN 'chapter "ch01" has no matching chapter-end' END AS error FROM documents""")
def chapter_errors(spark, sf_dir):
    from foliospark.operators.chapters import parse_chapters

    docs = table(spark, sf_dir, "documents", "doc_id")
    title = F.when(F.col("doc_id") % 3 == 0, 'A" b').otherwise("A b")
    end = F.when(F.col("doc_id") % 3 == 1, "").otherwise('<!-- book:chapter-end id="ch01" -->\n')
    md = docs.select(s("doc_id").alias("book"), cat('<!-- book:chapter-start id="ch01" title="', title, '" src="f" -->\nx\n', end).alias("markdown"))
    return parse_chapters(md)[0].select(F.col("book").cast("long").alias("doc_id"), "error")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'no text' WHEN 1 THEN 'unknown format' WHEN 2 THEN 'not UTF-8' END AS reason, CASE WHEN doc_id % 4 = 3 THEN 'ok' ELSE 'failed' END AS status FROM documents""")
def extract_failures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id")
    k = F.col("doc_id") % 4
    page = F.when(k == 0, None).when(k == 3, "<html><body><article><p>x</p></article></body></html>").otherwise("<plain/>")
    rows = docs.select(s("doc_id").alias("id"), F.when(k == 1, "xml").otherwise("html").alias("ext"), page.alias("text"), F.when(k == 2, "not UTF-8").alias("reason"))
    return extract_documents(rows).select(F.col("id").cast("long").alias("doc_id"), "reason", "status")
