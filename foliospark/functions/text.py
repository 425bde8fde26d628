"""Text rules as Column functions: no Python worker, and Catalyst sees through them.

WS is the Unicode White_Space class, spelt out so that Java's and RE2's regular expressions agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CLASS = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_white(x) -> Column:
    return F.regexp_replace(_c(x), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def normalize_text(x) -> Column:
    """Each run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(x), f"{WS_CLASS}+", " "))


def lines(x) -> Column:
    return F.split(F.regexp_replace(_c(x), r"\r?\n\z", ""), r"\r?\n", -1)


def is_blank(x) -> Column:
    return trim_white(x) == ""


def collapse_blanks(x) -> Column:
    """Of a run of blank lines the first stays, empty; every line ends in a newline."""
    ended = F.replace(F.regexp_replace(_c(x), r"\r?\n\z", ""), F.lit("\r\n"), F.lit("\n"))
    # White space from a line's start up to its own or a later line's end: a run of blank lines. The text is looked at once.
    kept = F.regexp_replace(ended, rf"(\A|\n){WS_CLASS}*(?=\n|\z)", "$1")
    return F.when(_c(x) == "", "").otherwise(F.concat(kept, F.lit("\n")))


def escape_yaml(x) -> Column:
    return F.replace(F.replace(_c(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def heading_slug(x) -> Column:
    plain = F.regexp_replace(F.lower(_c(x)), r"[^\p{IsAlphabetic}\p{N} -]", "")
    return F.regexp_replace(F.regexp_replace(plain, "[ -]+", "-"), "^-|-$", "")


def sanitize_attr(x) -> Column:
    """A value that fits between the quotes of an HTML comment's attribute."""
    out = F.replace(normalize_text(x), F.lit(">"), F.lit(""))
    out = F.replace(out, F.lit('"'), F.lit("'"))
    return trim_white(F.replace(out, F.lit("--"), F.lit("–")))


def heading(depth, x) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.least(_c(depth), F.lit(6))), F.lit(" "), _c(x))


def pad_number(n, width: int) -> Column:
    digits = _c(n).cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def chapter_id(n) -> Column:
    return F.concat(F.lit("ch"), pad_number(n, 2))


def byte_prefix(x, size: int) -> Column:
    """The first bytes as text; a cut code point becomes U+FFFD, which no marker contains."""
    return F.make_valid_utf8(F.substring(F.encode(_c(x), "UTF-8"), 1, size).cast("string"))


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def file_stem(path) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^[^.]*$|^\.[^.]*$"), name).otherwise(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def file_extension(path) -> Column:
    """Case-sensitive; a dot file has none."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def source_stem(path) -> Column:
    """The name without its last extension; empty for a name without a dot."""
    return F.regexp_extract(_c(path), r"([^/]*)\.[^./]*$", 1)


def title_before_suffix(x) -> Column:
    return trim_white(F.split_part(F.split_part(_c(x), F.lit(" | "), F.lit(1)), F.lit(" - "), F.lit(1)))


def junk_title(x) -> Column:
    t = trim_white(x)
    odd = ~t.contains(" ") & (t.rlike("[0-9]") | ~t.rlike(r"^\p{IsAlphabetic}*$") | (F.octet_length(t) <= 3))
    return (t == "") | F.lower(t).isin("cover", "nav", "title page") | odd


def doi_from_url(x) -> Column:
    return F.regexp_replace(_c(x), r"^https?://doi\.org/", "")


def kilobytes(n) -> Column:
    return F.floor(_c(n) / 1024).cast("long")


def structural_label(x) -> Column:
    return F.lower(_c(x)).isin("cover", "cover page", "title page", "contents", "table of contents")


def nav_heading(label) -> Column:
    t = trim_white(label)
    return F.when(t == "", "").when(F.lower(t).startswith("part "), F.concat(F.lit("# "), t)).otherwise(F.concat(F.lit("## "), t))


def first_heading_text(md) -> Column:
    """Text of the first line that starts with #; null if that line has none."""
    line = F.get(F.filter(lines(md), lambda s: s.rlike(f"^{WS_CLASS}*#")), 0)
    return F.nullif(trim_white(F.regexp_replace(line, f"^{WS_CLASS}*#+", "")), F.lit(""))


def start_marker(id_, title, src, prefix: str) -> Column:
    part = lambda name, v: F.concat(F.lit(f' {name}="'), sanitize_attr(v), F.lit('"'))
    return F.concat(F.lit(f"<!-- {prefix}:chapter-start"), part("id", id_), part("title", title), part("src", src), F.lit(" -->"))


def end_marker(id_, prefix: str) -> Column:
    return F.concat(F.lit(f'<!-- {prefix}:chapter-end id="'), sanitize_attr(id_), F.lit('" -->'))


def frontmatter(id_, kind, title, authors, doi, journal) -> Column:
    quoted = lambda key, v: F.when(v.isNotNull(), F.concat(F.lit(f'{key}: "'), v, F.lit('"\n')))
    people = F.when(F.size(authors) > 0, F.concat(F.lit("authors:\n"), F.array_join(F.transform(authors, lambda a: F.concat(F.lit('  - "'), escape_yaml(a), F.lit('"\n'))), "")))
    parts = [
        F.concat(F.lit("---\nid: "), id_, F.lit("\nsource_format: "), kind, F.lit("\n")),
        quoted("title", escape_yaml(title)), people, quoted("doi", doi), quoted("journal", escape_yaml(journal)), F.lit("---\n\n"),
    ]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def document(id_, kind, title, authors, doi, journal, body) -> Column:
    whole = F.concat(frontmatter(id_, kind, title, authors, doi, journal), body)
    return F.when(whole.endswith("\n"), whole).otherwise(F.concat(whole, F.lit("\n")))


def without_doctype(x) -> Column:
    return F.regexp_replace(_c(x), r"(?s)^(.*?)<!DOCTYPE[^>]*>", "$1")


def em_size(css_block) -> Column:
    """The first font-size of a CSS rule, if it is in em."""
    return F.regexp_extract(_c(css_block), r"(?s)font-size[^:]*:\s*([0-9.]+)\s*em", 1).try_cast("float")


def skeleton(md) -> Column:
    """What regression tests keep of a Markdown text: sha256, bytes, headings and words in all, and `sections`, the words
    between each heading and the next."""
    rows = F.split(_c(md), "\n", -1)
    words = lambda x: F.when(x.startswith("#") | (normalize_text(x) == ""), 0).otherwise(F.size(F.split(normalize_text(x), " "))).cast("long")
    section = lambda h, n: F.struct(h.alias("heading"), n.alias("words"))
    nothing = F.array().cast("array<struct<heading:string,words:bigint>>")

    def step(done, x):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(section(last.heading, last.words + words(x))))
        return F.when(x.startswith("#"), F.concat(done, F.array(section(x, F.lit(0).cast("long"))))).when(F.size(done) > 0, grown).otherwise(done)

    total = F.aggregate(F.transform(rows, words), F.lit(0).cast("long"), lambda a, b: a + b)
    heads = F.size(F.filter(rows, lambda x: x.startswith("#"))).cast("long")
    return F.struct(F.sha2(_c(md), 256).alias("sha256"), F.octet_length(_c(md)).cast("long").alias("bytes"), heads.alias("headings"), total.alias("words"), F.aggregate(rows, nothing, step).alias("sections"))
