"""A publisher's HTML page: metadata from its head, Markdown from its body container."""

from __future__ import annotations


from foliospark.config import Profile
from foliospark.dom import css, html5
from foliospark.dom.html5 import Element
from foliospark.errors import ExtractFailure
from foliospark.operators.plain import collapse_blanks, lines, normalize, trim

MAX_DEPTH = 512
_LEVEL = {"h1": "#", "h2": "##", "h3": "###", "h4": "####", "h5": "#####", "h6": "#####"}
_WRAP = {"b": ("**", "**"), "strong": ("**", "**"), "i": ("*", "*"), "em": ("*", "*"), "sup": ("^", ""), "sub": ("_", "")}
_NO_BLOCK = frozenset("script style noscript iframe svg img".split())
_NO_INLINE, _NO_TEXT = frozenset("script style svg img".split()), frozenset("script style svg".split())


def text_of(e: Element, depth: int = 0) -> str:
    if depth >= MAX_DEPTH:
        return ""
    out = []
    for c in e.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag not in _NO_TEXT:
            out.append(text_of(c, depth + 1))
    return "".join(out)


class Walker:
    def __init__(self, cruft: list[str]):
        self.cruft = css.by_subject(tuple(cruft))
        self.out: list[str] = []

    def is_cruft(self, e: Element) -> bool:
        by_tag, attributed, others = self.cruft
        own = by_tag.get(e.tag)
        return bool((own and css.matches(e, own)) or (e.attrs and css.matches(e, attributed)) or (others and css.matches(e, others)))

    def inline(self, e: Element, depth: int = 0) -> str:
        if depth >= MAX_DEPTH:
            return ""
        out = []
        for c in e.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br" and not self.is_cruft(c):
                out.append("\n")
            elif c.tag not in _NO_INLINE and not self.is_cruft(c):
                before, after = _WRAP.get(c.tag, ("", ""))
                out += (before, self.inline(c, depth + 1), after)
        return "".join(out)

    def block(self, e: Element, depth: int = 0) -> None:
        if depth >= MAX_DEPTH or self.is_cruft(e):
            return
        tag, say = e.tag, self.out.append
        if tag in _LEVEL:
            if t := normalize(text_of(e)):
                say(f"{_LEVEL[tag]} {t}\n\n")
        elif tag == "p":
            if t := normalize(self.inline(e)):
                say(f"{t}\n\n")
        elif tag in ("ul", "ol"):
            for n, item in enumerate((c for c in e.elements() if c.tag == "li"), 1):
                if t := normalize(self.inline(item)):
                    say(f"{n}. {t}\n" if tag == "ol" else f"- {t}\n")
            say("\n")
        elif tag == "table":
            self.table(e)
            say("\n")
        elif tag == "figcaption":
            if t := normalize(text_of(e)):
                say(f"*{t}*\n\n")
        elif tag == "blockquote":
            if t := normalize(text_of(e)):
                say("".join(f"> {x}\n" for x in lines(t)) + "\n")
        elif tag not in _NO_BLOCK:
            for c in e.elements():
                self.block(c, depth + 1)

    def table(self, e: Element) -> None:
        """The first head and the first body; in body rows the data cells come before the row's headings."""
        for part, kinds in (("thead", ("th", "td")), ("tbody", ("td", "th"))):
            found = next((d for d in e.descendants() if d.tag == part), None)
            for row in (d for d in found.descendants() if d.tag == "tr") if found else ():
                below = list(row.descendants())
                cells = [normalize(text_of(d)) for kind in kinds for d in below if d.tag == kind]
                if cells:
                    self.out.append(f"| {' | '.join(cells)} |\n")
                    if part == "thead":
                        self.out.append(f"| {' | '.join('---' for _ in cells)} |\n")


def preflight(html: str, profile: Profile) -> None:
    if profile.abstract_only:
        raise ExtractFailure("abstract-only format")
    if profile.fulltext_required and profile.fulltext_required not in html:
        raise ExtractFailure("abstract-only (no fulltext)")
    if profile.no_content_marker and profile.no_content_marker in html and not (profile.content_marker and profile.content_marker in html):
        raise ExtractFailure("no-content page (abstract only)")


def title_before_suffix(t: str) -> str:
    return trim(t.split(" | ")[0].split(" - ")[0])


def metadata(document: Element) -> dict:
    every = list(document.descendants())
    named = [(e.attrs.get("name", ""), e.attrs.get("content", "")) for e in every if e.tag == "meta" and e.attrs.get("content")]
    first = lambda *names: next((v for k, v in named if k in names), None)
    title = first("citation_title", "dc.Title", "DC.Title")
    if title is None:
        element = next((e for e in every if e.tag == "title"), None)
        title = element and title_before_suffix(normalize(text_of(element))) or None
    authors = [v for k, v in named if k == "citation_author"] or [normalize(v) for k, v in named if k in ("dc.Creator", "DC.Creator")]
    return {"title": title, "authors": authors, "doi": first("citation_doi", "DOI"), "journal": first("citation_journal_title")}


def extract(html: str, profile: Profile, strip_refs: bool = False) -> dict:
    """Metadata and body, or ExtractFailure."""
    preflight(html, profile)
    document = html5.parse(html)
    meta = metadata(document)
    body = next((e for s in profile.body_selectors if (c := css.compile_selector(s)) and (e := css.first(document, c)) is not None), None)
    if body is None:
        raise ExtractFailure("no content container found")
    cruft = [*profile.cruft_selectors, *([profile.ref_selector] if strip_refs and profile.ref_selector else [])]
    w = Walker(cruft)
    if meta["title"] is not None:
        w.out.append(f"# {meta['title']}\n\n")
    w.block(body)
    return meta | {"body": collapse_blanks("".join(w.out))}


