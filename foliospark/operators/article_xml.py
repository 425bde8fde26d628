"""Article XML: the JATS/NLM vocabulary and the WML3G vocabulary, each to metadata, Markdown and typed parts."""

from __future__ import annotations

from foliospark.dom import xml
from foliospark.dom.xml import Node, XmlError, local
from foliospark.errors import ExtractFailure
from foliospark.operators.plain import collapse_blanks, normalize, trim

_MARKS = {"italic": ("*", "*"), "i": ("*", "*"), "bold": ("**", "**"), "b": ("**", "**"), "sup": ("^", ""), "sub": ("_", "")}


class Vocabulary:
    """Names of one vocabulary, and the sections, tables and figures both have in common."""

    section, paragraph, table, figure = "sec", "p", "table-wrap", "fig"
    name = "JATS XML"

    def __init__(self) -> None:
        self.out: list[str] = []
        self.references: list[dict] = []
        self.tables: list[dict] = []

    def inline(self, node: Node) -> str:
        out = []
        for c in node.children:
            if isinstance(c, str):
                out.append(c)
            else:
                out.append(self.inline_element(local(c.name), c))
        return "".join(out)

    def inline_element(self, name: str, c: Node) -> str:
        if name == "xref":
            return c.text()
        before, after = _MARKS.get(name, ("", ""))
        return before + self.inline(c) + after

    def paragraphs(self, node: Node, loose: bool = False) -> str:
        out = []
        for c in node.children:
            if isinstance(c, str):
                t = normalize(c) if loose else ""
            else:
                t = normalize(self.inline(c)) if local(c.name) == "p" else ""
            if t:
                out.append(t + "\n\n")
        return "".join(out)

    def sections(self, parent: Node, depth: int) -> None:
        for c in parent.elements():
            name = local(c.name)
            if name == self.section:
                title = c.child("title")
                if title is not None and (t := normalize(title.text())):
                    self.out.append(f"{'#' * depth} {t}\n\n")
                self.sections(c, min(depth + 1, 6))
            elif name == self.paragraph:
                if t := normalize(self.inline(c)):
                    self.out.append(t + "\n\n")
            elif name == self.table:
                self.caption(*self.table_caption(c))
                self.rows(c)
                self.out.append("\n")
            elif name == self.figure:
                self.caption(*self.figure_caption(c))

    def caption(self, label: str, text: str) -> None:
        if label or text:
            self.out.append(f"**{trim(label)}** {text}\n\n")

    def row(self, cells: list[str], head: bool) -> None:
        self.out.append(f"| {' | '.join(cells)} |\n")
        if head:
            self.out.append(f"| {' | '.join('---' for _ in cells)} |\n")
        self.tables.append({"head": head, "cells": cells})

    def abstract(self, node: Node, loose: bool, gap: str) -> None:
        self.out.append("## Abstract\n\n")
        parts = list(node.elements(self.section))
        for part in parts:
            title = part.child("title")
            if title is not None and (t := title.text()):
                self.out.append(f"**{t}** ")
            self.out.append(self.paragraphs(part) + gap)
        if not parts:
            self.out.append(self.paragraphs(node, loose))
        self.out.append("\n")

    def reference(self, label: str, text: str, line: str) -> None:
        if text:
            self.out.append(line + "\n")
            self.references.append({"label": label, "text": text})


def _label(node: Node) -> str:
    found = node.child("label")
    return found.text() if found is not None else ""


def _person(node: Node | None, given: str, family: str) -> str:
    parts = [trim(c.text()) if node is not None and (c := node.child(n)) is not None else "" for n in (given, family)]
    return trim(" ".join(parts))


class Jats(Vocabulary):
    def figure_caption(self, node: Node) -> tuple[str, str]:
        caption = node.find("caption")
        if caption is None:
            return _label(node), ""
        p = caption.child("p")
        return _label(node), normalize((caption if p is None else p).text())

    table_caption = figure_caption

    def rows(self, node: Node) -> None:
        table = node.find("table")
        for part in ("thead", "tbody") if table is not None else ():
            found = table.child(part)
            for tr in found.elements("tr") if found is not None else ():
                self.row([normalize(c.text()) for c in tr.elements("th", "td")], part == "thead")

    def metadata(self, root: Node) -> dict:
        meta: dict = {"title": None, "authors": [], "doi": None, "journal": None}
        if (article := root.find("article-meta")) is not None:
            if (t := article.find("article-title")) is not None:
                meta["title"] = normalize(t.text()) or None
            for i in article.elements("article-id"):
                if i.attrs.get("pub-id-type") == "doi":
                    meta["doi"] = trim(i.text()) or meta["doi"]
            group = article.find("contrib-group")
            for c in group.elements("contrib") if group is not None else ():
                if c.attrs.get("contrib-type") == "author":
                    name = c.child("string-name")
                    name = _person(c.child("name") if name is None else name, "given-names", "surname")
                    meta["authors"] += [name] if name else []
        if (journal := root.find("journal-meta")) is not None and (t := journal.find("journal-title")) is not None:
            meta["journal"] = trim(t.text()) or None
        return meta

    def run(self, root: Node) -> None:
        if (a := root.find("abstract")) is not None:
            self.abstract(a, True, "\n")
        if (b := root.find("body")) is not None:
            self.sections(b, 2)
        if (refs := root.find("ref-list")) is not None:
            self.out.append("## References\n\n")
            for ref in refs.elements("ref"):
                label = _label(ref)
                cite = next(ref.elements("mixed-citation", "element-citation"), ref)
                text = normalize(cite.text())
                self.reference(label, text, f"{label}. {text}" if label else f"- {text}")
            self.out.append("\n")


class Wml(Vocabulary):
    section, table, figure = "section", "tabular", "figure"
    name = "Wiley XML"

    def inline_element(self, name: str, c: Node) -> str:
        if name == "link":
            return ""
        return self.inline(c) if name == "xref" else super().inline_element(name, c)

    def table_caption(self, node: Node) -> tuple[str, str]:
        title = node.child("title")
        return _label(node), normalize(title.text()) if title is not None else ""

    def figure_caption(self, node: Node) -> tuple[str, str]:
        caption = node.find("caption")
        return _label(node), normalize(caption.text()) if caption is not None else ""

    def rows(self, node: Node) -> None:
        table = node.find("table")
        group = table.child("tgroup") if table is not None else None
        for part in ("thead", "tbody") if group is not None else ():
            found = group.child(part)
            for r in found.elements("row") if found is not None else ():
                self.row([normalize(c.text()) for c in r.elements("entry")], part == "thead")

    def metadata(self, root: Node) -> dict:
        meta: dict = {"title": None, "authors": [], "doi": None, "journal": None}

        def main_title(parent: Node, clean, old):
            group = parent.child("titleGroup")
            for t in group.elements("title") if group is not None else ():
                if t.attrs.get("type") == "main":
                    old = clean(t.text()) or old
            return old

        header = root.child("header")
        if header is None:
            return meta
        if (content := header.child("contentMeta")) is not None:
            meta["title"] = main_title(content, normalize, None)
            creators = content.child("creators")
            for c in creators.elements("creator") if creators is not None else ():
                if c.attrs.get("creatorRole") == "author" and (name := _person(c.child("personName"), "givenNames", "familyName")):
                    meta["authors"].append(name)
        for p in header.elements("publicationMeta"):
            if p.attrs.get("level") == "unit" and (doi := p.child("doi")) is not None:
                meta["doi"] = trim(doi.text()) or meta["doi"]
            if p.attrs.get("level") == "product":
                meta["journal"] = main_title(p, trim, meta["journal"])
        return meta

    def run(self, root: Node) -> None:
        if (group := root.find("abstractGroup")) is not None and (a := group.find("abstract")) is not None:
            self.abstract(a, False, "")
        if (body := root.child("body")) is None:
            return
        self.sections(body, 2)
        if (refs := body.find("bibliography")) is not None:
            self.out.append("## References\n\n")
            for bib in refs.elements("bib"):
                cite = bib.child("citation")
                text = self.citation(cite) if cite is not None else normalize(bib.text())
                self.reference("", text, f"- {text}")
            self.out.append("\n")

    @staticmethod
    def citation(c: Node) -> str:
        value = lambda n: "" if (x := c.child(n)) is None else x.text()
        parts = []
        if people := [", ".join(trim(x.text()) if (x := a.child(n)) is not None else "" for n in ("familyName", "givenNames")) for a in c.elements("author")]:
            parts.append(", ".join(people))
        if (year := c.child("pubYear")) is not None:
            parts.append(f"({year.attrs.get('year', year.text())})")
        kind = next((n for n in ("articleTitle", "chapterTitle", "bookTitle") if c.child(n) is not None), None)
        parts += [t] if kind and (t := normalize(value(kind))) else []
        parts += [f"*{j}*"] if (j := normalize(value("journalTitle"))) else []
        volume, first, last = (trim(value(n)) for n in ("vol", "pageFirst", "pageLast"))
        if volume:
            parts.append(f"{volume}, {first}-{last}" if first and last else volume)
        return ". ".join(parts) + "." if parts else normalize(c.text())


def without_doctype(text: str) -> str:
    """Drops from the first declaration to the first > after it."""
    at = text.find("<!DOCTYPE")
    end = text.find(">", at) if at >= 0 else -1
    return text if end < 0 else text[:at] + text[end + 1 :]


def extract(text: str, vocabulary: type[Vocabulary]) -> dict:
    if vocabulary is Jats:
        text = without_doctype(text)
    if xml.deeper_than(text):
        raise ExtractFailure(f"{vocabulary.name} nests deeper than {xml.MAX_DEPTH} elements; refusing to parse")
    try:
        root = xml.parse(text)
    except XmlError as e:
        raise ExtractFailure(f"parsing {vocabulary.name}: {e}") from e
    v = vocabulary()
    meta = v.metadata(root)
    if meta["title"] is not None:
        v.out.append(f"# {meta['title']}\n\n")
    v.run(root)
    return meta | {"body": collapse_blanks("".join(v.out)), "references": v.references, "tables": v.tables}
