"""What an ePub archive says of itself: package, reading order, table of contents, style sheets. Plain Python, per book."""

from __future__ import annotations

import io
import re
import zipfile

from foliospark.dom import css, html5, xml
from foliospark.dom.xml import Node, XmlError, local, namespace
from foliospark.errors import ExtractFailure
from foliospark.operators.html_article import Walker, text_of
from foliospark.operators.plain import collapse_blanks, junk_title, normalize, trim

MAX_ENTRY = 64 << 20
NCX = "application/x-dtbncx+xml"
#: What is cut from ePub pages.
STRIP = ["section#frontmatter", "section#backmatter", "nav", "div.authors", "div.article-notes", "div#keywords", "script", "style"]


def read_entry(archive: zipfile.ZipFile, name: str, limit: int = MAX_ENTRY) -> str:
    """An entry as text; its declared and its real size are both held to the limit."""
    try:
        info = archive.getinfo(name)
    except KeyError:
        raise ExtractFailure(f"no entry {name}") from None
    if info.file_size > limit:
        raise ExtractFailure(f"{name} declares {info.file_size} bytes; the limit is {limit}")
    try:
        with archive.open(info) as f:
            raw = f.read(limit + 1)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError) as e:
        raise ExtractFailure(f"reading {name}: {e}") from e
    if len(raw) > limit:
        raise ExtractFailure(f"{name} is larger than {limit} bytes")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        raise ExtractFailure(f"{name} is not UTF-8") from None


def _xml(text: str, what: str, dtd: bool = False) -> Node:
    if xml.deeper_than(text):
        raise ExtractFailure(f"{what} nests deeper than {xml.MAX_DEPTH} elements; refusing to parse")
    try:
        return xml.parse(text, dtd)
    except XmlError as e:
        raise ExtractFailure(f"parsing {what}: {e}") from e


def folder(path: str) -> str:
    return path[: path.rfind("/") + 1]


def opf_path(archive: zipfile.ZipFile) -> str:
    container = _xml(read_entry(archive, "META-INF/container.xml"), "container.xml")
    for n in container.walk():
        if local(n.name) == "rootfile" and "full-path" in n.attrs:
            return n.attrs["full-path"]
    found = next((n for n in archive.namelist() if n.endswith(".opf")), None)
    if found is None:
        raise ExtractFailure("no OPF file found in ePub")
    return found


def _own_text(n: Node) -> str:
    """The text before an element's first child element."""
    return trim(n.children[0]) if n.children and isinstance(n.children[0], str) else ""


def package(archive: zipfile.ZipFile) -> dict:
    path = opf_path(archive)
    nodes = list(_xml(read_entry(archive, path), path).walk())
    meta: dict = {"title": None, "authors": [], "doi": None, "publisher": None}
    for n in nodes:
        if not namespace(n.name):
            continue
        name, t = local(n.name), _own_text(n)
        if name == "title":
            meta["title"] = t or meta["title"]
        elif name == "creator" and t:
            meta["authors"].append(t)
        elif name == "identifier" and t.startswith("10.") and "/" in t:
            meta["doi"] = t
    first = next((n for n in nodes if local(n.name) == "publisher" and namespace(n.name)), None)
    meta["publisher"] = first and _own_text(first) or None
    items, navs, toc = {}, set(), {"nav": None, "ncx": None}
    for n in nodes:
        if local(n.name) == "item" and "id" in n.attrs and "href" in n.attrs:
            full = folder(path) + n.attrs["href"]
            if "nav" in n.attrs.get("properties", ""):
                navs.add(n.attrs["id"])
                toc["nav"] = full
            if n.attrs.get("media-type") == NCX:
                toc["ncx"] = full
            items[n.attrs["id"]] = full
    spine = [items[r] for n in nodes if local(n.name) == "itemref" and (r := n.attrs.get("idref")) in items and r not in navs and n.attrs.get("linear", "yes") != "no"]
    spine = [p for p in spine if not p.lower().endswith(("cover.xhtml", "cover.html"))]
    if not spine:
        raise ExtractFailure("OPF spine contains no content items")
    have, base = set(spine), folder(spine[0])
    for name in archive.namelist():
        if name.startswith(base) and name.endswith(".xhtml") and name not in have and name.lower().rsplit("/", 1)[-1].startswith(("table", "fig")):
            spine.append(name)
    return meta | {"spine": spine, "toc": toc}


def split_href(href: str) -> tuple[str, str | None]:
    file, _, fragment = href.partition("#")
    return file, fragment or None


def nav_entries(text: str, base: str) -> list[dict]:
    """A navigation document's entries in reading order, with parent and depth."""
    document = html5.parse(text)
    navs = [e for e in document.descendants() if e.tag == "nav"]
    nav = next((e for e in navs if e.attrs.get("epub:type") == "toc"), navs[0] if navs else None)
    top = next((e for e in nav.descendants() if e.tag == "ol"), None) if nav is not None else None
    out: list[dict] = []

    def walk(ol, parent: int, depth: int) -> None:
        for li in ol.elements():
            if li.tag != "li":
                continue
            below = list(li.descendants())
            a = next((e for e in below if e.tag == "a"), None)
            if a is None:
                continue
            file, fragment = split_href(a.attrs.get("href", ""))
            out.append({"ord": len(out), "parent_ord": parent, "depth": depth, "label": normalize(text_of(a)), "href": base + file, "fragment": fragment})
            inner = next((e for e in below if e.tag == "ol"), None)
            if inner is not None and depth < 100:
                walk(inner, out[-1]["ord"], depth + 1)

    if top is not None:
        walk(top, -1, 0)
    return out


def ncx_entries(text: str, name: str) -> list[dict]:
    base, out = folder(name), []
    root = _xml(text, name, dtd=True)

    def walk(parent: Node, up: int, depth: int) -> None:
        for point in parent.elements("navPoint"):
            label, content = point.child("navLabel"), point.child("content")
            src = content.attrs.get("src") if content is not None else None
            file, fragment = split_href(src) if src is not None else (None, None)
            out.append({"ord": len(out), "parent_ord": up, "depth": depth, "label": normalize(label.text()) if label is not None else "", "href": "" if file is None else base + file, "fragment": fragment})
            walk(point, out[-1]["ord"], depth + 1)

    if (top := root.find("navMap")) is not None:
        walk(top, -1, 0)
    return out


def contents(archive: zipfile.ZipFile, toc: dict) -> list[dict]:
    """The EPUB 3 navigation document, or the NCX where that is missing, unreadable or empty."""
    for path, read in ((toc["nav"], lambda t, p: nav_entries(t, folder(p))), (toc["ncx"], ncx_entries)):
        if path is not None:
            try:
                if found := read(read_entry(archive, path), path):
                    return found
            except ExtractFailure:
                continue
    return []


def _em(block: str) -> float | None:
    m = re.search(r"font-size[^:]*:\s*(.*?)em", block, re.S)
    try:
        return float(m[1].strip()) if m else None
    except ValueError:
        return None


def subheading_classes(style: str) -> list[str]:
    """Classes of centred text that is larger than the body, smaller than the largest centred text, and not bold."""
    centred = [b for b in style.split("}") if "text-align" in b and "center" in b]
    largest = max((s for b in centred if (s := _em(b)) is not None), default=0.0)
    out = []
    for b in centred:
        size, name = _em(b), re.search(r"\.([\w-]+)", b)
        heavy = "font-weight" in b and ("bold" in b or "800" in b)
        if size is not None and 1.1 <= size < largest and not heavy and name and name[1].startswith("class") and b.index(".") == name.start():
            out.append(name[1])
    return out


def read_book(content: bytes) -> dict:
    """Everything the relational part needs; unreadable spine files have no text."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise ExtractFailure(f"opening ePub: {e}") from e
    with archive:
        found = package(archive)
        files = []
        for path in found["spine"]:
            try:
                files.append({"path": path, "xhtml": read_entry(archive, path)})
            except ExtractFailure:
                files.append({"path": path, "xhtml": None})
        classes = []
        for name in archive.namelist():
            if name.endswith(".css"):
                try:
                    classes += subheading_classes(read_entry(archive, name))
                except ExtractFailure:
                    continue
        return found | {"files": files, "nav": contents(archive, found["toc"]), "classes": classes}


# Rewriting of raw pages, before they are parsed

_P = re.compile(r"<p(?=[ \t\n\r>/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_TAG_ATTR = re.compile(r"([^\s=>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


def tag_attr(tag: str, name: str) -> str | None:
    for m in _TAG_ATTR.finditer(tag, re.match(r"<[^\s>/]*", tag).end()):
        if m[1].lower() == name:
            return next((g for g in m.groups()[1:] if g is not None), None)
    return None


def promote_paragraphs(page: str, levels: dict[str, int], class_levels: dict[str, int]) -> str:
    """<p> to <hN> where the class (first) or the id has a level."""
    out, at = [], 0
    while m := _P.search(page, at):
        tag, level = m[0], None
        if not tag.endswith("/>"):
            level = next((class_levels[c] for c in (tag_attr(tag, "class") or "").split() if c in class_levels), None)
            level = levels.get(tag_attr(tag, "id") or "") if level is None else level
        close = page.find("</p>", m.end()) if level is not None else -1
        if close < 0:
            out.append(page[at : m.end()])
            at = m.end()
            continue
        n = min(6, max(1, level))
        out += (page[at : m.start()], f"<h{n}", tag[2:], page[m.end() : close], f"</h{n}>")
        at = close + 4
    return "".join(out) + page[at:]


def promote_subheadings(page: str, classes: list[str]) -> str:
    for c in classes:
        page = re.sub(rf'<p class="{re.escape(c)}">(.*?)</p>', r"<h3>\1</h3>", page, flags=re.S)
    return page


def _body(document):
    for selector in ("section#bodymatter", "article", "body"):
        if (e := css.first(document, css.compile_selector(selector))) is not None:
            return e
    return None


def chapter(page: str, levels: dict, class_levels: dict, classes: list[str]) -> tuple[str, bool]:
    """(Markdown, has it a real heading) of one spine file."""
    if levels or class_levels:
        page = promote_paragraphs(page, levels, class_levels)
    document = html5.parse(promote_subheadings(page, classes))
    headed = any(e.tag in ("h1", "h2", "h3") and (t := normalize(text_of(e))) and not junk_title(t) for e in document.descendants())
    w = Walker(STRIP)
    w.block(_body(document))
    return trim(collapse_blanks("".join(w.out))), headed


def paper(pages: list[str]) -> dict:
    """A short ePub as one page, with the metadata that its markup carries."""
    document = html5.parse("".join(pages))
    pick = lambda s: css.first(document, css.compile_selector(s))
    named = lambda e: normalize(text_of(e)) if e is not None else ""
    title = named(pick('h1[property="name"]'))
    if not title:
        title = named(pick("title"))
        title = "" if junk_title(title) else title
    authors = []
    for e in css.every(document, css.compile_selector('span[property="author"]')):
        parts = [trim(text_of(x)) if (x := css.first(e, css.compile_selector(f'span[property="{p}"]'))) is not None else "" for p in ("givenName", "familyName")]
        authors += [n] if (n := trim(" ".join(parts))) else []
    bare = lambda href: re.sub(r"^https?://doi\.org/", "", href)
    same = pick('a[property="sameAs"]')
    doi = bare(same.attrs["href"]) if same is not None and "doi.org" in same.attrs.get("href", "") else None
    if doi is None:
        links = (e.attrs.get("href", "") for e in document.descendants() if e.tag == "a")
        doi = next((bare(h) for h in links if re.match(r"https?://doi\.org/10\.", h)), None)
    journal = named(pick('span[typeof="Periodical"] span[property="name"]'))
    w = Walker(STRIP)
    w.block(_body(document))
    return {"title": title or None, "authors": authors, "doi": doi, "journal": journal or None, "walked": "".join(w.out)}
