"""An HTML5 tree builder: the parts of the WHATWG rules that shape an article's tree.

Covered: raw-text and RCDATA elements, void elements, implied html/head/body, implied end tags, the list of active
formatting elements with its limit of three, the adoption agency, table modes with implied parts and foster parenting,
merged second html and body tags, bogus comments, and svg/math as plain subtrees with self-closing.
"""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("title", "textarea"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HEAD_ONLY = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search "
    "section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr plaintext xmp li dd dt".split()
)
BLOCKS = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav "
    "ol pre search section summary ul".split()
)
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template svg math foreignObject desc".split())
BUTTON_SCOPE, LIST_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}
TABLE_SCOPE = frozenset(("html", "table", "template"))
SPECIAL = (
    BLOCKS | HEADINGS | RAW | SCOPE | HEAD_ONLY | VOID
    | frozenset("body html form frame frameset li dd dt p table tbody tfoot thead tr td th colgroup select plaintext textarea".split())
) - FORMATTING
_FOSTER = frozenset(("table", "tbody", "tfoot", "thead", "tr"))
_LEAVES_FOREIGN = BLOCKS | HEADINGS | {"p", "b", "i", "table", "span", "br", "img", "body", "ul", "li", "ol"}
#: Before these no formatting elements are opened again.
_PLAIN = BLOCKS | HEADINGS | {"p", "form", "table", "hr", "li", "dd", "dt", "plaintext"} | (RAW - {"xmp"}) | frozenset("param source track rb rtc rp rt textarea".split())
_SPACE = "\t\n\f\r "


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, None
        self.children: list[Element | str] = []

    def append(self, node: Element | str) -> None:
        if isinstance(node, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += node
                return
        else:
            node.detach()
            node.parent = self
        self.children.append(node)

    def insert_before(self, node: Element | str, other: Element) -> None:
        at = next(i for i, c in enumerate(self.children) if c is other)
        if isinstance(node, str):
            if at and isinstance(self.children[at - 1], str):
                self.children[at - 1] += node
                return
        else:
            node.detach()
            node.parent = self
            at = next(i for i, c in enumerate(self.children) if c is other)
        self.children.insert(at, node)

    def detach(self) -> None:
        if self.parent is not None:
            kin = self.parent.children
            del kin[next(i for i, c in enumerate(kin) if c is self)]
            self.parent = None

    def elements(self):
        return (c for c in self.children if isinstance(c, Element))

    def descendants(self):
        """Elements below this one in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            if e.children:
                todo += [c for c in reversed(e.children) if isinstance(c, Element)]


_TOKEN = re.compile(
    r"<!--(?P<comment>-?>|.*?(?:--!?>|\Z))|<(?P<bogus>[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*?)(?P<end>/?>)|</>",
    re.S,
)
_ATTR = re.compile(r"[\s/]*([^\s=>/\"'][^\s=>/]*|[\"'=][^\s=>/]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.S)


def tokens(text: str):
    """("text", s), ("start", tag, attrs, self-closing) and ("end", tag)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            yield "text", html.unescape(text[at:])
            return
        if m.start() > at:
            yield "text", html.unescape(text[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            yield "end", name
            continue
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(m["attrs"]) if m["attrs"] else ():
            value = a[2] or ""
            if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            attrs.setdefault(a[1].lower(), html.unescape(value))
        yield "start", name, attrs, m["end"] == "/>"
        if name in RAW or name in RCDATA:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(text, at)
            end = close.start() if close else n
            if end > at:
                raw = text[at:end]
                yield "text", html.unescape(raw) if name in RCDATA else raw
            at = end


_MARKER = object()


class _Builder:
    def __init__(self) -> None:
        self.document = Element("#document")
        self.html = self.head = self.body = None
        self.open: list[Element] = []
        self.active: list = []
        self.foreign = 0
        self.after_head = False

    # the stack
    @property
    def now(self) -> Element:
        return self.open[-1]

    def has(self, tags, stop=SCOPE) -> bool:
        tags = (tags,) if isinstance(tags, str) else tags
        for e in reversed(self.open):
            if e.tag in tags:
                return True
            if e.tag in stop:
                return False
        return False

    def pop_until(self, *tags: str) -> None:
        while self.open and self.open.pop().tag not in tags:
            pass

    def imply(self, but: str = "") -> None:
        while self.now.tag in IMPLIED and self.now.tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.has("p", BUTTON_SCOPE):
            self.imply("p")
            self.pop_until("p")

    # insertion
    def spot(self) -> tuple[Element, Element | None]:
        """Where a node goes: (parent, before which child); foster-parented next to a table."""
        if self.now.tag not in _FOSTER:
            return self.now, None
        table = next((e for e in reversed(self.open) if e.tag == "table"), None)
        if table is None:
            return self.open[0], None
        if table.parent is not None:
            return table.parent, table
        return self.open[self.open.index(table) - 1], None

    def put(self, node: Element | str, fostered: bool = True) -> None:
        parent, before = self.spot() if fostered else (self.now, None)
        if before is None:
            parent.append(node)
        else:
            parent.insert_before(node, before)

    def push(self, tag: str, attrs: dict, fostered: bool = True) -> Element:
        e = Element(tag, attrs)
        self.put(e, fostered)
        self.open.append(e)
        return e

    def need_html(self, attrs: dict | None = None) -> None:
        if self.html is None:
            self.html = Element("html", attrs)
            self.document.append(self.html)
            self.open.append(self.html)

    def need_body(self, attrs: dict | None = None) -> None:
        self.need_html()
        if self.body is None:
            if self.head is None:
                self.head = Element("head")
                self.html.append(self.head)
            self.open = [self.html]
            self.body = Element("body", attrs)
            self.html.append(self.body)
            self.open.append(self.body)

    # formatting elements
    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is _MARKER or self.active[-1] in self.open:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not _MARKER and self.active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self.push(self.active[k].tag, dict(self.active[k].attrs))

    def format(self, tag: str, attrs: dict) -> None:
        e = self.push(tag, attrs)
        same = []
        for x in reversed(self.active):
            if x is _MARKER:
                break
            if x.tag == tag and x.attrs == attrs:
                same.append(x)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(e)

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not _MARKER:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency."""
        if self.now.tag == tag and self.now not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            fmt = None
            for x in reversed(self.active):
                if x is _MARKER:
                    break
                if x.tag == tag:
                    fmt = x
                    break
            if fmt is None:
                self.any_end(tag)
                return
            if fmt not in self.open:
                self.active.remove(fmt)
                return
            if not self.has_element(fmt):
                return
            at = self.open.index(fmt)
            furthest = next((e for e in self.open[at + 1 :] if e.tag in SPECIAL), None)
            if furthest is None:
                del self.open[at:]
                self.active.remove(fmt)
                return
            ancestor, mark = self.open[at - 1], self.active.index(fmt)
            node_at, last, inner = self.open.index(furthest), furthest, 0
            while True:
                inner += 1
                node_at -= 1
                node = self.open[node_at]
                if node is fmt:
                    break
                if inner > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.open.remove(node)
                    continue
                fresh = Element(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = fresh
                self.open[node_at] = fresh
                if last is furthest:
                    mark = self.active.index(fresh) + 1
                fresh.append(last)
                last = fresh
            last.detach()
            if ancestor.tag in _FOSTER:
                table = next((e for e in reversed(self.open) if e.tag == "table"), None)
                if table is not None and table.parent is not None:
                    table.parent.insert_before(last, table)
                else:
                    ancestor.append(last)
            else:
                ancestor.append(last)
            fresh = Element(fmt.tag, dict(fmt.attrs))
            for c in list(furthest.children):
                if isinstance(c, Element):
                    c.parent = fresh
                fresh.children.append(c)
            furthest.children = []
            furthest.append(fresh)
            if self.active.index(fmt) < mark:
                mark -= 1
            self.active.remove(fmt)
            self.active.insert(mark, fresh)
            self.open.remove(fmt)
            self.open.insert(self.open.index(furthest) + 1, fresh)

    def has_element(self, element: Element) -> bool:
        for e in reversed(self.open):
            if e is element:
                return True
            if e.tag in SCOPE:
                return False
        return False

    def any_end(self, tag: str) -> None:
        for e in reversed(self.open):
            if e.tag == tag:
                self.imply(tag)
                while self.open.pop() is not e:
                    pass
                return
            if e.tag in SPECIAL:
                return

    # tokens
    def text(self, s: str) -> None:
        if not self.open:
            if not (s := s.lstrip(_SPACE)):
                return
            self.need_body()
        if self.body is None and self.now.tag not in RAW and self.now.tag not in RCDATA:
            rest = s.lstrip(_SPACE)
            if s != rest and (self.now is self.head or self.now is self.html):
                if self.head is not None:
                    self.now.append(s[: len(s) - len(rest)])
            if not rest:
                return
            s = rest
            self.need_body()
        s = s.replace("\0", "")
        if self.now.tag in RAW or self.now.tag in RCDATA or self.foreign:
            self.now.append(s)
            return
        if self.now.tag in _FOSTER:
            if not s.strip(_SPACE):
                self.now.append(s)
                return
            self.reconstruct()
        elif s:
            self.reconstruct()
        if s:
            self.put(s)

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            self.need_html(attrs)
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag == "head" and self.head is None:
                self.need_html()
                self.head = self.push("head", attrs)
                return
            if tag == "body":
                self.need_body(attrs)
                return
            if tag in HEAD_ONLY and tag != "head" and tag != "template":
                self.need_html()
                if self.head is None:
                    self.head = self.push("head", {})
                elif self.head not in self.open:
                    self.open.append(self.head)
                e = self.push(tag, attrs)
                if tag in VOID or tag in ("base", "basefont", "bgsound", "link", "meta"):
                    self.open.remove(e)
                    if self.after_head:
                        self.open.remove(self.head)
                return
            if tag == "head":
                return
            self.need_body()
        elif tag in ("body", "head"):
            if tag == "body":
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return
        if self.foreign:
            if tag in _LEAVES_FOREIGN and self.now.tag not in ("foreignobject", "desc", "title"):
                while self.foreign and self.open:
                    if self.open.pop().tag in ("svg", "math"):
                        self.foreign -= 1
            else:
                e = self.push(tag, attrs)
                if closed:
                    self.open.pop()
                elif tag in ("svg", "math"):
                    self.foreign += 1
                return
        self.in_body(tag, attrs, closed)

    def clear_to(self, *tags: str) -> None:
        while self.now.tag not in tags and self.now.tag != "html":
            self.open.pop()

    def close_cell(self) -> None:
        if self.has(("td", "th"), TABLE_SCOPE):
            self.imply()
            self.pop_until("td", "th")
            self.clear_to_marker()

    def in_table_part(self, tag: str, attrs: dict) -> bool:
        """Start tags that only make sense inside a table."""
        if tag not in ("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"):
            return False
        if not self.has("table", TABLE_SCOPE):
            return True
        self.close_cell()
        if self.has("caption", TABLE_SCOPE):
            self.imply()
            self.pop_until("caption")
            self.clear_to_marker()
        if self.now.tag == "colgroup" and tag != "col":
            self.open.pop()
        if tag in ("td", "th"):
            if not self.has("tr", TABLE_SCOPE):
                self.in_table_part("tr", {})
            self.clear_to("tr")
            self.push(tag, attrs, False)
            self.active.append(_MARKER)
        elif tag == "tr":
            if not self.has(("tbody", "thead", "tfoot"), TABLE_SCOPE):
                self.clear_to("table")
                self.push("tbody", {}, False)
            self.clear_to("tbody", "thead", "tfoot")
            self.push("tr", attrs, False)
        else:
            if tag == "col":
                if self.now.tag != "colgroup":
                    self.clear_to("table")
                    self.push("colgroup", {}, False)
                self.now.append(Element("col", attrs))
                return True
            self.clear_to("table")
            self.push(tag, attrs, False)
            if tag == "caption":
                self.active.append(_MARKER)
        return True

    def in_body(self, tag: str, attrs: dict, closed: bool) -> None:
        if self.in_table_part(tag, attrs):
            return
        if tag in HEAD_ONLY and tag not in ("template", "noscript"):
            e = self.push(tag, attrs, tag not in ("script", "style"))
            if tag in VOID or tag in ("basefont", "bgsound"):
                self.open.remove(e)
            return
        if tag == "table" and self.now.tag in _FOSTER:
            self.pop_until("table")
        if tag in CLOSES_P and tag not in ("li", "dd", "dt"):
            self.close_p()
        if tag in HEADINGS and self.now.tag in HEADINGS:
            self.open.pop()
        if tag == "form" and any(e.tag == "form" for e in self.open):
            return
        if tag in ("li", "dd", "dt"):
            same = ("li",) if tag == "li" else ("dd", "dt")
            for e in reversed(self.open):
                if e.tag in same:
                    self.imply(e.tag)
                    self.pop_until(e.tag)
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        if tag in ("option", "optgroup") and self.now.tag == "option":
            self.open.pop()
        if tag in ("rb", "rtc", "rp", "rt") and self.has("ruby"):
            self.imply("rtc" if tag in ("rp", "rt") else "")
        if tag == "button" and self.has("button"):
            self.imply()
            self.pop_until("button")
        if tag == "a":
            for x in reversed(self.active):
                if x is _MARKER:
                    break
                if x.tag == "a":
                    self.adopt("a")
                    if x in self.active:
                        self.active.remove(x)
                    if x in self.open:
                        self.open.remove(x)
                    break
        if tag == "nobr" and self.has("nobr"):
            self.reconstruct()
            self.adopt("nobr")
        if tag not in _PLAIN:
            self.reconstruct()
        if tag in FORMATTING:
            self.format(tag, attrs)
            return
        if tag == "image":
            tag = "img"
        e = self.push(tag, attrs)
        if tag in VOID:
            self.open.remove(e)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(_MARKER)
        elif tag in ("svg", "math"):
            if closed:
                self.open.pop()
            else:
                self.foreign += 1

    def end(self, tag: str) -> None:
        if not self.open or self.body is None:
            if tag == "br":
                self.need_body()
            elif tag == "head" and self.head in self.open:
                self.open = [self.html]
                self.after_head = True
                return
            elif self.open and self.now.tag == tag and tag not in ("html", "head"):
                self.open.pop()
                if self.after_head and self.head in self.open:
                    self.open = [self.html]
                return
            elif tag in ("html", "body"):
                self.need_body()
                return
            else:
                return
        if tag in ("html", "body"):
            return
        if self.now.tag in RAW or self.now.tag in RCDATA:
            if self.now.tag == tag:
                self.open.pop()
            return
        if self.foreign:
            for e in reversed(self.open):
                if e.tag == tag:
                    while (x := self.open.pop()) is not e:
                        self.foreign -= x.tag in ("svg", "math")
                    self.foreign -= tag in ("svg", "math")
                    return
                if e.tag in ("svg", "math"):
                    break
        if tag == "br":
            self.reconstruct()
            self.put(Element("br"))
        elif tag == "p":
            if not self.has("p", BUTTON_SCOPE):
                self.push("p", {})
            self.close_p()
        elif tag in ("td", "th"):
            if self.has(tag, TABLE_SCOPE):
                self.imply()
                self.pop_until(tag)
                self.clear_to_marker()
        elif tag == "tr":
            if self.has("tr", TABLE_SCOPE):
                self.close_cell()
                self.clear_to("tr")
                self.open.pop()
        elif tag in ("tbody", "thead", "tfoot"):
            if self.has(tag, TABLE_SCOPE):
                self.close_cell()
                self.clear_to(tag)
                self.open.pop()
        elif tag == "table":
            if self.has("table", TABLE_SCOPE):
                self.close_cell()
                self.pop_until("table")
        elif tag == "caption":
            if self.has("caption", TABLE_SCOPE):
                self.imply()
                self.pop_until("caption")
                self.clear_to_marker()
        elif tag in ("col", "colgroup"):
            if tag == "colgroup" and self.now.tag == "colgroup":
                self.open.pop()
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in HEADINGS:
            if self.has(HEADINGS):
                self.imply()
                self.pop_until(*HEADINGS)
        elif tag == "li":
            if self.has("li", LIST_SCOPE):
                self.imply("li")
                self.pop_until("li")
        elif tag in BLOCKS or tag in ("dd", "dt", "form"):
            if self.has(tag):
                self.imply(tag)
                self.pop_until(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.has(tag):
                self.imply()
                self.pop_until(tag)
                self.clear_to_marker()
        else:
            self.any_end(tag)


def parse(text: str) -> Element:
    """The document node of an HTML text; its only element child is html."""
    b = _Builder()
    for token in tokens(text):
        if token[0] == "text":
            b.text(token[1])
        elif token[0] == "start":
            b.start(token[1], token[2], token[3])
        else:
            b.end(token[1])
    b.need_body()
    return b.document
