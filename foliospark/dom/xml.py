"""XML trees with limits: nesting is measured before parsing, DTDs are refused unless allowed, only UTF-8 text goes in."""

from __future__ import annotations

import re
from xml.parsers import expat

MAX_DEPTH = 64


class XmlError(ValueError):
    pass


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs = name, attrs
        self.children: list[Node | str] = []

    def elements(self, *names: str):
        return (c for c in self.children if isinstance(c, Node) and (not names or local(c.name) in names))

    def child(self, name: str) -> Node | None:
        return next(self.elements(name), None)

    def walk(self):
        """This element and all below, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if n.children:
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, name: str) -> Node | None:
        end = "}" + name
        return next((n for n in self.walk() if n.name == name or n.name.endswith(end)), None)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo.extend(reversed(n.children))
        return "".join(out)


def local(name: str) -> str:
    return name.rpartition("}")[2]


def namespace(name: str) -> str:
    return name.rpartition("}")[0][1:]


_PART = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^>\[]|\[[^\]]*\])*>|<(/?)[^\s<>/!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*?(/?)>", re.S)


def deeper_than(text: str, limit: int = MAX_DEPTH) -> bool:
    if text.count("<") - text.count("</") <= limit:
        return False  # so few start tags can't nest deeper
    depth = 0
    for m in _PART.finditer(text):
        if m[1] is None:
            continue
        if m[1]:
            depth = max(0, depth - 1)
        elif not m[2]:
            depth += 1
            if depth > limit:
                return True
    return False


def parse(text: str, dtd: bool = False) -> Node:
    """The root element. Names carry their namespace as {uri}local; comments split text nodes."""
    p = expat.ParserCreate("utf-8", "}")
    p.buffer_text = False
    top: list[Node] = []
    stack: list[Node] = []
    joined = [False]

    def name(n: str) -> str:
        return "{" + n if "}" in n else n

    def start(tag, attrs):
        n = Node(name(tag), {name(k): v for k, v in attrs.items()} if attrs else {})
        (stack[-1].children if stack else top).append(n)
        stack.append(n)
        joined[0] = False

    def end(_):
        stack.pop()
        joined[0] = False

    def chars(s):
        kin = stack[-1].children
        if joined[0] and kin and isinstance(kin[-1], str):
            kin[-1] += s
        else:
            kin.append(s)
        joined[0] = True

    def apart(*_):
        joined[0] = False

    def doctype(*_):
        if not dtd:
            raise XmlError("XML with DTD detected")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    p.CommentHandler = p.ProcessingInstructionHandler = apart
    p.StartDoctypeDeclHandler = doctype
    p.EntityDeclHandler = lambda *a: (_ for _ in ()).throw(XmlError("entity declarations are refused"))
    try:
        p.Parse(text.removeprefix("﻿").encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        raise XmlError(str(e)) from None
    return top[0]
