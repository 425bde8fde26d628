"""Selectors: type, universal, #id, .class, attribute tests, and the four combinators, in comma lists."""

from __future__ import annotations

import re
from functools import lru_cache

from foliospark.dom.html5 import Element

_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_SIMPLE = re.compile(
    rf"(?P<id>#{_NAME})|(?P<class>\.{_NAME})|(?P<type>\*|{_NAME})"
    rf"|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|{_NAME})\s*)?\]"
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


@lru_cache(maxsize=4096)
def compile_selector(text: str):
    """A list of (compound tests, combinators), or None if the text is no selector of this grammar."""
    out = []
    for part in re.split(r",(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", text):
        part, at, compounds, joins = part.strip(), 0, [[]], []
        if not part:
            return None
        while at < len(part):
            m = _SIMPLE.match(part, at)
            if m and not (m["type"] and compounds[-1]):
                if m["id"]:
                    test = ("attr", "id", "=", _plain(m["id"][1:]))
                elif m["class"]:
                    test = ("attr", "class", "~=", _plain(m["class"][1:]))
                elif m["type"]:
                    test = ("tag", _plain(m["type"]).lower())
                else:
                    value = m["value"]
                    test = ("attr", _plain(m["attr"]).lower(), m["op"], value[1:-1] if value and value[0] in "\"'" else value and _plain(value))
                compounds[-1].append(test)
                at = m.end()
                continue
            m = _COMBINATOR.match(part, at)
            if not m or not compounds[-1] or m.end() == len(part):
                return None
            joins.append(m[1] or " ")
            compounds.append([])
            at = m.end()
        if not compounds[-1]:
            return None
        out.append((compounds, joins))
    return out


@lru_cache(maxsize=256)
def by_subject(selectors: tuple[str, ...]) -> tuple[dict, list, list]:
    """The parts of all selectors by what their subject must have: (by its type; an attribute; neither)."""
    by_tag: dict[str, list] = {}
    attributed, others = [], []
    for part in (p for s in selectors for p in compile_selector(s) or ()):
        subject = part[0][-1]
        tag = next((t[1] for t in subject if t[0] == "tag" and t[1] != "*"), None)
        if tag is not None:
            by_tag.setdefault(tag, []).append(part)
        else:
            (attributed if any(t[0] == "attr" for t in subject) else others).append(part)
    return by_tag, attributed, others


def _simple(e: Element, test) -> bool:
    if test[0] == "tag":
        return test[1] in ("*", e.tag)
    have = e.attrs.get(test[1])
    if have is None:
        return False
    op, want = test[2], test[3]
    if op is None:
        return True
    if op == "=":
        return have == want
    if op == "~=":
        return bool(want) and want in re.split(r"[ \t\n\f\r]+", have)
    if op == "|=":
        return have == want or have.startswith(want + "-")
    return bool(want) and (have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have)


def _before(e: Element) -> list[Element]:
    if e.parent is None:
        return []
    kin = list(e.parent.elements())
    return kin[: next(i for i, k in enumerate(kin) if k is e)][::-1]


def _chain(e: Element, compounds, joins) -> bool:
    for t in compounds[-1]:
        if not _simple(e, t):
            return False
    if not joins:
        return True
    rest, others = (compounds[:-1], joins[:-1]), []
    if joins[-1] in " >":
        up = e.parent
        while up is not None and up.tag != "#document":
            others.append(up)
            up = up.parent if joins[-1] == " " else None
    else:
        others = _before(e)
        if joins[-1] == "+":
            others = others[:1]
    return any(_chain(o, *rest) for o in others)


def matches(e: Element, compiled) -> bool:
    return any(_chain(e, *c) for c in compiled)


def first(root: Element, compiled) -> Element | None:
    return next((e for e in root.descendants() if matches(e, compiled)), None)


def every(root: Element, compiled) -> list[Element]:
    return [e for e in root.descendants() if matches(e, compiled)]
