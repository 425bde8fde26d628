"""Text helpers of the tree walkers. The same rules as Column functions are in foliospark.functions.text."""

from __future__ import annotations

import re

#: Unicode White_Space; Python's own idea of white space has four control characters more.
WS = "\t-\r \x85\xa0  -     　"
_RUN, _EDGES = re.compile(f"[{WS}]+"), "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WS}]", c))


def trim(s: str) -> str:
    return s.strip(_EDGES)


def normalize(s: str) -> str:
    if "\x1c" in s or "\x1d" in s or "\x1e" in s or "\x1f" in s:
        return trim(_RUN.sub(" ", s))
    return " ".join(s.split())


def lines(s: str) -> list[str]:
    """Without line ends; a final one opens no line, CRLF counts as one."""
    *ended, last = s.split("\n")
    return [x.removesuffix("\r") for x in ended] + ([last] if last else [])


def collapse_blanks(s: str) -> str:
    out, blank = [], False
    for line in lines(s):
        empty = not trim(line)
        if not (empty and blank):
            out.append("" if empty else line)
        blank = empty
    return "".join(x + "\n" for x in out)


def junk_title(t: str) -> bool:
    t = trim(t)
    if not t or t.lower() in ("cover", "nav", "title page"):
        return True
    return " " not in t and (not t.isalpha() or len(t.encode()) <= 3)
