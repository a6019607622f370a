"""Patterns are written in the linear-time dialect that the SQL engine also reads; java() gives the form that means the same to the JVM."""

from __future__ import annotations

import re

#: A word boundary between ASCII word characters and all else.
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_SPACE = r"\t\n\f\r "


#: The same where a word character is sure to follow.
_BEGIN = "(?<![A-Za-z0-9_])"
_WORD_CLASS = re.compile(r"\[(?:[A-Za-z0-9_](?:-[A-Za-z0-9_])?)+\]|\\d|[A-Za-z0-9_]")


def _group_end(pattern: str, at: int) -> int:
    """Where the group that opens at a place is closed."""
    depth, inside = 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        else:
            depth += (c == "(") - (c == ")")
            if c == ")" and not depth:
                return at
        at += 1
    return at


def _alternatives(body: str) -> list[str]:
    out, at, low = [], 0, 0
    while at < len(body):
        if body[at] == "(":
            at = _group_end(body, at)
        elif body[at] == "\\":
            at += 1
        elif body[at] == "|":
            out.append(body[low:at])
            low = at + 1
        at += 1
    return [*out, body[low:]]


def starts_word(pattern: str) -> bool:
    """Whether all that a pattern matches is sure to begin with an ASCII word character. False if that isn't plain."""
    if pattern[:1] == "(" and (pattern[1:2] != "?" or pattern[1:3] == "?:"):
        end = _group_end(pattern, 0)
        first = all(starts_word(a) for a in _alternatives(pattern[3 if pattern[1:2] == "?" else 1 : end]))
        return first and pattern[end + 1 : end + 2] not in ("?", "*", "{") and end > 0
    found = _WORD_CLASS.match(pattern)
    return bool(found) and not re.match(r"[?*]|\{0", pattern[found.end() :])


def java(pattern: str) -> str:
    """ASCII word boundaries, white space without the vertical tab, and case folding beyond ASCII."""
    out, inside, at = [], False, 0
    pattern = pattern.replace("(?i)", "(?iu)")
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\b":
            out.append(_BEGIN if starts_word(pattern[at + 2 :]) else _BOUNDARY)
        elif two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = inside or two[0] == "["
            inside = inside and two[0] != "]"
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)
