"""Patterns with ASCII word boundaries and Unicode blanks, for Java's regex engine.

Java's ``\\b`` knows letters of every script and its ``\\s`` knows ASCII blanks
only; the rules here mean it the other way round.
"""

from __future__ import annotations

import re

BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The same characters one by one.
BLANK_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = "[A-Za-z0-9_]"
#: What a word boundary comes to before and after a character of a word.
OPENS, CLOSES = f"(?<!{_WORD})", f"(?!{_WORD})"
_BEFORE = re.compile(r"(?:\(\?:)*\[(?:0-9|A-Z|A-Za-z)\](?![?*])|[A-Za-z0-9](?![?*])")
_AFTER = re.compile(r"(?:\[0-9\]|\\d)(?:\+|\{[1-9]\d*(?:,\d+)?\})?$")
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with ``\\b`` and ``\\s`` (also inside classes) written out."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\b" and not inside:
            opens, closes = _BEFORE.match(pattern, at + 2), _AFTER.search(pattern[:at])
            out.append(OPENS if opens else CLOSES if closes else BOUNDARY)
        elif two == r"\s":
            out.append(BLANKS if inside else f"[{BLANKS}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{BLANKS}]")
        elif two.startswith("\\"):
            out.append(two)
        else:
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            # A bracket inside a class is a character there, to Java a class of its own.
            out.append(r"\[" if pattern[at] == "[" and out and inside and _open(out) else pattern[at])
            at += 1
            continue
        at += 2
    return ("(?iu)" if ignore_case else "") + "".join(out)


def _open(out: list[str]) -> bool:
    """Whether a class has been opened and not closed in the parts so far."""
    state = False
    for part in out:
        if part == "[":
            state = True
        elif part == "]":
            state = False
    return state
