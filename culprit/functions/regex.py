"""Regular-expression helpers.

Patterns in this package are written once, in RE2 notation, and used on the JVM.
The two dialects differ in ``\\b`` (Unicode-aware on the JVM, ASCII in RE2) and in
``\\s`` (the JVM adds the vertical tab), so both are spelled out before use.
"""

from __future__ import annotations

import re

ASCII_WORD = "0-9A-Za-z_"
ASCII_SPACE = r"\t\n\f\r "

# Unicode white space as a character-class body, valid in both dialects.
SPACE = r"\t-\r\x{85}\p{Z}"
ODD_SPACE = r"[\s\x{85}\p{Z}&&[^\n ]]"  # JVM only: white space other than blank and line feed

_BOUNDARY = f"(?:(?<![{ASCII_WORD}])(?=[{ASCII_WORD}])|(?<=[{ASCII_WORD}])(?![{ASCII_WORD}]))"
_WORD_START = f"(?<![{ASCII_WORD}])"
_WORD_END = f"(?![{ASCII_WORD}])"
_ATOM = re.compile(r"(?:\\d|\\w|\[[0-9A-Za-z+/\-]+\]|[0-9A-Za-z])(?:\{\d+,?\d*\}|\+)?")
_WORD_ATOM = re.compile(r"(?:\\d|\\w|\[(?:[0-9A-Za-z]-[0-9A-Za-z])+\]|[0-9A-Za-z])(?:\{\d+,?\d*\}|\+)?")
_ENDS_IN_WORD = re.compile(r"(?:\\d|[0-9A-Za-z])(?:\{\d+,?\d*\}|\+)?(?:\)\?)?$")


def _boundary(before: str, after: str) -> str:
    """``\\b`` between two pieces of a pattern.

    Looking ahead for the next piece before looking behind lets the JVM skip most positions
    after one character test.
    """
    atom = _ATOM.match(after)
    if atom:
        side = _WORD_START if _WORD_ATOM.fullmatch(atom.group()) else _BOUNDARY
        return f"(?={atom.group()}){side}"
    if not after and _ENDS_IN_WORD.search(before):
        return _WORD_END
    return _BOUNDARY


def jvm(pattern: str) -> str:
    """Return ``pattern`` (RE2 meaning) as an equivalent JVM pattern."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "b" and not in_class:
                out.append(_boundary(pattern[:i], pattern[i + 2 :]))
            elif n == "s":
                out.append(ASCII_SPACE if in_class else f"[{ASCII_SPACE}]")
            elif n == "S" and not in_class:
                out.append(f"[^{ASCII_SPACE}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and in_class:
            out.append("\\[")
        else:
            if c == "[":
                in_class = True
            elif c == "]" and in_class:
                in_class = False
            out.append(c)
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Shell glob (``*`` and ``?`` stay inside one path segment) as an anchored regex."""
    body = ""
    for c in pattern:
        body += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".^$+{}[]()|\\" else c)
    return f"^{body}$"
