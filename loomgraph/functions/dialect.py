"""Operator texts are written once; what the two engines spell differently is marked.

``@re(x, 'p')``       x contains a match of the regular expression p
``@set(x)``           the distinct non-null values of x, sorted, joined by ", ":
                      only where a group has few of them
"""

from __future__ import annotations

import re

_CALL = re.compile(r"@(re|set)\(")


def _args(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of a call whose bracket opened before ``at``, and the place behind it."""
    out, depth, quoted, start = [], 0, False, at
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif c in ",)" and not depth:
            out.append(text[start:i].strip())
            start = i + 1
            if c == ")":
                return out, i + 1
    raise ValueError("a marked call without end: " + text[at : at + 40])


_SPARK = {"re": "regexp_like({0}, {1})", "set": "array_join(array_sort(collect_set({0})), ', ')"}
_DUCK = {"re": "regexp_matches({0}, {1})", "set": "string_agg(DISTINCT {0}, ', ' ORDER BY {0})"}


def _fill(text: str, forms: dict[str, str]) -> str:
    out, at = [], 0
    while m := _CALL.search(text, at):
        args, end = _args(text, m.end())
        out += [text[at : m.start()], forms[m.group(1)].format(*args)]
        at = end
    return "".join([*out, text[at:]])


def spark_sql(text: str) -> str:
    return _fill(text, _SPARK).replace("\\", "\\\\")


def duck_sql(text: str) -> str:
    return _fill(text, _DUCK)
