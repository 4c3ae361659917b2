"""Balanced JSON objects in free text: an automaton over braces, quotes and escapes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = re.compile(r'[\\"{}]')


def balanced(text: str) -> list[str]:
    """The top-level balanced objects of ``text``, in order, of any depth; braces inside strings do not count.

    Strings begin inside objects only, and a backslash escapes inside strings only.  Where an object that is begun never
    ends, the search goes on behind its brace.  What a scan has found out about the braces it passed outside strings is
    kept, so a text with many open braces takes no scan for each of them.
    """
    marks = [(m.start(), m.group()) for m in _MARK.finditer(text)]
    ends: dict[int, int | None] = {}

    def scan(k: int) -> None:
        """Fill ``ends`` for the brace that is mark ``k``, and for those between it and its end."""
        opened, inside, skip = [], False, -1
        for n in range(k, len(marks)):
            at, c = marks[n]
            if at == skip:
                continue
            if c == "\\":
                skip = at + 1 if inside else skip
            elif c == '"':
                inside = not inside
            elif inside:
                continue
            elif c == "{":
                opened.append(at)
            else:
                ends[opened.pop()] = at
                if not opened:
                    return
        ends.update(dict.fromkeys(opened))

    out, free = [], 0
    for k, (at, c) in enumerate(marks):
        if c == "{" and at >= free:
            if at not in ends:
                scan(k)
            if ends[at] is not None:
                out.append(text[at : ends[at] + 1])
                free = ends[at] + 1
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _objects(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else balanced(t) for t in text.to_pylist()], pa.list_(pa.string()))


def objects(text: Column) -> Column:
    """The balanced objects of a text, as an array; null counts as empty, and texts without both braces don't go to Python's scan."""
    return F.coalesce(_objects(F.when(text.contains("{") & text.contains("}"), text)), F.array().cast("array<string>"))
