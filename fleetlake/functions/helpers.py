"""Helpers that run in Python: label-fragment parser, HTML entities, well-formed XML; and a plain reference of the common subsequence."""

from __future__ import annotations

import html
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits for each character."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(StringType())
def _all_entities(v: pd.Series) -> pd.Series:
    return v.map(html.unescape, na_action="ignore")


def _parses(xml: str | None) -> bool:
    try:
        if xml is not None:
            expat.ParserCreate("utf-8").Parse(xml.encode(), True)
        return xml is not None
    except (expat.ExpatError, UnicodeError):
        return False


@F.pandas_udf(BooleanType())
def well_formed(v: pd.Series) -> pd.Series:
    return v.map(_parses).astype(bool)


def html_unescape(c: Column) -> Column:
    """HTML entities decoded: the five common ones by built-in functions, others only where one is left."""
    plain = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    simple = ~F.regexp_replace(c, "&(lt|gt|quot|#39|amp);", "").rlike("&[#a-zA-Z]")
    return F.when(c.isNull() | ~c.contains("&"), c).when(simple, F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(_all_entities(c))


_PAIRS = {"'": "'", '"': '"', "`": "`", "(": ")", "{": "}"}


def scan_fragment(text: str) -> list[tuple[str, str, list[str], bool]]:
    """(label name, key, values, is_array) for every top-level assignment of a label fragment, in order.

    A value ends at a space, a semicolon or a line end outside of quotes, $(...), ${...} and backticks;
    those keep line ends. One layer of quotes is taken off; ( ... ) is an array of words. The header
    ``name)`` (aliases parted by |) and ;; are skipped, as are comments between statements.
    """
    out, name, i, n = [], "", 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace() or c == ";":
            i += 1
            continue
        line_end = text.find("\n", i)
        line_end = n if line_end < 0 else line_end
        if c == "#":
            i = line_end
            continue
        j = i
        while j < n and (text[j].isalnum() or text[j] == "_"):
            j += 1
        if j > i and not text[i].isdigit() and text[j : j + 1] == "=":
            if text[j + 1 : j + 2] == "(":
                words, i = _array(text, j + 2)
                out.append((name, text[_start(text, j) : j], words, True))
            else:
                value, stop = _value(text, j + 1)
                out.append((name, text[_start(text, j) : j], [_unquoted(value)], False))
                i = stop
            continue
        head = text[i:line_end].split("#")[0].strip()
        if head.endswith(")") and not name and not out and "(" not in head and "=" not in head:
            name = head[:-1].split("|")[0].strip().strip("'\"")
            i = line_end
            continue
        _, stop = _value(text, i)
        i = max(stop, i + 1)
    return out


def _start(text: str, j: int) -> int:
    while j and (text[j - 1].isalnum() or text[j - 1] == "_"):
        j -= 1
    return j


def _value(text: str, i: int, first_only: bool = False) -> tuple[str, int]:
    """The word that starts at i, with its quotes, and where it ends; or only its first quoted part."""
    start, n, open_ = i, len(text), []
    while i < n:
        c, inside = text[i], open_[-1] if open_ else ""
        if inside == "'":
            if c == "'":
                open_.pop()
        elif c == "\\":
            i += 1
        elif inside and c == inside:
            open_.pop()
        elif c == "$" and text[i + 1 : i + 2] in ("(", "{"):
            open_.append(_PAIRS[text[i + 1]])
            i += 1
        elif c == '"' or (c in "'`" and inside != '"') or (c == "`" and inside == '"'):
            open_.append(_PAIRS[c])
        elif c == "(" and inside == ")":
            open_.append(")")
        elif not inside and (c.isspace() or c in ";)"):
            break
        i += 1
        if first_only and not open_:
            break
    return text[start:i], min(i, n)


def _array(text: str, i: int) -> tuple[list[str], int]:
    words, n = [], len(text)
    while i < n and text[i] != ")":
        if text[i].isspace():
            i += 1
        elif text[i] == "#":
            end = text.find("\n", i)
            i = n if end < 0 else end
        else:
            word, stop = _value(text, i)
            if stop == i:
                break
            words.append(_unquoted(word))
            i = stop
    return words, min(i + 1, n)


def _unquoted(value: str) -> str:
    if len(value) >= 2 and value[0] in "'\"" and value[-1] == value[0] and _value(value, 0, first_only=True)[1] == len(value):
        return value[1:-1]
    return value


def parse_fragment_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over (name, fragment): one row for each assignment, ``pos`` counts a key's repeats from 0."""
    for batch in batches:
        rows = []
        for given, text in zip(batch["name"], batch["fragment"], strict=True):
            seen: dict[str, int] = {}
            for own, key, values, is_array in scan_fragment(text or ""):
                rows.append((own or given, key, seen.get(key, 0), values, is_array))
                seen[key] = seen.get(key, 0) + 1
        yield pd.DataFrame(rows, columns=["name", "key", "pos", "value", "is_array"])
