"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates licence expressions of AND, OR and WITH."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and labels of the base scan.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases and the labels they add.
NOTICE_PHRASES = {
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "isc license": "isc",
    "gnu free documentation license": "gfdl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "do what the fuck you want to public license": "wtfpl",
    "sil open font license": "ofl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "zlib license": "zlib",
    "cc0 1 0 universal": "cc0",
    "dedicated to the public domain": "public-domain",
    "permission to use copy modify and or distribute this software": "isc",
    "licensed under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "proprietary and confidential": "proprietary",
    "boost software license": "bsl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"

#: A word is a run of digits, small letters and bytes beyond ASCII, after A-Z are lower-cased.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKENS = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Identifiers that a tag may hold alone, or join by operators in small letters.
_VERSIONED = ("gpl", "lgpl", "agpl", "gfdl", "apache", "mpl", "epl", "cddl", "eupl", "cecill", "osl", "afl", "artistic", "bsl", "ecl", "lppl", "python", "php", "ofl", "cpl", "apsl", "mulanpsl", "zpl", "upl", "mit", "bsd", "isc", "zlib")
_KNOWN = re.compile(
    rf"(?:{'|'.join(_VERSIONED)})(?:-[0-9]+(?:\.[0-9]+)*[a-z]?(?:-only|-or-later|-clause(?:-[a-z0-9-]+)?)?\+?)?|0bsd|mit-0|mit-modern-variant|unlicense|wtfpl|ncsa|ofl-1\.1-(?:no-)?rfn|cc0-1\.0|"
    r"cc-by(?:-nc)?(?:-sa|-nd)?-[0-9]\.[0-9]|psf-2\.0|postgresql|x11|curl|libpng(?:-2\.0)?|openssl|ssh-openssh|ruby|vim|tcl|ms-pl|ms-rl|hpnd|icu|unicode-(?:dfs-2016|3\.0)|w3c|bzip2-1\.0\.6|json|beerware|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)
#: Alternatives of a step that are listed; an expression with more is kept in postfix order. Licences are named in any case.
ALTERNATIVES = 256


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if the expression is not well formed."""
    out, stack, operand = [], [], True
    for token in tokens:
        word = token.lower()
        if word in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand or not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(word)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def named(postfix: list[str]) -> set[str]:
    """The licences that a postfix expression names, by one pass; WITH joins each exception to each licence.

    Where that would make more than ALTERNATIVES pairs (no licence statement does), both sides are named unjoined.
    """
    stack: list[set[str]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append({token})
            continue
        right, left = stack.pop(), stack.pop()
        # the smaller set goes into the larger, so that a long chain takes no square time
        joined = token == "with" and len(left) * len(right) <= ALTERNATIVES
        small, large = sorted((left, right), key=len)
        stack.append({f"{x}+{y}" for x in left for y in right} if joined else large)
        if not joined:
            large |= small
    return stack[0]


def evaluate(expression: str) -> tuple[list[str], list[list[str]] | None] | None:
    """(licences named, alternatives): each alternative lists what must be met together; WITH joins an exception to its licence.

    Alternatives are None where a step would list more than ALTERNATIVES; the result is None if the expression is not well formed.
    """
    postfix = to_postfix(_leading(_TOKENS.findall(expression)))
    if postfix is None:
        return None
    names = sorted(named(postfix))
    stack: list[set[frozenset[str]]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append({frozenset([token])})
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(left | right)
        elif len(left) * len(right) > ALTERNATIVES:
            return names, None
        elif token == "and":
            stack.append({a | b for a in left for b in right})
        else:
            stack.append({frozenset(f"{x}+{y}" for x in a for y in b) for a in left for b in right})
    return names, sorted(sorted(x) for x in stack[0])


def _known(token: str) -> bool:
    return _KNOWN.fullmatch(token.lower()) is not None


def _leading(tokens: list[str]) -> list[str]:
    """The tokens up to where prose begins.

    That is after an operand with a full stop, before two operands side by side, and before an operator
    that is not in capitals unless known identifiers stand on both sides. A lone operand has to be known.
    """
    out: list[str] = []
    for i, token in enumerate(tokens):
        operand, before = token.lower() not in (*_BINDS, "(", ")"), out[-1] if out else "("
        after_operand = before == ")" or before.lower() not in (*_BINDS, "(")
        if (operand or token == "(") and after_operand:
            break
        if token.lower() in _BINDS and not token.isupper():
            following = next((t for t in tokens[i + 1 :] if t != "("), "")
            own = next((t for t in reversed(out) if t != ")"), "")
            if not (_known(own) and _known(following.rstrip(".:-"))):
                break
        out.append(token.rstrip(".:-") if operand else token)
        if operand and token != out[-1]:
            break
    names = [t for t in out if t.lower() not in (*_BINDS, "(", ")")]
    return out if len(names) > 1 or all(map(_known, names)) else []


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrases, base in ((NOTICE_PHRASES, False), (BASE_PHRASES, True)):
        for phrase, label in phrases.items():
            machine.add_word(f" {phrase} ", (phrase, label, base))
    machine.add_word(f" {TAG} ", (TAG, None, False))
    machine.make_automaton()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            words = text.encode().translate(_TO_WORDS).split()
            # single spaces between words, one code point a byte, so places are exact for any text
            line = f" {b' '.join(words).decode('latin-1')} "
            base, base_labels, labels, tagged = [], set(), set(), False
            ends = [(end, *found) for end, found in machine.iter(line)] if words else []
            at, number = 0, 0
            for end, phrase, label, is_base in ends:
                if is_base:
                    start = end - len(phrase) - 1
                    number += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                    at = start
                    base.append(number)
                    base_labels.add(label)
                if label:
                    labels.add(label)
                else:
                    tagged = True
            expressions = []
            for m in _TAG_LINE.finditer(text) if tagged else ():
                parsed = evaluate(m[1])
                if parsed:
                    labels.update(parsed[0])
                    listed = parsed[1] is not None
                    expressions.append(" OR ".join(" AND ".join(way) for way in parsed[1]) if listed else " ".join(to_postfix(_leading(_TOKENS.findall(m[1])))))
            places = len(ends)
            score = 0.0 if not labels else 1.0 if expressions else places / (places + 1.0)
            rows.append((doc_id, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), expressions, score))
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT) if rows else pa.RecordBatch.from_pylist([], schema=_RESULT)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, score) of every row.

    Words are runs of digits, letters and characters beyond ASCII after A-Z are lower-cased; a phrase
    occurs wherever its words stand consecutively, whatever stands between them, and places may
    overlap. ``n_base`` counts all places of the base phrases; first_word and last_word are the
    smallest and largest word numbers (from 0) at which one starts, null if none. ``labels`` adds other
    notices and the licences named by identifier tags, whose expressions are listed as alternatives, or
    in postfix order where these are too many. A tag's licence alone has to be a known identifier or a
    LicenseRef; joined by AND, OR and WITH in capitals any names count; what follows as prose does not.
    The score is 1 with a valid tag, 0 without labels, else n / (n + 1) for n places. Null and empty
    texts have no words and empty labels; rows are judged one by one, so repeated rows and ids give
    equal results and there are no ties; a text of any length is scanned whole, in one pass.
    """
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, kind)
