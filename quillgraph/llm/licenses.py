"""License scans: Aho-Corasick over the words of the whole text, and a shunting-yard parser of licence expressions.

The automaton finds the base phrases, notice phrases of the method, and the words of an identifier
tag. What follows a tag on its line is parsed as an expression with `or`, `and`, `with` and brackets;
its operands must be identifiers of the SPDX list (or `LicenseRef-...`), after `with` exceptions of it.

score: how little the findings permit, from 0 (nothing found, or public domain) to 1 (all rights
reserved). In an expression `or` takes the freer and `and` the stricter side, and `with` (an
exception) halves the restriction; the score of a text is that of its strictest finding.

Defined cases: a null text is empty; an expression that does not parse adds no label; labels are
distinct and sorted, empty string if there are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_TABLE, byte_list, column, steps

# Phrases of words and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
NOTICES = {
    "affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "boost software license version 1 0": "bsl-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "do what the fuck you want to public license": "wtfpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "gnu free documentation license": "gfdl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "sil open font license": "ofl",
    "this is free and unencumbered software": "unlicense",
}
# Identifiers that have versions, with these, and with what may follow the version.
VERSIONED = {
    "afl": ["1.1", "1.2", "2.0", "2.1", "3.0"],
    "agpl": ["1.0", "3.0"],
    "apache": ["1.0", "1.1", "2.0"],
    "apsl": ["1.0", "1.1", "1.2", "2.0"],
    "artistic": ["1.0", "2.0"],
    "bsl": ["1.0"],
    "busl": ["1.1"],
    "cc-by": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "cc-by-nc": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "cc-by-nc-nd": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "cc-by-nc-sa": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "cc-by-nd": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "cc-by-sa": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "cc0": ["1.0"],
    "cddl": ["1.0", "1.1"],
    "cecill": ["1.0", "1.1", "2.0", "2.1"],
    "cpal": ["1.0"],
    "cpl": ["1.0"],
    "ecl": ["1.0", "2.0"],
    "epl": ["1.0", "2.0"],
    "eupl": ["1.0", "1.1", "1.2"],
    "gfdl": ["1.1", "1.2", "1.3"],
    "gpl": ["1.0", "2.0", "3.0"],
    "lgpl": ["2.0", "2.1", "3.0"],
    "lppl": ["1.0", "1.1", "1.2", "1.3a", "1.3c"],
    "mpl": ["1.0", "1.1", "2.0"],
    "odc-by": ["1.0"],
    "odbl": ["1.0"],
    "ofl": ["1.0", "1.1"],
    "osl": ["1.0", "1.1", "2.0", "2.1", "3.0"],
    "pddl": ["1.0"],
    "php": ["3.0", "3.01"],
    "psf": ["2.0"],
    "python": ["2.0"],
    "sspl": ["1.0"],
    "upl": ["1.0"],
    "zpl": ["1.1", "2.0", "2.1"],
}
SUFFIXED = ["agpl", "gfdl", "gpl", "lgpl"]
SUFFIXES = ["-only", "-or-later"]
# Identifiers without a version of that form.
PLAIN = [
    "0bsd", "beerware", "blueoak-1.0.0", "bsd-1-clause", "bsd-2-clause", "bsd-2-clause-patent", "bsd-3-clause", "bsd-3-clause-clear", "bsd-4-clause", "bzip2-1.0.6", "cc-pddc", "curl", "ftl", "hpnd", "icu", "ijg",
    "isc", "json", "libpng", "libtiff", "mit", "mit-0", "ms-pl", "ms-rl", "mulanpsl-2.0", "naist-2003", "ncsa", "ntp", "openssl", "postgresql", "ruby", "sleepycat", "unicode-3.0", "unicode-dfs-2016", "unlicense", "vim",
    "w3c", "wtfpl", "x11", "zlib",
]
# Exceptions.
EXCEPTIONS = [
    "autoconf-exception-2.0", "autoconf-exception-3.0", "bison-exception-2.2", "classpath-exception-2.0", "font-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "libtool-exception", "linux-syscall-note", "llvm-exception",
    "openjdk-assembly-exception-1.0", "openvpn-openssl-exception", "qt-gpl-exception-1.0", "qt-lgpl-exception-1.1", "u-boot-exception-2.0", "wxwindows-exception-3.1",
]
IDENTIFIERS = set(PLAIN)
for _family, _versions in VERSIONED.items():
    IDENTIFIERS |= {f"{_family}-{v}{s}" for v in _versions for s in ["", *(SUFFIXES if _family in SUFFIXED else [])]}
TAG = "spdx license identifier"
# How much a label restricts.
RESTRICTION = {
    "agpl": 0.7,
    "apache": 0.25,
    "apache-2.0": 0.25,
    "bsl": 0.2,
    "cc0": 0.0,
    "cddl": 0.4,
    "epl": 0.4,
    "eupl": 0.5,
    "gfdl": 0.6,
    "isc": 0.2,
    "ofl": 0.3,
    "unlicense": 0.0,
    "wtfpl": 0.0,
    "bsd": 0.2,
    "cc-by": 0.3,
    "cc-by-4.0": 0.3,
    "cc-by-nc-4.0": 0.8,
    "cc-by-sa-4.0": 0.5,
    "gpl": 0.6,
    "gpl-2.0": 0.6,
    "gpl-3.0": 0.6,
    "lgpl": 0.5,
    "mit": 0.2,
    "mpl": 0.4,
    "public-domain": 0.0,
    "reserved": 1.0,
}
UNKNOWN = 0.7

_TOKEN = re.compile(rb"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_TAG_TEXT = re.compile(rb"spdx-license-identifier:([^\r\n]*)", re.I)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def restriction(name: str) -> float:
    family = next((k for k in (name, *(name[:n] for n in range(len(name) - 1, 2, -1))) if k in RESTRICTION), None)
    return RESTRICTION[family] if family else UNKNOWN


def identifier(token: str, exception: bool) -> str | None:
    """The identifier that a token is, without a `+` for later versions; None if it is none."""
    name = token.rstrip(".:")
    plain = name.removesuffix("+")
    if exception:
        return name if name in EXCEPTIONS else None
    return plain if plain in IDENTIFIERS or re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", plain) else None


def parse(expression: bytes) -> tuple[list[str], float] | None:
    """Identifiers of an expression in order, and its restriction; None if it is none. Ends where it stops to be one."""
    output: list[str] = []
    stack: list[str] = []
    operand = False  # whether an operand came last
    at = 0
    for m in _TOKEN.finditer(expression):
        if expression[at : m.start()].strip():
            break
        t = m[0].decode().lower()
        if t == "(" and not operand:
            stack.append(t)
        elif t == ")" and operand:
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif t in _RANK and operand:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                output.append(stack.pop())
            stack.append(t)
            operand = False
        elif t not in _RANK and t not in "()" and not operand:
            if (name := identifier(t, bool(stack) and stack[-1] == "with")) is None:
                break
            output.append("=" + name)
            operand = True
        else:
            break
        at = m.end()
    if not operand or "(" in stack:
        return None
    output += reversed(stack)
    names, values = [], []
    for t in output:
        if t[0] == "=":
            names.append(t[1:])
            values.append(restriction(t[1:]))
        else:
            b, a = values.pop(), values.pop()
            values.append(min(a, b) if t == "or" else max(a, b) if t == "and" else a / 2)
    return names, values[0]


def automaton() -> ahocorasick.Automaton:
    """Over words, each with a space before it and one after the last; a value lists (words, label, kind)."""
    found: dict[str, list[tuple[int, str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.setdefault(f" {phrase} ", []).append((len(phrase.split()), label, kind))
    a = ahocorasick.Automaton()
    for k, v in found.items():
        a.add_word(k, v)
    a.make_automaton()
    return a


def scan_text(text: bytes, a: ahocorasick.Automaton) -> tuple:
    w = text.translate(WORD_TABLE).split()
    line = b" " + b" ".join(w) + b" "
    n_base, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    passed = at = 0
    tags: list[int] = []
    for end, hits in a.iter(line.decode("latin-1")):
        passed += line.count(b" ", at, end + 1)
        at = end + 1
        for k, label, kind in hits:
            if kind == "tag":
                tags.append(passed - k - 1)
                continue
            if kind == "base":
                place = passed - k - 1
                n_base += 1
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
                base.add(label)
            labels.add(label)
            score = max(score, restriction(label))
    if tags:  # the raw bytes from the tag's first word on
        starts = [m.start() for m in _WORD.finditer(text)]
        for k in tags:
            if (m := _TAG_TEXT.match(text, starts[k])) and (x := parse(m[1].strip())) is not None:
                labels.update(x[0])
                score = max(score, x[1])
    return len(w), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels | base)), score


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in steps(batches):
            rows = [scan_text(t, a) for t in byte_list(column(b, "text"))]
            yield pa.record_batch([column(b, "doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
