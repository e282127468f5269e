"""License scan: Aho-Corasick over whole texts for notice phrases and identifier tags; a shunting-yard
parser evaluates the and/or/with expression behind each tag.

Words are runs of digits, letters and everything beyond ASCII, with A-Z lower-cased.  One automaton
finds every phrase at word edges in one pass over the words joined by single spaces.  The work is one
map over the rows: no shuffle, memory of one Arrow batch and its longest text.

Null or empty text: no words, nothing found, score 0.  Repeated rows are scanned alike.  A tag counts
where a known identifier, or one of the text's own (``LicenseRef-..``), follows; an expression that begins so and is
malformed gives the label ``spdx-malformed`` and no identifiers.  Extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm import _text as T

# Phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
# License identifiers that a tag may name, in lower case, by family; "+" may follow one.
PERMISSIVE = (
    "0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause "
    "bsl-1.0 cc0-1.0 cc-by-3.0 cc-by-4.0 curl ftl icu isc libpng mit mit-0 ms-pl ncsa openssl postgresql psf-2.0 python-2.0 unicode-3.0 unlicense upl-1.0 wtfpl x11 zlib zpl-2.1"
).split()
OTHER = (
    "agpl-3.0 agpl-3.0-only agpl-3.0-or-later cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 "
    "gfdl-1.3-only gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later "
    "lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-rl ofl-1.1 osl-3.0 qpl-1.0 rpl-1.5 sissl spl-1.0 vim"
).split()
# Exceptions that may stand behind "with".
EXCEPTIONS = "autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 u-boot-exception-2.0".split()
OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
# How much a base phrase, another notice and a tag with a valid expression speak for a license.
WEIGHTS = {"base": 0.9, "notice": 0.6, "tag": 0.95}

FOLDED = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
TAG_AT = re.compile(r"(?i)spdx[^a-z0-9]{1,3}license[^a-z0-9]{1,3}identifier[ \t]*:?")
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
LICENSES = frozenset(PERMISSIVE + OTHER)


def is_license(word: str) -> bool:
    return word.removesuffix("+") in LICENSES or OWN.fullmatch(word) is not None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            kinds.setdefault(phrase, []).append((kind, label))
    for phrase, said in kinds.items():
        found.add_word(f" {phrase} ", (len(phrase.split()), said))
    found.make_automaton()
    return found


def parse_expression(text: str, at: int = 0) -> tuple[list[str], bool]:
    """The longest expression that starts here as postfix tokens (shunting-yard), and whether it is well formed.

    Operands are known identifiers or references of the text's own; behind "with", known exceptions.  An operator that
    another word follows ends the expression before it, as in "MIT or any later version"."""
    out: list[str] = []
    waiting: list[str] = []
    operand, behind = True, ""  # an operand comes next, behind this operator
    while m := TOKEN.match(text, at):
        word = m[1].rstrip(".:").lower()
        if operand and word == "(" and behind != "with":
            waiting.append(word)
        elif operand and (word in EXCEPTIONS if behind == "with" else is_license(word)):
            out.append(word)
            operand = False
        elif not operand and word == ")":
            if "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif not operand and word in PRECEDENCE and _goes_on(text, m.end(), word):
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand, behind = True, word
        else:
            break
        at = m.end()
    well = not operand and "(" not in waiting
    return out + waiting[::-1], well


def _goes_on(text: str, at: int, operator: str) -> bool:
    """Whether an operand, a parenthesis or the text's end follows: the last leaves the expression malformed."""
    m = TOKEN.match(text, at)
    word = m[1].rstrip(".:").lower() if m else ""
    return not m or (word in EXCEPTIONS if operator == "with" else word == "(" or is_license(word))


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Licenses named by an expression (no exceptions), and whether it leaves a permissive choice (or: any, and: both, with: the license)."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (right, b), (left, a) = stack.pop(), stack.pop()
            stack.append((left, a) if token == "with" else (left | right, (a or b) if token == "or" else a and b))
        else:
            stack.append(({token}, token.removesuffix("+") in PERMISSIVE))
    return stack[0]


def names_something(text: str, at: int) -> bool:
    """Whether what stands behind a tag begins as an expression does, well formed or not."""
    m = TOKEN.match(text, at)
    while m and m[1] == "(":
        m = TOKEN.match(text, m.end())
    return m is not None and is_license(m[1].rstrip(".:").lower())


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive (null without a tag)."""
    words = text.encode("utf-8", "replace").translate(FOLDED).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, own, n, first, last, seen, before = set(), set(), 0, None, None, 0, 0
    kinds: set[str] = set()
    for end, (length, said) in automaton().iter(joined):
        seen += joined.count(" ", before, end)
        before = end
        start = seen - length
        for kind, label in said:
            kinds.add(kind)
            if kind == "base":
                n += 1
                base.add(label)
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
            elif kind == "notice":
                own.add(label)
    permissive = None
    if "tag" in kinds:
        kinds.discard("tag")
        for m in TAG_AT.finditer(text):
            postfix, well = parse_expression(text, m.end())
            if well:
                names, free = evaluate(postfix)
                own |= names
                permissive = free if permissive is None else permissive and free
                kinds.add("tag")
            elif names_something(text, m.end()):
                own.add("spdx-malformed")
    missing = 1.0
    for kind in sorted(kinds):
        missing *= 1.0 - WEIGHTS[kind]
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 - missing, permissive


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


@T.lean
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
    for b in batches:
        found = [scan(t.as_py() or "") for t in b.column("t")]
        columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the places of base phrases, the labels of base phrases, notices and expressions, and a score."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(_rows, SCHEMA)
