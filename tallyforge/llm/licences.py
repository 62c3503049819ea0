"""Licence scan: an automaton over identifier tags and notice phrases, and licence expressions.

The automaton finds notice phrases and the words of an identifier tag.  A tag counts where a
colon follows; the rest of its line, however long, is a licence expression.  A shunting-yard
parser turns it into postfix with the precedences ``with`` > ``and`` > ``or`` and parentheses,
and the evaluator gives the licences it names and whether some choice allowed by it is
permissive.  Operands are identifiers of any name: letters, digits, dots, hyphens and a plus.
Between two of them a slash means ``or`` and a comma ``and``.  The expression ends with its line,
at a parenthesis that closes none of its own, or where a word follows an operand: the rest of
the line is prose.  An operand that prose follows is read only if it is a known name written as
one (``FAMILIES``, with a digit or two capitals); any other is read if it is known or has a
capital or digit.  What is not read keeps its place as an unknown licence, without a label and
not permissive, and the other operands keep theirs.  NONE and NOASSERTION name no licence.

``score`` is the evidence that the text states a licence: 1 - product over the places of
(1 - weight), with weight 0.95 for a tag whose expression parses and the phrase's weight
otherwise; 0 without any place.

Null and empty texts have no words, no labels and score 0; a malformed expression gives no
label.  Texts of any length are read whole.  Equal places are ordered by their start; phrases
that overlap all count.  Repeated rows are scanned separately, an empty table gives no rows,
and only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.phrases import PhraseIndex
from tallyforge.llm.words import buffers, groups, words

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, their labels and weights.
NOTICES = {
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd 2 clause": ("bsd", 0.6),
    "bsd 3 clause": ("bsd", 0.6),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
    "under cc by": ("cc-by", 0.6),
    "under cc by nc": ("cc-by-nc", 0.6),
    "under cc by sa": ("cc-by-sa", 0.6),
    "under cc0": ("cc0", 0.6),
    "creative commons attribution": ("cc-by", 0.6),
    "all rights reserved": ("proprietary", 0.4),
}
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.7, 0.95
# Families that count as permissive.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "unlicense", "zlib", "cc-by", "0bsd", "bsl")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_LEXEME = re.compile(r"[()/,]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_LEAD = re.compile(r"[ \t\"']*:[ :\t]*")
_SEPARATORS = {"/": "or", ",": "and"}
# Heads of the licence identifiers that are known.
FAMILIES = (
    "0bsd aal afl agpl apache apl artistic blueoak bsd bsl bzip2 cal cc cc0 cddl cdla cecill cern cnri cpal cpl curl ecl efl epl eudatagrid eupl fair fsfap ftl gfdl gpl hpnd icu "
    "ijg imagemagick intel ipa ipl isc json lgpl libpng lpl lppl miros mit mpl ms-pl ms-rl mulanpsl nasa naumen ncsa ngpl nokia nposl ntp odbl odc ofl ogl oldap openssl osl pddl "
    "php postgresql psf python qpl rpl ruby saxpath sgi simpl sissl sleepycat spl sspl tcl ucl unicode unlicense upl vim w3c watcom wtfpl x11 xnet zlib zpl"
).split()
_IDENTIFIER = re.compile(rf"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|(?:{'|'.join(map(re.escape, FAMILIES))})(?:[-+.0-9][a-z0-9.+-]*)?")
# Families whose versions and variants share a label, and names that are no licence.
_FAMILY = re.compile(r"(mit|apache|lgpl|agpl|gpl|mpl|epl|bsd|isc|cc0|cc-by-nc-sa|cc-by-nc-nd|cc-by-nc|cc-by-nd|cc-by-sa|cc-by|unlicense|zlib|0bsd|bsl)(?:-?[0-9][0-9.]*|-v[0-9.]+|-clause|-only|-or-later|\+)*")
NO_LICENCE = ("none", "noassertion")
UNKNOWN = ""


class ExpressionError(ValueError):
    """The text is not a licence expression."""


def is_known(word: str) -> bool:
    return _IDENTIFIER.fullmatch(word.lower()) is not None


def is_read(word: str, before_prose: bool) -> bool:
    """Whether an operand is taken for a licence; before prose only a known name that is written as one."""
    capitals, digits = sum(map(str.isupper, word)), any(map(str.isdigit, word))
    if word.lower() in NO_LICENCE:
        return False
    if before_prose:
        return is_known(word) and (digits or capitals > 1)
    return is_known(word) or digits or capitals > 0


def to_postfix(text: str, at: int = 0, end: int | None = None) -> list[str]:
    """Shunting-yard: operands (``UNKNOWN`` where not read) and operators of the licence expression in text[at:end] in postfix order."""
    out, stack, want_operand, separator, named = [], [], True, None, False

    def push(op: str) -> None:
        while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[op]:
            out.append(stack.pop())
        stack.append(op)

    lexemes = (m[0] for m in _LEXEME.finditer(text, at, len(text) if end is None else end))
    lexeme, after = next(lexemes, None), None
    while lexeme is not None:
        after, low = next(lexemes, None), lexeme.lower()
        is_word = low not in _PRECEDENCE and low not in _SEPARATORS and low not in "()"
        prose = after is not None and after.lower() not in _PRECEDENCE and after.lower() not in _SEPARATORS and after not in "()"
        word = lexeme.rstrip(".:-")
        if separator is not None:
            if low != "(" and not (is_word and is_read(word, prose)):
                break
            push(_SEPARATORS[separator])
            separator, want_operand = None, True
        if low == ")" and not want_operand and "(" not in stack:
            break
        if is_word:
            if not want_operand:
                break  # the expression ends where two operands meet: the rest of the line is prose
            exception = bool(stack) and stack[-1] == "with"
            good = exception or is_read(word, prose)
            named |= good and not exception
            out.append(word.lower() if good else UNKNOWN)
            want_operand = False
        elif low == "(":
            if not want_operand:
                break
            stack.append("(")
        elif want_operand:
            raise ExpressionError("an operand is missing")
        elif low in _SEPARATORS:
            separator = low
        elif low in _PRECEDENCE:
            push(low)
            want_operand = True
        else:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        lexeme = after
    if want_operand:
        raise ExpressionError("an operand is missing")
    if not named:
        raise ExpressionError("no licence identifier")
    while stack:
        if (op := stack.pop()) == "(":
            raise ExpressionError("a parenthesis stays open")
        out.append(op)
    return out


def family(identifier: str) -> str:
    m = _FAMILY.fullmatch(identifier)
    return m[1] if m else identifier.rstrip("+.")


def evaluate(postfix: list[str]) -> tuple[frozenset[str], bool]:
    """(licences named, whether some permitted choice is permissive)."""
    stack: list[tuple[set[str], bool]] = []
    for x in postfix:
        if x not in _PRECEDENCE:
            stack.append(({family(x)} - {UNKNOWN}, family(x) in PERMISSIVE))
            continue
        (b, bp), (a, ap) = stack.pop(), stack.pop()
        if x == "with":  # an exception relaxes its licence and names none itself
            stack.append((a, ap))
            continue
        small, large = sorted((a, b), key=len)
        large |= small
        stack.append((large, ap and bp if x == "and" else ap or bp))
    return frozenset(stack[0][0]), stack[0][1]


@lru_cache(maxsize=1)
def index() -> PhraseIndex:
    patterns = [(tuple(p.split()), ("base", label, BASE_WEIGHT)) for p, label in BASE.items()]
    patterns += [(tuple(p.split()), ("notice", *x)) for p, x in NOTICES.items()]
    return PhraseIndex([*patterns, (tuple(TAG.split()), ("tag", "", TAG_WEIGHT))])


def scan(texts: pa.Array) -> list[tuple[int, list[int], set[str], set[str], float, bool | None]]:
    """For each text: words, starts of base places, base labels, all labels, score, permissive (tags only)."""
    buf, offs = buffers(texts)
    idx, out = index(), []
    for i, j in groups(offs):
        part, po = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, h = words(part, po)
        row = np.searchsorted(po, s, side="right") - 1
        count = np.bincount(row, minlength=j - i)
        before = np.concatenate([[0], np.cumsum(count)])
        found = [(int(n), [], set(), set(), 1.0, None) for n in count]
        plain, line = "", range(0)  # one character per byte, made for the first tag; the tag line looked at last
        for a, b, values in idx.matches(idx.numbered(h), row):
            r = int(row[a])
            n, places, base, labels, miss, permissive = found[r]
            for what, label, weight in values:
                if what == "base":
                    places.append(int(a - before[r]))
                    base.add(label)
                if what == "tag":
                    plain = plain or bytes(part).decode("latin-1")
                    start, stop = int(e[b - 1]), int(po[r + 1])
                    if start not in line:
                        end = plain.find("\n", start, stop)
                        line = range(start, end if end >= 0 else stop)
                    try:
                        if not (lead := _LEAD.match(plain, start, max(start, line.stop))):
                            raise ExpressionError("no tag without a colon")
                        names, free = evaluate(to_postfix(plain, lead.end(), line.stop))
                    except ExpressionError:
                        continue
                    labels |= names
                    permissive = free if permissive is None else permissive and free
                else:
                    labels.add(label)
                miss *= 1 - weight
            found[r] = (n, places, base, labels, miss, permissive)
        out += [(n, places, base, labels, 1 - miss, permissive) for n, places, base, labels, miss, permissive in found]
    return out


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: the id, n_words, places (base starts, ascending), base_labels, labels (sorted arrays), score, permissive."""
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(b.column(1))
            columns = [
                b.column(0),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([sorted(x[1]) for x in found], pa.list_(pa.int64())),
                pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                pa.array([sorted(x[3]) for x in found], pa.list_(pa.string())),
                pa.array([x[4] for x in found], pa.float64()),
                pa.array([x[5] for x in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "places", "base_labels", "labels", "score", "permissive"])

    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, places array<bigint>, base_labels array<string>, labels array<string>, score double, permissive boolean")
