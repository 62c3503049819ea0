"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, checksums.

One automaton holds every keyword (rule words, token prefixes and all four-character
hex grams, which every long hex run contains).  It walks the text once with A-Z folded;
a rule's expression is tried only at the places its keywords name, on the original
text.  Token formats that embed a CRC-32 are kept only when it verifies.

Null and empty texts have no spans.  Texts of any length are scanned whole; hits are judged as
they come, so memory follows the text and its spans, not its hits.  Spans that start together
are ordered by kind.  Repeated rows are scanned separately; an empty table gives no rows.  Only
the id and the text column are read, so other columns of the input may have any name.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in reporting order; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
# Keywords of each rule, lower case.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
HEX_GRAM = 4

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of a token body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _checked(m: re.Match) -> bool:
    return base62_crc(m[1][:30]) == m[1][30:]


RULES = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 6),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 20),
    "hex": (_HEX, lambda m: m.end() - m.start() >= 24),
    "github": (_GITHUB, _checked),
    "npm": (_NPM, _checked),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for k in keys:
            a.add_word(k, (kind, len(k)))
    for gram in itertools.product("0123456789abcdef", repeat=HEX_GRAM):
        a.add_word("".join(gram), ("hex", HEX_GRAM))
    a.make_automaton()
    return a


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text, by start and then kind as listed."""
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    spans, done = [], dict.fromkeys(RULES, 0)
    for end, (kind, size) in automaton().iter(folded):  # starts of one kind ascend, as no keyword holds another of its kind
        at = end - size + 1
        if at >= done[kind]:
            pattern, keep = RULES[kind]
            if m := pattern.match(text, at):
                done[kind] = m.end()
                if keep(m):
                    spans.append((at, done[kind], kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, and ``spans`` array<struct<kind, start, end>> in code points."""
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t)] if (t := x.as_py()) else [] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], [id_col, "spans"])

    return kept.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
