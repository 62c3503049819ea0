"""Alignment of two tokenizers over the same texts by elementary byte intervals.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model.  A reads a
space and the text, B the text (it adds the space itself).  The union of both arrays of token
ends cuts the bytes into elementary intervals; ``searchsorted`` names the A and the B token that
own each one, and as two ranges meet in one piece, every interval is one overlap: a link.  Ends
that both have close a group, and a group's A tokens times its B tokens is its product.  Both
sides cut at a space after a word, so each distinct word with its space is aligned once per
worker (many in one run of bytes) and a text is put together from its words.

Counts of linked id pairs over all texts take three jobs: texts are encoded once and stored with
their distinct links, links are summed by pair, and sums are joined back.  The most frequent
pairs (at most ``HEAD`` of them, by a threshold read from a histogram of the counts) are sent to
every task; each of the others has less than one ``HEAD``th of all links, so the shuffle of the
rest has no hot key.

A byte-level BPE whose merges make its ids in ascending order (checked when it is loaded) gives
the same ids by ranks, which tiktoken does at four times the speed; any other goes through its
own library.

Null and empty texts, and texts whose joined token bytes of either side differ from space and
text (those with U+2581 itself, for one), have no tokens: zeros and empty groups.  Texts of any
length are encoded whole.  Repeated rows are texts of their own, whatever their id, and count
each.  Ties for a B id's highest count all are best.  An empty table gives no rows.  Strings of
special tokens inside texts are plain text.  Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import save, temporary
from tallyforge.llm.words import release

#: Characters of texts, and of new units, that are handled at once (their arrays stay in a core's cache).
CHUNK = 1 << 16
#: Characters of units after which a worker forgets what it knows (about 60 MB).
UNIT_CHARS = 1 << 21
#: Most frequent id pairs that every task gets at most (about 5 MB).
HEAD = 1 << 17


def byte_alphabet() -> dict[str, int]:
    """The byte of each character by which byte-level vocabularies write bytes: printable ones are themselves, the others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Tokenizers:
    """Both tokenizers of a worker, with the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(byte_path)
        self.whole.encode_special_tokens = True
        alphabet = byte_alphabet()
        own = json.loads(self.whole.to_str())
        known = {i: bytes(alphabet[c] for c in t) for t, i in own["model"]["vocab"].items()}
        added = {t["id"]: t["content"].encode() for t in own["added_tokens"]}
        every = known | added
        self.a_bytes = [every.get(i, b"") for i in range(max(every) + 1)]
        self.ranked = self._ranked(own, {t: i for i, t in known.items() if i not in added})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.cut = self.ranked is not None and not any("▁" in self.pieces.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        ends = [[f"{i}{mark}" for i in range(len(t)) for mark in marks] for t, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.written = ends[0] + ends[1]  # 2 id (+ 1 at the end of its group) for A, then the same for B

    @staticmethod
    def _ranked(own: dict, ranks: dict[bytes, int]):
        """The same BPE by ranks; None unless its settings and the order of its merges allow it."""
        import tiktoken

        model, split = own["model"], own["pre_tokenizer"] or {}
        alphabet = byte_alphabet()
        made = [ranks.get(bytes(alphabet[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in model["merges"]]
        plain = (
            model["type"] == "BPE"
            and not (model["dropout"] or model["ignore_merges"] or model["unk_token"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"])
            and not (own["normalizer"] or own["truncation"] or own["padding"])
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and None not in made
            and all(x < y for x, y in zip(made, made[1:]))
            and len(made) + 256 == len(ranks)
        )
        # Fixed value: the split of byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where a side's bytes are not those of space and text."""
        spaced = " " + text
        raw = spaced.encode()
        if self.ranked is not None:
            a = self.ranked.encode_ordinary(spaced)  # takes bytes as they are, so they need no check
        else:
            a = self.whole.encode(spaced, add_special_tokens=False).ids
            if b"".join(map(self.a_bytes.__getitem__, a)) != raw:
                return _NONE
        b = self.pieces.encode(text, num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return _NONE
        return np.array(a, np.int64), np.array(b, np.int64)


def intervals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per elementary interval the A token and the B token that own it, and whether its end is one of both (and closes a group).

    The union of both ends with how many sides have each: ``union1d`` and ``intersect1d`` in one sort.
    """
    ends, sides = np.unique(np.concatenate([a_ends, b_ends]), return_counts=True)
    starts = np.concatenate([np.zeros(1, np.int64), ends])[: len(ends)]
    return np.searchsorted(a_ends, starts, "right"), np.searchsorted(b_ends, starts, "right"), sides == 2


class Aligner(dict):
    """Alignments of units by number, filled on demand; one per Python worker.

    A unit starts at a space after a character that is no white space and holds all up to the
    next one.  No token of either side crosses that place (A cuts there, B has no piece with a
    space after something else, which is checked), so a text's alignment is its units' in a row.
    """

    def __init__(self, t: Tokenizers) -> None:
        super().__init__()
        self.t = t
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.groups: list[str] = []
        self.kept = 0
        self.counts = np.zeros((0, len(_COUNTS)), np.int64)
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.waiting.append(unit)
        self.kept += len(unit)
        return number

    def units(self, text: str) -> list[str]:
        if not self.t.cut:
            return [text]
        words = text.split(" ")
        if _LOOSE.search(" " + text):
            out = [words[0]]
            for w in words[1:]:
                if not out[-1] or out[-1][-1].isspace():
                    out[-1] += " " + w
                else:
                    out.append(w)
            words = out
        if not words[-1] and len(words) > 1:  # a space at the end is no unit of its own: B adds none to an empty text
            words[-2:] = [words[-2] + " "]
        return words

    def _batches(self) -> Iterator[list[str]]:
        """The waiting units in their order, at most about ``CHUNK`` characters at a time; those with white space at an end by themselves."""
        some, size = [], 0
        for unit in self.waiting:
            loose = not unit or unit != unit.strip()
            if some and (loose or size >= CHUNK):
                yield some
                some, size = [], 0
            if loose:
                yield [unit]
            else:
                some.append(unit)
                size += len(unit)
        if some:
            yield some

    def fill(self) -> None:
        """Aligns the units that were asked for and not known, some at a time."""
        counts, firsts, pairs = [self.counts], [self.first], [self.pairs]
        for some in self._batches():
            c, texts, pair = align_units(self.t, some)
            counts.append(c)
            self.groups += texts
            firsts.append(firsts[-1][-1] + np.cumsum(c[:, 3]))
            pairs.append(pair)
        if len(counts) > 1:
            self.counts, self.first, self.pairs = np.concatenate(counts), np.concatenate(firsts), np.concatenate(pairs)
        self.waiting = []

    def rows(self, texts: list[str | None]) -> list[pa.Array]:
        """Columns of ``align`` but the ids, for some texts."""
        if self.kept >= UNIT_CHARS:
            self._empty()
        numbers = [[self[u] for u in self.units(x)] if x else [] for x in texts]
        self.fill()
        n = np.array([len(x) for x in numbers], np.int64)
        units, row = np.array([i for x in numbers for i in x], np.int64), np.repeat(np.arange(len(texts)), n)
        counts = self.counts[units]
        whole = np.bincount(row, counts[:, 0] == 0, len(texts)) == 0  # a unit without tokens: its text has none
        counts = np.stack([np.bincount(row, c, len(texts)) for c in counts.T]).astype(np.int64) * whole
        groups = [";".join(map(self.groups.__getitem__, x)) if w else "" for x, w in zip(numbers, whole.tolist(), strict=True)]

        units, row = units[whole[row]], row[whole[row]]
        first, links = self.first[units], np.diff(self.first)[units]
        place = np.repeat(first - np.cumsum(links) + links, links) + np.arange(links.sum())
        width_a, width_b = len(self.t.a_bytes), len(self.t.b_bytes)
        found, times = np.unique(np.repeat(row, links) * (width_a * width_b) + self.pairs[place], return_counts=True)
        row, pair = np.divmod(found, width_a * width_b)
        pair = (pair // width_b << 32) | pair % width_b
        offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(pair), pa.array(times, pa.int64())], fields=list(_LINK))
        return [*map(pa.array, counts), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), structs)]


_LOOSE = re.compile(r"\s ")
_LINK = pa.struct([("pair", pa.int64()), ("times", pa.int64())])
_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_products"]


def encode_units(t: Tokenizers, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens of each unit, and all A and B ids in a row.

    Units that neither start nor end with white space are encoded joined by spaces, since no
    token crosses these; the bytes at which they start part the ids.
    """
    joined = t.cut and all(x and x == x.strip() for x in texts)
    a, b = t.encode(" ".join(texts)) if joined else _NONE
    if len(a):
        unit_ends = np.cumsum([len(x.encode()) + 1 for x in texts])
        n_a, n_b = (np.bincount(np.searchsorted(unit_ends, np.cumsum(size[ids])), minlength=len(texts)) for size, ids in ((t.a_size, a), (t.b_size, b)))
        return n_a, n_b, a, b
    encoded = [t.encode(x) for x in texts]
    n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
    return n_a, n_b, *(np.concatenate([e[k] for e in encoded]) for k in (0, 1))


def align_units(t: Tokenizers, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Counts (texts x ``_COUNTS``), written groups, and the id pair of every link in order, as a x vocabulary of B + b."""
    rows = len(texts)
    n_a, n_b, a, b = encode_units(t, texts)
    own_a, own_b, closes = intervals(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
    group = np.cumsum(closes) - closes
    ends_a, ends_b = (np.flatnonzero(np.diff(own, append=-1)) for own in (own_a, own_b))  # the interval with which each token ends
    group_a, group_b = group[ends_a], group[ends_b]
    in_a, in_b = (np.bincount(g, minlength=int(closes.sum())) for g in (group_a, group_b))
    row_link = np.repeat(np.arange(rows), n_a)[own_a]
    row_group = row_link[closes]
    counts = [n_a, n_b, np.bincount(row_group, minlength=rows), np.bincount(row_link, minlength=rows), np.bincount(row_group, in_a * in_b, rows)]

    # text form: each group's A ids, then its B ids
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + closes[ends_a]
    codes[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * (len(t.a_bytes) + b) + closes[ends_b]
    at, groups, codes = 0, [], codes.tolist()
    for n in (n_a + n_b).tolist():
        groups.append("".join(map(t.written.__getitem__, codes[at : at + n]))[:-1])
        at += n
    return np.stack(counts, 1).astype(np.int64), groups, a[own_a] * len(t.b_bytes) + b[own_b]


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(Tokenizers(byte_path, piece_path))


def align(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_a n_b n_groups n_links n_products``, ``groups`` as text and ``links``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in order; ``links`` holds each distinct id pair of the row
    as ``a << 32 | b`` with its number of links.
    """
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()
    names = [id_col, *_COUNTS, "groups", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(byte_path, piece_path)
        for batch in batches:
            texts, size, first = [], 0, 0
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *known.rows(texts)], names)
                    texts, size, first = [], 0, i + 1
        release()

    longs = ", ".join(f"{c} bigint" for c in _COUNTS)
    return kept.mapInArrow(run, f"`{id_col}` {kind}, {longs}, groups string, links array<struct<pair:bigint,times:bigint>>")


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """A number that tells rows apart; it holds once the result is stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): links of every id pair in all rows, and whether none of its B id has more.

    The highest counts are one row per B id, so their table is as long as B's vocabulary at most.
    """
    counts = save(aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("times").alias("links")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def head_threshold(counts: DataFrame, most: int = HEAD) -> int:
    """The smallest power of 2 ** (1/8), as a count, that at most ``most`` pairs reach."""
    step = F.floor(8 * F.log2("links")).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return int(np.ceil(2 ** (least / 8) - 1e-9)) if least is not None else np.iinfo(np.int64).max


def link_scores(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` (stored, with a ``row`` number) with ``n_best`` and ``count_sum`` in place of its links."""
    with temporary(aligned.sparkSession):
        counts = save(pair_counts(aligned), "counts", keep=True)
    least = head_threshold(counts, head)
    links = aligned.select("row", F.inline("links"))
    frequent, rest = counts.filter(F.col("links") >= least), counts.filter(F.col("links") < least)

    def sums(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))

    near = sums(links.join(F.broadcast(frequent), "pair"))
    far = sums(links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rest, "pair"))
    both = near.unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("links").join(both, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
