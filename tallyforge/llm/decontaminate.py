"""Benchmark decontamination: one automaton over the items' normalised words.

Items and texts are normalised alike: A-Z folded, words taken, everything between words
dropped.  Each item gives windows of ``window`` consecutive words (an item of fewer, but
not none, is one window).  The automaton holds the items' words cut into blocks of half a
window (and short items whole): every window contains a whole block, and blocks need a tenth
of the nodes that windows would.  A text is scanned once; around each block that occurs the
windows of the text are looked up by hash in a table of all windows and compared with the
item word by word, on the words themselves.  Each occurrence covers words, and the covered runs
are mapped back to code-point offsets of the original text.

The items travel to the tasks, so their size is counted first, exactly.  Up to ``max_words``
item words (one per 16 bytes at least) one automaton is built and the text goes through one
scan.  A benchmark beyond that does not fit a worker's memory; its items (long ones in
overlapping pieces) are then dealt into groups of about that size by a hash, and the text goes
through one scan per group, each adding to the intervals that the earlier ones found.  The
driver holds one group at a time.

Null and empty texts have no words.  Repeated item rows count once per distinct id.  Items
without an id cover words like any other; together they are one item, a null at the end of a
text's items (it counts in their number and is not named in the digest).  Texts of any length
are scanned whole.  Repeated text rows are scanned separately; an empty table of texts gives
no rows, one of items no hits.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import save
from tallyforge.llm.words import buffers, code_points, groups, hash_word, mix, release, text_words, words

WINDOW = 10
MAX_WORDS = 1_000_000
PIECE = 50_000
BYTES_A_WORD = 16


def windows(ws: list[str], size: int) -> list[tuple[str, ...]]:
    if not ws:
        return []
    return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]


_RUN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])
_RUN_SQL = "array<struct<first:bigint,end:bigint,start_char:bigint,end_char:bigint>>"


def in_order(ids: set[str | None]) -> list[str | None]:
    """Item ids ascending, the null last."""
    return sorted(ids, key=lambda x: (x is None, x or ""))


class WindowIndex:
    """``pieces``: (item, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str | None, str]], window: int) -> None:
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.items = [item for item, _ in pieces]
        lists = [text.split(" ") for _, text in pieces]
        size = np.array([len(ws) for ws in lists], np.int64)
        self.vocabulary = sorted({w for ws in lists for w in ws})
        ids = {w: i for i, w in enumerate(self.vocabulary)}
        self.flat = np.fromiter((ids[w] for ws in lists for w in ws), np.int64, int(size.sum()))  # all item words
        first = np.cumsum(size) - size
        hashes = np.array([hash_word(w) for w in self.vocabulary], np.uint64)
        self.hashes, number = np.unique(hashes, return_inverse=True)
        self.number = number.ravel() + 1  # of each vocabulary word; words with one hash share it
        rng = np.random.default_rng(11)
        self.position = rng.integers(1, 1 << 63, window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        word_hash = hashes[self.flat]
        # every window: its hash with its length, where it starts among the item words, its item
        starts = np.concatenate([np.arange(f, f + max(n - window, 0) + 1) for f, n in zip(first, size, strict=True)]) if len(size) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(size)), np.maximum(size - window, 0) + 1)
        length = np.minimum(size, window)[owner]
        keys = np.zeros(len(starts), np.uint64)
        for n in np.unique(length):
            at = length == n
            keys[at] = self.window_hash(word_hash, starts[at], int(n))
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.owner, self.length = keys[order], starts[order], owner[order], length[order]
        self.short = np.unique(size[size < window]).tolist()
        self.shortest = min([*self.short, window])
        self.automaton = None
        if len(size):
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
            numbers = self.number[self.flat]
            for f, n in zip(first.tolist(), size.tolist(), strict=True):
                cut = [(f, f + n)] if n < window else [(i, i + self.block) for i in range(f, f + n - self.block + 1, self.block)]
                for i, j in cut:
                    self.automaton.add_word(tuple(numbers[i:j].tolist()))
            self.automaton.make_automaton()

    def window_hash(self, word_hash: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(starts), n, np.uint64)
        for k in range(n):
            total += word_hash[starts + k] * self.position[k]
        return mix(total)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of a hash array, 0 where no item has such a word."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def candidates(self, numbers: np.ndarray, text_of: np.ndarray) -> dict[int, np.ndarray]:
        """{length: starts} of the windows of the texts that hold a block."""
        found: dict[int, list[np.ndarray]] = {}
        if self.automaton is not None and len(numbers):
            known = numbers > 0
            cut = np.ones(len(numbers) + 1, dtype=bool)
            cut[1:-1] = (known[1:] != known[:-1]) | (text_of[1:] != text_of[:-1])
            edges = np.flatnonzero(cut)
            starts, ends = edges[:-1], edges[1:]
            for s, e in zip(*(x[known[starts] & (ends - starts >= self.shortest)].tolist() for x in (starts, ends)), strict=True):
                hits = list(self.automaton.iter(tuple(numbers[s:e].tolist())))
                if not hits:
                    continue
                last, n = np.array(hits).T
                if e - s >= self.window and (at := s + last[n == self.block] - self.block + 1).size:
                    around = np.unique(at[:, None] - np.arange(self.window - self.block + 1)[None, :])
                    found.setdefault(self.window, []).append(around[(around >= s) & (around + self.window <= e)])
                for m in self.short:
                    if (at := s + last[n == m] - m + 1).size:
                        found.setdefault(m, []).append(at)
        return {n: np.concatenate(x) for n, x in found.items()}

    def matches(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, end word, piece) of every window that occurs; none crosses texts."""
        for n, starts in self.candidates(self.numbered(h), text_of).items():
            keys = self.window_hash(h, starts, n)
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            size = hi - lo
            at = np.repeat(starts, size)
            which = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            same = self.length[which] == n
            for a, w in zip(at[same].tolist(), which[same].tolist(), strict=True):
                item = self.start[w]
                if all(bytes(buf[s[a + k] : e[a + k]]).lower() == self.vocabulary[self.flat[item + k]].encode("utf-8", "surrogatepass") for k in range(n)):
                    yield a, a + n, int(self.owner[w])


class Scanner:
    """Scans Arrow text arrays; the index is built once per Python worker process."""

    _built: dict[int, WindowIndex] = {}

    def __init__(self, items: list[tuple[str | None, str]], window: int, token: int) -> None:
        self.items, self.window, self.token = items, window, token

    def index(self) -> WindowIndex:
        key = hash((self.token, self.window, len(self.items)))
        if key not in self._built:
            self._built.clear()
            self._built[key] = WindowIndex(self.items, self.window)
        return self._built[key]

    def scan(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, int, int]], list[str | None]]]:
        """For each text: word count, covered runs (words and code points), item ids."""
        index = self.index()
        buf, offs = buffers(texts)
        out = []
        for i, j in groups(offs):
            part, po = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s, e, h = words(part, po)
            row = np.searchsorted(po, s, side="right") - 1
            count = np.bincount(row, minlength=j - i)
            before = np.concatenate([[0], np.cumsum(count)])
            hits: dict[int, set[tuple[int, int]]] = {}
            ids: dict[int, set[str | None]] = {}
            for a, b, piece in index.matches(part, s, e, h, row):
                r = int(row[a])
                hits.setdefault(r, set()).add((a, b))
                ids.setdefault(r, set()).add(index.items[piece])
            for r in range(j - i):
                runs: list[list[int]] = []
                for a, b in sorted(hits.get(r, ())):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                if runs:
                    cp = code_points(part[po[r] : po[r + 1]])
                    runs = [(a - before[r], b - before[r], cp[s[a] - po[r]], cp[e[b - 1] - po[r]]) for a, b in runs]
                out.append((int(count[r]), [tuple(map(int, x)) for x in runs], in_order(ids.get(r, set()))))
        return out


def union_runs(a: list[tuple[int, int, int, int]], b: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Covered runs of two scans of one text, merged."""
    out: list[tuple[int, int, int, int]] = []
    for x in sorted([*a, *b]):
        if out and x[0] <= out[-1][1]:
            if x[1] > out[-1][1]:
                out[-1] = (out[-1][0], x[1], out[-1][2], x[3])
        else:
            out.append(x)
    return out


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """(item, words, weight) from (item, text): distinct, long items in pieces that overlap by all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = text_words(text.as_py())
                cut = [" ".join(ws[at : at + PIECE + window - 1]) for at in range(0, max(len(ws) - window + 1, 1), PIECE)] if ws else []
                weight = [max(x.count(" ") + 1, len(x.encode("utf-8", "surrogatepass")) // BYTES_A_WORD) for x in cut]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.string()), pa.array(weight, pa.int64())], ["item", "words", "weight"])

    return items.mapInArrow(run, "item string, words string, weight bigint").distinct()


def _groups_of(items: DataFrame, window: int, max_words: int) -> Iterator[tuple[int, list[tuple[str | None, str]]]]:
    """(number of groups, one group of pieces), fetched one after the other."""
    pieces = save(pieces_of(items, window), "items")
    total = pieces.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / max_words))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(n))
    for g in range(n):
        yield n, [(r["item"], r["words"]) for r in (pieces if n == 1 else pieces.where(part == g)).collect()]


def scan_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Per input row: the id (and ``keep`` columns), n_words, runs (covered words and code points), items (ids as strings, sorted, a null last)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    carried = [id_col, *[c for c in (keep or []) if c != id_col]]
    text_name = "__text"
    df = docs.select(*[F.col(c) for c in carried], F.col(text_col).alias(text_name), F.lit(0).cast("bigint").alias("n_words"), F.array().cast(_RUN_SQL).alias("runs"), F.array().cast("array<string>").alias("items"))
    schema = df.schema
    names = list(df.columns)
    at = {c: i for i, c in enumerate(names)}
    for n_groups, group in _groups_of(items, window, max_words):
        scanner = Scanner(group, window, hash(tuple(group)))

        def run(batches: Iterator[pa.RecordBatch], scanner=scanner) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(start, 1000) for whole in batches for start in range(0, whole.num_rows, 1000)):
                found = scanner.scan(b.column(at[text_name]))
                runs, ids = b.column(at["runs"]).to_pylist(), b.column(at["items"]).to_pylist()
                new_runs = [[dict(zip(("first", "end", "start_char", "end_char"), x, strict=True)) for x in union_runs([tuple(d.values()) for d in old], more)] for old, (_, more, _) in zip(runs, found, strict=True)]
                new_ids = [in_order({*old, *more}) for old, (_, _, more) in zip(ids, found, strict=True)]
                columns = [*[b.column(i) for i in range(len(carried) + 1)], pa.array([n for n, _, _ in found], pa.int64()), pa.array(new_runs, pa.list_(_RUN)), pa.array(new_ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            release()

        df = df.mapInArrow(run, schema)
        if n_groups > 1:  # so that the driver need not keep this group
            df = save(df, "scan")
    return df.drop(text_name)


def hit_words(runs):
    """Number of words covered by the runs column."""
    return F.coalesce(F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["first"]), F.lit(0).cast("bigint"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows in whose text no item window occurs, all columns as they were."""
    columns = docs.columns
    named = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    at, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    found = scan_items(named, benchmark, at, text, keep=named.columns, **more).where(F.size("runs") == 0)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
