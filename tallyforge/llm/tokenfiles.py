"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Format.  A folder holds two Parquet tables, so every store that Spark writes will do and a
lost executor's half-written blocks are never seen:

* ``ranks``: the dictionary, rows (rank, id), rank 0 the most frequent id (ties: smaller id).
* ``blocks``: rows (part, block, doc_ids, n_ids, lengths, control, data) in ascending
  (part, block), documents in ascending id.  ``lengths`` is little-endian uint32 ids per
  document.  Each id is stored as its rank in 1 to 4 little-endian bytes in ``data``; its
  byte count less one is a 2-bit code, four codes to a byte of ``control``, lowest first.
  The decoder looks control bytes up in a 256 x 4 table of byte counts and gathers.

Tokenising.  A tokenizer that folds case, drops white space and lets no piece cross it (which
is read from its own settings, see ``plain_settings``) gives a text the ids of its pieces cut
at spaces, tabs and line ends, joined.  Each distinct piece goes through the tokenizers library
once per worker (a cache of bounded size).  Texts that may hold a special token are not folded
before; all texts of any other tokenizer go through the library whole.

Null and empty texts have no ids of their own, only the end id.  A text of any length is
encoded whole.  Documents with equal ids (null ids come first) stand next to each other,
ordered by length and a hash of their tokens, and are dealt over several parts where there are
many.  Repeated rows are documents of their own.  An empty table gives files without blocks.
Other columns are not read.
"""

from __future__ import annotations

import gc
import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import delete, fresh_path, write
from tallyforge.llm.words import release

END_ID = 1
#: Distinct pieces that a worker keeps at most (about 200 bytes each), in two generations.
CACHE_PIECES = 600_000
LONGEST_KEPT = 64
CHUNK = 1 << 20
BLOCK_IDS = 1 << 20
PART_IDS = 1 << 22

_FOLD = bytes(32 if i in (9, 10, 13) else i + 32 if 65 <= i <= 90 else i for i in range(256))
_SPACES = bytes(32 if i in (9, 10, 13) else i for i in range(256))
_MARKS = ".,;:!?#$%&*"
# The settings under which pieces may be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def plain_settings(tokenizer) -> bool:
    """Whether ids of a text are those of its pieces, and letters and the marks after them are pieces of their own."""
    t = json.loads(tokenizer.to_str())
    steps = (t["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        (t["normalizer"] or {}).get("normalizers") == _NORMALIZERS
        and len(steps) == 2
        and (steps[0]["type"], steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ("Split", {"Regex": _SPLIT}, "Removed", True)
        and (steps[1]["type"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("ByteLevel", False, False)
        and t["model"]["type"] == "BPE"
        and not t["model"]["dropout"]
        and not t["truncation"]
        and all(x["content"].startswith("<|") and not x["single_word"] and not x["lstrip"] and not x["rstrip"] for x in t["added_tokens"])
    )


class Encoder(dict):
    """Ids (as bytes) of each piece, filled on demand; built once per Python worker."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.by_piece = plain_settings(self.tokenizer)
        self.old: dict[str, bytes] = {}
        letters = [c for c in map(chr, range(256)) if c.isalpha()] if self.by_piece else []
        self.seen = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, piece: str) -> str | None:
        """What the tokenizer's model sees of a piece of letters below U+0100; None for others."""
        if not piece.isalpha():
            return None
        if piece.isascii():
            return piece.lower()
        return piece.lower().translate(self.seen) if max(piece) < "\u0100" else None

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if not piece:
                found = b""
            elif (seen := self.letters(piece)) is not None:  # one piece, so the library's model may be asked at once
                found = array(self.code, [t.id for t in self.model.tokenize(seen)]).tobytes()
            elif (word := piece.rstrip(_MARKS)) != piece and self.letters(word) is not None:
                found = self[word] + self[piece[len(word) :]]  # letters and the marks that follow them are pieces of their own
            else:
                found = self.whole(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHE_PIECES // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self.whole(text)
        raw = text.encode("utf-8", "surrogatepass")
        # special tokens are matched before case is folded, so texts that may hold one keep their case
        raw = raw.translate(_SPACES if b"<|" in raw else _FOLD)
        out, at = [], 0
        while at < len(raw):  # a long text goes in chunks cut at spaces
            end = raw.find(b" ", at + CHUNK)
            end = len(raw) if end < 0 else end
            out.append(b"".join(map(self.__getitem__, raw[at:end].decode("utf-8", "surrogatepass").split(" "))))
            at = end
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of uint32 ranks."""
    r = ranks.astype(np.uint32)
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    wide = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    b = np.frombuffer(data, np.uint8)
    out = b[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= b[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A large binary array whose rows are runs of ``values``."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def binary_values(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values, number of each row's) of a binary column."""
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype), np.diff(o) // dtype.itemsize


def tokenize(df: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, ids): ids as bytes, without the end id."""
    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        gc.disable()  # the library's token objects make no cycles, but their number calls the collector again and again
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    ids = [enc.encode(t) if (t := x.as_py()) else b"" for x in b.column(1)]
                    n = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])
        finally:
            gc.enable()
        release()

    return kept.mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def count_ids(tokens: DataFrame, vocabulary: str, end_id: int) -> list[int]:
    """All ids that occur, most frequent first (ties: smaller id); bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, total = encoder(vocabulary).dtype, np.zeros(0, np.int64)
        for b in batches:
            values, _ = binary_values(b.column(0), dtype)
            c = np.bincount(values, minlength=max(end_id + 1, len(total)))
            c[end_id] += b.num_rows
            c[: len(total)] += total
            total = c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return [r["id"] for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]


_BLOCK = "part int, block int, doc_ids array<bigint>, n_ids bigint, lengths binary, control binary, data binary"
_NAMES = ["part", "block", "doc_ids", "n_ids", "lengths", "control", "data"]
_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def encode_files(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None) -> str:
    """Write all texts to token files in a new folder (or ``path``) and return it."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "token-files")
    staged = write(tokenize(df, vocabulary, id_col, text_col), "tokens")
    tokens = spark.read.parquet(staged)
    order = count_ids(tokens, vocabulary, end_id)
    spark.createDataFrame(list(enumerate(order)), "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    total = tokens.agg(F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).alias("n")).first()["n"]
    rank = np.zeros(max([end_id, *order]) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, dtype, size = TaskContext.get().partitionId(), 0, encoder(vocabulary).dtype, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # documents, their numbers of ids, ranks

        def flush() -> pa.RecordBatch:
            control, data = pack(np.concatenate([x[2] for x in held]))
            lengths = np.concatenate([x[1] for x in held]).astype("<u4").tobytes()
            docs = pa.concat_arrays([x[0] for x in held])
            columns = [pa.array(v, t) for v, t in zip(([part], [block], None, [size], [lengths], [control], [data]), _TYPES, strict=True) if v is not None]
            columns.insert(2, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs))
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                values, n = binary_values(b.column(1), dtype)
                n = n + 1
                ends = np.cumsum(n)
                ranks = np.full(int(ends[-1]), rank[end_id], np.uint32)
                inside = np.ones(len(ranks), dtype=bool)
                inside[ends - 1] = False
                ranks[inside] = rank[values]
                i = 0
                while i < len(n):  # a block ends with the document that fills it
                    j = min(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_IDS - size)) + 1, len(n))
                    a, z = int(ends[i - 1]) if i else 0, int(ends[j - 1])
                    held.append((b.column(0).slice(i, j - i), n[i:j], ranks[a:z]))
                    size += z - a
                    if size >= BLOCK_IDS:
                        yield flush()
                        held, size, block = [], 0, block + 1
                    i = j
        if held:
            yield flush()
        release()

    parts = max(1, math.ceil(total / PART_IDS))
    # equal rows may stand in any order, so a number that only spreads them ends the key
    keyed = tokens.withColumn("h", F.xxhash64("ids")).withColumn("spread", F.monotonically_increasing_id() % 1024)
    keys = ["doc_id", "n", "h", "spread"]
    ordered = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    ordered.mapInArrow(run, _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    delete(spark, staged)
    return path


def _decoded(batches: Iterator[pa.RecordBatch], id_of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(part, block, its ids, where each document starts and the last one ends, documents), a block at a time."""
    for b in batches:
        for i in range(b.num_rows):
            part, block, docs, n, lengths, control, data = (b.column(k)[i] for k in range(7))
            ids = id_of[unpack(control.as_buffer(), data.as_buffer(), n.as_py())]
            at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths.as_buffer(), "<u4").astype(np.int64))])
            yield part.as_py(), block.as_py(), ids, at, docs.values


def _ids_of_ranks(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")


def decode_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, at, doc_id, ids array<bigint> as little-endian uint32 bytes) of every document in the files."""
    id_of = _ids_of_ranks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block, ids, at, docs in _decoded(batches, id_of):
            for i in range(0, len(docs), 500):
                own = at[i : i + 501]
                n = len(own) - 1
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(own[:-1]), docs.slice(i, 500), binary_rows(ids[own[0] : own[-1]], np.diff(own))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "at", "doc_id", "ids"])

    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(run, "part int, block int, at bigint, doc_id bigint, ids binary")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, base): ids before each block.  Sums go by part first, then within each part.

    The window over parts holds one row for each ``PART_IDS`` ids.
    """
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("w", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "block", (F.col("p") + F.col("w")).alias("base"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    id_of = _ids_of_ranks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block, ids, at, docs in _decoded(batches, id_of):
            n, raw = len(docs), memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[x:y]) for x, y in zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)]
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(at[:-1]), docs, pa.array(np.diff(at)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "block", "at", "doc_id", "n_tokens", "ids_crc32"])
        release()

    docs = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(run, "part int, block int, at bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(block_starts(spark, path), ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
