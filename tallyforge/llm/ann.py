"""Approximate nearest neighbours by an inverted multi-index.

Fit: each half of the vector space gets a codebook of centroids, by k-means on a sample of
about ``SAMPLE`` times as many vectors as there are centroids.  Their number grows with the
square root of the table, from ``CODEBOOK[0]`` to ``CODEBOOK[1]``.  Index: every row goes to the
cell named by its two nearest centroids.  Search: a query walks centroid pairs by the sum of
its two distances with a heap until the cells it has met hold ``least`` rows, and reranks all
their entries by exact distance in double precision.

``least`` is measured, not guessed: ``TRIALS`` vectors are compared with every row, and
``least`` is where the walks of these trials have met ``RECALL`` of their true neighbours.
Clustered vectors need a few hundredths of the rows; vectors without any structure, on which
every index fails, need about half of them, and that is then what is read.

Cells are packed into groups of about ``GROUP_ROWS`` entries; a cell with more entries than
that is split over several groups, so one very common vector does not make one task.  A group
that more than ``BLOCK_QUERIES`` queries visit is compared in several tasks, each with a part
of them; groups that nobody visits are not moved.

Vectors that are null, empty, all zero, or hold a null or non-finite component take no part.
Distances exist between vectors of one length only: the index covers the most common length
(ties: the shorter), and queries of any other length are compared with all rows of theirs.  An
id that occurs several times is searched once, with its smallest vector; as candidates its rows
all count, its own excepted.  Equal distances are ordered by id.  Rows with a null id take no
part.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import save

CODEBOOK = (16, 512)
SAMPLE = 32
TRIALS = 128
RECALL = 0.97
GROUP_ROWS = 4096
BLOCK_QUERIES = 2048
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0.0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances less the squared norm of x."""
    return (c * c).sum(axis=1) - 2 * x @ c.T


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
    """Cells in order of summed distance until they hold ``least`` entries; empty cells are left out.

    ``first`` and ``second``: distances to the centroids of the halves; ``counts[i, j]``: entries.
    """
    o1, o2 = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    d1, d2, held = first[o1].tolist(), second[o2].tolist(), counts.tolist()
    heap, found, total = [(d1[0] + d2[0], 0, 0)], [], 0
    while heap and total < least:
        _, i, j = heapq.heappop(heap)
        if n := held[o1[i]][o2[j]]:
            found.append(o1[i] * len(d2) + o2[j])
            total += n
        if j + 1 < len(d2):
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(d1):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def prepared(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, is_query) of the rows that take part."""
    every = vectors.withColumn("__q", F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col("__q").alias("is_query"))
    return every.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))


@dataclass
class MultiIndex:
    """Codebooks, the stored rows with their cells, and how many rows a walk must meet."""

    dim: int
    books: list[np.ndarray]
    rows: DataFrame
    counts: np.ndarray
    least: int

    @property
    def half(self) -> int:
        return self.dim // 2

    def walk(self, x: np.ndarray, least: int) -> list[int]:
        first, second = distances(x[None, : self.half], self.books[0])[0], distances(x[None, self.half :], self.books[1])[0]
        return walk(first, second, self.counts.reshape(-1, len(self.books[1])), least)


def codebook_size(n: int) -> int:
    return min(max(1 << max(0, round(math.log2(max(math.sqrt(n) / 4, 1)))), CODEBOOK[0]), CODEBOOK[1])


def build(every: DataFrame, dim: int, n: int, k: int, recall: float = RECALL) -> MultiIndex:
    """Index of the ``n`` rows of length ``dim`` among ``every`` (of ``prepared``)."""
    every = every.where(F.size("vec") == dim)
    size = codebook_size(n)
    wanted = SAMPLE * size
    taken = every.where(F.rand(5) < min(1.0, 1.2 * wanted / n)).select("vec").limit(2 * wanted).collect()
    sample = np.array(sorted(r["vec"] for r in taken)) if taken else np.array([every.first()["vec"]])
    half = dim // 2
    books = [kmeans(sample[:, :half], size), kmeans(sample[:, half:], size)]
    width = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            cell = nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["vec_id", "vec", "is_query", "cell"])

    rows = save(every.mapInArrow(assign, "vec_id bigint, vec array<double>, is_query boolean, cell int"), "multi-index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in rows.groupBy("cell").count().collect():  # at most the square of the codebook
        counts[r["cell"]] = r["count"]
    index = MultiIndex(dim, books, rows, counts, n)
    index.least = measured(index, n, k, recall)
    return index


def measured(index: MultiIndex, n: int, k: int, recall: float) -> int:
    """Rows that walks must meet to hold ``recall`` of the true ``k`` neighbours of some trial vectors."""
    dim = index.dim
    drawn = index.rows.where(F.rand(6) < min(1.0, 1.5 * TRIALS / n)).select("vec_id", "vec").limit(2 * TRIALS).collect()
    if not drawn:
        return n
    ids, trial = np.array([r["vec_id"] for r in drawn]), np.array([r["vec"] for r in drawn])
    norm = (trial * trial).sum(axis=1)[:, None]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell = np.full((len(ids), 0), np.inf), np.full((len(ids), 0), -1)
        for b in batches:
            x, own, at = _matrix(b.column(1), dim), b.column(0).to_numpy(), b.column(2).to_numpy()
            d = norm + (x * x).sum(axis=1)[None, :] - 2 * trial @ x.T
            d[ids[:, None] == own[None, :]] = np.inf
            score, cell = np.concatenate([score, d], axis=1), np.concatenate([cell, np.broadcast_to(at, d.shape)], axis=1)
            if score.shape[1] > k:
                keep = np.argpartition(score, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(score, keep, 1), np.take_along_axis(cell, keep, 1)
        q, j = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(score[q, j]), pa.array(cell[q, j].astype(np.int32))], ["q", "score", "cell"])

    order = Window.partitionBy("q").orderBy("score", "cell")
    near = index.rows.select("vec_id", "vec", "cell").mapInArrow(best, "q int, score double, cell int")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("q").agg(F.collect_list("cell").alias("cells")).collect()
    needed = []
    for r in near:
        cells = index.walk(trial[r["q"]], n)
        met = dict(zip(cells, np.cumsum(index.counts[cells]).tolist(), strict=True))
        needed += [met[c] for c in r["cells"]]
    return sorted(needed)[min(math.ceil(recall * len(needed)), len(needed)) - 1] if needed else n


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest found for every row for which ``is_query`` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    every = prepared(vectors, is_query, id_col, vec_col)
    lengths = every.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").limit(2).collect()
    if not common:
        return spark.createDataFrame([], RESULT)
    entries, visits = indexed(build(every, common[0]["dim"], common[0]["n"], k, recall), k)
    if len(common) > 1:
        more_entries, more_visits = unindexed(every.where(F.size("vec") != common[0]["dim"]), lengths)
        entries, visits = entries.unionByName(more_entries), visits.unionByName(more_visits)
    visits = save(visits, "visits")
    tasks = visits.groupBy("dim", "grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    dealt = entries.join(tasks, ["dim", "grp"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = visits.join(tasks, ["dim", "grp"]).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    keys = ["dim", "grp", "block"]
    near = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda a, b: compare(a, b, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_ENTRY = "dim int, grp int, vec_id bigint, vec array<double>, cell int"
_VISIT = "dim int, grp int, query_id bigint, query binary, cells binary"


def indexed(index: MultiIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """Entries with their groups, and the groups and cells that each query visits."""
    group_of, splits = pack(index.counts)
    dim, least = index.dim, max(index.least, k + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(2).to_numpy()
            grp = group_of[cell] + np.arange(len(cell)) % splits[cell]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim, np.int32)), pa.array(grp.astype(np.int32)), b.column(0), b.column(1), b.column(2)], ["dim", "grp", "vec_id", "vec", "cell"])

    rows, books, counts = index.rows, index.books, index.counts
    walker = MultiIndex(dim, books, None, counts, least)  # without the table, to travel to tasks

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            for r in range(b.num_rows):
                by_group: dict[int, list[int]] = {}
                for cell in walker.walk(x[r], least):
                    for s in range(splits[cell]):
                        by_group.setdefault(int(group_of[cell] + s), []).append(cell)
                m, query = len(by_group), b.column(0)[r].as_py()
                columns = [pa.array([dim] * m, pa.int32()), pa.array(list(by_group), pa.int32()), pa.array([query] * m, pa.int64()), pa.array([x[r].tobytes()] * m, pa.binary()), pa.array([np.array(c, np.int32).tobytes() for c in by_group.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "grp", "query_id", "query", "cells"])

    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # walks are dear, so small tables are not gathered in few tasks
    return rows.select("vec_id", "vec", "cell").mapInArrow(place, _ENTRY), asked.repartition(parts, "vec_id").mapInArrow(visit, _VISIT)


def unindexed(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and visits of rows of other lengths: every query visits all groups of its length."""
    parts = lengths.select("dim", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
    known = rows.withColumn("dim", F.size("vec")).join(parts, "dim")
    entries = known.select("dim", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int").alias("grp"), "vec_id", "vec", F.lit(0).alias("cell"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = pa.array([np.array(v.as_py()).tobytes() for v in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], vecs, pa.nulls(b.num_rows, pa.binary())], ["dim", "grp", "query_id", "query", "cells"])

    asked = known.where("is_query").groupBy("vec_id").agg(F.min_by("vec", F.struct("dim", "vec")).alias("vec")).withColumn("dim", F.size("vec")).join(parts, "dim")
    asked = asked.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dim", "grp", "vec_id", "vec")
    return save(entries, "other-lengths"), asked.mapInArrow(raw, _VISIT)


QUERIES_AT_ONCE = 64


def compare(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest entries of a group for each of its queries, among the cells that the query visits.

    A matrix product finds the entries that may be among them; their distances are then
    computed from the differences.
    """
    out: list[tuple[int, int, float]] = []
    if left.num_rows and right.num_rows:
        x, ids, cell = _matrix(left["vec"], left["dim"][0].as_py()), left["vec_id"].to_numpy(), left["cell"].to_numpy()
        known, own = np.unique(cell, return_inverse=True)
        norm = (x * x).sum(axis=1)
        for at in range(0, right.num_rows, QUERIES_AT_ONCE):
            part = right.slice(at, QUERIES_AT_ONCE)
            asked = part["query_id"].to_numpy()
            q = np.frombuffer(b"".join(part["query"].to_pylist())).reshape(len(asked), -1)
            seen = np.zeros((len(asked), len(known)), dtype=bool)
            for r, raw in enumerate(part["cells"].to_pylist()):
                seen[r] = True if raw is None else np.isin(known, np.frombuffer(raw, np.int32))
            use = seen[:, own] & (asked[:, None] != ids[None, :])
            square = (q * q).sum(axis=1)
            rough = np.where(use, norm[None, :] + square[:, None] - 2 * q @ x.T, np.inf)
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(asked), np.inf)
            limit = kth + 1e-9 * (square + norm.max())
            for r in range(len(asked)):
                near = np.flatnonzero(use[r] & ~(rough[r] > limit[r]))
                score = np.sqrt(((x[near] - q[r]) ** 2).sum(axis=1))
                out += [(int(asked[r]), int(ids[near[i]]), float(score[i])) for i in np.lexsort((ids[near], score))[:k]]
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def pack(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell: small cells share a group, large ones have several."""
    group_of, splits = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, held = 0, 0
    for cell in np.argsort(counts, kind="stable"):
        size = int(counts[cell])
        if held and held + size > GROUP_ROWS:
            group, held = group + 1, 0
        group_of[cell] = group
        if size > GROUP_ROWS:
            splits[cell] = math.ceil(size / GROUP_ROWS)
            group, held = group + int(splits[cell]), 0
        else:
            held += size
    return group_of, splits
