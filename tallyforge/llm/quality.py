"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

``statistics`` reduces each whole text to a fixed vector (sizes, character classes, word
repetition, line repetition); ids, language, source and labels are never among them.
``fit`` standardises the vectors of labelled rows, maps them through random Fourier
features of a Gaussian kernel and adds up normal equations per partition, one block per
fold.  Solving without a fold gives that fold's scores, on which pool-adjacent-violators
fits the calibration; the model itself is solved from all folds.

Learning reads at most about ``MAX_TRAIN`` labelled rows (a hash of the id decides) and never
rows that ``held_out`` marks (crc32 of the id as text, modulo 5, is 0; a null id counts as
held out).  Labels other than 0 and 1 teach nothing; a document labelled twice teaches
twice.  Without usable labels every score is 0.5; with one class only it is that class.  Whenever both
occur the model is fitted, however few the rows; calibration pools what they cannot tell apart.

Null and empty texts have the zero vector and get its score.  Texts of any length count whole.
Repeated rows are scored separately, equal texts alike.  An empty table gives no rows.  Other
columns are not read, and ``keep_good`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import save
from tallyforge.llm.words import buffers, groups, release, words

MAX_TRAIN = 60_000
FEATURES = 160
FOLDS = 4
THRESHOLD = 0.3
# Character classes whose shares are statistics.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?", "!", "#$%&*", "|", "()[]{}<>\"'", "@/\\=+_-", " ", "\n", "\t\r")

_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _i
N_STATS = 9 + len(CLASSES) + 1


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    buf, offs = buffers(texts)
    out = np.zeros((len(offs) - 1, N_STATS))
    for i, j in groups(offs):
        part, po = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n, size = j - i, np.diff(po)
        s, e, h = words(part, po)
        row = np.searchsorted(po, s, side="right") - 1
        count = np.bincount(row, minlength=n)
        per = np.maximum(count, 1)
        length = (e - s).astype(float)
        mean = np.bincount(row, length, n) / per
        square = np.bincount(row, length**2, n) / per
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        new = np.ones(len(hs), dtype=bool)
        new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
        at = np.flatnonzero(new)
        often, owner = np.diff(np.append(at, len(hs))), rs[at]
        most = np.zeros(n)
        np.maximum.at(most, owner, often)
        classes = np.zeros((n, len(CLASSES) + 1))
        for r0 in range(n):
            piece = part[po[r0] : po[r0 + 1]]
            classes[r0] = np.bincount(_CLASS[piece], minlength=len(CLASSES) + 1)
            lines = bytes(piece).split(b"\n")
            out[i + r0, 8] = 1 - len(set(lines)) / len(lines)
        out[i:j, 0] = np.log1p(size)
        out[i:j, 1] = np.log1p(count)
        out[i:j, 2] = mean
        out[i:j, 3] = np.sqrt(np.maximum(square - mean**2, 0))
        out[i:j, 4] = np.log1p(np.bincount(owner, minlength=n)) - np.log1p(count)
        out[i:j, 5] = most / per
        out[i:j, 6] = np.bincount(row[1:][same], minlength=n) / per
        out[i:j, 7] = np.log1p(count / (1 + classes[:, CLASSES.index(".,;:?")] + classes[:, CLASSES.index("!")]))
        out[i:j, 9:] = np.sqrt(classes / np.maximum(size, 1)[:, None])
    return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)) % 5 == 0


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = statistics(b.column(1))
            flat = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "stats"])
        release()

    return kept.mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    """A fitted classifier; ``weights`` is None where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = ((stats - self.mean) / self.scale).clip(-8, 8)
        f = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase)
        return np.concatenate([f, np.ones((len(f), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.values[0])
        return np.interp(self.features(stats) @ self.weights, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rows sorted by x with mean y and weight n: knots and nondecreasing values."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([min(max(b[1] / b[2], 0.0), 1.0) for b in blocks])


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def taught_rows(labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, seed: int = 7) -> DataFrame:
    """(doc_id, y) of the labelled rows that teach."""
    taught = labels.select("doc_id", F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    share = int(min(1.0, max_train / max(taught.count(), 1)) * 1_000_000)
    return taught.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share)


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> Model:
    """Fits on the texts of the labelled rows alone; the others are not looked at.

    The ids that are sent to every task are those of at most about ``MAX_TRAIN`` labelled rows.
    """
    ids = taught_rows(labels).select(F.col("doc_id").alias("__taught")).distinct()
    few = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__taught"), "left_semi")
    return fit(document_statistics(few, id_col, text_col), labels, **more)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, ridge: float = 1e-3, seed: int = 7) -> Model:
    """``stats``: (doc_id, stats); ``labels``: doc_id and a 0/1 column."""
    taught = taught_rows(labels, label_col, max_train, seed)
    train = save(stats.join(taught, "doc_id").select("stats", "y", (F.crc32(F.col("doc_id").cast("string")) % 5 - 1).cast("int").alias("fold")), "train")
    columns = [f(F.element_at("stats", k + 1)).alias(f"{name}{k}") for name, f in (("m", F.avg), ("s", F.stddev_pop)) for k in range(N_STATS)]
    found = train.agg(F.count("y").alias("n"), F.coalesce(F.avg("y"), F.lit(0.5)).alias("rate"), *columns).first()
    rng = np.random.default_rng(seed)
    mean = np.array([found[f"m{k}"] or 0.0 for k in range(N_STATS)])
    scale = np.array([found[f"s{k}"] or 0.0 for k in range(N_STATS)])
    scale[scale < 1e-9] = 1.0
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(N_STATS / 2), (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), None, np.zeros(1), np.array([float(found["rate"])]))
    if not found["n"] or found["rate"] in (0.0, 1.0):
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
        for b in batches:
            f, y, fold = model.features(_arrays(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in range(FOLDS):
                own = f[fold == k]
                gram[k] += own.T @ own
                moment[k] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], ["gram", "moment"])

    gram, moment = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1))
    for r in train.coalesce(8).mapInArrow(sums, "gram binary, moment binary").collect():
        gram += np.frombuffer(r["gram"]).reshape(gram.shape)
        moment += np.frombuffer(r["moment"]).reshape(moment.shape)

    def solve(without: int | None) -> np.ndarray:
        use = [k for k in range(FOLDS) if k != without]
        g = gram[use].sum(axis=0)
        return np.linalg.solve(g + ridge * max(g[-1, -1], 1.0) / FEATURES * np.eye(len(g)), moment[use].sum(axis=0))

    each = np.stack([solve(k) for k in range(FOLDS)])
    model.weights = solve(None)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (model.features(_arrays(b.column(0))) * each[b.column(2).to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * 1000).clip(-2000, 3000).astype(np.int32)), b.column(1)], ["bin", "y"])

    bins = train.mapInArrow(unseen, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("y").alias("n")).orderBy("bin").collect()
    model.knots, model.values = isotonic(np.array([r["bin"] / 1000 for r in bins]), np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins]))
    return model


def score_statistics(model: Model, stats: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of a statistics table."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_arrays(b.column(1))))], ["doc_id", "score"])

    scored = stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(model: Model, docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least ``threshold``, all columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                yield b.filter(pa.array(model.score(statistics(b.column(at))) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labelled rows and score all rows."""
    stats = save(document_statistics(docs, id_col, text_col), "statistics")
    return score_statistics(fit(stats, labels), stats)
