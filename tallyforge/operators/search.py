"""One search over models of different kinds on the same folds.

Linear models and heads come from the shared scans of ``fits``, extra trees and random forests of a
search over large tables from those of ``trees``.  Ensembles here are Spark ML's: each (candidate, fold) is a Spark job of its own, a bounded
number of them at a time.  Rules without a fit are counted in one aggregation.  Whatever the
kind, a candidate is scored by its confusion table on the rows that its fits left out, and these
tables are all that comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import fits


@dataclass(frozen=True)
class Ensemble:
    """A forest ("rf") or boosted trees ("gbt", one class against the rest) of Spark ML."""

    name: str
    features: tuple[str, ...]
    kind: str = "rf"
    depth: int = 3
    leaf: int = 3
    trees: int = 20
    balanced: bool = True


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], object]], at_once: int) -> list:
    """Results of independent jobs in their order, ``at_once`` of them running at a time; the first failure is raised."""
    with ThreadPoolExecutor(max(1, at_once)) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.result() for r in running]


def ensemble_confusions(f: fits.Fitted, candidates: Sequence[Ensemble], at_once: int = 4, seed: int = 42) -> np.ndarray:
    """(outer fold, candidate, truth, prediction) counts on left-out rows; gaps are filled with the training rows' medians."""
    sizes = fits.counted_left_out(f, [], False, (fits.CLASSES,), lambda y, _: np.bincount(y, minlength=fits.CLASSES).astype(float))

    def one(c: Ensemble, fold: int) -> np.ndarray:
        at = [f.names.index(x) for x in c.features]
        filled = F.array(*[F.nanvl(F.element_at("x", i + 1), F.lit(float(f.fills[fold][i]))) for i in at])
        n = sizes.sum(axis=0) - sizes[fold]
        weight = n.sum() / (max((n > 0).sum(), 1) * np.maximum(n, 1)) if c.balanced else np.ones(fits.CLASSES)
        rows = f.rows.select(F.col("label").cast("double").alias("label"), "outer", array_to_vector(filled).alias("features"), F.element_at(F.array(*map(F.lit, weight.tolist())), F.col("label") + 1).alias("weight"))
        if c.kind == "rf":
            model = RandomForestClassifier(numTrees=c.trees, maxDepth=c.depth, minInstancesPerNode=c.leaf, seed=seed, weightCol="weight")
        else:
            model = OneVsRest(classifier=GBTClassifier(maxIter=c.trees, maxDepth=c.depth, minInstancesPerNode=c.leaf, seed=seed), weightCol="weight", parallelism=1)
        table = np.zeros((fits.CLASSES, fits.CLASSES))
        scored = model.fit(rows.where(F.col("outer") != fold)).transform(rows.where(F.col("outer") == fold))
        for r in scored.groupBy(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).count().collect():
            table[r["y"], r["p"]] += r["count"]
        return table

    pairs = [(fold, c) for fold in range(f.folds) for c in candidates]
    found = side_by_side(f.rows.sparkSession, [lambda c=c, fold=fold: one(c, fold) for fold, c in pairs], at_once)
    return np.stack(found).reshape(f.folds, len(candidates), fits.CLASSES, fits.CLASSES) if found else np.zeros((f.folds, 0, fits.CLASSES, fits.CLASSES))


#: Targets of the two heads: undecided or not; helpful or not, of decided rows alone.
UNDECIDED, HELPFUL = (0, 1, 0), (0, -1, 1)


def two_stage_confusions(f: fits.Fitted, pairs: Sequence[tuple[int, int]], undecided_at: Sequence[float], helpful_at: Sequence[float]) -> np.ndarray:
    """(outer fold, pair of heads, threshold, threshold, truth, prediction) counts on left-out rows.

    A row is undecided where its first head reaches a threshold, else helpful where the second
    does.  Rows are counted by how many thresholds of each head they pass.
    """
    first, second = np.array(undecided_at), np.array(helpful_at)
    shape = (len(pairs), fits.CLASSES, len(first) + 1, len(second) + 1)

    def count(y: np.ndarray, p: dict[int, np.ndarray]) -> np.ndarray:
        passed = {k: np.searchsorted(limit, v[:, 1], "right") for limit, ks in ((first, {a for a, _ in pairs}), (second, {b for _, b in pairs})) for k, v in p.items() if k in ks}
        out = np.zeros(shape)
        for i, (a, b) in enumerate(pairs):
            out[i] = np.bincount((y * shape[2] + passed[a]) * shape[3] + passed[b], minlength=int(np.prod(shape[1:]))).reshape(shape[1:])
        return out

    cells = fits.counted_left_out(f, sorted({k for pair in pairs for k in pair}), False, shape, count)
    tables = np.zeros((f.folds, len(pairs), len(first), len(second), fits.CLASSES, fits.CLASSES))
    for i in range(len(first)):
        for j in range(len(second)):
            decided = cells[:, :, :, : i + 1]
            tables[:, :, i, j, :, 1] = cells[:, :, :, i + 1 :].sum(axis=(3, 4))
            tables[:, :, i, j, :, 2] = decided[..., j + 1 :].sum(axis=(3, 4))
            tables[:, :, i, j, :, 0] = decided[..., : j + 1].sum(axis=(3, 4))
    return tables


def disagreement_confusions(df: DataFrame, label: str, share: Column, margin: Column, entropy: Column, margins: Sequence[float], entropies: Sequence[float], cuts: Sequence[float]) -> np.ndarray:
    """(margin, entropy, cut, truth, prediction) counts of the rules without a fit, from one count of rows by thresholds passed.

    A row is undecided where the margin is at most, or the entropy at least, its threshold, else
    helpful from the cut on.  Gaps pass nothing.
    """
    passed = lambda value, limits, over: sum((F.coalesce((value >= F.lit(x)) if over else (value <= F.lit(x)), F.lit(False)).cast("int") for x in limits), F.lit(0))
    cells = np.zeros((fits.CLASSES, len(margins) + 1, len(entropies) + 1, len(cuts) + 1))
    keyed = df.groupBy(F.col(label).cast("int").alias("y"), passed(margin, margins, False).alias("m"), passed(entropy, entropies, True).alias("e"), passed(share, cuts, True).alias("c")).count()
    for r in keyed.collect():
        cells[r["y"], r["m"], r["e"], r["c"]] += r["count"]
    out = np.zeros((len(margins), len(entropies), len(cuts), fits.CLASSES, fits.CLASSES))
    for i in range(len(margins)):
        for j in range(len(entropies)):
            calm = cells[:, : len(margins) - i, : j + 1]  # ascending margins: those from the i-th on are passed where any of the first i is
            for k in range(len(cuts)):
                out[i, j, k, :, 2] = calm[..., k + 1 :].sum(axis=(1, 2, 3))
                out[i, j, k, :, 0] = calm[..., : k + 1].sum(axis=(1, 2, 3))
                out[i, j, k, :, 1] = cells.sum(axis=(1, 2, 3)) - calm.sum(axis=(1, 2, 3))
    return out


def scores(c: np.ndarray) -> dict[str, float]:
    """Metrics of a confusion table (truth, prediction)."""
    n = np.maximum(c.sum(axis=1), 1)
    balanced, accuracy, cross = fits.quality(c)
    recall = np.diag(c) / n
    return {
        "accuracy": accuracy,
        "balanced_accuracy": balanced,
        "resolved_coverage": float(c[:, [0, 2]].sum() / max(c.sum(), 1)),
        "recall_not_helpful": float(recall[0]),
        "recall_needs_more_ratings": float(recall[1]),
        "recall_helpful": float(recall[2]),
        "cross_error": int(-cross),
    }
