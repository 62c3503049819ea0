"""Model selection: imputation and scaling in SQL, Spark ML fits, nested cross-validation, blends and ablations.

Driver loops here run over folds and candidate specifications only; rows stay distributed.
Predictions are tables of three probability columns, so every rule and metric applies to them.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as c
from tallyforge.operators import fits

PROBS = ("p_nh", "p_nmr", "p_h")


@dataclass(frozen=True)
class Spec:
    """One candidate model: strength, class weighting, kind, and whether the penalty is on absolute weights."""

    c: float = 1.0
    balanced: bool = False
    kind: str = "lr"
    l1: bool = False


@dataclass(frozen=True)
class Experiment:
    """A named list of features."""

    name: str
    features: tuple[str, ...]


def prepared(train: DataFrame, other: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with median-filled, z-scored features; statistics come from ``train`` alone."""
    stats = train.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(features) for n, f in (("m", lambda v: F.percentile_approx(v, 0.5, 10_000)), ("a", F.avg), ("s", F.stddev_pop))]).first()
    fill = {x: stats[f"m{i}"] if stats[f"m{i}"] is not None else 0.0 for i, x in enumerate(features)}
    center = {x: stats[f"a{i}"] or 0.0 for i, x in enumerate(features)}
    scale = {x: stats[f"s{i}"] or 1.0 for i, x in enumerate(features)}
    z = {x: (F.coalesce(F.col(x).cast("double"), F.lit(float(fill[x]))) - center[x]) / scale[x] for x in features}
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    return tuple(assemble.transform(df.withColumns(z)) for df in (train, other))


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, spec: Spec) -> DataFrame:
    """``test`` with the three class probabilities of a model fitted on ``train``."""
    a, b = prepared(train, test, features)
    sizes = {r[0]: r[1] for r in a.groupBy(label).count().collect()}
    n = sum(sizes.values())
    weight = F.lit(1.0)
    if spec.balanced:
        weight = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(n / (len(sizes) * v))) for k, v in sizes.items())), F.col(label))
    a = a.withColumn("__w", weight).withColumn(label, F.col(label).cast("double"))
    if spec.kind == "lr":
        estimator = LogisticRegression(labelCol=label, weightCol="__w", family="multinomial", regParam=1 / (spec.c * n), elasticNetParam=float(spec.l1), standardization=False, maxIter=200)
    elif spec.kind == "rf":
        estimator = RandomForestClassifier(labelCol=label, weightCol="__w", numTrees=50, maxDepth=6, minInstancesPerNode=4, seed=42)
    else:
        estimator = OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, seed=42), labelCol=label, weightCol="__w")
    out = estimator.fit(a).transform(b)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        size = max(int(k) for k in sizes) + 1
        cols = [F.element_at(p, k + 1) if k < size else F.lit(0.0) for k in range(3)]
    else:
        raw = vector_to_array("rawPrediction")
        e = [F.exp(F.element_at(raw, k + 1)) for k in range(3)]
        cols = [x / (e[0] + e[1] + e[2]) for x in e]
    return out.select(*test.columns, *[v.alias(n) for v, n in zip(cols, PROBS, strict=True)])


def rule_grid() -> list[tuple[str, float, float]]:
    """Decision rules tried on out-of-fold probabilities."""
    gate = [("nmr_gate", round(0.25 + 0.05 * i, 2), 0.0) for i in range(8)]
    margin = [("margin_to_nmr", m, t) for m in (0.04, 0.08, 0.12, 0.16, 0.2, 0.24) for t in (0.15, 0.2, 0.25, 0.3, 0.35)]
    gap = [("resolved_gap", round(0.02 + 0.04 * i, 2), 0.0) for i in range(6)]
    return [("argmax", 0.0, 0.0), *gate, *margin, *gap]


def prob_meta(nh: Column, nmr: Column, h: Column) -> dict[str, Column]:
    """Entropy, top margin, resolved mass, signed margin and undecided gap of a probability triple."""
    tops = F.sort_array(F.array(nh, nmr, h), False)
    return {"meta_entropy": c.entropy([nh, nmr, h]), "meta_top_margin": tops[0] - tops[1], "meta_resolved": nh + h, "meta_signed": h - nh, "meta_nmr_gap": nmr - F.greatest(nh, h)}


def experiments(groups: dict[str, Sequence[str]], base: str) -> list[Experiment]:
    """Single groups, base plus each, cumulative, and leave-one-out feature lists."""
    union = lambda names: tuple(dict.fromkeys(x for n in names for x in groups[n]))
    names = list(groups)
    out = [Experiment(f"only_{n}", union([n])) for n in names]
    out += [Experiment(f"{base}+{n}", union([base, n])) for n in names if n != base]
    out += [Experiment(f"first_{i}", union(names[:i])) for i in range(2, len(names) + 1)]
    return out + [Experiment(f"without_{n}", union([x for x in names if x != n])) for n in names if len(names) > 1]


def deltas(df: DataFrame, group: str, method: str, value: str, baselines: Sequence[str]) -> DataFrame:
    """Adds ``delta_<baseline>``: the value less the baseline's in the same group, null where it is absent."""
    w = Window.partitionBy(group)
    return df.withColumns({f"delta_{b}": F.col(value) - F.max(F.when(F.col(method) == b, F.col(value))).over(w) for b in baselines})


def choose_k(df: DataFrame, features: Sequence[str], most: int = 8, starts: int = 20) -> int:
    """Cluster count of at least 2 with the best silhouette (ties: fewer); few rows allow few clusters."""
    n = df.count()
    scored, _ = fits.kmeans_many(df, features, range(2, min(most, max(2, n - 1)) + 1), starts)
    found = scored.orderBy(F.desc("silhouette"), "k").first()
    return found["k"] if found else min(2, n)
