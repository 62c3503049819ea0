"""Mini-batch k-means over many cluster counts, with a log of finished counts and a Euclidean silhouette.

Rows are dealt to batches by a hash of their key, so batches are the same in every run.  One scan
stores the batches that the steps will use, each in files of its own; a step reads one batch and
moves the centers of all cluster counts, each center by its own rate (rows of the batch over all
rows that it has had).  Full scans are two: the one that deals, and the one that scores.

``clustered`` does this for all groups of a table in the same scans.  Columns that rows share by a
key (weights of the words of a text that many rows have) stay in a table of their own: their part of
every distance is computed once per key, and only the rows that batches and samples use are widened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import fits
from tallyforge.operators.relational import fresh_folder, remove_folder, stable

BATCH, STEPS = 8192, 60
#: Rows (smallest hashes) on which starts are drawn and runs compared.
FIRST = 4096
#: Starts that are drawn for each count, and how many of them, by inertia on the first rows, take the steps.
STARTS, KEPT = 20, 6
SAMPLE = 10_000
#: Bytes of the shared columns' distances up to which they go to all tasks.
SENT = 32 << 20
#: A center with fewer rows than this part of the largest one's starts again, every ``AGAIN`` steps.
SMALL, AGAIN = 0.01, 10
FORM = "k int, n_rows long, sample_size int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"


def scaled(df: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """(h, x): a hash of the key, and the columns less their mean over their deviation; stored."""
    stats = df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [(F.col(x).cast("double") - (stats[f"m{i}"] or 0.0)) / (stats[f"s{i}"] or 1.0) for i, x in enumerate(names)]
    return stable(df.select(F.xxhash64(key).alias("h"), F.array(*z).alias("x")))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def _first(rows: DataFrame, n: int) -> np.ndarray:
    """The ``n`` rows with the smallest hashes, in that order; ``n`` is the stated bound of what the driver holds."""
    return np.array([r["x"] for r in rows.orderBy("h", "x").limit(n).select("x").collect()])


def _totals(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of each cluster, and their number in the last column."""
    return np.column_stack([(own == np.arange(k)[:, None]).astype(float) @ x, np.bincount(own, minlength=k)])


def _started(sample: np.ndarray, ks: Sequence[int], starts: int, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(clusters, centers, rows that each center has had); counts of which the sample has fewer distinct rows are left out."""
    distinct = len(np.unique(sample, axis=0)) if len(sample) else 0
    models = []
    for k in (k for k in ks if k <= distinct):
        rng = np.random.default_rng([seed, k])
        tries = [fits._plus_plus(sample, k, rng) for _ in range(starts)]
        spread = [_distances(sample, c).min(axis=1).sum() for c in tries]
        models += [(k, tries[i], np.zeros(k)) for i in np.argsort(spread, kind="stable")[:KEPT]]
    return models


def _batch_of(h: str, dealt: Column | int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), h), F.lit(dealt) if isinstance(dealt, int) else dealt).cast("int")


def _moved(stored: DataFrame, samples: Sequence[np.ndarray], models: list[tuple[int, int, np.ndarray, np.ndarray]], used: Sequence[int], scales: Sequence[tuple[np.ndarray, np.ndarray]] | None, steps: int, seed: int) -> list[dict[int, np.ndarray]]:
    """For every group the best centers of each count after all steps over the stored batches (x, g, b).

    ``models``: (group, clusters, centers, rows that each center has had).  A step reads the next
    batch of every group, and each group's rows move its own models.
    """
    of = {g: [i for i, m in enumerate(models) if m[0] == g] for g in sorted({m[0] for m in models})}
    for step in range(steps):

        def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                every, groups = fits._matrix(b.column(0)), b.column(1).to_numpy()
                for g in np.unique(groups).tolist():
                    x = every[groups == g]
                    x = x if scales is None else (x - scales[g][0]) / scales[g][1]
                    for i in of[g]:
                        _, k, centers, _ = models[i]
                        found[i] = found.get(i, 0) + _totals(x, _distances(x, centers).argmin(axis=1), k).ravel()
            return found

        wanted = reduce(lambda a, b: a | b, [(F.col("g") == g) & (F.col("b") == step % used[g]) for g in of])
        for i, s in enumerate(fits._summed(stored.where(wanted).select("x", "g"), task, len(models))):
            if s is None:
                continue
            g, k, centers, had = models[i]
            s = s.reshape(k, -1)
            had, hit = had + s[:, -1], s[:, -1] > 0
            centers = centers.copy()
            centers[hit] += (s[hit, :-1] - s[hit, -1:] * centers[hit]) / had[hit, None]
            if step % AGAIN == AGAIN - 1 and step + AGAIN < steps and (small := had < SMALL * had.max()).any():
                rng = np.random.default_rng([seed, k, step])
                centers[small] = samples[g][rng.integers(len(samples[g]), size=int(small.sum()))]
                had[small] = max(1.0, had[~small].min())
            models[i] = (g, k, centers, had)
    best: list[dict[int, tuple[float, np.ndarray]]] = [{} for _ in samples]
    for g, k, centers, _ in models:
        spread = float(_distances(samples[g], centers).min(axis=1).sum())
        if k not in best[g] or spread < best[g][k][0]:
            best[g][k] = (spread, centers)
    return [{k: centers for k, (_, centers) in b.items()} for b in best]


def mini_batches(rows: DataFrame, n: int, ks: Sequence[int], batch: int = BATCH, steps: int = STEPS, starts: int = STARTS, seed: int = 1) -> dict[int, np.ndarray]:
    """Centers for each cluster count; counts of which the first rows have fewer distinct values are left out."""
    spark = rows.sparkSession
    sample = _first(rows, FIRST)
    models = [(0, *m) for m in _started(sample, ks, starts, seed)]
    if not models:
        return {}
    dealt = max(1, math.ceil(n / batch))
    used = min(steps, dealt)
    folder = fresh_folder(spark, "batches")
    rows.select("h", "x", F.lit(0).alias("g"), _batch_of("h", dealt, seed).alias("b")).where(F.col("b") < used).repartition(min(used, 512), "b").write.partitionBy("g", "b").parquet(folder)
    try:
        return _moved(spark.read.parquet(folder), [sample], models, [used], None, steps, seed)[0]
    finally:
        remove_folder(spark, folder)


def euclidean_silhouettes(rows: DataFrame, centers: dict[int, np.ndarray], size: int = SAMPLE, block: int = 500) -> tuple[dict[int, float], int]:
    """Mean silhouettes by Euclidean distance of ``size`` rows (smallest hashes) under each set of centers, and how many rows that were."""
    every = _first(rows, size)
    return _silhouettes(rows.sparkSession, [(every, centers)], block)[0], len(every)


def _silhouettes(spark: SparkSession, samples: Sequence[tuple[np.ndarray, dict[int, np.ndarray]]], block: int = 500) -> list[dict[int, float]]:
    """Mean silhouettes of each sample under each of its sets of centers.

    All tasks get the samples, and each compares its blocks of one with the whole of it; distances of a
    block serve every cluster count.  A row alone in its cluster counts 0; one cluster gives NaN.
    """
    labels = [{k: _distances(every, c).argmin(axis=1) for k, c in centers.items()} if len(every) else {} for every, centers in samples]
    model = {key: i for i, key in enumerate((g, k) for g, own in enumerate(labels) for k in own)}
    places = [(g, at) for g, own in enumerate(labels) if own for at in range(0, len(samples[g][0]), block)]

    def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for place in b.column(0).to_pylist():
                g, start = places[place]
                every = samples[g][0]
                at = np.arange(start, min(start + block, len(every)))
                apart = np.sqrt(_distances(every[at], every))
                apart[np.arange(len(at)), at] = 0.0
                for k, own in labels[g].items():
                    member = (own[:, None] == np.arange(k)).astype(float)
                    count = member.sum(axis=0)
                    total, mine = apart @ member, own[at]
                    a = total[np.arange(len(at)), mine] / np.maximum(count[mine] - 1, 1)
                    mean = np.where(count > 0, total / np.maximum(count, 1), np.inf)
                    mean[np.arange(len(at)), mine] = np.inf
                    near = mean.min(axis=1)
                    value = np.where((count[mine] > 1) & np.isfinite(near), (near - a) / np.maximum(np.maximum(near, a), 1e-300), 0.0)
                    i = model[g, k]
                    found[i] = found.get(i, 0) + np.array([value.sum()])
        return found

    if not places:
        return [{} for _ in samples]
    blocks = spark.range(0, len(places), 1, min(len(places), 64)).select(F.col("id"))
    sums = fits._summed(blocks, task, len(model))
    return [{k: float(sums[model[g, k]][0] / len(samples[g][0])) if len(np.unique(own[k])) > 1 else float("nan") for k in own} for g, own in enumerate(labels)]


def scored(rows: DataFrame, n: int, centers: dict[int, np.ndarray], size: int = SAMPLE) -> list[tuple]:
    """Rows of ``FORM`` for each cluster count: inertia and both indices over all rows in one scan, silhouettes of the sample."""
    order = list(centers)

    def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            x = fits._matrix(b.column(0))
            for i, k in enumerate(order):
                d = _distances(x, centers[k])
                own, near = d.argmin(axis=1), d.min(axis=1)
                found[i] = found.get(i, 0) + np.column_stack([_totals(x, own, k), np.bincount(own, (x * x).sum(axis=1), k), np.bincount(own, near, k)]).ravel()
        return found

    def scatter(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            x = fits._matrix(b.column(0))
            for i, k in enumerate(order):
                own = _distances(x, centers[k]).argmin(axis=1)
                found[i] = found.get(i, 0) + np.bincount(own, np.sqrt(((x - means[k][own]) ** 2).sum(axis=1)), k)
        return found

    body = rows.select("x")
    sums = {k: s.reshape(k, -1) for k, s in zip(order, fits._summed(body, task, len(order)), strict=True)}
    means = {k: s[:, :-3] / np.maximum(s[:, -3:-2], 1) for k, s in sums.items()}
    spreads = dict(zip(order, fits._summed(body, scatter, len(order)), strict=True))
    silhouettes, used = euclidean_silhouettes(rows, centers, size)
    out = []
    for k in order:
        s, count = sums[k], sums[k][:, -3]
        have = count > 0
        m, whole = means[k][have], s[:, :-3].sum(axis=0) / n
        within = float((s[have, -2] - count[have] * (m * m).sum(axis=1)).sum())
        between = float((count[have] * ((m - whole) ** 2).sum(axis=1)).sum())
        spread = spreads[k][have] / count[have]
        apart = np.sqrt(_distances(m, m))
        np.fill_diagonal(apart, np.inf)
        db = float(((spread[:, None] + spread[None, :]) / np.maximum(apart, 1e-300)).max(axis=1).mean()) if have.sum() > 1 else float("nan")
        kk = int(have.sum())
        ch = between / max(kk - 1, 1) / max(within / max(n - kk, 1), 1e-300) if kk > 1 else float("nan")
        out.append((k, n, used, float(s[:, -1].sum()), silhouettes[k], ch, db))
    return out


def search_k(df: DataFrame, names: Sequence[str], key: str, ks: Sequence[int], log: str | None = None, at_once: int = 8, **more) -> DataFrame:
    """Scores of every cluster count, ``at_once`` of them per run of mini-batches.

    ``log``: a folder to which each run appends its rows when they are complete.  A search that
    was stopped starts with what the log holds and gives the table that it would have given.
    """
    spark = df.sparkSession
    done: dict[int, tuple] = {}
    if log is not None:
        spark.createDataFrame([], FORM).write.mode("append").parquet(log)
        done = {r["k"]: tuple(r) for r in spark.read.schema(FORM).parquet(log).collect()}
    left = [k for k in ks if k not in done]
    if left:
        rows = scaled(df, names, key)
        n = rows.count()
        for at in range(0, len(left), at_once):
            found = scored(rows, n, mini_batches(rows, n, left[at : at + at_once], **more)) if n else []
            if log is not None and found:
                spark.createDataFrame(found, FORM).coalesce(1).write.mode("append").parquet(log)
            done |= {r[0]: r for r in found}
    return spark.createDataFrame([done[k] for k in ks if k in done], FORM)


def _shared_scales(counts: DataFrame, n: Sequence[int], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every group the means and deviations of the shared columns over its ``n`` rows; counts: (g, n, v), rows without v hold zeros.

    A deviation within rounding of its mean is none.
    """

    def sums(of: Sequence[np.ndarray] | None) -> list[np.ndarray]:
        def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                groups, times, v = b.column(0).to_numpy(), b.column(1).to_numpy().astype(float), fits._matrix(b.column(2))
                for g in np.unique(groups).tolist():
                    t, x = times[groups == g], v[groups == g]
                    found[g] = found.get(g, 0) + np.append(t @ (x if of is None else (x - of[g]) ** 2), t.sum())
            return found

        return [np.zeros(width + 1) if s is None else s for s in fits._summed(counts, task, len(n))]

    means = [s[:-1] / m for s, m in zip(sums(None), n, strict=True)]
    spread = [np.sqrt((s[:-1] + (m - s[-1]) * c**2) / m) for s, m, c in zip(sums(means), n, means, strict=True)]
    return [(m, np.where(s <= 1e-12 * np.abs(m), 0.0, s)) for m, s in zip(means, spread, strict=True)]


def clustered(df: DataFrame, names: Sequence[str], key: str, ks: Sequence[int], small: int = 8, steps: int = 20, group: str | None = None, shared: DataFrame | None = None, width: int = 0, on: str | None = None) -> DataFrame:
    """Adds the cluster under the count with the best silhouette (ties: fewer clusters).

    With fewer than ``small`` rows there are two clusters at most; rows that are all alike are one.
    ``group``: a column (without nulls) whose values are clustered each on its own, all in the same scans.
    ``shared``: (``on``, v), further ``width`` columns as one array for all rows with an equal ``on``, unique
    there; rows without a match have zeros.  The table and ``shared`` are read several times.
    """
    spark = df.sparkSession
    name = F.lit(0) if group is None else F.col(group)
    stats = sorted(df.groupBy(name.alias("__name")).agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, x in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).collect(), key=lambda r: r["__name"])
    if not stats:
        return df.withColumn("cluster", F.lit(0))
    n = [r["n"] for r in stats]
    of = reduce(lambda rest, i: F.when(name == F.lit(stats[i]["__name"]), i).otherwise(rest), range(len(stats)), F.lit(0))
    dense = F.array(*[F.col(x).cast("double") for x in names])
    rows = df.select(F.xxhash64(key).alias("h"), of.alias("g"), dense.alias("x"), *([on] if shared is not None else []))
    scales = [tuple(np.array([r[f"{k}{i}"] or 0.0 for i in range(len(names))]) for k in "ms") for r in stats]
    missing = F.array_repeat(F.lit(0.0), width)
    if shared is not None:
        counts = stable(rows.groupBy("g", on).agg(F.count(F.lit(1)).alias("n")).join(shared, on).select("g", "n", "v"))
        scales = [tuple(np.append(a, b) for a, b in zip(own, more, strict=True)) for own, more in zip(scales, _shared_scales(counts, n, width), strict=True)]
    scales = [(m, np.where(s == 0, 1.0, s)) for m, s in scales]

    # one scan draws what batches and samples will use: hashes up to a bound hold the smallest ones, unless keys repeat much
    dealt = [max(1, math.ceil(x / BATCH)) for x in n]
    used = [min(steps, x) for x in dealt]
    each = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("g") + 1)

    def drawn(bounds: Sequence[int]) -> DataFrame:
        some = rows.withColumn("b", _batch_of("h", each(dealt), 1)).withColumn("first", F.col("h") <= each(bounds)).where((F.col("b") < each(used)) | F.col("first"))
        if shared is not None:
            some = some.join(shared, on, "left").withColumn("x", F.concat("x", F.coalesce("v", missing)))
        return stable(some.select("x", "g", "b", "h", "first"))

    top = (1 << 63) - 1
    bounds = [top if x <= 2 * SAMPLE else int(2**64 * 1.2 * SAMPLE / x) - (1 << 63) for x in n]
    kept = drawn(bounds)
    have = {r["g"]: r["n"] for r in kept.where("first").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(have.get(g, 0) < min(SAMPLE, x) for g, x in enumerate(n)):
        kept = drawn([b if have.get(g, 0) >= min(SAMPLE, n[g]) else top for g, b in enumerate(bounds)])
    samples = [(_first(kept.where(F.col("first") & (F.col("g") == g)), SAMPLE) - m) / s for g, (m, s) in enumerate(scales)]
    firsts = [x[:FIRST] for x in samples]
    models = [(g, *m) for g, x in enumerate(firsts) for m in _started(x, [k for k in ks if k < n[g]] if n[g] >= small else [2], STARTS, 1)]
    centers: list[dict[int, np.ndarray]] = [{} for _ in n]
    if models:
        folder = fresh_folder(spark, "batches")
        kept.where(F.col("b") < each(used)).select("x", "g", "b").repartition(min(sum(used), 512), "g", "b").write.partitionBy("g", "b").parquet(folder)
        try:
            within = reduce(lambda a, b: a | b, [F.col("g") == g for g in {m[0] for m in models}])
            centers = _moved(spark.read.parquet(folder).where(within), firsts, models, used, scales, steps, 1)
        finally:
            remove_folder(spark, folder)
    chosen = []
    for g, scores in enumerate(_silhouettes(spark, list(zip(samples, centers, strict=True)))):
        found = {k: s for k, s in scores.items() if not math.isnan(s)}
        chosen.append(centers[g][max(found, key=lambda k: (round(found[k], 9), -k))] if found else np.zeros((1, len(scales[g][0]))))
    return _placed(df, of, dense, scales, chosen, len(names), shared, width, on)


def _placed(df: DataFrame, of: Column, dense: Column, scales: Sequence[tuple[np.ndarray, np.ndarray]], centers: Sequence[np.ndarray], own: int, shared: DataFrame | None, width: int, on: str | None) -> DataFrame:
    """Adds the nearest center of the row's group (ties: the first); the shared columns' part of the distances is found once per row of ``shared``."""

    def apart(x: np.ndarray, g: int, columns: slice) -> np.ndarray:
        m, s = (v[columns] for v in scales[g])
        z = (x - m) / s
        return np.column_stack([((z - c[columns]) ** 2).sum(axis=1) for c in centers[g]])

    wide, rest, starts = shared is not None, slice(own, own + width), np.cumsum([0, *map(len, centers)])

    def far(v: np.ndarray) -> np.ndarray:
        return np.concatenate([apart(v, g, rest) for g in range(len(centers))], axis=1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = far(fits._matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))], [on, "__far"])

    @F.arrow_udf("int")
    def nearest(g: pa.Array, x: pa.Array, more: pa.Array) -> pa.Array:
        groups, x, more = g.to_numpy(), fits._matrix(x), fits._matrix(more)
        out = np.zeros(len(groups), dtype=np.int32)
        for k in np.unique(groups).tolist():
            at = groups == k
            d = apart(x[at], k, slice(0, own))
            out[at] = (d + more[at, starts[k] : starts[k + 1]] if wide else d).argmin(axis=1)
        return pa.array(out)

    if not wide:
        return df.withColumn("cluster", nearest(of, dense, F.array(F.lit(0.0))))
    zero = F.array(*[F.lit(float(x)) for x in far(np.zeros((1, width)))[0]])
    near = shared.select(on, "v").mapInArrow(parts, f"{on} {dict(shared.dtypes)[on]}, __far array<double>")
    if shared.count() * (int(starts[-1]) + 4) * 8 <= SENT:
        near = F.broadcast(near)
    return df.join(near, on, "left").withColumn("cluster", nearest(of, dense, F.coalesce("__far", zero))).drop("__far")
