"""Extremely randomised trees, grown level by level in shared scans.

All trees of all forests and folds grow together.  A level takes two scans: the range of every
feature in every open node, from which each node draws cut points for some features, and the
class counts on both sides of these cuts.  The driver keeps the best cut by Gini impurity.  What
travels is bounded by trees, nodes and features.

Rows that are alike in their label and a forest's features go the same way in all its trees, so they
are counted by fold once and each scan reads them as one row with these numbers.  A scan takes
``BLOCK`` rows at a time, sorted by label, and hands the numbers of the rows in a node down to its
children, so a tree reads of a row only the features that it asks for.

Random forests (``grow_bagged``) choose among the bounds of ``BINS`` bins, one scan a level.  A tree's
sample of the rows is a Poisson number for each, drawn from a hash of the row: equal in every scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import fits
from tallyforge.operators.relational import stable


#: Rows that a task works on at a time, and bins of a feature in random forests.
BLOCK, BINS = 1 << 15, 32


@dataclass(frozen=True)
class Forest:
    """Trees to be tried: features, depth, least rows on each side of a cut."""

    name: str
    features: tuple[str, ...]
    depth: int
    leaf: int
    trees: int = 20
    balanced: bool = True


@dataclass
class Tree:
    """A tree as a heap: children of node i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    forest: int
    fold: int
    number: int
    columns: np.ndarray
    fill: np.ndarray
    weight: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    counts: np.ndarray  # rows per class in each node

    def values(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.columns]
        return np.where(np.isnan(v), self.fill, v)

    def node(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of ``values`` has reached after ``depth`` levels."""
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            feature = self.feature[at]
            right = x[np.arange(len(x)), np.maximum(feature, 0)] >= self.cut[at]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at


def draws(seed: int, tree: Tree, node: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, float]]:
    """Features with more than one value in a node, as many as the root of all, each with a uniform cut inside its range."""
    rng = np.random.default_rng([seed, tree.forest, tree.fold, tree.number, node])
    order, u = rng.permutation(len(low)), rng.random(len(low))
    usable = [int(j) for j in order if low[j] < high[j]]
    cuts = [(j, float(low[j] + u[j] * (high[j] - low[j]))) for j in usable[: max(1, int(np.sqrt(len(low))))]]
    return [(j, c if c > low[j] else float(high[j])) for j, c in cuts]  # rows go left below the cut, so it has to be above the least


def gini(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight times impurity."""
    w = counts * weight
    total = w.sum(axis=-1)
    return total - (w * w).sum(axis=-1) / np.maximum(total, 1e-300)


def best_cut(found: Sequence[tuple[int, float]], left: np.ndarray, total: np.ndarray, weight: np.ndarray, leaf: int) -> int | None:
    """The drawn cut (its place) with the least impurity on both sides; ties go to the earlier one."""
    right = total - left
    allowed = (left.sum(axis=1) >= leaf) & (right.sum(axis=1) >= leaf)
    if not len(found) or not allowed.any():
        return None
    score = np.where(allowed, np.round(gini(left, weight) + gini(right, weight), 9), np.inf)
    return int(score.argmin())


def alike(f: fits.Fitted, features: Sequence[str]) -> DataFrame:
    """(label, n, x, hash of label and x): the rows that are equal in these, with their number in each fold; features that a forest doesn't use are 0 in ``x``.

    The table is stored once for all forests of these features.
    """
    key = tuple(sorted(features))
    if key not in f.alike:
        n = F.array(*[F.count_if(F.col("outer") == i) for i in range(f.folds)])
        rows = f.rows.select("label", "outer", fits.seen(f.names, features).alias("x")).groupBy("label", "x").agg(n.alias("n"))
        f.alike[key] = stable(rows.select("label", "n", "x", F.xxhash64("label", "x").alias("hash")))
    return f.alike[key]


def _planted(f: fits.Fitted, forests: Sequence[Forest]) -> list[Tree]:
    """The roots of every forest on the training rows of every outer fold of ``f``."""
    per_label = fits.counted_left_out(f, [], False, (fits.CLASSES,), lambda y, _: np.bincount(y, minlength=fits.CLASSES).astype(float))
    trees: list[Tree] = []
    for k, forest in enumerate(forests):
        at = np.array([f.names.index(x) for x in forest.features])
        size = 2 ** (forest.depth + 1) - 1
        for fold in range(f.folds):
            n = per_label.sum(axis=0) - per_label[fold]
            weight = n.sum() / (max((n > 0).sum(), 1) * np.maximum(n, 1)) if forest.balanced else np.ones(fits.CLASSES)
            for number in range(forest.trees):
                counts = np.zeros((size, fits.CLASSES))
                counts[0] = n
                trees.append(Tree(k, fold, number, at, f.fills[fold][at], weight, np.full(size, -1), np.zeros(size), counts))
    return trees


def grow(f: fits.Fitted, forests: Sequence[Forest], seed: int = 1) -> list[Tree]:
    """Grows every forest on the training rows of every outer fold of ``f``."""
    trees = _planted(f, forests)
    for features in dict.fromkeys(x.features for x in forests):
        _grow(alike(f, features), [t for t in trees if forests[t.forest].features == features], forests, seed)
    return trees


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, numbers by fold, columns x rows, hashes) of some rows at a time, sorted by label."""
    kept: list[pa.RecordBatch] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y, n, x, hashes = (np.concatenate([read(b.column(i)) for b in kept]) for i, read in enumerate((pa.Array.to_numpy, fits._matrix, fits._matrix, pa.Array.to_numpy)))
        order = np.argsort(y, kind="stable")
        return y[order], n[order], np.ascontiguousarray(x[order].T), hashes[order].view(np.uint64)

    for b in batches:
        if b.num_rows:
            kept.append(b)
        if sum(x.num_rows for x in kept) >= BLOCK:
            yield block()
            kept = []
    if kept:
        yield block()


def _taught(x: np.ndarray, n: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns x rows without gaps, numbers, places) of the rows of a block in the training part of a tree."""
    many = n.sum(axis=1) - n[:, tree.fold]
    use = np.flatnonzero(many > 0)
    v = x[tree.columns][:, use]
    return np.where(np.isnan(v), tree.fill[:, None], v), many[use].astype(float), use


def _descend(tree: Tree, x: np.ndarray, nodes: Sequence[int], rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
    """(place in ``nodes``, numbers of its rows in order) of the nodes that rows reach; None: all rows.  No node lies below another."""
    wanted = {n: i for i, n in enumerate(nodes)}
    above = set()
    for n in nodes:
        while n > 0:
            n = (n - 1) // 2
            above.add(n)
    open_: list[tuple[int, np.ndarray | None]] = [(0, rows)]
    while open_:
        node, rows = open_.pop()
        if node in wanted:
            yield wanted[node], rows
        elif node in above:
            v = x[tree.feature[node]]
            left = (v if rows is None else v[rows]) < tree.cut[node]
            for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
                if child in wanted or child in above:
                    own = np.flatnonzero(side) if rows is None else rows[side]
                    if len(own):
                        open_.append((child, own))


def _open(t: Tree, level: int, forest: Forest) -> list[int]:
    """The nodes of a level that may be cut."""
    first = 2**level - 1
    return [n for n in range(first, 2 * first + 1) if (n == 0 or t.feature[(n - 1) // 2] >= 0) and t.counts[n].sum() >= 2 * forest.leaf and (t.counts[n] > 0).sum() > 1] if level < forest.depth else []


def _grow(body: DataFrame, trees: Sequence[Tree], forests: Sequence[Forest], seed: int) -> None:
    """Grows the trees of one list of features on the rows of ``alike``."""
    first = {t.fold: i for i, t in reversed(list(enumerate(trees)))}  # all trees of a fold have the same root

    for level in range(max((forests[t.forest].depth for t in trees), default=0)):
        nodes = [_open(t, level, forests[t.forest]) for t in trees]
        if not any(nodes):
            break

        def ranges(batches: Iterator[pa.RecordBatch], nodes: list = nodes, level: int = level) -> dict[int, np.ndarray]:
            found: dict[int, np.ndarray] = {}
            for _, n, x, _ in _blocks(batches):
                seen = {fold: _taught(x, n, trees[i])[0] for fold, i in first.items()}
                for i, tree in enumerate(trees):
                    v = seen[tree.fold]
                    if not nodes[i] or not v.size or (level == 0 and i != first[tree.fold]):
                        continue
                    mine = found.setdefault(i, np.full((len(nodes[i]), 2, len(v)), np.inf))
                    for at, rows in _descend(tree, v, nodes[i]):
                        own = v if rows is None else v.take(rows, axis=1)
                        mine[at] = np.minimum(mine[at], [own.min(axis=1), -own.max(axis=1)])
            return {i: x.ravel() for i, x in found.items()}

        drawn: list[list[list[tuple[int, float]]]] = []
        limits = fits._summed(body, ranges, len(trees), np.minimum)
        for i, tree in enumerate(trees):
            s = limits[first[tree.fold] if level == 0 and nodes[i] else i]
            bounds = s.reshape(len(nodes[i]), 2, -1) if s is not None else np.zeros((0, 2, 0))
            drawn.append([draws(seed, tree, n, low, -high) for n, (low, high) in zip(nodes[i], bounds, strict=False)])
        most = [max((len(x) for x in d), default=0) for d in drawn]

        def sides(batches: Iterator[pa.RecordBatch], nodes: list = nodes, drawn: list = drawn, most: list = most) -> dict[int, np.ndarray]:
            found: dict[int, np.ndarray] = {}
            for y, n, x, _ in _blocks(batches):
                seen = {fold: _taught(x, n, trees[i]) for fold, i in first.items()}
                ends = {fold: np.searchsorted(y[use], range(fits.CLASSES + 1)) for fold, (_, _, use) in seen.items()}
                single = {fold: bool((many == 1).all()) for fold, (_, many, _) in seen.items()}
                for i, tree in enumerate(trees):
                    v, many, use = seen[tree.fold]
                    if not nodes[i] or not len(use):
                        continue
                    mine = found.setdefault(i, np.zeros((len(nodes[i]), most[i], fits.CLASSES)))
                    for at, rows in _descend(tree, v, nodes[i]):
                        cut = ends[tree.fold] if rows is None else np.searchsorted(rows, ends[tree.fold])
                        weight = None if single[tree.fold] else many if rows is None else many[rows]
                        for k, (feature, c) in enumerate(drawn[i][at]):
                            left = (v[feature] if rows is None else v[feature][rows]) < c
                            for label in range(fits.CLASSES):
                                part = slice(cut[label], cut[label + 1])
                                mine[at, k, label] += np.count_nonzero(left[part]) if weight is None else left[part] @ weight[part]
            return {i: x.ravel() for i, x in found.items()}

        for i, s in enumerate(fits._summed(body, sides, len(trees))):
            if s is None:
                continue
            tree = trees[i]
            for n, found, left in zip(nodes[i], drawn[i], s.reshape(len(nodes[i]), most[i], fits.CLASSES), strict=True):
                k = best_cut(found, left[: len(found)], tree.counts[n], tree.weight, forests[tree.forest].leaf)
                if k is not None:
                    tree.feature[n], tree.cut[n] = found[k]
                    tree.counts[2 * n + 1], tree.counts[2 * n + 2] = left[k], tree.counts[n] - left[k]


@lru_cache(4096)
def _poisson(n: int) -> tuple[int, np.ndarray]:
    """(least number, chances of at most it and those after it) of a Poisson law of mean ``n``, as far as doubles tell."""
    first = max(0, int(n - 10 * np.sqrt(n) - 10))
    k = np.arange(first, int(n + 10 * np.sqrt(n) + 20))
    log = k * np.log(n) - n - np.cumsum(np.log(np.maximum(np.arange(k[-1] + 1), 1)))[k]
    return first, np.cumsum(np.exp(log))


def bag(hashes: np.ndarray, many: np.ndarray, seed: int, number: int) -> np.ndarray:
    """How often a tree's sample has each row, ``many`` of which are alike: the sum of as many Poisson numbers of mean 1."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * (1 + number + 1009 * seed)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    out = np.zeros(len(u))
    order = np.argsort(many, kind="stable")
    values, starts = np.unique(many[order], return_index=True)
    for n, rows in zip(values, np.split(order, starts[1:])):
        first, upto = _poisson(int(n))
        out[rows] = first + np.searchsorted(upto[:-1], u[rows], "right")
    return out


def bounds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cut points between bins of about as many rows: midway between neighbouring values, between all of them if they are few."""
    distinct, n = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(distinct) <= bins:
        return middle
    upto = n.cumsum()[:-1]
    return middle[np.unique(np.searchsorted(upto, len(values) * np.arange(1, bins) / bins).clip(0, len(middle) - 1))]


def _sampled(f: fits.Fitted) -> tuple[np.ndarray, np.ndarray]:
    """(outer folds, columns) of the rows that bins are cut by: all, or about ``fits.SAMPLE`` of a larger table by their hash."""
    times = f.rows.count() // fits.SAMPLE
    few = f.rows.where(F.pmod(F.xxhash64("key"), F.lit(times)) == 0) if times > 1 else f.rows
    read = few.select("outer", "x").toArrow().combine_chunks()
    return read.column(0).to_numpy(), np.concatenate([fits._matrix(c) for c in read.column(1).chunks if len(c)] or [np.zeros((0, len(f.names)))])


def grow_bagged(f: fits.Fitted, forests: Sequence[Forest], seed: int = 42) -> list[Tree]:
    """Grows random forests on the training rows of every outer fold: Poisson samples of the rows, the best of all bounds of a few features.

    A forest of less depth is the upper part of a deeper one, so forests that differ in depth alone
    are grown once.  As in Spark ML, leaves below a node that say the same class are one leaf.
    """
    outer, x = _sampled(f)
    deepest = {}
    for forest in forests:
        alone = replace(forest, name="", depth=0)
        deepest[alone] = max(forest.depth, deepest.get(alone, 0))
    grown = [replace(alone, depth=depth) for alone, depth in deepest.items()]
    trees = _planted(f, grown)
    for features in dict.fromkeys(g.features for g in grown):
        own = [t for t in trees if grown[t.forest].features == features]
        cuts = {}
        for t in own:
            if t.fold not in cuts:
                v = x[outer != t.fold][:, t.columns]
                cuts[t.fold] = [bounds(c) for c in np.where(np.isnan(v), t.fill, v).T]
        _grow_bagged(alike(f, features), own, grown, cuts, seed)
    place = {alone: i for i, alone in enumerate(deepest)}
    return [cropped(t, k, forest.depth) for k, forest in enumerate(forests) for t in trees if t.forest == place[replace(forest, name="", depth=0)]]


def cropped(tree: Tree, forest: int, depth: int) -> Tree:
    """The upper ``depth`` levels of a tree, without cuts whose leaves say the same class."""
    size = 2 ** (depth + 1) - 1
    feature = tree.feature[:size].copy()
    feature[2**depth - 1 :] = -1
    says = (tree.counts[:size] * tree.weight).argmax(axis=1)
    for n in reversed(range(2**depth - 1)):
        if feature[n] >= 0 and (feature[[2 * n + 1, 2 * n + 2]] < 0).all() and says[2 * n + 1] == says[2 * n + 2]:
            feature[n] = -1
    return replace(tree, forest=forest, feature=feature, cut=tree.cut[:size], counts=tree.counts[:size])


def chosen(seed: int, tree: Tree, node: int) -> np.ndarray:
    """The features that a node of a random forest may use: the root of all, rounded up."""
    p = len(tree.columns)
    return np.sort(np.random.default_rng([seed, tree.forest, tree.fold, tree.number, node]).permutation(p)[: int(np.ceil(np.sqrt(p)))])


def best_bound(hist: np.ndarray, weight: np.ndarray, leaf: int) -> tuple[int, int] | None:
    """(feature, bins on the left less one) of the bound with the least impurity on both sides of class counts (features, bins, classes)."""
    left = hist.cumsum(axis=1)[:, :-1]
    total = hist.sum(axis=1, keepdims=True)
    right = total - left
    allowed = (left.sum(axis=2) >= leaf) & (right.sum(axis=2) >= leaf)
    score = np.where(allowed, np.round(gini(left, weight) + gini(right, weight), 9), np.inf)
    at = int(score.argmin())
    return divmod(at, score.shape[1]) if score.ravel()[at] < np.round(gini(total[0, 0], weight), 9) else None


def _grow_bagged(body: DataFrame, trees: Sequence[Tree], forests: Sequence[Forest], cuts: dict[int, list[np.ndarray]], seed: int) -> None:
    """Grows the trees of one list of features on the rows of ``alike`` with their hashes, between the cut points of each fold."""
    first = {t.fold: t for t in reversed(trees)}
    width = 1 + max((len(c) for own in cuts.values() for c in own if len(c)), default=1)
    for level in range(max((forests[t.forest].depth for t in trees), default=0)):
        # samples are counted by the first scan
        nodes = [[0] if level == 0 and forests[t.forest].depth else _open(t, level, forests[t.forest]) for t in trees]
        if not any(nodes):
            break
        asked = [[chosen(seed, t, n) for n in own] for t, own in zip(trees, nodes, strict=True)]

        def count(batches: Iterator[pa.RecordBatch], nodes: list = nodes, asked: list = asked) -> dict[int, np.ndarray]:
            found: dict[int, np.ndarray] = {}
            by_fold: dict[int, list[int]] = {}
            for i, t in enumerate(trees):
                if nodes[i]:
                    by_fold.setdefault(t.fold, []).append(i)
            for y, n, x, hashes in _blocks(batches):
                for fold, members in by_fold.items():
                    v, many, use = _taught(x, n, first[fold])
                    if not len(use):
                        continue
                    codes = np.stack([np.searchsorted(c, u, "left") for c, u in zip(cuts[fold], v, strict=True)]) * fits.CLASSES + y[use]
                    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                    for i in members:
                        tree = trees[i]
                        if tree.number not in bags:
                            times = bag(hashes[use], many, seed, tree.number)
                            bags[tree.number] = times, np.flatnonzero(times)
                        times, rows = bags[tree.number]
                        mine = found.setdefault(i, np.zeros((len(nodes[i]), len(asked[i][0]), width * fits.CLASSES)))
                        for at, own in _descend(tree, v, nodes[i], rows):
                            weight = times[own]
                            for k, feature in enumerate(asked[i][at]):
                                mine[at, k] += np.bincount(codes[feature][own], weight, width * fits.CLASSES)
            return {i: x.ravel() for i, x in found.items()}

        for i, s in enumerate(fits._summed(body, count, len(trees))):
            tree, leaf = trees[i], forests[trees[i].forest].leaf
            for n, features, hist in zip(nodes[i], asked[i], s.reshape(len(nodes[i]), -1, width, fits.CLASSES) if s is not None else (), strict=False):
                if n == 0:
                    tree.counts[0] = hist[0].sum(axis=0)
                best = best_bound(hist, tree.weight, leaf)
                if best is not None:
                    feature, upto = features[best[0]], best[1]
                    # rows of a bin are at most its upper bound, and rows below the cut go left
                    tree.feature[n], tree.cut[n] = feature, np.nextafter(cuts[tree.fold][feature][upto], np.inf)
                    left = hist[best[0], : upto + 1].sum(axis=0)
                    tree.counts[2 * n + 1], tree.counts[2 * n + 2] = left, tree.counts[n] - left


def probabilities(trees: Sequence[Tree], x: np.ndarray, depth: int) -> np.ndarray:
    """Mean class shares (by weight) of the leaves (or nodes at ``depth``) that rows reach."""
    total = np.zeros((len(x), fits.CLASSES))
    seen: dict[tuple, np.ndarray] = {}
    for tree in trees:
        key = (tree.columns.tobytes(), tree.fill.tobytes())
        if key not in seen:
            seen[key] = np.ascontiguousarray(tree.values(x).T)
        share = tree.counts * tree.weight
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        leaves, below = [], [0]
        while below:
            n = below.pop()
            inside = tree.feature[n] >= 0 and n < 2**depth - 1
            below += [2 * n + 1, 2 * n + 2] if inside else []
            leaves += [] if inside else [n]
        for at, rows in _descend(tree, seen[key], leaves):
            total[slice(None) if rows is None else rows] += share[leaves[at]]
    return total / max(len(trees), 1)


def confusions(f: fits.Fitted, forests: Sequence[Forest], trees: Sequence[Tree]) -> np.ndarray:
    """(outer fold, forest, truth, prediction) counts on the rows that the fold leaves out."""
    own = {(k, i): [t for t in trees if (t.forest, t.fold) == (k, i)] for k in range(len(forests)) for i in range(f.folds)}
    shape = (f.folds, len(forests), fits.CLASSES, fits.CLASSES)

    def task(batches: Iterator[pa.RecordBatch], features: tuple[str, ...]) -> dict[int, np.ndarray]:
        found = np.zeros(shape)
        for y, n, x, _ in _blocks(batches):
            for i in range(shape[0]):
                use = n[:, i] > 0
                mine = x[:, use].T
                for k, forest in enumerate(forests):
                    if forest.features == features:
                        pred = probabilities(own[k, i], mine, forest.depth).argmax(axis=1)
                        found[i, k] += np.bincount(y[use] * fits.CLASSES + pred, n[use, i], fits.CLASSES**2).reshape(fits.CLASSES, fits.CLASSES)
        return {0: found.ravel()}

    views = dict.fromkeys(x.features for x in forests)
    tables = [fits._summed(alike(f, x), lambda batches, x=x: task(batches, x), 1)[0] for x in views]
    return sum((t.reshape(shape) for t in tables if t is not None), np.zeros(shape))


def predict(f: fits.Fitted, forest: Forest, trees: Sequence[Tree]):
    """(key, outer, p_nh, p_nmr, p_h, pred) of every row under the trees that left it out."""
    own = {i: [t for t in trees if t.fold == i] for i in range(f.folds)}
    kind = f.rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, x = b.column(1).to_numpy(), fits._matrix(b.column(2))
            p = np.zeros((len(o), fits.CLASSES))
            for i in np.unique(o):
                p[o == i] = probabilities(own[int(i)], x[o == i], forest.depth)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(p[:, k].copy()) for k in range(fits.CLASSES)), pa.array(p.argmax(axis=1).astype(np.int32))], ["key", "outer", "p_nh", "p_nmr", "p_h", "pred"])

    return f.rows.select("key", "outer", "x").mapInArrow(run, f"key {kind}, outer int, p_nh double, p_nmr double, p_h double, pred int")
