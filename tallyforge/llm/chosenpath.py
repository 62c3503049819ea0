"""Near-duplicate join on word shingles: Jaccard similarity by chosen paths.

A text's set is its distinct runs of five words (a text of fewer words, but not none, has
one run).  Texts with equal sets are collapsed first.  ``DIMS`` independent minima of the
hashed set are its sampled tokens.

Chosen path.  A run starts by splitting all sets on two sampled tokens; a bucket of more than
``LEAF`` sets is split again on one or two tokens that a hash of its path chooses, and so on.
Sets that share a token go on together, so similar ones stay together on some path.  Runs
are repeated until a pair at the threshold is expected to meet with probability ``RECALL``.
Buckets with the same members are examined once.  Inside small buckets all pairs are
compared on their sampled tokens.  A large bucket that a split leaves together (one child keeps the
threshold's share of it) is a family, and one that is still large after ``DEPTH`` splits holds
sets that agreed on every token sampled on its path; the members of both are candidates of each
other without a comparison.

Verification.  Candidates are joined into components, each text of which is fetched once and
turned into its shingle hashes, which are stored; every pair of a component is compared on
them, so pairs that no path brought together are found too when they share a component.  Large
components are compared in pairs of blocks (an eighth of the component, ``BLOCKS[0]`` to
``BLOCKS[1]`` sets, about ``BLOCK_SHINGLES`` shingles at most), each pair a group of its own; hashes, never texts, are dealt
to them.  A pair of blocks costs a comparison of every two sets and moves each set once, so the
comparisons, not the moves, bound a component of any size.  Links are counted where they are
found; only one row per set and task leaves the comparison, never the pairs.

Identity.  Sets are told apart by the md5 of their shingle hashes and numbered without
clashes when they are stored.  Buckets count as equal if their sizes and two independent
64-bit sums of member hashes agree.  Shingles are 64-bit hashes: two of a pair of texts of
20,000 words clash with probability 1e-10.

Result: one row per document with its class (the smallest id reached over links), its number
of links to other documents, copies included, and to other texts.  Null and empty texts and
texts without words have no set: they are their own class and have no links.  A null id
never names a class that has another id.  Repeated rows count as copies of each other.  An
empty input gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components
from tallyforge.llm.shared import save, temporary
from tallyforge.llm.words import buffers, groups, mix, release, words

SHINGLE = 5
THRESHOLD = 0.8
DIMS = 64
LEAF = 64
DEPTH = 6
RECALL = 0.99
BLOCKS = (256, 2048)
BLOCK_SHINGLES = 1 << 20
ROWS = 1024
#: Share of equal sampled tokens below which a pair is no candidate: four deviations under the threshold.
SKETCH = 0.6
#: Up to this many ids the fetch of texts may send the ids to every task; beyond it both sides are shuffled.
BROADCAST_IDS = 200_000
BROADCAST_GONE = 1_000_000

_rng = np.random.default_rng(53)
_MULTIPLY = _rng.integers(1, 1 << 63, DIMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a bucket of the last level."""
    stay = 1.0
    for _ in range(depth - 1):
        stay = 0.75 * threshold * stay + 0.25 * (1 - (1 - threshold * stay) ** 2)
    met = 1 - (1 - threshold * stay) ** 2
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, concatenated, and their offsets."""
    n = len(offs) - 1
    s, _, h = words(buf, offs)
    row = np.searchsorted(offs, s, side="right") - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    out_rows, out = [], []
    if len(h) >= size:
        m = len(h) - size + 1
        total = h[:m] * _POSITION[0]
        for k in range(1, size):
            total = total + h[k : k + m] * _POSITION[k]
        inside = row[:m] == row[size - 1 :]
        out.append(mix(total[inside]))
        out_rows.append(row[:m][inside])
    for r in np.flatnonzero((count > 0) & (count < size)):
        v = h[first[r] : first[r + 1]]
        out.append(mix((v * _POSITION[: len(v)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(v))))
        out_rows.append(np.array([r]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    x, r = np.concatenate(out), np.concatenate(out_rows)
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    x, r = x[keep], r[keep]
    return x, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])


def signatures(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sampled tokens of every non-empty set: rows x DIMS of uint32."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), DIMS), np.uint32)
    if len(starts):
        for i in range(DIMS):
            least = np.minimum.reduceat(x * _MULTIPLY[i], starts)
            out[:, i] = (mix(least) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


_SIGNED = "doc_id bigint, text_key binary, set_key binary, size bigint, sig binary"


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, set_key, size, sig) of every row; the last three null or 0 without words."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("text_key"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffers(b.column(2))
            for i, j in groups(offs):
                x, at = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                size = np.diff(at)
                sig = iter(signatures(x, at))
                keys = [hashlib.md5(x[at[k] : at[k + 1]].tobytes()).digest() if size[k] else None for k in range(j - i)]
                sigs = [next(sig).tobytes() if k else None for k in keys]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "set_key", "size", "sig"])
        release()

    return kept.mapInArrow(run, _SIGNED)


def shingled(texts: DataFrame) -> DataFrame:
    """The rows with ``text`` replaced by its sorted shingle hashes."""
    names = [c for c in texts.columns if c != "text"]
    kept = texts.select(*names, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"), "shingles binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = buffers(b.column(len(names)))
            for i, j in groups(offs):
                x, at = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                sets = [x[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(names))), pa.array(sets, pa.binary())], [*names, "shingles"])
        release()

    return kept.mapInArrow(run, schema)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all hashes, number of each row's) of a column of shingle sets."""
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(np.frombuffer(data, np.uint8)[o[0] : o[-1]].tobytes(), np.uint64), np.diff(o) // 8


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint32).reshape(-1, DIMS)


def _child(key: np.ndarray, dim: np.ndarray, sig: np.ndarray) -> np.ndarray:
    token = np.take_along_axis(sig, dim[:, None], 1)[:, 0].astype(np.uint64)
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + mix(token + (dim.astype(np.uint64) << np.uint64(40)))).view(np.int64)


def first_level(sets: DataFrame, runs: int) -> DataFrame:
    """(path, sid): the buckets of the first split of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, sid = _sig_matrix(b.column(1)), b.column(0).to_numpy()
            paths = [_child(np.full(len(sid), k // 2 + 1, np.uint64), np.full(len(sid), k % DIMS), sig) for k in range(2 * runs)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), pa.array(np.tile(sid, 2 * runs))], ["path", "sid"])

    return sets.select("sid", "sig").mapInArrow(run, "path bigint, sid bigint")


def next_level(members: DataFrame) -> DataFrame:
    """(path, sid, parent) one split further, from (path, sid, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, sid, sig = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), _sig_matrix(b.column(2))
            r1, r2 = mix(path + np.uint64(1)), mix(path + np.uint64(2))
            d1 = (r1 % np.uint64(DIMS)).astype(np.int64)
            d2 = (d1 + 1 + (r2 % np.uint64(DIMS - 1)).astype(np.int64)) % DIMS
            twice = (r1 >> np.uint64(32)) % np.uint64(4) == 0
            paths = np.concatenate([_child(path, d1, sig), _child(path[twice], d2[twice], sig[twice])])
            parents = np.concatenate([path, path[twice]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(np.concatenate([sid, sid[twice]])), pa.array(parents)], ["path", "sid", "parent"])

    return members.mapInArrow(run, "path bigint, sid bigint, parent bigint")


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted input cut so that rows that agree on the first ``n_keys`` columns stay together."""
    held: list[pa.RecordBatch] = []
    for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        same = np.ones(b.num_rows, dtype=bool)
        for k in range(n_keys):
            v = b.column(k).to_numpy()
            same &= v == v[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut == 0 and held and all(held[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in range(n_keys)):
            held.append(b)
            continue
        # what is held ends inside this batch or before it
        done = [*held, b.slice(0, cut)] if cut else held
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def leaf_edges(members: DataFrame) -> DataFrame:
    """Edges (a, b) that join the sets of each small bucket whose sampled tokens agree; from (path, sid, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, 1):
            path, sid, sig = b.column(0).to_numpy(), b.column(1).to_numpy(), _sig_matrix(b.column(2))
            xs, ys = [], []
            i = np.arange(len(path) - 1)
            for d in range(1, LEAF):
                i = i[i + d < len(path)]
                i = i[path[i] == path[i + d]]
                if not len(i):
                    break
                for part in np.array_split(i, max(1, len(i) // 20_000)):
                    close = part[(sig[part] == sig[part + d]).sum(axis=1) >= SKETCH * DIMS]
                    xs.append(close)
                    ys.append(close + d)
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
            root = roots(len(path), x, y)
            joined = np.flatnonzero(root != np.arange(len(path)))
            yield pa.RecordBatch.from_arrays([pa.array(sid[joined]), pa.array(sid[root[joined]])], ["a", "b"])
        release()

    return members.repartition("path").sortWithinPartitions("path", "sid").mapInArrow(run, "a bigint, b bigint")


def candidate_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """Stored edges (a, b) between the sets that the chosen paths bring together."""
    with temporary(sets.sparkSession):
        return save(_candidate_edges(sets, threshold), "candidates", keep=True)


def _candidate_edges(sets: DataFrame, threshold: float) -> DataFrame:
    sigs = sets.select("sid", "sig")
    rows, leaves, stars = save(first_level(sets, runs_needed(threshold)), "paths").withColumn("parent", F.lit(None).cast("bigint")), None, None
    inside, large = None, None  # members and sizes of the large buckets one split before
    star = lambda members: members.select(F.col("sid").alias("a"), F.col("least").alias("b")).where("a <> b")
    both = lambda a, b: b if a is None else a.unionByName(b)
    for depth in range(1, DEPTH + 1):
        counts = rows.groupBy("path").agg(F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n"), F.min("sid").alias("least"), F.bit_xor(F.xxhash64("sid")).alias("mark"), F.bit_xor(F.xxhash64("sid", F.lit(7))).alias("mark2"))
        counts = save(counts.where("n > 1"), "buckets")
        if inside is not None:
            kept = counts.groupBy("parent").agg(F.max("n").alias("most"))
            families = save(large.join(kept, large["path"] == kept["parent"]).where(F.col("most") >= threshold * F.col("n")).select("path"), "families")
            stars = both(stars, star(inside.join(families, "path")))
            counts = counts.join(families.withColumnRenamed("path", "parent"), "parent", "left_anti")
        small = counts.where(F.col("n") <= LEAF).groupBy("n", "mark", "mark2").agg(F.min("path").alias("path")).select("path")
        leaves = both(leaves, rows.join(small, "path").select("path", "sid"))
        large = counts.where(F.col("n") > LEAF).select("path", "n", "least")
        if large.isEmpty():
            break
        inside = rows.select("path", "sid").join(large.select("path", "least"), "path")
        if depth == DEPTH:
            stars = both(stars, star(inside))
        else:
            rows = save(next_level(inside.join(sigs, "sid").select("path", "sid", "sig")), "paths")
    edges = leaf_edges(leaves.join(sigs, "sid").select("path", "sid", "sig"))
    return edges if stars is None else edges.unionByName(stars.distinct())


def overlaps(x: np.ndarray, at: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some of ``rows``, common shingles with every one of ``columns``), a few rows at a time.

    Shingles of the columns are sorted once; each row looks its shingles up and counts the
    columns listed under them.
    """
    owner = np.repeat(np.arange(len(columns)), np.diff(at)[columns])
    flat = np.concatenate([x[at[c] : at[c + 1]] for c in columns]) if len(columns) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    step = max(1, (1 << 19) // max(len(columns), 1))
    for i in range(0, len(rows), step):
        part = rows[i : i + step]
        mine = np.concatenate([x[at[r] : at[r + 1]] for r in part])
        local = np.repeat(np.arange(len(part)), np.diff(at)[part])
        lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        size = hi - lo
        total = np.zeros(len(part) * len(columns), np.int64)
        use = np.flatnonzero(size)
        ends = np.cumsum(size[use])
        j = 0
        while j < len(use):  # slices of about half a million increments
            k = max(j + 1, int(np.searchsorted(ends, (ends[j - 1] if j else 0) + (1 << 19), "right")))
            e = use[j:k]
            n = size[e]
            step_in = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            total += np.bincount(np.repeat(local[e] * len(columns), n) + owner[np.repeat(lo[e], n) + step_in], minlength=len(total))
            j = k
        yield part, total.reshape(len(part), len(columns))


_LINKED = "sid bigint, component bigint, root bigint, docs bigint, texts bigint"


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison inside tasks; from (component, bi, bj, own, sid, n_docs, n_texts, shingles).

    A task (component, bi, bj) compares block bi with block bj, or bi with itself; ``own`` is a
    row's block.  Gives per set and task: links found and the smallest set reached.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, 3):
            component, bi, bj = (b.column(k).to_numpy() for k in range(3))
            own, sid, n_docs, n_texts = (b.column(k).to_numpy() for k in range(3, 7))
            x, size = _hashes(b.column(7))
            change = np.flatnonzero((component[1:] != component[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            bounds = np.concatenate([[0], change, [len(component)]])
            at = np.concatenate([[0], np.cumsum(size)])
            docs, texts, root = np.zeros(len(sid), np.int64), np.zeros(len(sid), np.int64), np.arange(len(sid))
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                alone = bi[s] == bj[s]
                everyone = np.arange(s, e)
                rows, columns = (everyone, everyone) if alone else (everyone[own[s:e] == bi[s]], everyone[own[s:e] == bj[s]])
                a_all, b_all = [], []
                for part, common in overlaps(x, at, rows, columns):
                    similar = common >= threshold * (size[part][:, None] + size[columns][None, :] - common) - 1e-9
                    similar &= common > 0
                    if alone:
                        similar &= part[:, None] != columns[None, :]
                    docs[part] += similar @ n_docs[columns]
                    texts[part] += similar @ n_texts[columns]
                    if not alone:
                        docs[columns] += n_docs[part] @ similar
                        texts[columns] += n_texts[part] @ similar
                    p, q = np.nonzero(similar)
                    if len(p):  # a spanning forest of what is known so far is all that is kept
                        a_all, b_all = [*a_all, part[p] - s], [*b_all, columns[q] - s]
                        if sum(map(len, a_all)) > 1 << 20:
                            r = roots(e - s, np.concatenate(a_all), np.concatenate(b_all))
                            a_all, b_all = [np.arange(e - s)], [r]
                if a_all:
                    root[s:e] = roots(e - s, np.concatenate(a_all), np.concatenate(b_all)) + s
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(component), pa.array(sid[root]), pa.array(docs), pa.array(texts)], ["sid", "component", "root", "docs", "texts"])
        release()

    keys = ["component", "bi", "bj"]
    return members.repartition(*keys).sortWithinPartitions(*keys, "sid").mapInArrow(run, _LINKED)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_text_links."""
    return _classes(docs, id_col, text_col, threshold).drop("text_key")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """The columns of ``near_duplicates`` and text_key."""
    signed = save(sign(docs, id_col, text_col), "signed")
    with temporary(docs.sparkSession):
        known = save(_linked_sets(docs, signed, id_col, text_col, threshold), "linked-sets", keep=True)
    classes = known.groupBy("root").agg(F.min("min_doc").alias("class_id"))
    per_key = known.join(classes, "root").select(
        "set_key",
        "class_id",
        (F.col("n_docs") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        (F.col("n_texts") - 1 + F.coalesce("texts", F.lit(0))).alias("n_text_links"),
    )
    out = signed.select("doc_id", "text_key", "set_key").join(per_key, "set_key", "left")
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))


def _linked_sets(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(set_key, sid, n_docs, n_texts, min_doc, docs, texts, root) of every set."""
    texts = signed.where("set_key IS NOT NULL").groupBy("set_key", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc"), F.max("size").alias("size"), F.min("sig").alias("sig"))
    sets = texts.groupBy("set_key").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"), F.min("doc").alias("min_doc"), F.min(F.struct("doc", "text_key")).alias("pick"), F.max("size").alias("size"), F.min("sig").alias("sig"))
    sets = save(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")

    edges = candidate_edges(sets, threshold)
    nodes = save(components(edges), "components")
    placed = sets.join(nodes.withColumnRenamed("node", "sid"), "sid")
    n = F.count(F.lit(1))
    block = F.least(F.greatest(n / 8, F.lit(BLOCKS[0])), F.lit(BLOCKS[1]))
    many = F.greatest(F.ceil(n / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = save(placed.groupBy("component").agg(many.alias("blocks")), "component-sizes")
    wanted = placed.join(sizes, "component")
    wanted = wanted.select("component", "blocks", "sid", "n_docs", "n_texts", F.col("pick.doc").alias("__doc"), F.col("pick.text_key").alias("__key"))
    wanted = save(wanted, "wanted")

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    fetched = source.join(ids, F.col("doc").eqNullSafe(F.col("__doc"))).where(F.unhex(F.md5("text")) == F.col("__key"))
    fetched = save(shingled(fetched.select("component", "blocks", "sid", "n_docs", "n_texts", "text")), "shingles")
    dealt = fetched.withColumn("own", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = dealt.select("component", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "sid", "n_docs", "n_texts", "shingles")
    once = wanted.where("__doc IS NULL").isEmpty() and signed.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    if not once:  # rows that repeat an id and a text would take part several times
        tasks = tasks.dropDuplicates(["component", "bi", "bj", "sid"])
    found = save(verify(tasks, threshold), "links")

    big = sizes.where("blocks > 1").select("component")
    spread = found.join(big, "component", "left_semi")
    crossed = components(spread.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sid").withColumnRenamed("component", "whole")
    per_set = found.groupBy("sid").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"), F.min("root").alias("root"))
    per_set = per_set.join(crossed, "sid", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
    known = sets.select("set_key", "sid", "n_docs", "n_texts", "min_doc").join(per_set, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return known


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that name their class, all columns as they were.

    Rows without an id stay.  Where an id and its text are repeated, one of the rows stays.
    Where an id is repeated with other texts, each text stays or goes by its own class.
    """
    found = save(_classes(docs, id_col, text_col, threshold), "classes")
    once = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    names = [F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key")][: 1 if once else 2]
    gone = save(found.where(F.col("doc_id") != F.col("class_id")).select(*names).distinct(), "gone")
    few = gone.count() * len(names) ** 2 <= BROADCAST_GONE  # 16 MB of ids and keys at most; with more, texts and ids are shuffled
    same = F.col(id_col).cast("long") == F.col("__gone")
    if not once:
        same &= F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))) == F.col("__gone_key")
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    if once:
        return left
    named, unnamed = left.where(F.col(id_col).isNotNull()), left.where(F.col(id_col).isNull())
    marked = named.withColumn("__text_key", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return marked.dropDuplicates([id_col, "__text_key"]).drop("__text_key").unionByName(unnamed)
