"""Search, mixing, quality, sharding, token files and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import ann, hilbert, mixing, quality, queries, tokenfiles
from tests.conftest import DATA, rows
from tests.llm.cases import AWKWARD, documents


def test_search_recall_and_order(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    hits = total = 0
    found = defaultdict(list)
    for r in queries.op5_multi_index(spark, DATA).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
        assert r.score == pytest.approx(float(np.sqrt(((data[r.query_id] - data[r.vec_id]) ** 2).sum())), abs=1e-12)
    assert set(found) == {i for i in data if i % 100 == 0}
    for q, got in found.items():
        assert got == sorted(got) and len(got) == 10 and q not in [v for _, v in got]
        d = np.sqrt(((x - data[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len({v for _, v in got} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_of_the_index(spark, clustered):
    """On 20,000 vectors the walks read a small part of clustered data, and recall holds on both kinds."""
    rng = np.random.default_rng(8)
    n, dim = 20_000, 16
    x = rng.normal(size=(n, dim))
    if clustered:
        x = 8 * rng.normal(size=(200, dim))[rng.integers(0, 200, n)] + x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    index = ann.build(ann.prepared(df, F.lit(False), "vec_id", "embedding"), dim, n, 10)
    assert len(index.books[0]) == ann.codebook_size(n) == 32 and index.counts.sum() == n
    if clustered:
        assert index.least < 0.1 * n
    else:
        assert index.least < 0.7 * n
    found = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / (n / 100 * 10) >= 0.9


def test_other_lengths_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rows_ = [(i, [float(i), 1.0]) for i in range(1, 80)] + [(1000 + i, [float(i % 13), 2.0, 1.0]) for i in range(40)] + [(5000, [1.0] * 5)]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"), F.lit(True), k=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for i in range(40):
        near = sorted((abs(j % 13 - i % 13), 1000 + j) for j in range(40) if j != i)[:3]
        assert got[1000 + i] == [v for _, v in near]
    assert 5000 not in got and len(got) == 119


def test_search_of_awkward_vectors(spark):
    good = [(i, [float(i % 5), 1.0, 0.5]) for i in range(1, 60)]
    bad = [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (400, [1.0, float("nan"), 2.0]), (500, [float("inf"), 1.0, 1.0]), (600, [1.0, 2.0]), (700, []), (None, [1.0, 1.0, 1.0])]
    hot = [(1000 + i, [2.0, 1.0, 0.5]) for i in range(200)]
    df = spark.createDataFrame([*good, *bad, *hot, (1000, [2.0, 1.0, 0.5])], "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("grp", F.lit("x"))
    saved, ann.GROUP_ROWS = ann.GROUP_ROWS, 50  # the common vector fills several groups
    try:
        got = ann.search(df, F.col("vec_id") % 100 == 0, k=5).orderBy("query_id", "rank").collect()
    finally:
        ann.GROUP_ROWS = saved
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r.vec_id)
    assert set(by) == {1000, 1100}
    assert by[1000] == [2, 7, 12, 17, 22] and by[1100] == [2, 7, 12, 17, 22]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0
    few = ann.search(df.where("vec_id in (1, 2, 3)"), F.col("vec_id") == 1, k=10).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [2, 3]


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(6), rng.random(5), rng.integers(0, 4, (6, 5))
    got = ann.walk(a, b, counts, 10**9)
    sums = [a[c // 5] + b[c % 5] for c in got]
    assert sums == sorted(sums) and sorted(got) == sorted(np.flatnonzero(counts.ravel()).tolist())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 20_000), min_size=1, max_size=40))
def test_packing(counts):
    first, n = ann.pack(np.array(counts))
    load = Counter()
    for c, f, k in zip(counts, first, n, strict=True):
        for s in range(k):
            load[int(f + s)] += c / k
    assert max(load.values()) <= ann.GROUP_ROWS


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        goal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > cap * sizes[s]}
        if not over:
            return {**{s: cap * sizes[s] for s in capped}, **goal}
        capped |= over


def test_mix(spark):
    texts = [*AWKWARD, *[" ".join(["word"] * (i % 17)) for i in range(600)]]
    docs = documents(spark, texts)
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    size = {i: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t in enumerate(texts)}
    source = {r.doc_id: r.source for r in docs.collect()}
    sums, taken = Counter(), Counter()
    for r in got:
        sums[source[r.doc_id]] += size[r.doc_id]
        taken[source[r.doc_id]] += r.taken
        assert r["size"] == size[r.doc_id] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    want = plain_targets(dict(sums))
    for r in got:
        assert r.source_size == sums[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    for s in sums:
        assert abs(taken[s] - want[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    out = mixing.take(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: int(r.copies) for r in got if r.copies})
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0


def test_mix_splits_repeated_rows(spark):
    """Many equal rows at the cut: as many are taken as fit, not all or none."""
    rows_ = [(None, "a b c d", "s")] * 500 + [(7, "a b c d", "s")] * 40 + [(i, "x y", "t") for i in range(20, 40)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(7)
    goal = plain_targets({"s": 540 * 4, "t": 40})
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        assert r.copies <= 3
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal)
    assert Counter(r.text for r in mixing.take(docs).collect())["a b c d"] * 4 == taken["s"]


def test_mix_favours_longer_documents(spark):
    """Inclusion odds follow size: at the same share of words, longer documents are drawn more often."""
    rows_ = [(i, "w " * (10 if i % 2 else 40), "s") for i in range(4000)] + [(9000 + i, "w " * 500, "t") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows_, "doc_id long, text string, source string")).where("source = 's'")
    rate = {r["size"]: r.c for r in got.groupBy("size").agg(F.avg("copies").alias("c")).collect()}
    assert rate[40] % 1 > rate[10] % 1 and int(rate[40]) == int(rate[10])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(queries.ORACLES[name]).df())


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op7_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    r = [(x.score, x.quality) for x in got.where("held_out").join(labels, "doc_id").collect()]
    good, bad = [s for s, q in r if q == 1], [s for s, q in r if q == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.95
    assert np.mean([s >= quality.THRESHOLD for s in good]) > 0.95
    for x in got.limit(50).collect():
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1


def test_quality_of_few_labels(spark):
    """A dozen rows of two kinds are enough to tell further rows of these kinds apart."""
    good = "The river runs past the old mill, and people walk there in the evening. "
    texts = [good * (1 + i % 5) if i % 2 else "$$$ 000 !!! ### " * (5 + i % 7) for i in range(60)]
    docs = documents(spark, texts)
    taught = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:12]
    labels = spark.createDataFrame([(i, i % 2) for i in taught], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if i % 2 == 0)
    model = quality.fit(quality.document_statistics(docs), labels)
    assert {r.doc_id for r in quality.keep_good(model, docs).collect()} == set(range(1, 60, 2))
    two = spark.createDataFrame([(taught[0], 0), (taught[1], 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, two).collect())


def test_quality_against_plain_versions(spark):
    """Statistics, normal equations, isotonic fit and scores of the query, each written out for single texts."""
    import re

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}

    def stats(t):
        b = (t or "").encode()
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b.lower())
        n, size, per = len(w), len(b), max(len(w), 1)
        mean = sum(map(len, w)) / per
        counts = [sum(b.count(bytes([c])) for c in k.encode()) for k in quality.CLASSES]
        classes = [*counts, size - sum(counts)]
        lines = b.split(b"\n")
        ends = counts[quality.CLASSES.index(".,;:?")] + counts[quality.CLASSES.index("!")]
        head = [np.log1p(size), np.log1p(n), mean, np.sqrt(max(sum(len(x) ** 2 for x in w) / per - mean**2, 0)), np.log1p(len(set(w))) - np.log1p(n), max(Counter(w).values(), default=0) / per, sum(x == y for x, y in zip(w, w[1:])) / per, np.log1p(n / (1 + ends)), 1 - len(set(lines)) / len(lines)]
        return np.array([*head, *np.sqrt(np.array(classes) / max(size, 1))])

    x = {r.doc_id: stats(r.text) for r in docs}
    own = {r.doc_id: np.array(r.stats) for r in quality.document_statistics(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert all(np.allclose(own[i], x[i], atol=1e-9) for i in x)
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    train = [i for i in x if labels.get(i) in (0, 1) and crc(i)]
    a, y, fold = np.stack([x[i] for i in train]), np.array([float(labels[i]) for i in train]), np.array([crc(i) - 1 for i in train])
    model = quality.fit(quality.document_statistics(spark.read.parquet(f"{DATA}/documents.parquet")), spark.read.parquet(f"{DATA}/labels.parquet"))
    scale = a.std(axis=0)
    scale[scale < 1e-9] = 1.0
    assert np.allclose(model.mean, a.mean(axis=0)) and np.allclose(model.scale, scale, atol=1e-7)

    def solved(use):
        f = model.features(a[use])
        g = sum(np.outer(r, r) for r in f)
        return np.linalg.solve(g + 1e-3 * max(g[-1, -1], 1.0) / quality.FEATURES * np.eye(len(g)), sum(r * v for r, v in zip(f, y[use])))

    assert np.allclose(model.weights, solved(np.ones(len(a), bool)), atol=1e-4)
    raw = np.zeros(len(a))
    for k in range(quality.FOLDS):
        raw[fold == k] = model.features(a[fold == k]) @ solved(fold != k)
    bins = sorted({round(v * 1000) for v in raw})
    near = [np.interp(b / 1000, model.knots, model.values) for b in bins]
    assert all(p <= q + 1e-12 for p, q in zip(near, near[1:])) and abs(np.mean([np.interp(v, model.knots, model.values) for v in raw]) - y.mean()) < 0.05
    got = {r.doc_id: r.score for r in queries.op7_quality(spark, DATA).collect()}
    for i in x:
        want = np.interp(model.features(x[i][None])[0] @ model.weights, model.knots, model.values)
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_quality_fit_on_labelled_texts_alone(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.fit(quality.document_statistics(docs), labels), quality.fit_documents(docs, labels)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.values, b.values, atol=1e-9)


def test_quality_edges(spark):
    docs = documents(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    only = spark.createDataFrame([(i, 1) for i in range(13)] + [(3, None), (4, 7)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, only).collect()} == {1.0}
    assert quality.classify(docs.where("false"), only).count() == 0
    x, v = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.2, 0.1, 0.9, 0.8]), np.ones(4))
    assert v.tolist() == pytest.approx([0.15, 0.85]) and x.tolist() == [1.5, 3.5]


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3)])
def test_hilbert_neighbours(spark, n, bits):
    cells = spark.range((1 << bits) ** n).select(*[(F.floor(F.col("id") / (1 << bits) ** k) % (1 << bits)).cast("int").alias(f"x{k}") for k in range(n)])
    got = sorted(tuple(r) for r in cells.select(hilbert.hilbert_index([F.col(c) for c in cells.columns], bits), *cells.columns).collect())
    assert [g[0] for g in got] == list(range(len(got)))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:], strict=True)) == 1 for a, b in zip(got, got[1:], strict=False))


def check_shards(got, texts):
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(hilbert.SHARDS)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(b) + 8, zlib.crc32(b))


def test_shards(spark):
    texts = [*AWKWARD, *["hot text"] * 300, *[f"text {i} " * (i % 40) for i in range(200)]]
    check_shards(hilbert.shard(hilbert.metadata(documents(spark, texts))).collect(), texts)
    check_shards(hilbert.shard(hilbert.metadata(documents(spark, texts[:5]))).collect(), texts[:5])
    assert hilbert.shard(hilbert.metadata(documents(spark, texts).where("false"))).count() == 0
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    check_shards(queries.op9_hilbert_shards(spark, DATA).collect(), whole)


def plain_hilbert(x, bits):
    """Skilling's transform, one cell at a time."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def plain_shards(docs):
    """{doc_id: (curve, shard, slot)} by one sort of all rows."""
    import math

    import xxhash

    steps = {}
    for c in ("lang", "source"):
        values = sorted({r[c] for r in docs}, key=lambda v: (v is None, v or ""))
        steps[c] = {v: i * 32 // len(values) for i, v in enumerate(values)}

    def key(r):
        b = (r.text or "").encode()
        size, crc = len(b) + 8, zlib.crc32(b)
        h = xxhash.xxh64_intdigest(size.to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest(crc.to_bytes(8, "little"), h)
        h = h - (1 << 64) if h >> 63 else h
        cell = (steps["lang"][r.lang], steps["source"][r.source], min(math.floor(math.log2(size) * 1.25), 31))
        return plain_hilbert(cell, 5), h % 16, crc, size, r.doc_id

    order = sorted(map(key, docs))
    short, long_ = divmod(len(order), 24)
    out, at = {}, 0
    for s in range(24):
        for slot in range(short + (s < long_)):
            out[order[at][4]] = (order[at][0], s, slot)
            at += 1
    return out


def test_shards_against_one_sort(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: (r.curve, r.shard, r.slot) for r in queries.op9_hilbert_shards(spark, DATA).collect()}
    assert got == plain_shards(docs)


def test_shards_of_texts_and_ids_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE_ROWS", 8)
    rows_ = [(i, "hot text") for i in range(200)] + [(None, "hot text")] * 150 + [(5000, "hot text")] * 90 + [(1000 + i, f"text {i}") for i in range(130)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows_], "doc_id long, text string, lang string, source string")
    got = hilbert.shard(hilbert.metadata(docs)).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows_) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
    crc = zlib.crc32(b"hot text")
    line = [r.text_crc32 == crc for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(line, line[1:])) <= 2  # equal texts stand together


def test_shards_can_be_pruned(spark):
    """A reader of one source and language opens a small part of the files."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    where = defaultdict(set)
    for r in queries.op9_hilbert_shards(spark, DATA).collect():
        where[docs[r.doc_id].lang, docs[r.doc_id].source].add(r.shard)
    assert np.mean([len(v) for v in where.values()]) <= 6


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_packed_ranks(values):
    r = np.array(values, np.uint32)
    control, data = tokenfiles.pack(r)
    assert tokenfiles.unpack(control, data, len(r)).tolist() == values


def test_token_files(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 50)
    monkeypatch.setattr(tokenfiles, "PART_IDS", 400)
    texts = [*AWKWARD, "it's DON'T <|endoftext|>x, <|ENDOFTEXT|> É, Straße İz! ſa", "a\x1fb c\xa0d 12,5%", "𝔘nicode! ①②, ½."] + [f"Word{i} words, more!" for i in range(120)]
    folder = tokenfiles.encode_files(documents(spark, texts, 10), path)
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    start = 0
    got = {r.doc_id: r for r in tokenfiles.summary(spark, folder).collect()}
    for i, x in enumerate(ids):
        r = got[10 + i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    full = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfiles.decode_files(spark, folder).collect()}
    assert [full[10 + i] for i in range(len(ids))] == ids
    freq = Counter(t for x in ids for t in x)
    order = [r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    assert order == sorted(freq, key=lambda t: (-freq[t], t))
    assert tokenfiles.summary(spark, tokenfiles.encode_files(documents(spark, texts).where("false"), path)).count() == 0


def test_token_query_over_documents(spark):
    """The registered query against the library on every whole text of the table."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in queries.op10_token_files(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = [*plain.encode(d.text or "", add_special_tokens=False).ids, 1]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcABé ÀÞªµßñ÷×ÿ.,;:!?#$%&*'<|>\t\n\r\x0b\x1f\x85\xa0İſ12½①Σς\u0338\u0301=日本—s", max_size=60))
def test_pieces_give_the_ids_of_the_text(text):
    P = pytest.importorskip("public_tokenizers")
    e = tokenfiles.encoder(P.path("word_bpe_49k.json"))
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.by_piece and np.frombuffer(e.encode(text), e.dtype).tolist() == want


def test_other_vocabularies_take_whole_texts(spark, tmp_path):
    """A tokenizer that keeps case or blanks is not asked piece by piece."""
    P = pytest.importorskip("public_tokenizers")
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(P.path("word_bpe_49k.json")))
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    plain = Tokenizer.from_file(str(tmp_path / "cased.json"))
    texts = ["Some Words, with  Case\n", None, "", "x"]
    got = {r.doc_id: r for r in tokenfiles.summary(spark, tokenfiles.encode_files(documents(spark, texts), str(tmp_path / "cased.json"))).collect()}
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_repeated_and_null_ids_in_token_files(spark):
    P = pytest.importorskip("public_tokenizers")
    rows_ = [(None, f"word {i % 7}") for i in range(60)] + [(5, "same text")] * 40 + [(6, "last one")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = tokenfiles.summary(spark, tokenfiles.encode_files(docs, P.path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 60 + [5] * 40 + [6]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_pipeline(spark):
    """Each stage against a plain version on what the stage before it kept."""
    cp = pytest.importorskip("corpus_pipeline")
    from tallyforge.llm import decontaminate
    from tallyforge.llm.shared import save
    from tests.llm.test_near import brute

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    steps = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in cp.STAGES:
        steps.append(save(stage(spark, steps[-1], DATA), name))
    assert all(s.columns == names for s in steps[:-1])
    kept = [sorted(s.collect(), key=lambda r: r.doc_id) for s in steps]
    scores = {r.doc_id: r.predicted for r in queries.op7_quality(spark, DATA).collect()}
    assert [r.doc_id for r in kept[1]] == [r.doc_id for r in kept[0] if scores[r.doc_id]]
    want = brute([r.doc_id for r in kept[1]], [r.text for r in kept[1]])
    assert [r.doc_id for r in kept[2]] == [r.doc_id for r, w in zip(kept[1], want, strict=True) if w[0] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    vocabulary = {tuple(w) for _, t in items for w in decontaminate.windows(decontaminate.text_words(t), 10)}
    clean = [r for r in kept[2] if not any(tuple(w) in vocabulary for w in decontaminate.windows(decontaminate.text_words(r.text), 10) if len(w) == 10)]
    assert [r.doc_id for r in kept[3]] == [r.doc_id for r in clean]
    copies = {r.doc_id: r.copies for r in mixing.mix(steps[3]).collect()}
    assert Counter(r.doc_id for r in kept[4]) == Counter({i: int(k) for i, k in copies.items() if k})
    sizes = Counter(r.shard for r in kept[5])
    assert len(kept[5]) == len(kept[4]) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    run = cp.run(spark, DATA)
    assert sorted(map(tuple, run.collect()), key=str) == sorted(map(tuple, steps[-1].collect()), key=str)


def test_pipeline_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    """After a run only the table of the last stage is in the shared folder, and it can be read."""
    cp = pytest.importorskip("corpus_pipeline")
    from tallyforge.llm import shared

    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    out = cp.run(spark, DATA)
    assert sorted(x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()) == ["hilbert_shards"]
    assert out.count() > 0


def test_shared_folder():
    """The session's own setting; else a temporary folder on one machine, and none on several."""
    from types import SimpleNamespace

    from tallyforge.llm import shared

    def session(setting, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: setting), sparkContext=SimpleNamespace(master=master, applicationId="test"))

    assert shared.shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    assert shared.shared_dir(session(None, "local[4]")) == shared.shared_dir(session(None, "local[4]"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(session(None, "local-cluster[3,2,1024]"))


def test_blocks_belong_to_their_thread(spark):
    """Tables of one thread outlive the block of another."""
    from concurrent.futures import ThreadPoolExecutor

    from tallyforge.llm import shared

    with ThreadPoolExecutor(1) as other:
        with shared.temporary(spark):
            mine = shared.save(spark.range(3).toDF("x"), "mine")
            theirs = other.submit(lambda: shared.save(spark.range(4).toDF("x"), "theirs")).result()
            assert mine.count() == 3
        assert theirs.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist"):
        mine.count()


@pytest.mark.parametrize("texts", [[], AWKWARD])
def test_pipeline_on_awkward_documents(spark, tmp_path, texts):
    """No rows; null, empty, repeated and very long texts, null ids and clashing columns: every stage keeps what it has no reason to drop."""
    cp = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, texts or ["x"]).where(F.lit(bool(texts)))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            docs = out
    rows_out = out.collect()
    assert (len(rows_out) > 0) == bool(texts)
    slots = defaultdict(list)
    for r in rows_out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
