"""Chosen-path join and components against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import chosenpath as cp
from tallyforge.llm import queries
from tallyforge.llm.components import components
from tests.conftest import DATA
from tests.llm.cases import AWKWARD, documents, word_list


def sets_of(texts):
    out = []
    for t in texts:
        w = word_list(t)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, texts, threshold=0.8):
    """{position: (class, links, links to other texts)}"""
    sets, n = sets_of(texts), len(texts)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append(ids[i])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(smallest[label[i]] if sets[i] else ids[i], len(near[i]), len({texts[j] for j in near[i]} - {texts[i]})) for i in range(n)]


def made(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([2, 6, 40, 120]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(" ".join(copy) + r.choice(["", ".", "!"]))
    return texts


@pytest.mark.parametrize("leaf, block, depth", [(cp.LEAF, cp.BLOCKS, cp.DEPTH), (4, (2, 3), 3)])
def test_against_brute_force(spark, monkeypatch, leaf, block, depth):
    """Small leaf, block and depth send ordinary groups through the paths meant for huge ones."""
    monkeypatch.setattr(cp, "LEAF", leaf)
    monkeypatch.setattr(cp, "BLOCKS", block)
    monkeypatch.setattr(cp, "DEPTH", depth)
    texts = [*AWKWARD, *made(4)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in cp.near_duplicates(documents(spark, texts, 100)).collect()}
    want = brute([100 + i for i in range(len(texts))], texts)
    assert [got[100 + i] for i in range(len(texts))] == want


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    near = text + " more"
    rows = [(7, text), (7, text), (5, near), (None, text), (None, "another text of its own entirely here"), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in cp.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 5, 3), (7, 5, 3), (5, 5, 3), (None, 5, 3), (None, None, 0), (9, 9, 0), (9, 9, 0)], key=str)
    kept = cp.keep_one(docs)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, near), (None, text), (None, "another text of its own entirely here"), (9, None)], key=str)
    assert cp.near_duplicates(docs.where("false")).count() == 0
    assert cp.keep_one(documents(spark, AWKWARD)).columns == documents(spark, AWKWARD).columns


def test_repeated_id_loses_only_its_near_duplicate(spark):
    text = " ".join(f"w{i}" for i in range(30))
    clean = "nobody else holds this text of another kind"
    docs = spark.createDataFrame([(5, text), (7, text + " more"), (7, clean), (7, clean), (7, None), (8, text)], "doc_id long, text string")
    kept = cp.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, text), (7, clean), (7, None)], key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.doc_id for r in docs], [r.text for r in docs])
    got = {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in queries.op3_chosen_path(spark, DATA).collect()}
    assert [got[r.doc_id] for r in docs] == want


def test_paths_keep_pairs_at_the_threshold():
    """Simulated recall of the runs that are asked for, for pairs exactly at the threshold."""
    assert 3 <= cp.runs_needed() <= 12
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        agree = rng.random(cp.DIMS) < 0.8
        found = False
        for k in range(2 * cp.runs_needed()):
            alive = [k] if agree[k] else []
            for _ in range(cp.DEPTH - 1):
                alive = [d for _ in alive for d in rng.choice(cp.DIMS, 2 if rng.random() < 0.25 else 1, replace=False) if agree[d]]
            found |= bool(alive)
        met += found
    assert met / 400 > 0.95


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=20))
def test_roots(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    label = list(range(n))
    for _ in range(n):
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
    assert cp.roots(n, a, b).tolist() == label


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(500, 500 + i) for i in range(1, 30)]
    r = random.Random(2)
    r.shuffle(chain)
    got = dict(components(spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in chain], "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{500 + i: 500 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
