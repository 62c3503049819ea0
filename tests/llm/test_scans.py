"""Secret, personal-data, licence and benchmark scans against plain versions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import decontaminate, licences, pii, queries, secrets
from tallyforge.llm.phrases import PhraseIndex
from tallyforge.llm.words import buffers, hash_word, text_words, words
from tests.conftest import DATA, rows
from tests.llm.cases import AWKWARD, documents, word_list

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain_secrets(t):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def plain_pii(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="tokenTOKEN=:'\" passwdAPI_keyKIA0123456789abcdefABZé-", max_size=90))
def test_secret_base_spans(t):
    assert [s for s in secrets.find(t) if s[2] in secrets.BASE] == plain_secrets(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-() 0123456789é%_", max_size=90))
def test_pii_base_spans(t):
    assert pii.base_spans(t) == plain_pii(t)


def test_secrets_of_a_very_long_text():
    t = ("deadbeef" * 100_000) + " token=abcdef12 " + "0123456789abcdef " * 50_000 + "AKIA" + "Z" * 20
    assert [s for s in secrets.find(t) if s[2] in secrets.BASE] == plain_secrets(t) and len(plain_secrets(t)) == 3


def test_secret_shapes():
    body = "A" * 30
    good = f"ghp_{body}{secrets.base62_crc(body)}"
    assert ("github" in {s[2] for s in secrets.find(f"x {good} y")}) and "github" not in {s[2] for s in secrets.find(f"x ghp_{'A' * 36} y")}
    assert "npm" in {s[2] for s in secrets.find(f"npm_{body}{secrets.base62_crc(body)}")}
    hexes = "deadbeef" * 4
    assert secrets.find(f"A{hexes}G")[0] == (1, 33, "hex")


def test_skip_edges_carry_a_kind_to_a_repeated_mention():
    text = "call +1 (017) 555-7713 today and later dial 555-7713 or write to x.y@example.com ; 23904 items"
    found = pii.find_all([text, None, ""])
    assert found[1] == found[2] == []
    assert {s[:3] for s in found[0] if s[3]} == set(plain_pii(text))
    added = [(text[s[0] : s[1]], s[2]) for s in found[0] if not s[3]]
    assert added == [("555-7713", "phone")]


@pytest.mark.parametrize("first", [True, False])
def test_one_base_span_reaches_every_mention(first):
    full, later = "call +1 (017) 555-7713 today ", "and later dial 555-7713 or not " * 49
    text = full + later if first else later + full
    found = pii.find_all([text])[0]
    assert [text[s[0] : s[1]] for s in found if s[3]] == ["+1 (017) 555-7713"]
    assert [(text[s[0] : s[1]], s[2]) for s in found if not s[3]] == [("555-7713", "phone")] * 49


def test_beliefs_settle_on_exact_marginals(monkeypatch):
    """On mentions in a row the beliefs are those of adding up all labellings."""
    import itertools

    text = "and 23904 23904 " * 2 + "call 555-7713 or 555-7713 at 555-7713"
    g = pii.Graph()
    g.add(0, text, [(text.index("555-7713"), text.index("555-7713") + 8, "phone")])
    node, chain, skip, sure = pii.model()
    total = np.zeros((len(g.fixed), len(pii.LABELS)))
    feats = np.split(np.array(g.feats), np.cumsum(g.n_feats)[:-1])
    ties = [tuple(x) for x in (*pii.pairs_of(g.skip), *pii.pairs_of(g.sure))]
    given = {(a, b) if g.fixed[a] >= 0 else (b, a) for a, b in ties if max(g.fixed[a], g.fixed[b]) >= 0}
    for y in itertools.product(range(len(pii.LABELS)), repeat=len(g.fixed)):
        if all(f in (-1, v) for f, v in zip(g.fixed, y)):
            weight = sum(node[f, v].sum() + q * chain[0, v] for f, v, c, q in zip(feats, y, g.fixed, g.plain) if c < 0)
            weight += sum(chain[y[a], y[b]] for a, b in pii.pairs_of(g.chain)) + sum(skip[y[a], y[b]] for a, b in ties if max(g.fixed[a], g.fixed[b]) < 0) + sum(sure[y[a], y[b]] for a, b in given)
            total[np.arange(len(y)), y] += np.exp(weight)
    monkeypatch.setattr(pii, "STILL", 1e-9)
    assert np.allclose(pii.beliefs(g, pii.model()), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_model_on_unseen_sentences():
    """Inference with the clamps of the base patterns, against the truth of sentences it was not trained on."""
    import random

    r, g, truth = random.Random(99), pii.Graph(), []
    for row in range(300):
        text, spans = pii._sentence(r)
        g.add(row, text, pii.base_spans(text))
        truth += [next((pii.LABELS.index(k) for a, b, k in spans if a < e and b > s), 0) for s, e in pii.tokens(text)]
    p = pii.beliefs(g, pii.model())
    added = (p.max(axis=1) >= pii.SURE) & (p.argmax(axis=1) > 0) & (np.array(g.fixed) < 0)
    assert (p.argmax(axis=1) == truth).mean() > 0.9
    assert added.sum() > 10 and (p.argmax(axis=1) == truth)[added].mean() > 0.95


# Sentences written by hand: (text, what is personal data in it beyond the base patterns, with its kind).
WRITTEN = [
    ("Our desk: +44 (020) 7946-0958. Ring 7946-0958 after nine.", [("7946-0958", "phone")]),
    ("Reach Ana at +49 (030) 901-8200, and if nobody answers try 901-8200 again.", [("901-8200", "phone")]),
    ("Hotline +1 (555) 010-4477 is busy; 010-4477 also takes faxes, and 010-4477 is open all night.", [("010-4477", "phone")] * 2),
    ("In 1998 the mill made 1200 tons, in 2001 it made 1350 tons.", []),
    ("Version 2.4.1 fixed issue 88213 and issue 90011 on 2021-03-04.", []),
    ("Rooms 14, 15 and 16 are closed; use rooms 17 to 21.", []),
    ("Order 7741-20 shipped; order 7741-21 waits. Total $450.", []),
    ("The train of 10:45 leaves from track 9, the one of 11:15 from track 3.", []),
    ("See page 204, figure 12.5 and table 3 of the 1986 edition.", []),
    ("Temperatures of 21.5 to 23.0 degrees and 65% humidity were logged 1440 times.", []),
    ("Follow @mill_town and @river for 3 new pictures a day.", []),
    ("The account 4556737586899855 was charged twice; card 4556737586899855 is blocked.", []),
    ("Isbn 978-3-16-148410-0 was lent 12 times in 2019 and 9 times in 2020.", []),
]


def test_model_on_sentences_written_by_hand():
    for text, want in WRITTEN:
        found = [(text[s:e], kind) for s, e, kind, base in pii.find_all([text])[0] if not base]
        assert found == want, (text, found)


def test_number_in_groups_is_tied_to_its_full_form():
    text = "call +1 (017) 555-7713 today or 017 555 7713 after six, not room 12"
    added = [text[s:e] for s, e, kind, base in pii.find_all([text])[0] if not base and kind == "phone"]
    assert any("555 7713" in x for x in added) and not any("12" in x for x in added)


def test_very_long_texts():
    """Parts of thousands of zeros, tokens of any length, many spans in one token, a million characters of numbers."""
    zeros = "0" * 12_000 + "1.1.1.1"
    assert pii.base_spans(zeros) == [(0, len(zeros), "ip")]
    token = "x" * 300 + "5557713"
    g = pii.Graph()
    g.add(0, f"+1 (017) 555-7713 and {token}", [(0, 17, "phone")])
    assert (2, 3) in [tuple(p) for p in pii.pairs_of(g.skip)]
    many = ",".join(f"a{i}@b.co" for i in range(40))
    spans = pii.base_spans(many)
    assert len(spans) == 40 and all(s[3] for s in pii.find_all([many])[0])
    text = " ".join(str(100_000 + i * 7919 % 900_000) for i in range(60_000))
    assert len(pii.tokens(text)) == 60_000
    assert [s[:3] for s in pii.find_all([text[:200_000]])[0] if s[3]] == plain_pii(text[:200_000])


def test_scans_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    rows = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    people = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(AWKWARD):
        assert [(s.start, s.end, s.kind) for s in rows[i].spans if s.kind in secrets.BASE] == plain_secrets(t or "")
        assert [(s.start, s.end, s.kind) for s in people[i].spans if s.base] == plain_pii(t or "")
    empty = docs.where("false")
    assert secrets.scan_secrets(empty).count() == pii.find_pii(empty).count() == 0


def test_digest_queries(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for q, plain, kinds in ((queries.op1_secrets, plain_secrets, secrets.BASE), (queries.op2_pii, plain_pii, pii.KINDS)):
        for r in q(spark, DATA).collect():
            spans = plain(texts[r.doc_id])
            joined = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in spans) for k in kinds]
            assert set(joined.split(",")) <= set(r.spans.split(","))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_word_kernel(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    buf, offs = buffers(pa.array(texts, pa.string()))
    s, e, h = words(buf, offs)
    got = [bytes(buf[a:b]).lower().decode() for a, b in zip(s, e)]
    assert got == [w for t in texts for w in word_list(t)]
    assert h.tolist() == [hash_word(w) for w in got]
    assert [text_words(t) for t in texts] == [word_list(t) for t in texts]


def test_word_kernel_over_segments(monkeypatch):
    from tallyforge.llm import words as kernel

    monkeypatch.setattr(kernel, "SEGMENT", 64)
    texts = ["abc " * 50, "x" * 300, "", "é" * 90 + " end", "short"]
    buf, offs = buffers(pa.array(texts))
    s, e, _ = words(buf, offs)
    assert [bytes(buf[a:b]).decode() for a, b in zip(s, e)] == [w for t in texts for w in word_list(t)]


def plain_windows(text, items, size=10):
    w, hit, ids = word_list(text), set(), set()
    for item, t in items:
        v = word_list(t)
        for k in range(max(1, len(v) - size + 1) if v else 0):
            x = v[k : k + size]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 5])
def test_decontamination(spark, max_words):
    items = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "same TEXT"), (3, None), (4, "..."), (5, "one"), (10, "quick brown fox jumps over the lazy dog again and"), (2, "same text")]
    texts = [*AWKWARD, "Prefix: the QUICK brown-fox jumps; over the lazy dog\nagain and more", "the quick brown fox jumps over the lazy dog"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan_items(documents(spark, texts), bench, max_words=max_words)
    for r in found.collect():
        n, hit, ids = plain_windows(texts[r.doc_id], [x for x in items if x[1]])
        assert (r.n_words, sum(x.end - x.first for x in r.runs), list(r["items"])) == (n, hit, ids)
        for x in r.runs:
            assert word_list(texts[r.doc_id][x.start_char : x.end_char]) == word_list(texts[r.doc_id])[x.first : x.end]
    clean = decontaminate.keep_clean(documents(spark, texts), bench, max_words=max_words)
    assert clean.columns == documents(spark, texts).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not plain_windows(t, [x for x in items if x[1]])[1]}
    nothing = decontaminate.scan_items(documents(spark, texts), bench.where("false"))
    assert nothing.where("size(runs) > 0").isEmpty() and nothing.count() == len(texts)


def test_many_item_words_in_one_automaton():
    """A million item words: one index, found by its own windows at every offset and by nothing else."""
    rng = np.random.default_rng(2)
    words_ = [f"w{x}" for x in rng.integers(0, 50_000, 1_000_000)]
    pieces = [(str(i), " ".join(words_[at : at + 5000])) for i, at in enumerate(range(0, len(words_), 5000))]
    scanner = decontaminate.Scanner(pieces, 10, 1)
    at = [7, 5003, 123_457, 999_980]
    texts = [f"other text {' '.join(words_[a : a + 10])}, and more" for a in at] + [" ".join(words_[a : a + 9]) + " w0 end" for a in at[:2]]
    found = scanner.scan(pa.array(texts))
    assert [x[2] for x in found] == [["0"], ["1"], ["24"], ["199"], [], []]
    assert all([r[:2] for r in x[1]] == [(2, 12)] for x in found[:4])


def test_long_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    body = [f"v{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(body))], "item_id long, text string")
    texts = [" ".join(body[i : i + 10]) for i in range(51)] + ["x " * 400_000 + " ".join(body) + " y" * 400_000]
    found = {r.doc_id: r for r in decontaminate.scan_items(documents(spark, texts), bench).collect()}
    assert all(sum(x.end - x.first for x in found[i].runs) == 10 for i in range(51))
    assert [(x.first, x.end, x.start_char) for x in found[51].runs] == [(400_000, 400_060, 800_000)] and found[51].n_words == 800_060


def test_equal_hashes_are_no_match(monkeypatch):
    """Words that only share their hash with an item's words are told apart by the words."""
    kernel = decontaminate.words
    monkeypatch.setattr(decontaminate, "hash_word", lambda w: 1)
    monkeypatch.setattr(decontaminate, "words", lambda b, o: (*kernel(b, o)[:2], np.ones(len(kernel(b, o)[0]), np.uint64)))
    scanner = decontaminate.Scanner([("1", "alpha beta"), ("2", "beta alpha")], 10, 2)
    assert [x[2] for x in scanner.scan(pa.array(["gamma delta", "alpha beta", "alpha beta alpha", "beta"]))] == [[], ["1"], ["1", "2"], []]


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 3])
def test_decontamination_by_items_without_id(spark, duck, tmp_path, monkeypatch, max_words):
    """The query, with every item list in one and in several groups, against its SQL."""
    items = [(None, "The quick brown fox jumps over the lazy dog again and again"), (None, "same TEXT"), (3, "same text"), (4, "one"), (None, None), (None, "...")]
    texts = [*AWKWARD, "the quick brown fox jumps over the lazy dog again", "same quick text"]
    documents(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    views = [f"{t} AS (SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet'))" for t in ("documents", "benchmark")]
    want = rows(duck.execute(f"WITH {', '.join(views)}, {queries.ORACLES['op4_decontaminate'].strip()[5:]}").df())
    scan = decontaminate.scan_items
    monkeypatch.setattr(decontaminate, "scan_items", lambda *a, **k: scan(*a, **{"max_words": max_words, **k}))
    got = rows(queries.op4_decontaminate(spark, str(tmp_path)).toPandas())
    assert got == want
    kept = decontaminate.keep_clean(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark")))
    clean = {r[want[0].index("doc_id")] for r in want[1] if not r[want[0].index("contaminated")]}
    assert {r.doc_id for r in kept.collect()} == clean and 0 < len(clean) < len(texts) - 4


def test_decontamination_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    by_first = {}
    for item, t in items:
        v = word_list(t)
        for k in range(max(1, len(v) - 9)):
            by_first.setdefault(tuple(v[k : k + 10]), set()).add(str(item))
    for r in queries.op4_decontaminate(spark, DATA).collect():
        w, hit, ids = word_list(texts[r.doc_id]), set(), set()
        for i in range(len(w) - 9):
            if found := by_first.get(tuple(w[i : i + 10])):
                hit.update(range(i, i + 10))
                ids |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize(
    "text, postfix, names, free",
    [
        ("MIT", ["mit"], {"mit"}, True),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"], {"gpl", "mit"}, True),
        ("MIT AND (GPL-3.0 OR Apache-2.0)", ["mit", "gpl-3.0", "apache-2.0", "or", "and"], {"mit", "gpl", "apache"}, True),
        ("MIT AND GPL-3.0 -- see file", ["mit", "gpl-3.0", "and"], {"mit", "gpl"}, False),
        ("(LGPL-2.1)", ["lgpl-2.1"], {"lgpl"}, False),
        ("MIT/Apache-2.0", ["mit", "apache-2.0", "or"], {"mit", "apache"}, True),
        ("MIT, Apache-2.0, see the file", ["mit", "apache-2.0", "and"], {"mit", "apache"}, True),
        ("GPL-2.0 WITH Linux-syscall-note (see COPYING)", ["gpl-2.0", "linux-syscall-note", "with"], {"gpl"}, False),
        ("MIT. Use it", ["mit"], {"mit"}, True),
    ],
)
def test_expressions(text, postfix, names, free):
    if text.endswith("file"):
        text = text.split(" --")[0]
    assert licences.to_postfix(text) == postfix
    assert licences.evaluate(licences.to_postfix(text)) == (names, free)


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "()", "for every file", "NONE", "/MIT", "fair enough", "json is used here", "python code follows", "See LICENSE file", "SEE LICENSE IN x", "others", "NOASSERTION"])
def test_malformed_expressions(text):
    with pytest.raises(licences.ExpressionError):
        licences.to_postfix(text)


@pytest.mark.parametrize(
    ("text", "labels", "free"),
    [
        ("MIT OR Beerware", {"mit", "beerware"}, True),
        ("MIT AND Elastic-2.0", {"mit", "elastic-2.0"}, False),
        ("BUSL-1.1", {"busl-1.1"}, False),
        ("MIT)", {"mit"}, True),
        ("(MIT OR GPL-2.0-only)) and more", {"mit", "gpl"}, True),
        ("MIT or later versions", {"mit"}, True),
        ("MIT and others", {"mit"}, False),
        ("MIT AND every", {"mit"}, False),
        ("some OR MIT", {"mit"}, True),
        ("MIT-foo-bar", {"mit-foo-bar"}, False),
        ("MIT terms apply", {"mit"}, True),
        ("BSD-3-Clause */", {"bsd"}, True),
        ("Apache-2.0 WITH LLVM-exception -->", {"apache"}, True),
        ("mit", {"mit"}, True),
        ("curl", {"curl"}, False),
        ("MIT/X11, Zlib", {"mit", "x11", "zlib"}, True),
        ("GPL-2.0+ or the like", {"gpl"}, False),
        ("CC-BY-NC-SA-4.0", {"cc-by-nc-sa"}, False),
    ],
)
def test_identifiers_and_prose(text, labels, free):
    """Any identifier is read, an unknown one keeps the others, and prose is none."""
    assert licences.evaluate(licences.to_postfix(text)) == (labels, free)
    row = licences.scan(pa.array([f"(SPDX-License-Identifier: {text}\nrest"]))[0]
    assert (row[3], row[5]) == (labels, free) and row[4] >= licences.TAG_WEIGHT - 1e-9


_NAMES = {"MIT": ("mit", True), "Apache-2.0": ("apache", True), "GPL-3.0-or-later": ("gpl", False), "Beerware": ("beerware", False), "LicenseRef-x.y": ("licenseref-x.y", False), "zlib": ("zlib", True), "something": (None, False)}
expressions = st.recursive(
    st.sampled_from(sorted(_NAMES)).map(lambda n: (n, {_NAMES[n][0]} - {None}, _NAMES[n][1])),
    lambda inner: st.tuples(st.sampled_from([" AND ", " or ", " With "]), inner, inner).map(
        lambda x: (f"{x[1][0]} WITH Some-exception", x[1][1], x[1][2]) if "With" in x[0] and x[1][0] in _NAMES else (f"({x[1][0]}){x[0].replace('With', 'OR')}( {x[2][0]} )", x[1][1] | x[2][1], (x[1][2] and x[2][2]) if "AND" in x[0] else (x[1][2] or x[2][2]))
    ),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(expressions, st.sampled_from(["", " ", ")", ") is the licence", " */", "\nAND ISC"]))
def test_random_expressions(expression, tail):
    """Labels and permission are those of the tree that an expression was written from."""
    text, labels, free = expression
    row = licences.scan(pa.array([f"// SPDX-License-Identifier: {text}{tail}"]))[0]
    assert (row[3], row[5]) == ((labels, free) if labels else (set(), None))
    assert row[4] == pytest.approx(licences.TAG_WEIGHT if labels else 0)


def plain_base(text):
    w, places, labels = word_list(text), [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), sorted(places), sorted(labels)


def test_licences(spark):
    texts = [*AWKWARD, "SPDX-License-Identifier: MIT OR GPL-3.0\nrest", "SPDX-License-Identifier: (\nrest", "Released under the MIT License. GNU Lesser General Public License; MIT\nLicense!", "mit apache license general public licenses"]
    for r in licences.scan_licences(documents(spark, texts)).collect():
        n, places, labels = plain_base(texts[r.doc_id])
        assert (r.n_words, list(r.places), list(r.base_labels)) == (n, places, labels)
        assert set(labels) <= set(r.labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    got = {r.doc_id: r for r in licences.scan_licences(documents(spark, texts)).collect()}
    assert list(got[len(AWKWARD)].labels) == ["gpl", "mit"] and got[len(AWKWARD)].permissive
    assert list(got[len(AWKWARD) + 1].labels) == []
    assert "lgpl" in got[len(AWKWARD) + 2].labels
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op8_licences(spark, DATA).collect():
        n, places, labels = plain_base(whole[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(labels))


@pytest.mark.parametrize("joined", [" AND ", " OR (é ", " AND MIT\u00a0AND "])
def test_long_expressions(joined):
    """Every licence of a tag's line counts, however long, and none of the next line or text."""
    many = [f"LicenseRef-{i}" for i in range(20_000)]
    line = joined.join([*many, "GPL-3.0"]) + ")" * (joined.count("(") * len(many))
    texts = ["x\nSPDX-License-Identifier: " + line + end for end in ("", "\nAND Zlib", " prose Zlib (", "\r\nAND Zlib")] + ["AND Zlib"]
    want = {x.lower() for x in many} | {"gpl"} | ({"mit"} if "MIT" in joined else set())
    for got in licences.scan(pa.array(texts))[:-1]:
        assert got[3] == want and got[4] == pytest.approx(licences.TAG_WEIGHT) and got[5] is False


def test_tag_lines():
    texts = ["add an SPDX license identifier for every file", "SPDX license identifier: for every file", "SPDX-License-Identifier", "SPDX-License-Identifier:\nMIT", "SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0\nSPDX-License-Identifier: ISC", "SPDX-License-Identifier: ", "MIT"]
    assert [sorted(x[3]) for x in licences.scan(pa.array(texts))] == [[], [], [], [], ["gpl", "isc", "mit"], [], []]


def test_phrases_do_not_cross_texts():
    index = PhraseIndex([(("a", "b"), 1), (("b",), 2)])
    buf, offs = buffers(pa.array(["x a", "b a b"]))
    s, _, h = words(buf, offs)
    row = np.searchsorted(offs, s, side="right") - 1
    assert sorted((a, b, tuple(v)) for a, b, v in index.matches(index.numbered(h), row)) == [(2, 3, (2,)), (3, 5, (1,)), (4, 5, (2,))]
