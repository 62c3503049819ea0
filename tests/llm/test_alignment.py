"""Alignment of two tokenizers, against whole encodings by both libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import alignment, queries
from tallyforge.llm.shared import save
from tests.conftest import DATA
from tests.llm.cases import AWKWARD, documents

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(BYTE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE)


def token_bytes():
    letters = {}
    extra = 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            letters[chr(byte)] = byte
        else:
            letters[chr(extra)] = byte
            extra += 1
    a = {i: t.encode() if i == 50256 else bytes(letters[c] for c in t) for t, i in A.get_vocab().items()}
    b = {i: bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in range(32000)}
    return a, b


A_BYTES, B_BYTES = token_bytes()


def plain(text):
    """Groups as text and links as a list of id pairs; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    if b"".join(A_BYTES[i] for i in a) != raw or b"".join(B_BYTES[i] for i in b) != raw:
        return None
    links, groups, group = [], [], ([], [])
    i = j = a_end = b_end = 0
    a_spans, b_spans = [], []
    for i in a:
        a_spans.append((a_end, a_end := a_end + len(A_BYTES[i]), i))
    for j in b:
        b_spans.append((b_end, b_end := b_end + len(B_BYTES[j]), j))
    k = 0
    for start, end, i in a_spans:
        while k and b_spans[k - 1][1] > start:
            k -= 1
        while k < len(b_spans) and b_spans[k][0] < end:
            if b_spans[k][1] > start:
                links.append((i, b_spans[k][2]))
            k += 1
    ends = {e for _, e, _ in a_spans} & {e for _, e, _ in b_spans}
    for end, side, i in sorted([(e, 0, i) for _, e, i in a_spans] + [(e, 1, i) for _, e, i in b_spans], key=lambda x: x[:2]):
        group[side].append(i)
        if side == 1 and end in ends:
            groups.append(group)
            group = ([], [])
    return a, b, ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups), links, sum(len(x) * len(y) for x, y in groups)


def expected(texts):
    """Rows without ids, in order, by counting links over all texts."""
    each = [plain(t) for t in texts]
    counts = Counter(pair for e in each if e for pair in e[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for e in each:
        if e is None:
            out.append((0,) * 6 + ("", 0))
            continue
        a, b, groups, links, products = e
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((len(a), len(b), groups.count(";") + 1, len(links), best, sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest(), products))
    return out


def found(spark, df, head=alignment.HEAD):
    aligned = alignment.align(df, BYTE, PIECE)
    stored = save(alignment.numbered(aligned.withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")), "aligned")
    rows = alignment.link_scores(stored, head).collect()
    return [(r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha, r.n_products)) for r in rows]


TEXTS = [
    *AWKWARD,
    "▁ marks a space",
    "a▁b",
    "<|endoftext|> is plain, <s> too </s>",
    "tabs\t and \n lines  \r\n  with   runs of   space ",
    "x\n y\n\n  z   w　 v",
    " leading and trailing  ",
    "it's don't I'LL we 've",
    "naïve café 日本語 \U0001f600\U0001f469‍\U0001f469 \x00\x01\x7f",
    " " * 40,
    "\n" * 25,
    "word " * 3_000,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 200,
]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_awkward_texts(spark, head):
    """Nulls, empty and long texts, repeated rows, any size of the table that all tasks get."""
    df = documents(spark, TEXTS).repartition(3)
    assert sorted(found(spark, df, head)) == list(enumerate(expected(TEXTS)))


def test_repeated_and_null_ids(spark):
    df = documents(spark, ["one two", "one two", "three"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, 7).cast("long"))
    assert Counter(r for _, r in found(spark, df)) == Counter(expected(["one two", "one two", "three"]))
    assert sorted(i or -1 for i, _ in found(spark, df)) == [-1, 7, 7]


def test_empty_table(spark):
    assert found(spark, documents(spark, ["x"]).limit(0)) == []


def test_the_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_alignment(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in docs], expected([r.text for r in docs]), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t 　\x1c.'s▁aZ9é日\U0001f600") | st.characters(codec="utf-8"), max_size=40) | st.none(), max_size=6))
def test_units_give_whole_texts(texts):
    """Words put together give what whole texts give, also when the worker forgets."""
    known = alignment.aligner(BYTE, PIECE)
    n_a, n_b, n_groups, n_links, n_products, groups, links = known.rows(texts)
    known.kept = alignment.UNIT_CHARS
    for i, e in enumerate(map(plain, texts)):
        a, b, text, pairs, products = e or ((), (), "", [], 0)
        assert (n_a[i].as_py(), n_b[i].as_py(), n_groups[i].as_py(), n_links[i].as_py(), n_products[i].as_py()) == (len(a), len(b), text.count("|"), len(pairs), products)
        assert groups[i].as_py() == text
        assert {x["pair"]: x["times"] for x in links[i].as_py()} == {(p << 32) | q: n for (p, q), n in Counter(pairs).items()}


def test_ranks_agree_with_the_library():
    """Every code point between letters and digits, and random joins of vocabulary entries."""
    t = alignment.aligner(BYTE, PIECE).t
    assert t.ranked is not None and t.cut
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(3)
    words = [w for x in A_BYTES.values() if (w := x.decode("utf-8", "ignore")).encode() == x]
    texts = ["a".join(f" x{c}1" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    texts += ["".join(words[i] for i in rng.integers(0, len(words), 60)) for _ in range(1500)]
    for text, e in zip(texts, A.encode_batch(texts, add_special_tokens=False), strict=True):
        assert t.ranked.encode_ordinary(text) == e.ids


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_intervals(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    last = min(a[-1], b[-1])
    a, b = np.append(a[a < last], last), np.append(b[b < last], last)
    own_a, own_b, closes = alignment.intervals(a, b)
    spans = [(i, j) for i, (s, e) in enumerate(zip([0, *a], a)) for j, (t, f) in enumerate(zip([0, *b], b)) if s < f and t < e]
    assert list(zip(own_a.tolist(), own_b.tolist())) == spans
    assert closes.sum() == len(set(a.tolist()) & set(b.tolist()))
