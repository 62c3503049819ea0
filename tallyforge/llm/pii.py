"""Personal data: a skip-chain conditional random field over the tokens of a text.

The chain runs over all whitespace tokens.  A token without a digit or ``@`` can only be "none",
so it is a fixed node: it cuts the chain, and its chain factor is added to its neighbours; only
the other tokens are kept as nodes.  Node potentials come from token shape and the neighbouring
words, and skip edges tie each token to the next one in the text that repeats it or shares its
digits (also across tokens that follow each other, as in a number written in groups).  Loopy
sum-product passes run over the texts of a group at once until the messages stop changing.
Tokens inside a span of a base pattern are clamped to that kind, and every other mention is also
tied to one clamped mention (the last before it, else the first after it), so what the patterns
are sure of reaches all mentions in one step: a number repeated without its prefix, or an
address in another form.

Potentials (node, chain, skip, and one for ties to clamped mentions) are trained together by
pseudo-likelihood on generated sentences of bounded number (``TRAIN_TEXTS``, fixed seed), with
the clamps that inference has; nothing is learned from the scanned corpus.

A token repeated n times makes n - 1 skip edges and fewer than n ties to clamped mentions.
Texts of any length are scanned whole; a group holds about ``GROUP_CHARS`` characters or one
text, and memory follows its number of tokens with a digit or ``@``.  Null and empty texts have
no spans; an empty table gives no rows; spans that start together are ordered by kind; repeated
rows are scanned separately; other columns are not read.  All base expressions are written so
that their cost is linear in the text.
"""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in reporting order.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_TEXTS = 800
ROUNDS = 12
RIDGE = 5e-6
SURE = 0.75
STILL = 1e-4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"\s")
_INK = re.compile(r"\S")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_CUE = {"email": ("mail", "email", "contact"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "pay"), "phone": ("call", "phone", "tel", "mobile", "fax")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    if not _MARK.search(text):
        return out
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at)):
            out.append((s, m.end(), "email"))
            done = m.end()
        at += 1
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def tokens(text: str) -> list[tuple[int, int]]:
    """Whitespace tokens that hold a digit or an at sign."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        s = m.start()
        while s > at and not text[s - 1].isspace():
            s -= 1
        e = _TOKEN_END.search(text, m.end())
        at = e.start() if e else len(text)
        out.append((s, at))
    return out


def features(text: str, s: int, e: int) -> list[int]:
    """Indices of the features that hold for one token."""
    token = text[s:e].strip(".,;:!?\"'<>[]{}")
    n = sum(c.isdigit() for c in token)
    parts = token.split(".")
    f = [0, 1 + min(n, 20)]
    at = token.find("@")
    f += [22] * (0 < at < len(token) - 1) + [23] * (at > 0 and "." in token[at:]) + [24] * token.startswith("+")
    f += [25] * ("(" in token) + [26] * ("-" in token) + [27] * (len(parts) == 4 and token.isascii() and all(p.isdigit() and int(p[:4]) < 256 for p in parts))
    f += [28] * (12 <= n <= 19 and token.isascii() and luhn("".join(c for c in token if c.isdigit()))) + [29] * (n == len(token)) + [30] * any(c.isalpha() for c in token)
    before = text[max(0, s - 24) : s].lower().split()
    f += [31 + i for i, cues in enumerate(_CUE.values()) if before and before[-1].strip(":.,#") in cues]
    return f


N_FEATURES = 35


def token_key(text: str, s: int, e: int) -> str | None:
    """What a token shares with another mention that repeats it."""
    token = text[s:e].strip(".,;:!?\"'<>[]{}()").lower()
    return "t" + token if len(token) >= 6 else None


class Graph:
    """Nodes, clamps and edges of some texts, in flat arrays."""

    def __init__(self) -> None:
        self.feats, self.n_feats = array("b"), array("b")
        self.fixed, self.plain = array("b"), array("b")  # clamped label or -1; neighbours that can only be "none"
        self.row, self.start, self.end = array("q"), array("q"), array("q")
        self.chain, self.skip = array("q"), array("q")  # pairs of nodes, flat
        self.sure = array("q")  # mentions and their clamped mention, where no skip edge has them

    def add(self, row: int, text: str, spans: Sequence[tuple[int, int, str]]) -> None:
        last_of: dict[str, int] = {}
        sure_of: dict[str, int] = {}
        waiting: dict[str, list[int]] = {}
        prev, at, open_spans = -1, 0, 0
        run: list[tuple[int, str]] = []  # the last nodes in a row that hold digits, and these
        for s, e in tokens(text):
            i = len(self.fixed)
            while open_spans < len(spans) and spans[open_spans][1] <= s:
                open_spans += 1
            label, k = -1, open_spans
            while k < len(spans) and spans[k][0] < e and label < 0:
                if spans[k][1] > s:
                    label = LABELS.index(spans[k][2])
                k += 1
            f = features(text, s, e)
            self.feats.extend(f)
            self.n_feats.append(len(f))
            self.fixed.append(label)
            self.plain.append(0)
            self.row.append(row)
            self.start.append(s)
            self.end.append(e)
            follows = prev >= 0 and _INK.search(text, at).start() == s
            if follows:
                self.chain.extend((prev, i))
            elif _INK.search(text, at).start() < s:
                self.plain[i] += 1
                if prev >= 0:
                    self.plain[prev] += 1
            if not follows:
                run.clear()
            if key := token_key(text, s, e):
                self._mention([i], key, last_of, sure_of, waiting)
            if text[s] == "+":  # a new number
                run.clear()
            if digits := _NOT_DIGIT.sub("", text[s:e])[-7:]:
                run.append((i, digits))
                tail, taken = "", []
                for node, part in reversed(run):
                    tail = (part + tail)[-7:]
                    taken.append(node)
                    if len(tail) == 7:
                        self._mention(taken, "d" + tail, last_of, sure_of, waiting)
                        break
                del run[:-7]
            prev, at = i, e
        if prev >= 0 and _INK.search(text, at):
            self.plain[prev] += 1

    def _mention(self, nodes: list[int], key: str, last_of: dict[str, int], sure_of: dict[str, int], waiting: dict[str, list[int]]) -> None:
        """Ties the nodes of one mention, the last first, to other mentions with this key."""
        last, own = last_of.get(key), nodes[0]
        if last is not None and last < nodes[-1]:
            for i in nodes:
                self.skip.extend((last, i))
        if self.fixed[own] >= 0:
            for j in waiting.pop(key, ()):
                if j != last:
                    self.sure.extend((j, own))
            sure_of[key] = own
        elif key not in sure_of:
            waiting.setdefault(key, []).extend(nodes)
        elif sure_of[key] != last:
            for i in nodes:
                self.sure.extend((sure_of[key], i))
        last_of[key] = own


def pairs_of(flat: array) -> np.ndarray:
    return np.frombuffer(flat, np.int64).reshape(-1, 2) if len(flat) else np.zeros((0, 2), np.int64)


EDGES_AT_ONCE = 1 << 16


def beliefs(g: Graph, model: tuple[np.ndarray, ...]) -> np.ndarray:
    """Posterior label probabilities of every node once no message changes by ``STILL``.

    Each pass renews the messages that are still moving.  A message of a text of n nodes that
    swings for 4 n + 64 passes, in which evidence has crossed the text, is left as it is.
    """
    node, chain, skip, sure = model
    n, k = len(g.fixed), len(LABELS)
    unary = np.zeros((n, k))
    np.add.at(unary, np.repeat(np.arange(n), np.frombuffer(g.n_feats, np.int8)), node[np.frombuffer(g.feats, np.int8)])
    unary += np.frombuffer(g.plain, np.int8)[:, None] * chain[0]
    fixed, row = np.frombuffer(g.fixed, np.int8), np.frombuffer(g.row, np.int64)
    unary[fixed >= 0] = -40.0
    unary[fixed >= 0, fixed[fixed >= 0]] = 0.0
    parts = [pairs_of(x) for x in (g.chain, g.skip, g.sure)]
    pairs = np.concatenate(parts)
    if len(pairs):
        # several edges between two nodes are one factor, so that evidence does not go round between them
        pairs, same = np.unique(pairs, axis=0, return_inverse=True)
        chains = np.bincount(same.ravel()[: len(parts[0])], minlength=len(pairs))
        skips = np.bincount(same.ravel()[len(parts[0]) :], minlength=len(pairs))
        given = np.where(skips == 0, 0, np.where(fixed[pairs[:, 0]] >= 0, 1, np.where(fixed[pairs[:, 1]] >= 0, 2, 0)))
        skips[given > 0] = 0
        forms, form = np.unique(np.stack([chains, skips, given], axis=1), axis=0, return_inverse=True)  # few kinds of factor
        psi = forms[:, 0, None, None] * chain + forms[:, 1, None, None] * skip
        psi[forms[:, 2] == 1] += sure
        psi[forms[:, 2] == 2] += sure.T
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        form = np.concatenate([form.ravel(), form.ravel() + len(forms)])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        m, half = np.zeros((len(src), k)), len(pairs)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        most = 4 * np.bincount(row)[row[src]] + 64
        by_src = np.argsort(src, kind="stable")
        first = np.searchsorted(src[by_src], np.arange(n + 1))
        live, done = np.flatnonzero(fixed[dst] < 0), 0  # what reaches a clamped node changes nothing
        while len(live):
            change = np.empty((len(live), k))
            for at in range(0, len(live), EDGES_AT_ONCE):
                e = live[at : at + EDGES_AT_ONCE]
                new = unary[src[e]] - m[back[e]]
                new = np.logaddexp.reduce(new[:, :, None] + psi[form[e]], axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                change[at : at + len(e)] = 0.5 * (new - m[e])
            moving = np.abs(change).max(axis=1) >= STILL
            live, change = live[moving], change[moving]
            m[live] += change
            np.add.at(unary, dst[live], change)
            done += 1
            nodes = np.unique(dst[live])
            size = first[nodes + 1] - first[nodes]
            woken = by_src[np.repeat(first[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            live = np.union1d(live, woken[fixed[dst[woken]] < 0])
            live = live[done < most[live]]
    unary -= np.logaddexp.reduce(unary, axis=1, keepdims=True)
    return np.exp(unary)


def _sentence(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated text and its true spans."""
    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    parts: list[tuple[str, str | None]] = []
    email, ip, number = f"{word()}.{digits(2)}@{word()}.example.{r.choice(['com', 'org', 'net'])}", ".".join(str(r.randint(0, 255)) for _ in range(4)), card()
    land, area, mid, end = r.choice(("1", "1", "44", "49", "351", "86")), digits(r.choice((2, 3, 3, 4))), digits(r.choice((3, 3, 4))), digits(r.choice((3, 4, 4)))
    forms = {
        "email": [email, email.upper(), f"<{email}>"],
        "ip": [ip],
        "card": [number],
        "phone": [f"+{land} ({area}) {mid}-{end}", f"+{land} {area} {mid} {end}", f"({area}) {mid}-{end}", f"{mid}-{end}", f"+{land}{area}{mid}{end}", f"{area} {mid} {end}", f"{mid} {end}", f"{mid}-{end}"],
    }
    noise = [lambda: digits(r.randint(1, 6)), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: "$" + digits(3), lambda: next(d for d in iter(lambda: digits(r.randint(13, 16)), None) if not luhn(d)), *[lambda: f"{digits(r.choice((3, 3, 4)))}-{digits(r.choice((3, 4, 4)))}"] * 4, *[lambda: f"{digits(3)} {digits(3)} {digits(4)}"] * 2, lambda: digits(7), lambda: digits(8), lambda: digits(10), lambda: f"{digits(4)}-{digits(2)}", lambda: f"({digits(3)})", lambda: f"@{word()}", lambda: ".".join(digits(3) for _ in range(3))]
    chosen = r.sample(list(KINDS), r.randint(0, 2))
    for kind in chosen:
        for mention in range(r.randint(1, 3)):  # the first mention is in full, later ones may be cut
            parts += [(word(), None) for _ in range(r.randint(1, 5))]
            if r.random() < 0.2:
                parts.append((r.choice(_CUE[kind]), None))
            form = forms[kind][0] if mention == 0 else r.choice(forms[kind])
            parts.append((form, kind))
    for _ in range(r.randint(4, 12)):
        at = r.randint(0, len(parts))
        again = r.choice(noise)()
        parts[at:at] = [(word(), None), (again, None)] + [(word(), None), (again, None)] * r.choice((0, 1, 1, 2))
    text, spans = "", []
    for t, kind in parts:
        if kind:
            spans.append((len(text), len(text) + len(t), kind))
        text += t + " "
    return text, spans


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, ...]:
    """Node weights (features x labels); chain, skip and clamp log potentials (the last: clamped label x own label)."""
    r, g = random.Random(20), Graph()
    truth: list[int] = []
    for row in range(TRAIN_TEXTS):
        text, spans = _sentence(r)
        g.add(row, text, base_spans(text))
        truth += [next((LABELS.index(kind) for a, b, kind in spans if a < e and b > s), 0) for s, e in tokens(text)]
    n, k, y, fixed = len(g.fixed), len(LABELS), np.array(truth), np.array(g.fixed)
    x = np.zeros((n, N_FEATURES + 3 * k))  # own features, then labels over chain edges, skip edges and ties to clamped mentions
    x[np.repeat(np.arange(n), np.frombuffer(g.n_feats, np.int8)), np.frombuffer(g.feats, np.int8)] = 1
    x[:, N_FEATURES] = np.frombuffer(g.plain, np.int8)
    for a, b in pairs_of(g.chain).tolist():
        x[a, N_FEATURES + y[b]] += 1
        x[b, N_FEATURES + y[a]] += 1
    for a, b in [*pairs_of(g.skip).tolist(), *pairs_of(g.sure).tolist()]:
        for i, j in ((a, b), (b, a)):
            if fixed[j] >= 0:
                x[i, N_FEATURES + 2 * k + y[j]] = 1
            elif fixed[i] < 0:
                x[i, N_FEATURES + k + y[j]] += 1
    x, y = x[fixed < 0], y[fixed < 0]
    n = len(x)
    skip_at = slice(N_FEATURES + k, N_FEATURES + 2 * k)
    tied = x[:, skip_at].copy()
    # skip edges only say that labels agree, so one strength is kept of their table, and the rest is trained again with it
    table = _newton(x, y, np.zeros((n, k)))[skip_at]
    strength = np.trace(table) / k - (table.sum() - np.trace(table)) / (k * (k - 1))
    x[:, skip_at] = 0
    w = _newton(x, y, strength * tied)
    chain, sure = w[N_FEATURES : N_FEATURES + k], w[N_FEATURES + 2 * k :]
    return w[:N_FEATURES], (chain + chain.T) / 2, strength * np.eye(k), sure


def _newton(x: np.ndarray, y: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Ridge multinomial regression: weights (features x labels)."""
    n, f, k = len(x), x.shape[1], len(LABELS)
    w = np.zeros((f, k))
    rows, same = np.unique(np.concatenate([x, offset], axis=1), axis=0, return_inverse=True)  # many tokens look alike: count them
    x, offset = rows[:, :f], rows[:, f:]
    target = np.zeros((len(x), k))
    np.add.at(target, (same.ravel(), y), 1)
    size = target.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        z = x @ w + offset
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (p * size - target) / n + RIDGE * w
        curve = np.zeros((k, f, k, f))
        for a in range(k):
            for b in range(k):
                curve[a, :, b] = (x * (size[:, 0] * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x / n
        curve = curve.reshape(k * f, k * f) + RIDGE * np.eye(k * f)
        w -= np.linalg.solve(curve, slope.T.ravel()).reshape(k, f).T
    return w


def find_all(texts: list[str | None], trained: tuple[np.ndarray, ...] | None = None) -> list[list[tuple[int, int, str, bool]]]:
    """For each text its spans (start, end, kind, base), by start and then kind as listed."""
    g, base = Graph(), []
    for row, text in enumerate(texts):
        spans = base_spans(text) if text else []
        base.append(spans)
        if text:
            g.add(row, text, spans)
    out: list[list[tuple[int, int, str, bool]]] = [[(*s, True) for s in spans] for spans in base]
    fixed = np.frombuffer(g.fixed, np.int8)
    if len(fixed) and fixed.min() < 0:
        p = beliefs(g, trained or model())
        best = p.argmax(axis=1)
        open_at: tuple[int, int, int] | None = None
        for i in np.flatnonzero((fixed < 0) & (best > 0) & (p.max(axis=1) >= SURE)):
            row, s, e = g.row[i], g.start[i], g.end[i]
            kind = LABELS[best[i]]
            text = texts[row]
            while e > s and text[e - 1] in ".,;:!?\"'<>[]{}":
                e -= 1
            while s < e and text[s] in ".,;:!?\"'<>[]{}":
                s += 1
            if open_at == (row, i - 1, best[i]) and s - out[row][-1][1] <= 1:
                out[row][-1] = (out[row][-1][0], e, kind, False)
            else:
                out[row].append((s, e, kind, False))
            open_at = (row, i, best[i])
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) if len(x) > 1 else x for x in out]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
_ROWS = 256
GROUP_CHARS = 1 << 20


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``_ROWS`` rows whose texts have about ``GROUP_CHARS`` characters."""
    size = np.cumsum(np.nan_to_num(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(float)))
    i = 0
    while i < b.num_rows:
        j = int(np.searchsorted(size, (size[i - 1] if i else 0) + GROUP_CHARS, side="right"))
        j = min(max(j, i + 1), i + _ROWS, b.num_rows)
        yield b.slice(i, j - i)
        i = j


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, and ``spans`` array<struct<kind, start, end, base>> in code points."""
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()
    trained = model()  # a few small arrays, trained once here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole):
                rows = [[dict(zip(("kind", "start", "end", "base"), (k, s, e, y), strict=True)) for s, e, k, y in x] for x in find_all(b.column(1).to_pylist(), trained)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], [id_col, "spans"])

    return kept.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
