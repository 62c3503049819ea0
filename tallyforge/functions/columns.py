"""Column builders: cleaning, features and decision rules as plain expressions.

Everything here stays in whole-stage codegen; nothing needs a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NH, NMR, H = 0, 1, 2

# Statuses with their labels and classes.
STATUSES = {
    "CURRENTLY_RATED_HELPFUL": ("HELPFUL", H),
    "NEEDS_MORE_RATINGS": ("NEEDS_MORE_RATINGS", NMR),
    "CURRENTLY_RATED_NOT_HELPFUL": ("NOT_HELPFUL", NH),
}


def r6(c: Column) -> Column:
    return F.round(c, 6)


def coerce_numeric(c: Column, kind: str = "double") -> Column:
    """Number of a text; null where it is none."""
    return F.trim(c.cast("string")).try_cast(kind)


def flag(c: Column) -> Column:
    """0/1 column of free text: unparseable and null count as 0, decimals are cut."""
    return F.coalesce(coerce_numeric(c).try_cast("int"), F.lit(0))


def indicator(c: Column, mode: str = "zero") -> Column:
    """A vote indicator where -1 means unparsed: ``zero`` clips it to 0, ``null`` blanks it, ``raw`` keeps it."""
    x = coerce_numeric(c)
    if mode == "zero":
        return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(x >= 0, x) if mode == "null" else x


def status_label(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (label, _) in reversed(STATUSES.items()):
        out = F.when(status == name, label).otherwise(out)
    return out


def status_class(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (_, k) in reversed(STATUSES.items()):
        out = F.when(status == name, F.lit(k)).otherwise(out)
    return out


def binary_class(k: Column) -> Column:
    """1 for helpful, 0 for not helpful, null for what is undecided."""
    return F.when(k == H, 1).when(k == NH, 0)


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """Index of the interval (edge, next edge] that holds x; null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        out = out.when(x <= edge, i)
    return out.otherwise(len(edges))


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def entropy(shares: Iterable[Column], floor: float = 1e-9) -> Column:
    terms = [F.least(F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(floor)), F.lit(1.0)) for s in shares]
    return -sum((p * F.ln(p) for p in terms[1:]), terms[0] * F.ln(terms[0]))


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the non-null values of a row."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    known = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return total / F.nullif(known, F.lit(0))


def row_sum(columns: Sequence[Column]) -> Column:
    return sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))


def argmax3(nh: Column, nmr: Column, h: Column) -> Column:
    """Class of the largest value; ties go to the lower class."""
    return F.when((nh >= nmr) & (nh >= h), NH).when(nmr >= h, NMR).otherwise(H)


def resolved_side(nh: Column, h: Column) -> Column:
    return F.when(h >= nh, H).otherwise(NH)


def majority(share_h: Column) -> Column:
    return F.when(share_h >= 0.5, H).otherwise(NH)


def score_thirds(mean_score: Column, low: float = 1 / 3, high: float = 2 / 3) -> Column:
    return F.when(mean_score >= high, H).when(mean_score <= low, NH).otherwise(NMR)


def dual_threshold(p: Column, low: Column | float, high: Column | float) -> Column:
    return F.when(p <= low, NH).when(p >= high, H).otherwise(NMR)


def nmr_gate(nh: Column, nmr: Column, h: Column, t: Column | float) -> Column:
    return F.when(nmr >= t, NMR).otherwise(resolved_side(nh, h))


def margin_to_nmr(nh: Column, nmr: Column, h: Column, margin: Column | float, least: Column | float, base: Column | None = None) -> Column:
    side = resolved_side(nh, h) if base is None else base
    return F.when((F.abs(h - nh) < margin) & (nmr >= least), NMR).otherwise(side)


def resolved_gap(nh: Column, nmr: Column, h: Column, gap: Column | float) -> Column:
    return F.when(F.greatest(h, nh) - nmr < gap, NMR).otherwise(resolved_side(nh, h))


def two_stage(p_nmr: Column, p_h: Column, t_nmr: float, t_h: float) -> Column:
    return F.when(p_nmr >= t_nmr, NMR).when(p_h >= t_h, H).otherwise(NH)


def guarded_nmr(base: Column, nh: Column, nmr: Column, h: Column, t: float, resolved: float, margin: float) -> Column:
    tops = F.sort_array(F.array(nh, nmr, h), False)
    doubtful = (nmr >= t) & (F.greatest(nh, h) <= resolved) & (tops[0] - tops[1] <= margin)
    return F.when((base != NMR) & doubtful, NMR).otherwise(base)


def disagreement(base: Column, margin: Column, ent: Column, conf: Column, understanding: Column, m: float, e: float, c: float, u: float) -> Column:
    """Undecided where votes are close or mixed, or confidence or understanding is low (0 switches those two off)."""
    doubt = (margin <= m) | (ent >= e)
    if c:
        doubt = doubt | (F.coalesce(conf, F.lit(100.0)) <= c)
    if u:
        doubt = doubt | (F.coalesce(understanding, F.lit(100.0)) <= u)
    return F.when(doubt, NMR).otherwise(base)


def bias_rule(nh: Column, nmr: Column, h: Column, bias: Sequence[float], band: float, cross: float) -> Column:
    s = [F.ln(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0))) + b for p, b in zip((nh, nmr, h), bias, strict=True)]
    close = (F.abs(s[2] - s[0]) < cross) & (s[1] >= F.least(s[2], s[0]) - band)
    return F.when(close, NMR).otherwise(argmax3(*s)) if cross > 0 else argmax3(*s)


def ordered_thresholds(nh: Column, nmr: Column, h: Column, t_h: float, t_nh: float, mode: str) -> Column:
    if mode == "helpful_first":
        return F.when(h >= t_h, H).when(nh >= t_nh, NH).otherwise(NMR)
    if mode == "not_helpful_first":
        return F.when(nh >= t_nh, NH).when(h >= t_h, H).otherwise(NMR)
    return argmax3(nh, nmr, h + t_h)


def selective(score: Column, low: Column | float, high: Column | float) -> Column:
    return F.when(score <= low, 0).when(score >= high, 1).otherwise(-1)


def resolved_or_abstain(nh: Column, h: Column, t: Column | float) -> Column:
    """The likelier resolved class where it reaches t, else -1; ties go to not helpful."""
    return F.when(F.greatest(nh, h) >= t, F.when(h > nh, H).otherwise(NH)).otherwise(-1)


def rescue(base: Column, p_resolved: Column, p_nmr: Column, p_h_given_resolved: Column, t: Column | float, gap: Column | float, direction: Column | float) -> Column:
    sure = F.greatest(p_h_given_resolved, 1 - p_h_given_resolved)
    go = (base == NMR) & (p_resolved >= t) & (p_resolved - p_nmr >= gap) & (sure >= direction)
    return F.when(go, F.when(p_h_given_resolved >= 0.5, H).otherwise(NH)).otherwise(base)


def near_tie(margin: Column, limit: float = 0.125) -> Column:
    return F.coalesce((margin <= limit).cast("int"), F.lit(0))


def target_key(target: float) -> str:
    """A coverage target as it stands in column names: 0.65 is 0p65."""
    return f"{target:.2f}".replace(".", "p")


def combined(scores: Sequence[Column], rule: Column, margin: Column) -> Column:
    """Class with the largest weighted score; by rule, close or contested ones stay undecided."""
    nh, nmr, h = scores
    contested = (nh > 0) & (nmr > 0) & (h > 0)
    return F.when((rule == "margin_to_nmr") & (F.abs(h - nh) <= margin), NMR).when((rule == "any_cross_to_nmr") & contested, NMR).otherwise(argmax3(nh, nmr, h))


def weighted_vote(predictions: Sequence[Column], weights: Sequence[float]) -> Column:
    score = [sum((F.when(p == k, w).otherwise(0.0) for p, w in zip(predictions, weights, strict=True)), F.lit(0.0)) for k in (NH, NMR, H)]
    return argmax3(*score)


def majority_of_three(a: Column, b: Column, c: Column) -> Column:
    """The value that two agree on; the lowest where all differ."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.least(a, b, c))


def accuracy_first(pred: Column, high_acc: Column, high_ba: Column, summary: Column) -> Column:
    p = F.when((pred != high_acc) & (pred != summary), majority_of_three(pred, high_acc, summary)).otherwise(pred)
    p = F.when((p == NMR) & (high_acc != NMR) & (high_acc == summary), high_acc).otherwise(p)
    return F.when((p != NMR) & (high_ba != p) & (high_ba != summary) & (high_ba != NMR), high_ba).otherwise(p)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def shorten(c: Column, n: int) -> Column:
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


# Character entities and what they stand for, in the order they are replaced.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip_html(c: Column) -> Column:
    text = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
