"""Sharding along a Hilbert curve over document metadata, in DataFrame operations only.

Dimensions.  Language, source and size are each quantised to ``2**BITS`` steps: strings by
their rank among the distinct values (so steps keep order and files can be pruned by
min/max), size by its logarithm.  The three steps name a cell, the cell has an index on the
Hilbert curve, and rows are ordered by index.  Shards are cut from that order by the ``rows``
law: row counts are at most one apart.

Ranks without a global sort.  Rows are counted per (curve index, slice), a slice being a hash
of size and text checksum; within an index rows go by slice, then text checksum, then id, so
equal texts of one source and language stand together.  The number of slices grows with the
table.  A text that many rows share has slices of its own after the others, split by a hash of
the id (or, for null ids and for an id that many of its rows share, by place in the input).
Starts of the at most 2**(3*BITS) indices come from one running sum, starts of slices from
running sums per index, and places inside a slice from a window over that slice only, so
neither a cell nor a text that holds a third of all rows is ordered by one task.

Null language or source sorts last; null texts have 8 bytes and checksum 0, as empty ones.
Null ids come first among equal texts.  Texts of any length count whole.  Repeated rows are
ordered arbitrarily among themselves, which changes no result.  An empty input gives no rows.
Other columns are not read.  Windows without keys run over one row per distinct language,
source or curve index, which one task is expected to hold.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import save

SHARDS = 24
BITS = 5
#: Rows of one slice, about, in a cell that holds all rows; and bounds for the number of slices.
SLICE_ROWS = 4096
SLICES = (16, 1 << 16)
#: A text or id with more than this part of all rows is split; so at most this many are.
HOT = 4096


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell whose coordinates have ``bits`` bits each.

    From the top bit down, each axis either inverts the low bits of the first axis or
    exchanges differing low bits with it; the result is Gray-coded and interleaved.
    """
    n = len(axes)

    def turn(x: Column, *, q: Column, i: int) -> Column:
        inverted = F.array(x[0].bitwiseXOR(q - 1), *[x[k] for k in range(1, n)])
        if i == 0:
            return F.when(x[0].bitwiseAND(q) != 0, inverted).otherwise(x)
        differ = x[0].bitwiseXOR(x[i]).bitwiseAND(q - 1)
        exchanged = F.array(*[x[k].bitwiseXOR(differ) if k in (0, i) else x[k] for k in range(n)])
        return F.when(x[i].bitwiseAND(q) != 0, inverted).otherwise(exchanged)

    def level(x: Column, q: Column) -> Column:
        for i in range(n):
            x = _let(x, partial(turn, q=q, i=i))
        return x

    def gray(x: Column) -> Column:
        parts = [x[0]]
        for i in range(1, n):
            parts.append(parts[-1].bitwiseXOR(x[i]))
        return F.array(*parts)

    def finish(g: Column) -> Column:
        low = F.aggregate(powers, F.lit(0), lambda t, q: F.when(g[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return _let(low, lambda t: F.transform(g, lambda v: v.bitwiseXOR(t)))

    powers = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    turned = F.aggregate(powers, F.array(*[a.cast("int") for a in axes]), level)
    coded = _let(_let(turned, gray), finish)
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
    bit = lambda v, m: F.when(v.bitwiseAND(m) != 0, F.lit(1)).otherwise(F.lit(0))
    return _let(coded, lambda c: F.aggregate(masks, F.lit(0).cast("long"), lambda h, m: F.aggregate(c, h, lambda a, v: a * 2 + bit(v, m))))


def _steps(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, step): the distinct values of a string column, ranked into 2**bits steps, nulls last."""
    distinct = values.select(column).distinct()
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last())) - 1
    return distinct.select(F.col(column).alias(f"__{column}"), F.floor(rank * (1 << bits) / F.count(F.lit(1)).over(whole)).cast("int").alias(f"{column}_step"))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The small columns that ordering needs, stored: doc_id, lang, source, size, text_crc32, place (in the input)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return save(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place")), "metadata")


def _same(columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return on


def _often(rows: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """The key values of more than ``least`` rows, stored: __<key> columns and their number __<name>."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"__{name}")).where(F.col(f"__{name}") > least)
    return save(found.select(*[F.col(k).alias(f"__{k}") for k in keys], f"__{name}"), name)


def _sliced(rows: DataFrame, total: int) -> DataFrame:
    slices, least = min(max(total // SLICE_ROWS, SLICES[0]), SLICES[1]), max(SLICE_ROWS, total // HOT)
    usual = F.pmod(F.xxhash64("size", "text_crc32"), F.lit(slices))
    text = ["lang", "source", "size", "text_crc32"]
    hot = _often(rows, text, least, "texts")
    if hot.isEmpty():
        return rows.withColumn("slice", usual)
    shared = rows.join(F.broadcast(hot), _same(text), "left").drop(*[f"__{k}" for k in text])
    ids = _often(shared.where("__texts IS NOT NULL"), [*text, "doc_id"], least, "ids")
    marked = shared.join(F.broadcast(ids), _same([*text, "doc_id"]), "left")
    by_place = F.col("doc_id").isNull() | F.col("__ids").isNotNull()
    part = F.pmod(F.when(by_place, F.xxhash64("place")).otherwise(F.xxhash64("doc_id")), F.least(F.ceil(F.col("__texts") / SLICE_ROWS), F.lit(HOT)))
    own = F.lit(slices) + F.col("text_crc32") * HOT + part
    return marked.select(*rows.columns, F.when(F.col("__texts").isNull(), usual).otherwise(own).alias("slice"))


def shard(table: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Adds curve (Hilbert index), shard and slot to the rows of ``metadata``."""
    size_step = F.least(F.floor(F.log2(F.col("size").cast("double")) * 1.25), F.lit((1 << bits) - 1)).cast("int")
    rows = _sliced(table.withColumn("size_step", size_step), table.count())
    counted = save(rows.groupBy("lang", "source", "size_step", "slice").agg(F.count(F.lit(1)).alias("n")), "cells")
    cells = counted.groupBy("lang", "source", "size_step").agg(F.sum("n").alias("n"))
    for c in ("lang", "source"):
        steps = _steps(counted, c, bits)
        cells = cells.join(steps, F.col(c).eqNullSafe(F.col(f"__{c}")))
    cells = cells.withColumn("curve", hilbert_index([F.col("lang_step"), F.col("source_step"), F.col("size_step")], bits))
    cells = save(cells.select("lang", "source", "size_step", "curve", "n"), "curve")
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = cells.groupBy("curve").agg(F.sum("n").alias("n"))
    starts = starts.select("curve", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("curve_start"), F.sum("n").over(everything).alias("total"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = cells.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("size_step").alias("__size_step"), "curve").join(starts, "curve")
    named = save(named, "starts")
    on_cell = same("lang", "__lang") & same("source", "__source") & (F.col("size_step") == F.col("__size_step"))
    earlier = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counted.join(named, on_cell).groupBy("curve", "slice").agg(F.sum("n").alias("n"), F.max("curve_start").alias("curve_start"), F.max("total").alias("total"))
    slices = save(slices.select("curve", "slice", (F.col("curve_start") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start"), "total"), "slices")
    inside = Window.partitionBy("curve", "slice").orderBy("text_crc32", "size", "doc_id", "place")
    placed = rows.join(named.select("__lang", "__source", "__size_step", "curve"), on_cell).withColumn("place", F.row_number().over(inside) - 1)
    ranked = placed.join(slices, ["curve", "slice"]).withColumn("rank", F.col("start") + F.col("place"))
    short, long_ = F.floor(F.col("total") / shards), F.col("total") % shards
    in_long = F.col("rank") < long_ * (short + 1)
    number = F.when(in_long, F.floor(F.col("rank") / (short + 1))).otherwise(long_ + F.floor((F.col("rank") - long_ * (short + 1)) / F.greatest(short, F.lit(1))))
    first = number * short + F.least(number, long_)
    kept = [c for c in table.columns if c != "place"]
    return ranked.select(*kept, "curve", number.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))
