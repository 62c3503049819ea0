"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets.  The sources share all words by weight; a source's target stops at ``cap`` times
its words and the excess goes to the others by weight until none is above.  As the capped
sources are those with the smallest (cap x words / weight), one pass over the sources in
that order with running sums gives the level directly.

Draw.  A source with target/words = r takes every document floor(r) times (whole, certain
copies) and then a fixed-size sample for the remainder p = r - floor(r).  Inclusion odds are
unequal, between sources and between documents: a document's odds are its source's p/(1-p)
times t, its size over the source's mean size, held between 1/2 and 2 (a sample of words
varies least when longer documents are likelier, the bounds keep short ones in).  Each document
has a random number u from a hash; its Pareto rank variable is q = (u/(1-u)) / (its odds), and
the smallest q are taken until the source's remaining words are filled, so the size is fixed in
words, to within half of the document at the cut.  A common factor of the odds does not change
this order, so the one with which expected and remaining words agree needs no solving.

The cut needs no total order of a source: words are added up over ``RANGES`` ranges of q/(1+q)
per source, the running sum finds the range that holds the cut, and only that range's
documents are ordered.  A source with a third of all rows is thus spread like any other.

Ties.  u hashes id, size and text, so rows with one u are repeated rows; they are one group
with a number of copies in the order, and if the cut falls into such a group, as many of its
rows are taken as fit, numbered by counts per slice.

Null texts have size 0.  Null sources form one source, the last in order.  Documents of size
0 take nothing.  Texts of any length are counted whole.  Null ids are drawn like others.  An
empty input gives an empty mix.  Only the named columns are read, and all are kept by ``take``.
Windows without keys run over one row per source, which one task is expected to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import save, temporary

CAP = 3
WEIGHTS = (5, 2, 1)
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, size: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of seed, id, size and the text's md5."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("-")), size.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, source_rows, target) from (source, size); one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), kind + 1).cast("long")
    known = totals.withColumn("weight", weight)
    level_order = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows, before, rest = Window.partitionBy(), level_order.rowsBetween(Window.unboundedPreceding, -1), level_order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest)
    free = cap * F.col("source_size") >= F.col("level") * F.col("weight")
    found = known.withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(free, F.struct(cap * F.col("source_size") / F.col("weight"), "source", F.col("level").alias("at")))).over(all_rows)["at"])
    target = F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf"))))
    return found.select("source", "source_size", "source_rows", target.alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The columns the draw needs: doc_id, source, size, u."""
    size = word_count(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), uniform(F.col(id_col), size, F.col(text_col), seed).alias("u"))


def _rank_variable(table: DataFrame, goals: DataFrame) -> DataFrame:
    """Rows with their source's goal, q as q/(1+q), and the range it falls in."""
    rows = table.join(goals, F.col("source").eqNullSafe(F.col("__source")))
    relative = (F.col("size") * F.col("source_rows")).cast("double") / F.nullif(F.col("source_size"), F.lit(0))
    tilt = F.coalesce(F.least(F.greatest(relative, F.lit(0.5)), F.lit(2.0)), F.lit(1.0))
    q = (F.col("u") / (1 - F.col("u"))) / ((F.col("p") / (1 - F.col("p"))) * tilt)
    rows = rows.withColumn("q", F.when(F.col("p") > 0, q / (1 + q)).otherwise(F.lit(1.0)))
    return rows.withColumn("range", F.least(F.floor(F.col("q") * RANGES), F.lit(RANGES - 1)).cast("int"))


def _order() -> Column:
    return F.struct("q", "doc_id", "size")


def rules(table: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: source_size, target, whole copies, and where its draw is cut; stored.

    ``table``: (doc_id, source, size, u), stored.  Documents before the cut range are drawn, and
    in that range those up to ``last`` in the order of q; without a cut range all are drawn.  Of
    the repeated rows ``split`` the first ``fit`` are drawn.
    """
    with temporary(table.sparkSession):
        return save(_rules(table, weights, cap), "rules", keep=True)


def _rules(table: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    goals = targets(table, weights, cap)
    goals = goals.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    goals = goals.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = save(goals.withColumnRenamed("source", "__source"), "targets")
    rows = _rank_variable(table, goals)
    per_range = rows.groupBy("__source", "range").agg(F.sum("size").alias("n"), F.max("left").alias("left"))
    running = Window.partitionBy("__source").orderBy("range")
    per_range = per_range.withColumn("upto", F.sum("n").over(running)).withColumn("start", F.col("upto") - F.col("n"))
    cut = per_range.where((F.col("start") < F.col("left")) & (F.col("upto") >= F.col("left")))
    cut = save(cut.select(F.col("__source").alias("cut_source"), F.col("range").alias("cut_range"), "start"), "cuts")
    boundary = rows.join(cut, F.col("__source").eqNullSafe(F.col("cut_source")) & (F.col("range") == F.col("cut_range")))
    groups = boundary.groupBy("__source", "cut_source", "start", "left", "q", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("__source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.col("start") - F.coalesce(F.sum(F.col("size") * F.col("m")).over(before), F.lit(0)) - F.col("size") / 2
    # copies of this row that fit; the first needs room for half of it
    fit = F.when(room < 0, F.lit(0)).otherwise(F.coalesce(F.least(F.floor(room / F.nullif(F.col("size"), F.lit(0))) + 1, F.col("m")), F.col("m")))
    last = groups.withColumn("fit", fit.cast("long")).groupBy("cut_source").agg(
        F.max(F.when(F.col("fit") == F.col("m"), _order())).alias("last"),
        F.min(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("m")), F.struct(_order().alias("row"), "fit"))).alias("split"),
    )
    last = last.withColumnRenamed("cut_source", "last_source")
    cuts = cut.drop("start").join(last, F.col("cut_source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    found = goals.join(cuts, F.col("__source").eqNullSafe(F.col("cut_source")), "left")
    split, fit = F.col("split.row").alias("split"), F.col("split.fit").alias("fit")
    return found.select("__source", "source_size", "source_rows", "target", "whole", "p", "cut_range", "last", split, fit)


SLICES = 1024


def copies_of(table: DataFrame, rule: DataFrame) -> DataFrame:
    """``table`` (doc_id, source, size, u and any others) with source_size, target and copies."""
    rows = _rank_variable(table, rule)
    drawn = (F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & F.coalesce(_order() <= F.col("last"), F.lit(False)))
    # a source without a remainder draws nobody; one whose words never reach the cut draws everybody
    more = F.when(F.col("p") <= 0, F.lit(False)).when(F.col("cut_range").isNull(), F.lit(True)).otherwise(drawn)
    out = [*table.columns, "source_size", "target", "copies"]
    counted = rows.withColumn("copies", F.col("whole") + more.cast("int"))
    if rule.where("fit IS NOT NULL").isEmpty():
        return counted.select(*out)
    # a cut inside repeated rows: they are numbered by slices, whose counts give each slice its start
    inside = F.col("fit").isNotNull() & F.coalesce(_order().eqNullSafe(F.col("split")), F.lit(False))
    repeated = save(counted.where(inside).withColumn("__slice", (F.monotonically_increasing_id() % SLICES).cast("int")), "repeated")
    earlier = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = repeated.groupBy("__source", "__slice").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(F.col("__source").alias("__of"), F.col("__slice").alias("__at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    numbered = repeated.join(F.broadcast(starts), F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__slice") == F.col("__at")))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__source", "__slice").orderBy("u"))
    numbered = numbered.withColumn("__place", place).withColumn("copies", F.col("whole") + (F.col("__place") <= F.col("fit")).cast("int"))
    return counted.where(~inside).select(*out).unionByName(numbered.select(*out))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """Per input row: doc_id, source, size, source_size, target, copies, taken."""
    table = save(sized(docs, id_col, text_col, source_col, seed), "sizes")
    return copies_of(table, rules(table, weights, cap)).withColumn("taken", F.col("copies") * F.col("size")).drop("u")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """Each row as often as the mix takes it, all columns as they were."""
    rule = rules(save(sized(docs, id_col, text_col, source_col, seed), "sizes"), weights, cap)
    carried = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")).select("row", F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].alias("source"), word_count(F.col("row")[text_col]).alias("size"))
    carried = carried.withColumn("u", uniform(F.col("doc_id"), F.col("size"), F.col("row")[text_col], seed))
    drawn = copies_of(carried, rule).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
