"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected the same number of times, its source's
rate (target words over source words, at most `max_copies`). Documents stand in
order of their size; the expected copies are summed up along that order, one
offset per source is added, and a document is taken once for every whole number
its stretch crosses. Ordering by size makes the words taken differ from the target
by about the largest document at most, whatever the sizes.

The place of a document in the order is found without a task that holds a source:
rows are counted by (source, size) and within equal sizes by hash cell, the
counts are summed up on these small tables, and only the rows of one cell are
numbered together. The number of cells follows the root of the number of rows, so
neither the tables per size nor the cells grow with the rows themselves.

Defined cases: a null text has size 0, and so has one without words; null is a
source of its own, the last; a source without words gets target 0; repeated rows
are documents of their own; an empty table gives an empty one; the other columns
of `docs` go along with `taken copies` only in `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import SPACE_RUN, boxed, split_words, text_key, unboxed, whole

WEIGHTS = (5, 2, 1)       # of the sources by code point, repeating
SHARE = 1.5               # of all words
MAX_COPIES = 2.0
SEED = "mix-1"
LEAST_CELL_ROWS = 256


def _unit(seed: str, *values: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the values only."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(seed), *values)), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source: weights met up to the caps.

    Sources whose cap is reached give their excess to the others by weight until none is above.
    That ends where every target is min(cap, level * weight); sources are capped in order of
    cap / weight, so the level comes from running sums over the (few) sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = sizes.withColumn("weight", F.get(w, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    along = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped_before = F.coalesce(F.sum("cap").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_after = F.sum("weight").over(along.rowsBetween(0, Window.unboundedFollowing))
    goal = F.lit(float(share)) * F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (goal - capped_before) / weight_after)
    # A source is capped if the level that its predecessors leave is above its own cap / weight.
    rows = rows.withColumn("above", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("above"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)
    rows = rows.withColumn("open_level", level["level"])
    return rows.select("source", "source_size", F.when(F.col("above"), F.col("cap")).otherwise(
        F.col("open_level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES,
           seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, text_key, size, source_size, target, copies): a row per row of `docs`."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(source).alias("source"),
        F.size(split_words(whole(text), SPACE_RUN)).cast("long").alias("size"))
    spot = _unit(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("spot", spot)
    # One small table per (source, size): how many documents come before, and the source's total.
    steps = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = steps.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    plan = targets(totals, weights, share, most)
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before_size", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Cells of equal size: rows of a cell are numbered together, cells by the counts before them.
    n_cells = steps.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.greatest(F.lit(LEAST_CELL_ROWS), F.sqrt(F.sum("n"))))).alias("cells"))
    rows = rows.crossJoin(F.broadcast(n_cells)).withColumn("cell", F.floor(F.col("spot") * F.col("cells"))).drop("cells")
    cells = rows.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before_cell", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    of_size = (F.col("c.source").eqNullSafe(F.col("s.source"))) & (F.col("c.size") == F.col("s.size"))
    of_source = F.col("c.source").eqNullSafe(F.col("p.source"))
    cells = (cells.alias("c").join(steps.alias("s"), of_size).join(plan.alias("p"), of_source).select(
        F.col("c.source").alias("at_source"), F.col("c.size").alias("at_size"), F.col("c.cell").alias("at_cell"),
        (F.col("before_size") + F.col("before_cell")).alias("before"), "source_size", "target"))
    inside = Window.partitionBy("source", "size", "cell").orderBy("spot", "doc_id", "text_key")
    rows = rows.withColumn("place", F.row_number().over(inside))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("size") == F.col("at_size"))
                     & (F.col("cell") == F.col("at_cell")))
    place = (F.col("before") + F.col("place")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(seed, F.coalesce(F.col("source"), F.lit("null")))
    crossed = F.floor(offset + place * rate) - F.floor(offset + (place - 1) * rate)
    return rows.select("doc_id", "text_key", "size", "source_size", "target",
                       F.least(crossed, F.lit(int(most))).cast("long").alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    rows = boxed(docs, doc_id, text)
    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((doc_id, "doc_id"), (text, "text"), (source, "source"))])
    taken = copies(narrow, **settings).where("copies > 0")
    # Rows that repeat id and text are told apart by number: their copies are shared out as a list.
    taken = taken.groupBy("doc_id", "text_key").agg(F.sum("copies").cast("int").alias("copies")).select(
        F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "copies")
    first = rows.dropDuplicates(["id", "key"])
    joined = first.join(taken, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
    joined = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return joined.select(*unboxed(joined, docs.columns))
