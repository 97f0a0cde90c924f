"""Order-dependent operators that survive a hot key.

A window partitioned by a source address, a flow or a file puts the whole key
into one task.  These helpers find the few keys that are too large for that
(`hot_keys`), leave every other key on the plain window, and cut each hot key
into slices of its ordering column.  A slice is processed on its own and what
it needs from earlier slices arrives as one small row per (key, slice).

Slices only decide where rows are processed; any cut gives the same result.
Two session settings steer them:

    spark.flowspark.hotMinRows   rows from which a key counts as hot, and about the rows of a slice (1,000,000)
    spark.flowspark.hotSlices    most slices per hot key (16384)

Null and NaN of an ordering column have the place that the sort gives them: null
before and NaN behind all numbers when ascending, the reverse when descending
(`descending`). Text and time columns are turned into numbers that ascend with
them by `slice_number`.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.session import store

DEFAULT_MIN_ROWS = 1_000_000
MAX_SLICES = 1 << 14      # per key; beyond 1.6e10 rows of one key slices grow, and spill
SMALL_TABLE_ROWS = 100_000
SMALL_TABLE_BYTES = 32 << 20
INFINITY = float("inf")


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(name, str(default)))


def min_hot_rows(df: DataFrame) -> int:
    return _setting(df, "spark.flowspark.hotMinRows", DEFAULT_MIN_ROWS)


def slice_count(df: DataFrame) -> int:
    return max(2, min(MAX_SLICES, _setting(df, "spark.flowspark.hotSlices", MAX_SLICES)))


def _same_keys(left: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality between `keys` of the left side and the renamed right side."""
    return reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"`{prefix}{k}`")) for k in keys))


def _renamed(table: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    for k in keys:
        table = table.withColumnRenamed(k, prefix + k)
    return table


def ascending(value: Column) -> Column:
    """`value` as a number whose order is that of an ascending sort, null and NaN included."""
    number = value.cast("double")
    return F.when(number.isNull(), F.lit(-INFINITY)).when(F.isnan(number), F.lit(INFINITY)).otherwise(number)


def descending(value: Column) -> Column:
    """A number that ascends as a descending sort by `value` goes on, null and NaN included."""
    return -ascending(value)


def slice_number(df: DataFrame, name: str) -> Column:
    """A number that ascends with the column `name` of any sortable type; ties are allowed.

    Text is ranked by the six bytes behind the start that all values share, which
    one aggregation finds.
    """
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if not isinstance(kind, T.StringType):
        return value.cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    shared = 0
    for a, b in zip((low or "").encode(), (high or "").encode(), strict=False):
        if a != b:
            break
        shared += 1
    six = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), shared + 1, 6)), 12, "0")
    return F.conv(six, 16, 10).cast("double")


@dataclass
class HotKeys:
    """Keys with at least hotMinRows rows (so no more than rows / hotMinRows), with the slice bounds of the ordering column."""

    keys: list[str]
    table: DataFrame
    order: Column | None = None

    def _join(self, df: DataFrame, how: str, columns: list[str]) -> DataFrame:
        side = _renamed(self.table.select(*[F.col(f"`{k}`") for k in self.keys], *columns), self.keys, "__hot_")
        if not self.keys:
            return df.crossJoin(F.broadcast(side)) if how == "inner" else df
        joined = df.join(F.broadcast(side), _same_keys(df, self.keys, "__hot_"), how)
        return joined if how in ("left_semi", "left_anti") else joined.drop(*["__hot_" + k for k in self.keys])

    def rows(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys."""
        return self._join(df, "left_semi", []) if self.keys else df

    def others(self, df: DataFrame) -> DataFrame:
        """Rows of every other key (none when the whole input is one key)."""
        return self._join(df, "left_anti", []) if self.keys else df.limit(0)

    def with_columns(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Rows of hot keys with columns of the key table."""
        return self._join(df, "inner", columns)

    def sliced(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys with the number of their slice in `__slice`."""
        joined = self.with_columns(df, ["__bounds"])
        return joined.withColumn("__slice", _slice_number(ascending(self.order), F.col("__bounds"))).drop("__bounds")


def _slice_number(value: Column, bounds: Column) -> Column:
    """How many bounds are <= value, by binary search."""
    steps = F.array(*[F.lit(MAX_SLICES >> i) for i in range(MAX_SLICES.bit_length())])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= value, at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


#: A number that ascends with the order of the rows, or what finds it; that is asked only if there is a hot key.
SliceOn = Column | Callable[[], Column]


def hot_keys(df: DataFrame, keys: list[str], order: SliceOn | None = None) -> HotKeys | None:
    """The keys of `df` with at least hotMinRows rows, or None.

    Runs one aggregation (partial sums before the shuffle); a row per hot key comes
    to the driver, with `order` also the slice bounds, about one per
    hotMinRows / 2 rows of the key.
    """
    floor = min_hot_rows(df)
    cols = [F.col(f"`{k}`") for k in keys]
    sizes = (
        df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= floor)
    )
    found = sizes.collect()
    if not found:
        return None
    spark = df.sparkSession
    key_schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    if order is None:
        return HotKeys(keys, spark.createDataFrame([tuple(r)[:-1] for r in found], key_schema))
    order = order if isinstance(order, Column) else order()
    # Bounds are quantiles of the ordering column; a smaller hot key takes every step-th of them.
    wanted = lambda size: max(2, -(-2 * size // floor))
    n = min(slice_count(df), wanted(max(r["__n"] for r in found)))
    step = lambda size: max(1, n // min(n, wanted(size)))
    stepped = T.StructType(list(key_schema) + [T.StructField("__step", T.IntegerType())])
    steps = spark.createDataFrame([(*tuple(r)[:-1], step(r["__n"])) for r in found], stepped)
    rows = HotKeys(keys, steps).with_columns(df.select(*cols, ascending(order).alias("__order")), ["__step"])
    cuts = F.percentile_approx("__order", [i / n for i in range(1, n)], 10 * n)
    bounds = rows.groupBy(*cols, "__step").agg(cuts.alias("__all")).select(
        *cols, F.filter("__all", lambda x, i: i % F.col("__step") == F.col("__step") - 1).alias("__bounds")).collect()
    schema = T.StructType(list(key_schema) + [T.StructField("__bounds", T.ArrayType(T.DoubleType()))])
    return HotKeys(keys, spark.createDataFrame([tuple(r) for r in bounds], schema), order)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one row per (hot key, slice): about two per hotMinRows rows of the input."""
    on = keys + ["__slice"]
    side = F.broadcast(_renamed(carry, on, "__c_"))
    return rows.join(side, _same_keys(rows, on, "__c_"), "left").drop(*["__c_" + k for k in on])


def number_rows(df: DataFrame, keys: list[str], order: list[Column], slice_on: SliceOn,
                name: str = "row_number", limit: int | None = None, most: int | None = None) -> DataFrame:
    """row_number() per key; `slice_on` is numeric and ascends with `order`.

    With `limit`, only rows numbered up to it are kept. `most` is what is known of the number of rows: below
    hotMinRows no key needs looking for.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    hot = None if most is not None and most < min_hot_rows(df) else hot_keys(df, keys, slice_on)

    def plain(rows):
        return rows.withColumn(name, F.row_number().over(window).cast("long"))

    def capped(rows):
        return rows if limit is None else rows.where(F.col(name) <= limit)

    if hot is None:
        return capped(plain(df))
    rows = hot.sliced(df)
    sizes = rows.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, "__slice", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    rows = _with_carry(rows, carry, keys)
    if limit is not None:
        rows = rows.where(F.col("__before") < limit)
    within = Window.partitionBy(*keys, "__slice").orderBy(*order)
    rows = rows.withColumn(name, F.row_number().over(within) + F.col("__before")).drop("__slice", "__before")
    return capped(plain(hot.others(df)).unionByName(rows) if keys else rows)


def previous_value(df: DataFrame, keys: list[str], order: list[Column], slice_on: SliceOn,
                   value: Column, name: str, hot: HotKeys | None | str = "find") -> DataFrame:
    """lag(value) per key; `order` is a list of plain columns, ascending."""
    if hot == "find":
        hot = hot_keys(df, keys, slice_on)
    window = Window.partitionBy(*keys).orderBy(*order)

    def plain(rows):
        return rows.withColumn(name, F.lag(value).over(window))

    if hot is None:
        return plain(df)
    rows = hot.sliced(df)
    ends = rows.groupBy(*keys, "__slice").agg(F.max_by(F.struct(value.alias("v")), F.struct(*order)).alias("__end"))
    along = Window.partitionBy(*keys).orderBy("__slice")
    carry = ends.select(*keys, "__slice", F.lag("__end").over(along).alias("__carry"))
    within = Window.partitionBy(*keys, "__slice").orderBy(*order)
    rows = (
        _with_carry(rows, carry, keys)
        .withColumn(name, F.coalesce(F.lag(F.struct(value.alias("v"))).over(within), F.col("__carry"))["v"])
        .drop("__slice", "__carry")
    )
    return plain(hot.others(df)).unionByName(rows) if keys else rows


def running_sums(df: DataFrame, keys: list[str], order: list[Column], slice_on: SliceOn,
                 sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key, one new column per entry of `sums`."""
    hot = hot_keys(df, keys, slice_on)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def plain(rows):
        return rows.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})

    if hot is None:
        return plain(df)
    rows = hot.sliced(df)
    totals = rows.groupBy(*keys, "__slice").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "__slice", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_carry(rows, carry, keys).withColumns(
        {n: F.sum(c).over(within) + F.col(f"__b_{n}") for n, c in sums.items()})
    rows = rows.drop("__slice", *[f"__b_{n}" for n in sums])
    return plain(hot.others(df)).unionByName(rows) if keys else rows


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], small_rows: int = SMALL_TABLE_ROWS,
                table_keys: DataFrame | None = None) -> DataFrame:
    """Left join to a table with one row per key.

    The table is broadcast only after its size was checked; where `table` is
    costly, `table_keys` is a cheaper frame with at least as many rows to count.
    A larger table is joined by a shuffle; rows of hot keys then stay out of the
    shuffle and meet their table rows by broadcast (a row per hot key).
    """
    if _is_small(table if table_keys is None else table_keys, small_rows):
        return df.join(F.broadcast(table), keys, "left")
    return keyed_join(df, table, keys, hot_keys(df, keys))


def _is_small(table: DataFrame, rows: int = SMALL_TABLE_ROWS, size: int = SMALL_TABLE_BYTES) -> bool:
    """Whether a table is below both limits, in rows and in bytes as text."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    n, stored = table.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return n <= rows and stored <= size


def keyed_join(df: DataFrame, table: DataFrame, keys: list[str], hot: HotKeys | None) -> DataFrame:
    """Left shuffle join on `keys`; rows of the given hot keys join by broadcast."""
    if hot is None:
        return df.join(table, keys, "left")
    cold = hot.others(df).join(table, keys, "left")
    warm = hot.rows(df).join(F.broadcast(hot.rows(table)), keys, "left")
    return cold.unionByName(warm)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and probability; null values are left out, NaN is the largest.

    One aggregation counts the groups. A group below hotMinRows rows is counted by distinct value and summed up, and so is an input
    without groups that has so few distinct values, however many rows. In a larger one the wanted ranks are closed in by counts alone, and after two or three rounds fewer than
    hotMinRows rows or a single value are left for each. Columns: `by`, `prob`, `quantile`.
    """
    by = list(by or [])
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    if not by:
        most = min_hot_rows(df)
        total, distinct = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("__v")).first()
        few = total < most or distinct < most // 2        # the estimate only chooses between two exact ways
        return _whole_quantiles(rows, probs, total) if few else _selected_quantiles(rows, by, probs, most)
    hot = hot_keys(rows, by)
    if hot is None:
        return _counted_quantiles(rows, by, probs)
    return _counted_quantiles(hot.others(rows), by, probs).unionByName(_selected_quantiles(hot.rows(rows), by, probs, min_hot_rows(df)))


def _whole_quantiles(rows: DataFrame, probs: list[float], total: int) -> DataFrame:
    """Quantiles of `total` rows without groups: only the values at the wanted ranks leave the running count."""
    if not total or not probs:
        return rows.select(F.lit(0.0).alias("prob"), F.col("__v").alias("quantile")).limit(0)
    ranks = {float(p): (math.floor(p * (total - 1)), math.ceil(p * (total - 1)), p * (total - 1) % 1) for p in probs}
    wanted = sorted({r for low, high, _ in ranks.values() for r in (low, high)})
    upto = F.sum("__n").over(Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    steps = rows.groupBy("__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__upto", upto)
    here = reduce(lambda a, b: a | b, (F.col("__upto").between(r + 1, F.col("__n") + r) for r in wanted), F.lit(False))
    at = lambda r: F.max(F.when(F.col("__upto").between(r + 1, F.col("__n") + r), F.col("__v")))
    found = steps.where(here).agg(*[at(r).alias(f"r{r}") for r in wanted])
    lines = [F.struct(F.lit(p).alias("prob"), (F.col(f"r{low}") + (F.col(f"r{high}") - F.col(f"r{low}")) * F.lit(part)).alias("quantile"))
             for p, (low, high, part) in ranks.items()]
    return found.select(F.inline(F.array(*lines)))




def _counted_quantiles(rows: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    counted = rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*by)
    steps = counted.withColumns({
        "__upto": F.sum("__n").over(whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)), "__total": F.sum("__n").over(whole)})
    at = F.col("p") * (F.col("__total") - 1)
    points = steps.select(
        *by, "__v", "__n", "__upto", "__total",
        F.explode(F.filter(
            F.array(*[F.lit(float(p)) for p in probs]),
            lambda p: (F.ceil(p * (F.col("__total") - 1)) >= F.col("__upto") - F.col("__n"))
            & (F.floor(p * (F.col("__total") - 1)) < F.col("__upto")),
        )).alias("p"),
    )
    low, high = F.floor(at), F.ceil(at)
    covers = lambda k: (k >= F.col("__upto") - F.col("__n")) & (k < F.col("__upto"))
    ends = points.groupBy(*by, F.col("p").alias("prob")).agg(
        F.max(F.when(covers(low), F.col("__v"))).alias("__low"),
        F.max(F.when(covers(high), F.col("__v"))).alias("__high"),
        F.max(at - low).alias("__part"),
    )
    return ends.select(*by, "prob", (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias("quantile"))


GRID, SKETCH_ACCURACY, GRID_MARGIN = 1000, 10_000, 2      # the sketch is off by a tenth of a grid step
OCTAVE_CELLS = 64


def _cell(value: Column) -> Column:
    """A whole number that never falls as `value` rises, NaN last: 64 cells between a number and its double, either sign."""
    size = F.floor(F.log2(F.least(F.abs(value), F.lit(sys.float_info.max))) * OCTAVE_CELLS) + 1100 * OCTAVE_CELLS
    return F.when(F.isnan(value), 1 << 20).when(value > 0, size).when(value < 0, -size).otherwise(0).cast("int")


def _cell_state(rows: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Where every wanted rank (`side` 0 and 1 of a probability) lies, from one count by cell: an open range or, in a cell of one value, that value."""
    cells = rows.groupBy(*by, _cell(F.col("__v")).alias("__cell")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    whole = Window.partitionBy(*by)                           # some thousand rows a group at most
    along = whole.orderBy("__cell")
    cells = cells.withColumns({
        "__upto": F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, 0)), "__total": F.sum("__n").over(whole),
        "__from": F.lag("__most").over(along), "__to": F.lead("__least").over(along)})
    at = F.col("p") * (F.col("__total") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side")) for p in probs for side in (0, 1)])).alias("w")
    cells = cells.select("*", wanted).select("*", "w.*").withColumn("__rank", F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at)))
    below = F.col("__upto") - F.col("__n")
    return cells.where((F.col("__rank") >= below) & (F.col("__rank") < F.col("__upto"))).select(
        *by, "p", "side", "__total", "__rank", "__from", "__to", below.alias("__below"), F.col("__n").alias("__inside"),
        F.when(F.col("__least") == F.col("__most"), F.col("__least")).alias("__value"))


def _selected_quantiles(rows: DataFrame, by: list[str], probs: list[float], floor: int) -> DataFrame:
    """Quantiles of large groups (so few that the state is broadcast: two rows per probability and `floor` rows).

    The state of a wanted rank is an open range of values, the number of rows below it and inside. It begins as the
    cell of a logarithmic scale that holds the rank, as cells are cheap to count; a sketch has to look at fewer rows then. A round
    picks two values a < b near the rank from a sketch and counts what lies below, at, between and above them, so the rank
    falls on a, on b or into one of three smaller ranges, however far the sketch is off.
    """
    key = [*by, "p", "side"]
    at = F.col("p") * (F.col("__total") - 1)
    state = store(_cell_state(rows, by, probs), "quantile-state")
    sizes = state.select(*by, "p", "__total").distinct()

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        if not keys:
            return left.crossJoin(F.broadcast(right))
        return left.join(F.broadcast(_renamed(right, keys, "__q_")), _same_keys(left, keys, "__q_")).drop(*["__q_" + k for k in keys])

    def inside(table: DataFrame) -> DataFrame:
        v, low, high = F.col("__v"), F.col("__from"), F.col("__to")
        return joined(rows, table, by).where((low.isNull() | (v > low)) & (high.isNull() | (v < high)))

    wide = F.col("__value").isNull() & (F.col("__inside") > floor)
    while not state.where(wide).isEmpty():
        grid = F.percentile_approx("__v", [i / GRID for i in range(GRID + 1)], SKETCH_ACCURACY)
        sketch = inside(state.where(wide)).groupBy(*key).agg(grid.alias("__grid"))
        near = F.floor((F.col("__rank") - F.col("__below")) * GRID / F.col("__inside")).cast("int")
        pivots = store(joined(state.where(wide), sketch, key).withColumns({
            "__a": F.get("__grid", F.greatest(F.lit(0), near - GRID_MARGIN)),
            "__b": F.get("__grid", F.least(F.lit(GRID), near + 1 + GRID_MARGIN))}).drop("__grid"), "quantile-pivots")
        v, a, b = F.col("__v"), F.col("__a"), F.col("__b")
        counts = inside(pivots).groupBy(*key).agg(
            F.count_if(v < a).alias("c1"), F.count_if(v == a).alias("c2"), F.count_if((v > a) & (v < b)).alias("c3"),
            F.count_if((v == b) & (v > a)).alias("c4"))
        step = joined(pivots, counts, key)
        rank = F.col("__rank") - F.col("__below")
        upto = [F.lit(0), F.col("c1"), F.col("c1") + F.col("c2"), F.col("c1") + F.col("c2") + F.col("c3"), F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")]
        place = sum(((rank >= u).cast("int") for u in upto[1:]), F.lit(0))        # 0 below a, 1 at a, 2 between, 3 at b, 4 above
        step = step.withColumn("__place", place).select(
            *key, "__total", "__rank",
            F.when(F.col("__place") == 2, a).when(F.col("__place") == 4, b).otherwise(F.col("__from")).alias("__from"),
            F.when(F.col("__place") == 0, a).when(F.col("__place") == 2, b).otherwise(F.col("__to")).alias("__to"),
            (F.col("__below") + F.get(F.array(*upto), F.col("__place"))).alias("__below"),
            F.get(F.array(F.col("c1"), F.lit(0), F.col("c3"), F.lit(0), F.col("__inside") - upto[4]), F.col("__place")).alias("__inside"),
            F.when(F.col("__place") == 1, a).when(F.col("__place") == 3, b).alias("__value"))
        state = store(state.where(~wide).unionByName(step), "quantile-state")
    open_ = F.col("__value").isNull()
    counted = inside(state.where(open_)).groupBy(*key, "__rank", "__below", "__v").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("__upto", F.sum("__n").over(along) + F.col("__below"))
    last = counted.where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n"))).select(
        *key, F.col("__v").alias("__value"))
    part = sizes.select(*by, F.col("p").alias("prob"), (at - F.floor(at)).alias("__part")).distinct()
    ends = state.where(~open_).select(*key, "__value").unionByName(last).groupBy(*by, F.col("p").alias("prob")).agg(
        F.max(F.when(F.col("side") == 0, F.col("__value"))).alias("__low"), F.max(F.when(F.col("side") == 1, F.col("__value"))).alias("__high"))
    return joined(ends, part, [*by, "prob"]).select(
        *by, "prob", (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias("quantile"))


def _attach_totals(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Totals per group (one row each) onto rows: by broadcast if there are few groups, else by shuffle with hot groups apart."""
    if not by:
        return df.crossJoin(F.broadcast(totals))
    side = _renamed(totals, by, "__g_")

    def joined(rows, table):
        return rows.join(table, _same_keys(rows, by, "__g_"), "inner").drop(*["__g_" + k for k in by])
    if _is_small(df.select(*by).distinct()):
        return joined(df, F.broadcast(side))
    hot = hot_keys(df, by)
    if hot is None:
        return joined(df, side)
    return joined(hot.others(df), side).unionByName(joined(hot.rows(df), F.broadcast(_renamed(hot.rows(totals), by, "__g_"))))
