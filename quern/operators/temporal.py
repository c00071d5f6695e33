"""Temporal and entity features with explicit keys; nothing after a row's own time is read.

Rows of one entity and time are ordered by ``tie``; without one their order, and so what lag, trend and rolling values
read among them, is not defined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.splits import fresh

#: Rows of an entity that one task orders at once where it is split (``by_rows``).
TILE = 100_000
#: Stretches of time that a table is cut into.
STRETCHES = 4096
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def keys(entity: str | list[str]) -> list[str]:
    return [entity] if isinstance(entity, str) else list(entity)


def window_agg(entity: str, ts: str, x: str, seconds: int, how: str = "sum") -> Column:
    """Aggregate over the entity's last ``seconds`` up to and with the row's time. Spark adds up a range's rows again for each row, so where a
    range may hold many rows ``range_agg`` is the way."""
    w = Window.partitionBy(*keys(entity)).orderBy(micros(F.col(ts))).rangeBetween(-seconds * 1_000_000, 0)
    return AGGREGATES[how](x).over(w)


def in_order(entity: str, ts: str, tie: str | None):
    return Window.partitionBy(*keys(entity)).orderBy(ts, *([tie] if tie else []))


def lag(entity: str, ts: str, x: str, steps: int = 1, tie: str | None = None) -> Column:
    return F.lag(x, steps).over(in_order(entity, ts, tie))


def last_rows(entity: str, ts: str, n: int, tie: str | None = None):
    return in_order(entity, ts, tie).rowsBetween(-(n - 1), 0)


def trend(entity: str, ts: str, x: str, n: int = 5, tie: str | None = None) -> Column:
    """Slope of x per second over the entity's last n rows; NULL for one row."""
    seconds = micros(F.col(ts)) / 1e6
    return F.regr_slope(F.col(x), seconds).over(last_rows(entity, ts, n, tie))


def time_since(entity: str, ts: str) -> Column:
    """Seconds from the entity's row before."""
    return (micros(F.col(ts)) - micros(F.lag(ts).over(Window.partitionBy(*keys(entity)).orderBy(ts)))) / 1e6


def rolling_mean(entity: str, ts: str, x: str, n: int = 5, tie: str | None = None) -> Column:
    return F.avg(x).over(last_rows(entity, ts, n, tie))


def rolling_std(entity: str, ts: str, x: str, n: int = 5, tie: str | None = None) -> Column:
    return F.stddev_samp(x).over(last_rows(entity, ts, n, tie))


def stretches(df: DataFrame, ts: str, least: int = 1) -> tuple[Column, int, int]:
    """(number, start of the first, width): the stretch of time a row is in, of ``STRETCHES`` between the first and the last time, each ``least``
    microseconds long or more; missing times come before all."""
    low, high = df.agg(F.min(micros(F.col(ts))), F.max(micros(F.col(ts)))).first()
    width = max(least, ((high or 0) - (low or 0)) // STRETCHES + 1)
    return F.coalesce(F.floor((micros(F.col(ts)) - (low or 0)) / width), F.lit(-1)).cast("long"), (low or 0), width


def by_rows(df: DataFrame, entity: str, ts: str, n: int, make: Callable[[list[str]], dict[str, Column]], tie: str | None = None, tile: int = TILE) -> DataFrame:
    """Add columns that read a row and its entity's ``n`` - 1 rows before it, with no task over a whole entity.

    ``make`` gives the columns for the keys it gets instead of the entity: ``by_rows(df, "user", "ts", 5, lambda e: {"mean":
    rolling_mean(e, "ts", "x", 5)})``. An entity's rows are counted by stretches of time and numbered within each, which gives every row its
    place; tiles of ``tile`` places, with a halo of the n - 1 rows before, are then ordered by themselves. Rows of one time and tie
    in different stretches don't exist, so the result is that of one window over the entity; without a tie equal times have no order.
    """
    tile = max(tile, n)
    names = {x: fresh(df.columns, x) for x in ("_at", "_place", "_tile", "_own")}
    at, place, tiled, own = names.values()
    number, _, _ = stretches(df, ts)
    rows = df.withColumn(at, number)
    counts = rows.groupBy(entity, at).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(entity).orderBy(at)) - F.col("n")
    of, when, first = (fresh(df.columns, x) for x in ("_of", "_when", "_first"))
    counts = counts.select(F.col(entity).alias(of), F.col(at).alias(when), before.alias(first))
    within = F.row_number().over(Window.partitionBy(entity, at).orderBy(ts, *([tie] if tie else []))) - 1
    placed = rows.withColumn(place, within).join(counts, F.col(entity).eqNullSafe(F.col(of)) & (F.col(at) == F.col(when)))
    placed = placed.withColumn(place, (F.col(first) + F.col(place)).cast("long")).drop(of, when, first, at)
    home = F.floor(F.col(place) / tile).cast("long")
    late = F.col(place) % tile >= tile - (n - 1)
    copies = F.array(F.struct(home.alias("t"), F.lit(True).alias("o")), F.struct((home + 1).alias("t"), F.lit(False).alias("o")))
    spread = placed.withColumn(own, F.explode(F.when(late & F.lit(n > 1), copies).otherwise(F.slice(copies, 1, 1))))
    spread = spread.withColumns({tiled: F.col(f"{own}.t"), own: F.col(f"{own}.o")})
    return spread.withColumns(make([entity, tiled])).where(F.col(own)).drop(place, tiled, own)


def by_time(df: DataFrame, entity: str, ts: str, seconds: int, make: Callable[[list[str]], dict[str, Column]]) -> DataFrame:
    """Add columns that read the entity's last ``seconds`` up to a row's time, with no task over a whole entity.

    As ``by_rows``, but each stretch of time (as long as the range at least) is ordered by itself, with a halo of the rows of
    the stretch before that the range reaches back to.
    """
    names = {x: fresh(df.columns, x) for x in ("_tile", "_own")}
    tiled, own = names.values()
    number, low, width = stretches(df, ts, seconds * 1_000_000)
    reaches = micros(F.col(ts)) + seconds * 1_000_000 >= (number + 1) * width + low
    copies = F.array(F.struct(number.alias("t"), F.lit(True).alias("o")), F.struct((number + 1).alias("t"), F.lit(False).alias("o")))
    spread = df.withColumn(own, F.explode(F.when(reaches, copies).otherwise(F.slice(copies, 1, 1))))
    spread = spread.withColumns({tiled: F.col(f"{own}.t"), own: F.col(f"{own}.o")})
    return spread.withColumns(make([entity, tiled])).where(F.col(own)).drop(tiled, own)


def range_agg(df: DataFrame, entity: str, ts: str, seconds: int, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Add ``wanted`` columns (name: (sum, avg, min, max or count; column)) over the entity's last ``seconds`` up to and with the row's time; as
    ``window_agg``, but the work is in proportion to the rows, however many a range holds, and no task sees a whole entity.

    Time is cut into stretches as long as the range. A range is then the end of one stretch, from its start on, and the beginning of the next, up to the
    row: two running aggregates, one backwards over the rows of the stretch before (moved on by the range), one forwards over the row's own. Nothing is
    subtracted, so minima are as easy as sums and large values leave no error behind. Rows without a time are a group of their own.
    """
    tiled, own, at = (fresh([*df.columns, *wanted], x) for x in ("_tile", "_own", "_at"))
    width = max(seconds, 0) * 1_000_000
    time = micros(F.col(ts))
    # A range of no length is the rows of one time; a stretch is a microsecond then, and no row is moved.
    number = (time - F.pmod(time, F.lit(width))) / F.lit(width) if width else time
    number = F.round(number).cast("long")
    home = F.struct(number.alias("t"), F.lit(True).alias("o"), time.alias("a"))
    moved = F.struct((number + 1).alias("t"), F.lit(False).alias("o"), (time + width).alias("a"))
    copies = F.when(time.isNotNull() & F.lit(width > 0), F.array(home, moved)).otherwise(F.array(home))
    spread = df.withColumn(own, F.explode(copies))
    spread = spread.withColumns({tiled: F.col(f"{own}.t"), at: F.col(f"{own}.a"), own: F.col(f"{own}.o")})
    group = Window.partitionBy(*keys(entity), tiled)
    ahead = group.orderBy(F.col(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = group.orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}

    def whole(how: str, x: str) -> Column:
        mine, before = F.when(F.col(own), F.col(x)), F.when(~F.col(own), F.col(x))
        return both[how](AGGREGATES[how](mine).over(ahead), AGGREGATES[how](before).over(back))

    def value(how: str, x: str) -> Column:
        return F.try_divide(whole("sum", x).cast("double"), whole("count", x)) if how == "avg" else whole(how, x)

    return spread.withColumns({name: value(*of) for name, of in wanted.items()}).where(F.col(own)).drop(tiled, own, at)


def group_by_agg(df: DataFrame, entity: str, x: str, how: str = "avg", ts: str | None = None, t_star: str | None = None, split: str | None = None) -> DataFrame:
    """(entity, value) over the rows up to ``t_star``, if one is given, and over the train rows alone where ``split`` names the split column."""
    rows = df.where(F.col(ts) <= F.lit(t_star).cast("timestamp")) if ts and t_star else df
    rows = rows.where(F.col(split) == "train") if split else rows
    return rows.groupBy(entity).agg(AGGREGATES[how](x).alias("value"))


def entity_join(df: DataFrame, attributes: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """Attach one row of attributes per entity, so that no row of ``df`` is doubled: of several for a key the one with the greatest
    ``latest``, and of equal ones (or without ``latest``) the one whose columns come first in their order."""
    rest = [c for c in attributes.columns if c != key]
    order = [F.col(c).alias(f"o{i}") for i, c in enumerate(rest)]
    if latest:
        newest = attributes.groupBy(key).agg(F.max(latest).alias("newest"))
        attributes = attributes.join(newest.withColumnRenamed(key, "newest_key"), (F.col(key) == F.col("newest_key")) & F.col(latest).eqNullSafe(F.col("newest"))).select(*attributes.columns)
    one = attributes.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    one = one.select(F.col(key), *[F.col(f"first.o{i}").alias(c) for i, c in enumerate(rest)])
    return df.join(one, key, "left")


def asof_join(df: DataFrame, attributes: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Add ``asof_value``: ``value`` of the entity's latest attribute row at or before each row's time (NULLs are passed over; of
    rows of one time the greatest value counts).

    A forward fill at two levels, so that no task sees a whole entity: the last value of each stretch of time is carried on over the
    stretches, then both sides' rows are filled within each stretch, from the carried value on. The work is a sort of both sides, never a
    product of rows. Rows of ``df`` keep their columns, whatever their names, but one named asof_value, which is replaced.
    """
    side, v, at, of, when, before = (fresh([*df.columns, *attributes.columns], x) for x in ("_side", "_value", "_at", "_of", "_when", "_carried"))
    df = df.drop("asof_value")
    right = attributes.select(F.col(key), F.col(ts), F.col(value).alias(v)).where(F.col(v).isNotNull() & F.col(ts).isNotNull())
    both = df.withColumn(v, F.lit(None).cast(right.schema[v].dataType)).withColumn(side, F.lit(1)).unionByName(right.withColumn(side, F.lit(0)), allowMissingColumns=True)
    number, _, _ = stretches(both, ts)
    both = both.withColumn(at, number)
    last = both.groupBy(F.col(key).alias(of), F.col(at).alias(when)).agg(F.max(F.when(F.col(side) == 0, F.struct(ts, v))).getField(v).alias(before))
    carried = F.last(before, ignorenulls=True).over(Window.partitionBy(of).orderBy(when).rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(of, when, carried.alias(before)).where(F.col(before).isNotNull())
    inside = Window.partitionBy(key, at).orderBy(ts, side, v).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("asof_value", F.last(v, ignorenulls=True).over(inside)).where(F.col(side) == 1)
    met = F.col(key).eqNullSafe(F.col(of)) & (F.col(at) == F.col(when))
    return filled.join(carried, met, "left").withColumn("asof_value", F.coalesce("asof_value", before)).drop(side, v, at, of, when, before)
