"""Splits, folds and samples by hash, so that they don't depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import staged


def bucket(key: Column, seed: int = 0, n: int = 10_000) -> Column:
    """A number in [0, n) from the md5 of seed and key; DuckDB can compute the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def rank_key(key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def train_val_test(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Add ``_split``: 20 % test, 20 % of the rest val, else train; no shuffle."""
    b = bucket(F.col(key), seed)
    return df.withColumn("_split", F.when(b < 2000, "test").when(b < 3600, "val").otherwise("train"))


def fresh(columns: list[str], name: str) -> str:
    """``name`` with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_ranges(df: DataFrame, by: list[str]) -> tuple[DataFrame, str]:
    """``df`` as a written table, with a column that numbers the ranges of ``by`` that its rows were dealt into (sampled, so that they are
    even): what is in a range comes before all that is in a later one. Returns the column's name too."""
    spark, part = df.sparkSession, fresh(df.columns, "_range")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.repartitionByRange(n, *by).withColumn(part, F.spark_partition_id())), part


#: Codes that are broadcast at most.
FEW = 100_000


def places(df: DataFrame, by: str) -> DataFrame:
    """(``by``, place): the distinct values' places, 0.. in sorted order. Values are numbered within ranges and only the number of values in
    each range, one for each partition, comes to the driver; there is no window over the whole table. Up to ``FEW`` of them are marked to be broadcast: a
    join that deals rows by a value that half of them have would bring those to one task."""
    rows, part = in_ranges(df.select(by).where(F.col(by).isNotNull()).distinct(), [by])
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())
    starts, total = [], 0
    for k, size in sizes:
        starts.append((k, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts, "range_of int, first_place long")
    within = F.row_number().over(Window.partitionBy(part).orderBy(by)) - 1
    placed = rows.withColumn("place_in_range", within).join(F.broadcast(offsets), F.col(part) == F.col("range_of"))
    out = placed.select(by, (F.col("first_place") + F.col("place_in_range")).alias("place"))
    return F.broadcast(out) if total <= FEW else out


def label_encode(df: DataFrame, label: str) -> DataFrame:
    """Add ``label_code``: 0.. in sorted order over all rows; null for a null label. Any number of distinct labels (``places``)."""
    codes = places(df, label).select(F.col(label), F.col("place").cast("int").alias("label_code"))
    return df.join(codes, label, "left")


def equal_tiles(df: DataFrame, key: str, tiles: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``fold``: ``tiles`` parts of each group ``by`` in the order of the key's hash, whose sizes differ by one at most.

    As ntile over each group, but no task sorts a whole group: rows are counted by ranges of the hash (65,536 of them), the
    counts before a range are added up over that small table, and only a range's rows are numbered together. A column
    named fold is replaced, others may have any name.
    """
    keep = [c for c in df.columns if c != "fold"]
    h, r, p = (fresh(df.columns, c) for c in ("_hash", "_range", "_place"))
    rows = df.select(*keep).withColumn(h, rank_key(F.col(key), seed)).withColumn(r, F.substring(h, 1, 4))
    groups = [f"by_{i}" for i in range(len(by))]
    ranges = rows.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(r).alias("range_of")).groupBy(*groups, "range_of").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*groups).orderBy("range_of").rowsBetween(Window.unboundedPreceding, -1)
    side = ranges.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*groups))})
    side = side.select(*groups, "range_of", F.struct("before", "total").alias(fresh(df.columns, "_sizes")))
    met = F.col(f"rows.{r}") == F.col("side.range_of")
    for c, g in zip(by, groups, strict=True):
        met = met & F.col(f"rows.{c}").eqNullSafe(F.col(f"side.{g}"))
    sizes = F.col(f"side.{fresh(df.columns, '_sizes')}")
    numbered = rows.withColumn(p, F.row_number().over(Window.partitionBy(*by, r).orderBy(h)) - 1)
    place, total = F.col(f"rows.{p}") + sizes["before"], sizes["total"]
    least, more = F.floor(total / tiles), total % tiles  # the first ``more`` tiles have one row more
    late = F.try_divide(place - more * (least + 1), least)
    fold = F.when(place < more * (least + 1), F.floor(place / (least + 1))).otherwise(more + F.floor(late))
    return numbered.alias("rows").join(side.alias("side"), met).select(*[F.col(f"rows.`{c}`") for c in keep], fold.cast("int").alias("fold"))


def k_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 42, exact: bool = False) -> DataFrame:
    """Add ``fold``. ``exact``: sizes differ by one at most (``equal_tiles``); else by hash, without a shuffle."""
    if not exact:
        return df.withColumn("fold", bucket(F.col(key), seed, folds).cast("int"))
    return equal_tiles(df, key, folds, seed)


def stratified_k_fold(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``, balanced within each label (null is one)."""
    return equal_tiles(df, key, folds, seed, (label,))


def mini_sample(df: DataFrame, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """The n rows of smallest hash with ``part``: the first 80 % train, the rest eval."""
    h = fresh(df.columns, "_hash")
    top = df.withColumn(h, rank_key(F.col(key), seed)).orderBy(h).limit(n)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(h))
    return top.withColumn("part", F.when(place <= F.floor(total * 0.8), "train").otherwise("eval")).drop(h)
