"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, named, small, staged, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Columns that ``copies`` adds, after its prefix.
ADDED = ("size", "source_size", "target", "rate", "copies")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, weight, target and rate = target / source_size.

    ``sizes`` has source and size. The targets add up to ``total`` times all sizes, in proportion to the
    weights, but none exceeds ``most`` times its source; what is cut is shared again by weight. That is
    min(cap, level * weight) for one level, found by one pass over the sources in order of cap / weight:
    the level is (total - caps before) / (weights from here on) at the first source whose cap it doesn't reach.
    Sources without words have target 0 and rate 0. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.array(*[F.lit(w).cast("double") for w in weights])
    ranked = per.select("source", "source_size", F.get(pick, (place - 1) % len(weights)).alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total))
    level = ranked.withColumn("level", (everything - before) / after)
    open_ = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(Window.partitionBy())
    target = F.when(open_.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), open_ * F.col("weight")))
    out = level.withColumn("target", target)
    return out.select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and seed only."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + seed)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: str = "mix", prefix: str = "mix_") -> DataFrame:
    """Every document with mix_size, mix_source_size, mix_target, mix_rate and mix_copies (columns so named are replaced).

    mix_copies = floor(rate) + one Bernoulli draw with the fraction as its probability, seeded by the key
    (by the text's md5 where the key is null); rows with equal keys share their draw. Null sources are a
    source of their own, null texts have size 0. A single very large source is aggregated map-side first;
    the join back is a broadcast behind a check of the number of sources, else shuffled with skew handling.
    """
    sized = docs.drop(*[f"{prefix}{c}" for c in ADDED]).withColumn(f"{prefix}size", word_count(F.col(text)))
    targets = staged(source_targets(sized.select(F.col(source).alias("source"), F.col(f"{prefix}size").alias("size")), weights, total, most))
    own = fresh(sized.columns, ("source",), "quern_mix_") + "source"
    side = small(targets.select(F.col("source").alias(own), F.col("source_size").alias(f"{prefix}source_size"), F.col("target").alias(f"{prefix}target"), F.col("rate").alias(f"{prefix}rate")))
    seeded = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rate = F.col(f"{prefix}rate")
    extra = (draw(seeded, seed) < rate - F.floor(rate)).cast("long")
    return sized.join(side, F.col(source).eqNullSafe(F.col(own))).drop(own).withColumn(f"{prefix}copies", (F.floor(rate) + extra).cast("long"))


def emit(mixed: DataFrame, prefix: str = "mix_") -> DataFrame:
    """Repeat each row of ``copies`` mix_copies times (0 drops it) and take the columns away that ``copies`` added."""
    times = F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}copies"))
    rows = mixed.where(F.col(f"{prefix}copies") > 0).withColumn(fresh(mixed.columns, ("",), "mix_copy"), F.explode(times))
    return rows.select(*named(c for c in mixed.columns if c not in {f"{prefix}{x}" for x in ADDED}))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as ``copies`` says, with their columns whatever their names are."""
    prefix = fresh(docs.columns, ADDED, "mix_")
    return emit(copies(docs, prefix=prefix, **options), prefix).select(*named(docs.columns))
