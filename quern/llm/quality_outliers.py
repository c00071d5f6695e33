"""Quality rules: plain rules on a text's statistics, and robust multivariate outliers by language and source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, named, small, staged, unstage

SPACES, SYMBOL = r"[ \t-\r]+", r"[#*$%&|<>]"
#: Words in a window of the repetition rule.
WINDOW = 3
#: Transformed statistics, and what of each one's spread is always allowed for (several are 0 in most texts).
P, FLOORS = 5, (0.25, 0.05, 0.06, 0.15, 0.15)
#: Part of a group's rows that its estimate is made from, and concentration steps.
SHARE, STEPS = 0.75, 6
#: What makes the covariance of the nearest 75 % of normal rows in five dimensions that of all: 0.75 / P(chi2 of 7 <= 6.626).
CONSISTENT = 1.41
#: Rows' weight of the estimate for all rows in each group's.
PRIOR = 10
#: The squared distance that 1 of 10,000 normal rows exceeds: chi2 of 5.
CUTOFF = 25.74
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "distance", "kept"]


def covered(starts: Column) -> Column:
    """How many places windows at these sorted places cover."""
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["total"] + p + WINDOW - F.greatest(a["end"], p)).alias("total"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step, lambda a: a["total"])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words (long) of whole texts; a null text counts as empty.

    Everything is row by row within one projection. Windows are compared by 64-bit hashes; they are only sorted where some repeat.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    bare = F.trim(body, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare != "", F.split(bare, SPACES)).otherwise(F.array().cast("array<string>"))
    out = docs.withColumns({"_words": words, "_lines": lines, "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long")})
    w = F.col("_words")
    hashes = F.transform(F.slice(w, 1, F.size(w) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    out = out.withColumn("_windows", F.when(F.size(w) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    h = F.col("_windows")
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col("_placed")
    twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    repeats = F.when(s.isNotNull(), covered(F.sort_array(F.transform(twice, lambda x: x["p"])))).otherwise(0)
    return out.select(
        *docs.columns, F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"),
    )

def vector(stats: DataFrame) -> DataFrame:
    """Add the transformed statistics x0 to x4: logarithms of length and word length, square roots of the shares of symbols, repeated
    lines and repeated words, which makes their spread nearly the same at every length."""
    n = F.col("n_words") + 1
    shares = {"x2": F.col("n_symbols") / (F.col("word_chars") + 1), "x3": F.col("n_dup_lines") / (F.col("n_lines") + 1), "x4": F.col("n_repeat_words") / n}
    return stats.withColumns({"x0": F.log(n.cast("double")), "x1": F.log((F.col("word_chars") + 1) / n)} | {k: F.sqrt(v) for k, v in shares.items()})


def bin_at(frame: DataFrame, keys: list[str], bin_: str, share: float) -> DataFrame:
    """Per group the least bin up to which at least ``share`` of its rows lie; rows are counted by bin before any shuffle."""
    counts = frame.groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("n"))
    up_to, whole = Window.partitionBy(*keys).orderBy(bin_), Window.partitionBy(*keys)
    counts = counts.withColumns({"below": F.sum("n").over(up_to), "all": F.sum("n").over(whole)})
    return counts.where(F.col("below") >= F.col("all") * share).groupBy(*keys).agg(F.min(bin_).alias(bin_))


def factor(estimates: DataFrame) -> DataFrame:
    """Add the Cholesky factor l_ij of the covariance c_ij plus the floors' squares."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return estimates


def distanced(frame: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        frame = frame.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    squares = [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]
    return frame.withColumn("d2", sum(squares[1:], squares[0]))


def closeness(d2: Column) -> Column:
    """The bin of a squared distance; bins are 1/256 wide in ln(1 + d2)."""
    return F.floor(F.log(d2 + 1) * 256)


def moments(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the number of rows, means m_i and covariances c_ij, from sums around the group's old centre o_i."""
    around = [F.col(f"x{i}") - F.col(f"o{i}") for i in range(P)]
    sums = [F.avg(around[i]).alias(f"a{i}") for i in range(P)] + [F.avg(around[i] * around[j]).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]
    out = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.first(f"o{i}").alias(f"o{i}") for i in range(P)], *sums)
    covariances = [(F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    return out.select(*keys, "n", *[(F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(P)], *covariances)


def starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two first estimates for each group around its medians: spreads by median absolute deviation alone (start 0), and the same with
    the correlations of the rows' spatial signs (start 1), of which distant rows have no more than others."""
    long = rows.select(*keys, F.posexplode(F.array(*[F.col(f"x{i}") for i in range(P)])).alias("dim", "x"))
    half = bin_at(long.withColumn("b", F.round(F.col("x") * 1024).cast("long")), [*keys, "dim"], "b", 0.5).select(*keys, "dim", (F.col("b") / 1024).alias("middle"))
    off = matched(long, half, [*keys, "dim"]).withColumn("b", F.round(F.abs(F.col("x") - F.col("middle")) * 1024).cast("long"))
    spread = bin_at(off, [*keys, "dim"], "b", 0.5).select(*keys, "dim", (1.4826 * F.col("b") / 1024).alias("mad"))
    pick = lambda name, i: F.max(F.when(F.col("dim") == i, F.col(name)))
    wide = matched(half, spread, [*keys, "dim"]).groupBy(*keys).agg(*[pick("middle", i).alias(f"m{i}") for i in range(P)], *[F.sqrt(pick("mad", i) ** 2 + FLOORS[i] ** 2).alias(f"s{i}") for i in range(P)])
    signs = matched(rows, wide, keys)
    signs = signs.withColumns({f"u{i}": (F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(P)})
    signs = signs.withColumn("length", sum((F.col(f"u{i}") ** 2 for i in range(P)), F.lit(1e-9)))
    products = signs.groupBy(*keys).agg(*[F.avg(F.col(f"u{i}") * F.col(f"u{j}") / F.col("length")).alias(f"r{i}{j}") for i in range(P) for j in range(i)])
    both = matched(wide, products, keys).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    covariance = lambda i, j: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.when(F.col("start") == 1, F.col(f"r{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}")).otherwise(0.0)
    return both.select(*keys, "start", *[f"m{i}" for i in range(P)], *[covariance(i, j).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])


def matched(left: DataFrame, right: DataFrame, keys: list[str], hint: Callable[[DataFrame], DataFrame] = lambda df: df, how: str = "inner") -> DataFrame:
    """Join by keys that may be null; the keys stay once."""
    other = right.select([F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return left.join(hint(other), reduce(lambda a, b: a & b, same), how).drop(*[f"_{c}" for c in keys])


def fit(rows: DataFrame, keys: list[str], share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates for each group of ``rows`` (columns x0 to x4): count n, means m_i, covariances c_ij.

    Each of a fixed number of concentration steps measures all rows by the last estimate, takes the nearest ``share`` of each group (whole
    bins of distance, so ties stay together) and estimates anew from these. Both starts go their way side by side; the one that ends with the
    smaller determinant is the group's. Groups only meet as partial counts and sums, whatever their size.
    """
    own = [*keys, "start"]
    estimates = staged(starts(rows, keys), narrow=True)
    hint = F.broadcast if small(estimates) is not estimates else (lambda df: df)
    for _ in range(steps):
        measured = distanced(matched(rows, factor(estimates), keys, hint)).withColumn("near", closeness(F.col("d2")))
        limit = bin_at(measured, own, "near", share).withColumnRenamed("near", "limit")
        nearest = matched(measured, limit, own, hint).where("near <= limit").withColumns({f"o{i}": F.col(f"m{i}") for i in range(P)})
        last, estimates = estimates, staged(moments(nearest, own), narrow=True)
        unstage(last)
    volume = factor(estimates).withColumn("volume", sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))
    names = ["n", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i in range(P) for j in range(i + 1)]]
    return volume.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("volume", "start")).alias("e")).select(*keys, "e.*")


def judge(docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), share: float = SHARE, steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """The columns of ``docs`` but its text, with n_words, the statistics, base_failed, distance (squared; null where base_failed) and kept.

    A text fails the plain rules with fewer than 50 words or more than half of them in repeated windows. The others are held against the robust
    estimate of their language and source: rejected if the squared distance is over ``cutoff``. That estimate is the mean of the
    group's own, with the weight of its nearest rows, and that of all rows, with the weight of ``PRIOR`` rows; so a group of one row is judged too.
    A null or empty text has no words and fails. Null languages and sources are groups of their own. Each row is judged by itself,
    so repeated rows and ties have one fate; an empty table gives an empty one. Where ``docs`` has columns of the new names, the new ones
    get underscores.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    rest = [c for c in docs.columns if c != text]
    row = F.struct(*named(rest)).alias("row") if rest else F.lit(None).alias("row")
    flat = docs.select(row, *[c.alias(k) for c, k in zip(named(groups), keys, strict=True)], named([text])[0].alias("body"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = vector(staged(statistics(flat, "body").drop("body").withColumn("base_failed", failed)))
    levels = [F.struct(F.lit(0).alias("level"), *[F.lit(None).cast(dict(flat.dtypes)[k]).alias(k) for k in keys]), F.struct(F.lit(1).alias("level"), *[F.col(k) for k in keys])]
    rows = stats.where("not base_failed").select(*[f"x{i}" for i in range(P)], F.explode(F.array(*levels)).alias("of")).select("of.*", *[f"x{i}" for i in range(P)])
    found = staged(fit(rows, ["level", *keys], share, steps), narrow=True)
    pairs = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i in range(P) for j in range(i + 1)]
    whole = found.where("level = 0").first()
    weight = F.col("n") + PRIOR
    mixed = [((F.col("n") * F.col(c) + PRIOR * F.lit(float(whole[c] if whole else 0))) / weight * (CONSISTENT if c[0] == "c" else 1.0)).alias(c) for c in pairs]
    own = found.where("level = 1").select(*keys, *mixed)
    hint = F.broadcast if small(found) is not found else (lambda df: df)
    told = distanced(matched(stats, factor(own), keys, hint, "left"))
    prefix = fresh(rest, NAMES, "")
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    verdict = ~F.col("base_failed") & (F.col("d2") <= cutoff)
    out = [*NAMES[:6], "base_failed"]
    return told.select("row.*" if rest else F.lit(1).alias("row"), *[F.col(c).alias(prefix + c) for c in out], distance.alias(f"{prefix}distance"), F.coalesce(verdict, F.lit(False)).alias(f"{prefix}kept"))
