"""Feature profiles, rank correlation and redundancy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from quern.operators.splits import FEW, in_ranges, rank_key
from quern.sources.scratch import staged, unstage

#: Counts in one aggregate at most.
COUNTS = 400

#: Values that are dealt to one range, about.
RANGE = 1_000_000

#: Columns at most whose ranks beside one other column are found together.
BESIDE = 50


def profile(df: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """(feature_id, n, missing_rate, std, n_distinct, ok, reason) per column, in one wide aggregate.

    Reasons: TIER1_NAN for an empty column, one with more than half missing or all missing, TIER1_CONSTANT for a sample
    deviation under 1e-9 or a single category. n_distinct is counted for categories only, all columns' values in one grouped
    aggregate; constancy needs only min and max.
    """
    n = F.count(F.lit(1))
    parts = []
    for c in [*numeric, *categorical]:
        x = F.col(c)
        std = F.stddev_samp(x.cast("double")) if c in numeric else F.lit(None).cast("double")
        constant = std < 1e-9 if c in numeric else F.min(x) == F.max(x)
        parts.append(F.struct(F.lit(c).alias("feature_id"), n.alias("n"), F.avg(x.isNull().cast("double")).alias("missing_rate"), std.alias("std"), F.count(x).alias("present"), constant.alias("constant")).alias(c))
    rows = df.agg(*parts).select(F.explode(F.array(*[F.col(c) for c in [*numeric, *categorical]])).alias("p")).select("p.*")
    if categorical:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature_id"), F.col(c).cast("string").alias("v")) for c in categorical])).alias("p")).select("p.*")
        kinds = long.where("v is not null").distinct().groupBy("feature_id").agg(F.count(F.lit(1)).alias("kinds"))
        every = F.when(F.col("feature_id").isin(*categorical), F.coalesce("kinds", F.lit(0).cast("bigint")))
        rows = rows.join(kinds, "feature_id", "left").withColumn("n_distinct", every)  # a row a column
    else:
        rows = rows.withColumn("n_distinct", F.lit(None).cast("bigint"))
    reason = F.when((F.col("present") == 0) | (F.coalesce(F.col("missing_rate"), F.lit(1.0)) > 0.5), "TIER1_NAN").when(F.coalesce("constant", F.lit(False)), "TIER1_CONSTANT").otherwise("")
    return rows.select("feature_id", "n", "missing_rate", "std", "n_distinct", reason.alias("reason")).withColumn("ok", F.col("reason") == "")


def rank_correlation(df: DataFrame, key: str, pairs: list[tuple[str, str]], sample: int | None = 5000, seed: int = 42) -> DataFrame:
    """(candidate, accepted, n, value_sim): Pearson correlation of average ranks over the rows where both are there.

    At most ``sample`` such rows of smallest hash a pair (None: all, see ``full_ranks``). 0 under 30 rows or for a side that is constant or not numeric
    (boolean is); pairs without common rows have n = 0.
    """
    pairs = list(dict.fromkeys(pairs))
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def value(c: str):
        """Its double; of what isn't numeric a constant where it is there, so that it counts and scores 0."""
        return F.col(c).cast("double") if isinstance(kinds[c], NumericType | BooleanType) else F.when(F.col(c).isNotNull(), 0.0)

    pair = ["candidate", "accepted"]
    if sample is None:
        out = full_ranks(df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(dict.fromkeys(c for p in pairs for c in p))]), pairs)
    else:
        each = [F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("accepted"), value(a).alias("a"), value(b).alias("b")) for a, b in pairs]
        long = smallest(df, rank_key(F.col(key), seed), each, sample).withColumn("r", F.row_number().over(Window.partitionBy(*pair).orderBy("h"))).where(F.col("r") <= sample)
        average_rank = lambda c: F.rank().over(Window.partitionBy(*pair).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*pair, c)) - 1) / 2.0
        ranked = long.select(*pair, "a", "b", average_rank("a").alias("ra"), average_rank("b").alias("rb"))
        out = ranked.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("da"), F.stddev_pop("b").alias("db"), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("r"))
    usable = (F.col("n") >= 30) & (F.col("da") >= 1e-12) & (F.col("db") >= 1e-12)
    out = out.select(*pair, "n", F.when(usable, F.coalesce("r", F.lit(0.0))).otherwise(0.0).alias("value_sim"))
    asked = df.sparkSession.createDataFrame(pairs, "candidate string, accepted string")
    return asked.join(out, pair, "left").select(*pair, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("value_sim", F.lit(0.0)).alias("value_sim"))


def smallest(df: DataFrame, h: Column, each: list[Column], sample: int) -> DataFrame:
    """(h, candidate, accepted, a, b): of each pair of ``each`` at least its ``sample`` complete rows of smallest hash ``h``, and few others.

    A window over a pair would bring all its rows to one task. So the rows of each pair are counted first; hashes are even, so a bound on the hash
    leaves about as many as are asked for, and a bound that turns out too low is doubled. Only what is under a pair's bound is multiplied by the pairs
    and shuffled. Every row is read and every hash compared: what comes out holds the rows that a full sort would put first.
    """
    there = [x["a"].isNotNull() & x["b"].isNotNull() for x in each]

    def counted(rows: DataFrame, wanted: dict[int, Column]) -> dict[int, int]:
        out: dict[int, int] = {}
        for low in range(0, len(wanted), COUNTS):
            part = list(wanted)[low : low + COUNTS]
            out |= dict(zip(part, rows.agg(*[F.count_if(wanted[i]).alias(f"n{i}") for i in part]).first(), strict=True))
        return out

    # A bound is a number of 52 bits, compared with the hash's first 13 hexadecimal digits; None: all rows.
    bound = lambda share: int(share * 16.0**13) if share < 0.5 else None
    under = lambda share: F.lit(True) if bound(share) is None else F.substring(h, 1, 13) <= f"{bound(share):013x}"
    total = counted(df, dict(enumerate(there)))
    shares = {i: (sample + 6 * sample**0.5 + 10) / n if n > sample else 1.0 for i, n in total.items()}
    open_ = [i for i in shares if bound(shares[i]) is not None]
    while open_:
        found = counted(df.where(under(max(shares[i] for i in open_))), {i: there[i] & under(shares[i]) for i in open_})
        open_ = [i for i in open_ if found[i] < sample]
        for i in open_:
            shares[i] *= 2
        open_ = [i for i in open_ if bound(shares[i]) is not None]
    own = F.array(*[F.when(ok & under(shares[i]), x) for i, (x, ok) in enumerate(zip(each, there, strict=True))])
    rows = df.where(under(max(shares.values())))
    return rows.select(h.alias("h"), F.explode(F.array_compact(own)).alias("p")).select("h", "p.*")


def full_ranks(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(candidate, accepted, n, da, db, r) over all rows: the correlation of average ranks, and the sides' deviations.

    ``rows`` has a double c0, c1, .. for each different name of ``pairs``, in their order. Only the side with fewer values (roughly; only speed hangs on
    it), a, is ranked by itself (``centred_ranks``). Its ranks go to the rows, which are added up by the other side's values; these are dealt into ranges and sorted, and a range
    gives the sums of products with the ranks that b has within it. What lies in the ranges before only shifts those, so it is
    added to the sums. A column beside itself needs its ranks once. Where all pairs have a column in common, that is the side a (``beside_one``).
    """
    rows = staged(rows)
    at = {c: i for i, c in enumerate(dict.fromkeys(c for p in pairs for c in p))}
    common = sorted(set(pairs[0]).intersection(*pairs)) if len(pairs) > 1 and all(a != b for a, b in pairs) else []
    if common:
        others = [at[b if a == common[0] else a] for a, b in pairs]
        halves = [beside_one(rows, at[common[0]], others[low : low + BESIDE], low) for low in range(0, len(others), BESIDE)]
        values, of_a = (reduce(lambda x, y: x.unionByName(y), half) for half in zip(*halves, strict=True))
        unstage(rows)
        return correlations(values, of_a, [], pairs)
    kinds: list[int] = []
    for low in range(0, len(at), COUNTS):
        kinds += [distinct(bits) for bits in rows.agg(*[lowest_bits(F.col(c)) for c in rows.columns[low : low + COUNTS]]).first()]
    sides = {i: sorted((at[a], at[b]), key=lambda c: kinds[c]) for i, (a, b) in enumerate(pairs)}
    one = [i for i, (a, b) in sides.items() if a == b]
    few = [i for i, (a, b) in sides.items() if a != b and kinds[a] * kinds[b] <= FEW]
    more = [i for i in sides if i not in one and i not in few]

    def long(wanted: list[int]) -> DataFrame:
        each = [(F.lit(i).alias("pair"), *[F.col(f"c{c}").alias(name) for c, name in zip(sides[i], "ab", strict=True)]) for i in wanted]
        return reduce(lambda x, y: x.unionByName(y), [rows.select(*x).where("a is not null and b is not null") for x in each])

    found, done = [], [rows]
    if two := [*few, *more]:
        # Values that are few on both sides are counted together once.
        counted = [staged(long(few).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")))] if few else []
        done += counted
        if more:
            counted = [*counted, long(more).withColumn("n", F.lit(1).cast("long"))]
        counts = reduce(lambda x, y: x.unionByName(y), counted)
        ranks, of_a = centred_ranks(counts.groupBy("pair", "a").agg(F.sum("n").alias("n")))
        found = [with_ranks(counts, ranks).groupBy("pair", "b").agg(F.sum("n").alias("n"), F.sum(F.col("z") * F.col("n")).alias("s"))]
    if one:
        found.append(long(one).groupBy("pair", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit(0.0)))
    values = staged(reduce(lambda x, y: x.unionByName(y), found))
    unstage(*done)
    return correlations(values, of_a if two else None, one, pairs)


def correlations(values: DataFrame, of_a: DataFrame | None, one: list[int], pairs: list[tuple[str, str]]) -> DataFrame:
    """The second half of ``full_ranks``: from b's values (pair, b, n, s), a written table, s being the sum of a's centred ranks, and (pair, aa, da) of a.
    ``one``: pairs of a column and itself."""
    spark = values.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), values.count() // RANGE)
    dealt = values.repartitionByRange(ranges, "pair", "b").sortWithinPartitions("b")
    sums = range_sums(dealt)
    own = Window.partitionBy("pair")
    total = F.sum("n").over(own)
    shift = F.sum("n").over(own.orderBy("part")) - F.col("n") - (total + 1) / 2.0
    sums = sums.withColumns({"shift": shift, "off": F.col("mean") - F.sum(F.col("mean") * F.col("n")).over(own) / total})
    square = F.sum(F.col("shift") * F.col("shift") * F.col("n") + 2 * F.col("shift") * F.col("x") + F.col("xx"))
    deviation = F.sqrt(F.sum(F.col("m2") + F.col("off") * F.col("off") * F.col("n")) / F.sum("n"))
    out = sums.groupBy("pair").agg(F.sum("n").alias("n"), deviation.alias("db"), square.alias("bb"), F.sum(F.col("shift") * F.col("s") + F.col("xs")).alias("ab"))
    if of_a is not None:
        out = out.join(of_a, "pair", "left")
    else:
        out = out.withColumns({"da": F.lit(None).cast("double"), "aa": F.lit(None).cast("double")})
    same = F.col("pair").isin(one)
    both = F.when(same, F.col("bb")).otherwise(F.col("ab"))
    r = F.try_divide(both, F.sqrt(F.when(same, F.col("bb")).otherwise(F.col("aa"))) * F.sqrt("bb"))
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, candidate string, accepted string")
    return out.join(F.broadcast(names), "pair").select("candidate", "accepted", "n", F.when(same, F.col("db")).otherwise(F.col("da")).alias("da"), "db", r.alias("r"))


def beside_one(rows: DataFrame, one: int, others: list[int], first: int) -> tuple[DataFrame, DataFrame]:
    """(pair, b, n, s) and (pair, aa, da) for ``correlations`` of the column c<one> with each of ``others``; pairs are numbered from ``first``.

    The one's values are counted once for all pairs, with a count for each of the others: the rows where it is there too. They are dealt into ranges and
    their counts added up, so that a value's ranks in all pairs are one row, and the rows are joined with them once.
    """
    spark, m = rows.sparkSession, range(len(others))
    own = rows.select(F.col(f"c{one}").alias("a"), *[F.col(f"c{c}").alias(f"b{i}") for i, c in enumerate(others)]).where("a is not null")
    values, part = in_ranges(own.groupBy("a").agg(F.count(F.lit(1)).alias("n"), *[F.count(f"b{i}").alias(f"n{i}") for i in m]), ["a"])
    sizes = sorted(values.groupBy(part).agg(F.sum("n"), *[F.sum(f"n{i}") for i in m]).collect())
    total, *totals = [sum(r[k + 1] for r in sizes) for k in range(len(others) + 1)]
    before, shifts = [0] * len(others), []
    for k, _, *ns in sizes:
        shifts.append((k, *[b - t / 2.0 for b, t in zip(before, totals, strict=True)]))
        before = [b + n for b, n in zip(before, ns, strict=True)]
    shifts = spark.createDataFrame(shifts, f"{part} int" + "".join(f", z{i} double" for i in m))
    within = Window.partitionBy(part).orderBy("a")
    placed = values.withColumns({f"p{i}": F.sum(f"n{i}").over(within) - F.col(f"n{i}") / 2.0 for i in m}).join(F.broadcast(shifts), part)
    ranks = staged(placed.select("a", *[f"n{i}" for i in m], *[(F.col(f"p{i}") + F.col(f"z{i}")).alias(f"z{i}") for i in m], (F.col("n") * 1000 >= total).alias("hot")))
    unstage(values)
    there = lambda i, x: F.when(F.col(f"n{i}") > 0, x * F.col(f"n{i}"))
    means = ranks.agg(*[F.try_divide(F.sum(there(i, F.col("a"))), F.sum(f"n{i}")) for i in m]).first()
    off = lambda i: F.col("a") - F.lit(means[i])
    told = ranks.agg(*[F.sum(there(i, F.col(f"z{i}") * F.col(f"z{i}"))) for i in m], *[F.sqrt(F.try_divide(F.sum(there(i, off(i) * off(i))), F.sum(f"n{i}"))) for i in m]).first()
    of_a = spark.createDataFrame([(first + i, told[i], told[len(others) + i]) for i in m], "pair int, aa double, da double")
    z = [f"z{i}" for i in m]
    if ranks.count() <= FEW:
        met = own.join(F.broadcast(ranks.select("a", *z)), "a")
    else:
        hot, cold = F.broadcast(ranks.where("hot").select("a", *z)), ranks.where("not hot").select("a", *z)
        met = own.join(hot, "a").unionByName(own.join(hot, "a", "left_anti").join(cold, "a"))
    long = met.select(F.inline(F.array(*[F.struct(F.lit(first + i).alias("pair"), F.col(f"b{i}").alias("b"), F.col(f"z{i}").alias("z")) for i in m]))).where("b is not null")
    out = staged(long.groupBy("pair", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s")))
    unstage(ranks)
    return out, of_a


def lowest_bits(c: Column) -> Column:
    """The lowest set bits of the values' hashes, for ``distinct``."""
    h = F.hash(c).cast("long")
    return F.bit_or(F.when(c.isNotNull(), h.bitwiseAND(-h)))


def distinct(bits: int | None) -> int:
    """Values that a column has, to a factor of two or so: half of all hashes are odd, a quarter of them ends in 10, and so on."""
    place = 0
    while (bits or 0) >> place & 1 and place < 32:
        place += 1
    return 2**place


def centred_ranks(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, a, z, hot) of the counted values (pair, a, n): average ranks less their mean, and whether a value has a thousandth of the pair's rows;
    (pair, aa, da): the sum of z's squares over the rows, and the values' deviation.

    Values are dealt into ranges, and a value's rank is what lies in the ranges before, plus what lies before it in its own, plus half of its ties;
    no task orders a whole pair.
    """
    values, part = in_ranges(counts, ["pair", "a"])
    weighed = F.sum(F.col("a") * F.col("n")) / F.sum("n")
    middle = values.groupBy("pair").agg(F.sum("n").alias("total"), weighed.alias("mean"))
    sizes = values.groupBy("pair", part).agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("pair").orderBy(part)) - F.col("size")
    sizes = sizes.withColumn("before", before).drop("size").join(F.broadcast(middle), "pair")
    within = F.sum("n").over(Window.partitionBy("pair", part).orderBy("a")) - F.col("n")
    z = F.col("before") + F.col("within") + (F.col("n") + 1) / 2.0 - (F.col("total") + 1) / 2.0
    ranks = staged(values.withColumn("within", within).join(F.broadcast(sizes), ["pair", part]).select("pair", "a", "n", "mean", z.alias("z"), (F.col("n") * 1000 >= F.col("total")).alias("hot")))
    unstage(values)
    off = F.col("a") - F.col("mean")
    of_a = ranks.groupBy("pair").agg(F.sum(F.col("z") * F.col("z") * F.col("n")).alias("aa"), F.sqrt(F.sum(off * off * F.col("n")) / F.sum("n")).alias("da"))
    return ranks.select("pair", "a", "z", "hot"), of_a


def with_ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(pair, b, n, z): ``rows`` (pair, a, b, n) with their a's rank. Up to ``FEW`` ranks are broadcast; of more, those of hot values are, so that no task gets all rows of one."""
    if ranks.count() <= FEW:
        return rows.join(F.broadcast(ranks), ["pair", "a"]).select("pair", "b", "n", "z")
    hot, cold = F.broadcast(ranks.where("hot")), ranks.where("not hot")
    rest = rows.join(hot, ["pair", "a"], "left_anti").join(cold, ["pair", "a"])
    return rows.join(hot, ["pair", "a"]).select("pair", "b", "n", "z").unionByName(rest.select("pair", "b", "n", "z"))


def range_sums(dealt: DataFrame) -> DataFrame:
    """A row for each range and pair of the values (pair, b, n, s) of ``dealt``, sorted by b: sums over the rows, x being b's average rank within the range."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), {}
        for batch in batches:
            pair, b, n, s = (batch.column(c).to_numpy() for c in ("pair", "b", "n", "s"))
            for p in np.unique(pair):
                own = pair == p
                k, v, z = n[own], b[own], s[own]
                had = found.setdefault(int(p), [0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
                x = had[0] + np.cumsum(k) - (k - 1) / 2.0
                size = int(k.sum())
                mean = v[0] + ((v - v[0]) * k).sum() / size
                off, total = mean - had[5], had[0] + size
                had[6] += ((v - mean) ** 2 * k).sum() + off * off * had[0] * size / total
                had[5] += off * size / total
                for i, more in enumerate((size, (x * k).sum(), (x * x * k).sum(), z.sum(), (x * z).sum())):
                    had[i] += more
        if found:
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 6]
            columns = zip(*[(p, part, had[0], *map(float, had[1:])) for p, had in found.items()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pair", "part", "n", "x", "xx", "s", "xs", "mean", "m2"])

    return dealt.mapInArrow(sums, "pair int, part int, n long, x double, xx double, s double, xs double, mean double, m2 double")


def redundancy_of_many(df: DataFrame, key: str, candidates: list[str], accepted: list[str], sample: int = 5000, seed: int = 42, columns: int = 256) -> DataFrame:
    """(candidate, accepted, n, value_sim) as ``rank_correlation`` gives it, for thousands of candidates against the accepted set.

    Rows are sampled once: numeric columns without a missing value have the same ``sample`` rows of smallest hash in every pair. Each column becomes one row, its
    vector of standardised average ranks; the accepted ones' (``columns`` at a time, 10 MB at most) go to every task, and a pair is one product of
    vectors. Only the pairs of columns with missing values, or that aren't numbers, go through ``rank_correlation``. Nothing accepted gives no pairs.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema.fields}
    number = [c for c in dict.fromkeys([*candidates, *accepted]) if isinstance(kinds[c], NumericType | BooleanType)]
    whole: set[str] = set()
    for low in range(0, len(number), columns):
        part = number[low : low + columns]
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(part)]).first()
        whole |= {c for c, n in zip(part, row, strict=True) if n == 0}
    every = [c for c in number if c in whole]
    fast, slow = [], []
    for c in dict.fromkeys(candidates):
        for a in dict.fromkeys(accepted):
            (fast if c in whole and a in whole else slow).append((c, a))
    out = rank_correlation(df, key, slow, sample, seed) if slow else None
    if fast and every:
        first = df.select(rank_key(F.col(key), seed).alias("h"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(every)]).orderBy("h").limit(sample)
        rows = staged(first.drop("h").coalesce(1).withColumn("place", F.monotonically_increasing_id()))

        def ranked(own: pd.DataFrame) -> pd.DataFrame:
            v = own.v.to_numpy()
            usable = len(v) >= 30 and v.std() >= 1e-12
            rank = own.v.rank().to_numpy()
            z = (rank - rank.mean()) / rank.std() / np.sqrt(len(v)) if usable else np.zeros(len(v))
            return pd.DataFrame({"i": [own.i.iloc[0]], "n": [len(v)], "z": [z]})

        # Vectors of different columns meet by the rows' places.
        parts = [range(low, min(low + columns, len(every))) for low in range(0, len(every), columns)]
        longs = [rows.select("place", F.posexplode(F.array(*[f"c{i}" for i in part])).alias("i", "v")).select("place", (F.col("i") + part[0]).cast("int").alias("i"), "v") for part in parts]
        vectors = staged(reduce(lambda x, y: x.unionByName(y), longs).groupBy("i").applyInPandas(lambda own: ranked(own.sort_values("place")), "i int, n long, z array<double>"))
        at = {c: i for i, c in enumerate(every)}
        told = [at[a] for a in dict.fromkeys(accepted) if a in whole]
        wanted = [at[c] for c in dict.fromkeys(candidates) if c in whole]
        names = spark.createDataFrame(list(enumerate(every)), "i int, name string")
        for low in range(0, len(told), columns):
            held = {r.i: np.array(r.z) for r in vectors.where(F.col("i").isin(told[low : low + columns])).collect()}

            def products(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                ids, table = np.array(list(held)), np.array(list(held.values()))
                for batch in batches:
                    sims = np.stack(batch.z.to_list()) @ table.T
                    yield pd.DataFrame({"i": np.repeat(batch.i.to_numpy(), len(ids)), "j": np.tile(ids, len(batch)), "n": np.repeat(batch.n.to_numpy(), len(ids)), "value_sim": sims.ravel()})

            own = vectors.where(F.col("i").isin(wanted)).mapInPandas(products, "i int, j int, n long, value_sim double")
            own = own.join(F.broadcast(names.withColumnRenamed("name", "candidate")), "i").join(F.broadcast(names.select(F.col("i").alias("j"), F.col("name").alias("accepted"))), "j")
            own = own.select("candidate", "accepted", "n", "value_sim")
            out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "candidate string, accepted string, n long, value_sim double")


def redundancy(pairs: DataFrame, hashes: DataFrame, threshold: float = 0.92, absolute: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """Per candidate of ``pairs`` redundancy_max, redundancy_argmax and whether it is under the gate.

    ``hashes`` has feature_id, seq and hash. A pair's similarity is the larger of value_sim (signed, unless ``absolute``)
    and 1 for equal hashes; negative ones don't count, and of equal ones the accepted feature of smallest seq is named.
    Each row of ``candidates`` (feature_id) has a row, with 0 where there is nothing accepted to compare with.
    """
    one = hashes.select(F.col("feature_id").alias("candidate"), F.col("hash").alias("h1"))
    two = hashes.select(F.col("feature_id").alias("accepted"), F.col("hash").alias("h2"), "seq")
    value = F.abs("value_sim") if absolute else F.col("value_sim")
    joined = pairs.join(one, "candidate").join(two, "accepted").withColumn("sim", F.greatest(value, (F.col("h1") == F.col("h2")).cast("double"), F.lit(0.0)))
    best = joined.groupBy("candidate").agg(F.max(F.struct("sim", (-F.col("seq")).alias("s"), "accepted")).alias("m"))
    sim = F.col("m.sim")
    out = best.select("candidate", sim.alias("redundancy_max"), F.when(sim > 0, F.col("m.accepted")).otherwise("").alias("redundancy_argmax"))
    if candidates is not None:
        out = candidates.select(F.col("feature_id").alias("candidate")).distinct().join(out, "candidate", "left")
        out = out.select("candidate", F.coalesce("redundancy_max", F.lit(0.0)).alias("redundancy_max"), F.coalesce("redundancy_argmax", F.lit("")).alias("redundancy_argmax"))
    return out.withColumn("passes", F.col("redundancy_max") < threshold)


def select_nonredundant(pairs: DataFrame, hashes: DataFrame, order: list[str], threshold: float = 0.92, absolute: bool = False) -> list[str]:
    """Keep-first selection over an ordered list of features (a few thousand at most): a later one goes if its
    similarity to a kept one (see ``redundancy``: value_sim or equal hashes) reaches the threshold.

    ``pairs`` needs each two features of the list, in either direction, and ``hashes`` (feature_id, hash) each feature; what is
    missing is an error. The hashes and the pairs over the threshold come to the driver.
    """
    order = list(dict.fromkeys(order))
    own = {r.feature_id: r.hash for r in hashes.where(F.col("feature_id").isin(order)).select("feature_id", "hash").collect()}
    if absent := [f for f in order if f not in own]:
        raise ValueError(f"no hash of {absent[:10]}")
    asked = pairs.where(F.col("candidate").isin(order) & F.col("accepted").isin(order) & (F.col("candidate") != F.col("accepted")))
    given = asked.select(F.least("candidate", "accepted"), F.greatest("candidate", "accepted")).distinct().count()
    if given < len(order) * (len(order) - 1) // 2:
        raise ValueError(f"{len(order) * (len(order) - 1) // 2 - given} pairs of the {len(order)} features have no similarity")
    value = F.abs("value_sim") if absolute else F.col("value_sim")
    close = {frozenset((r.candidate, r.accepted)) for r in asked.where(value >= threshold).select("candidate", "accepted").collect()}
    kept: list[str] = []
    for f in order:
        same = any(own[f] is not None and own[f] == own[k] for k in kept) and threshold <= 1
        if not same and not any(frozenset((f, k)) in close for k in kept):
            kept.append(f)
    return kept
