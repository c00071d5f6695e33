"""Registered queries of the feature-program operators, each with the SQL that gives the same rows.

The tables have no missing values, so both sides put some in with the same expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.grammar import IID_FAMILIES, structural_hash
from quern.operators import audit, certify, features, gains, scoring, selection, splits, temporal
from quern.sources import datasets
from quern.sources.scratch import shared_folder, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ORDERS = """select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as price,
 o_totalprice - 150000 as signed, cast(o_orderkey % 5 as double) as small,
 case when o_orderkey % 11 = 0 then null else o_orderpriority end as priority, o_orderstatus as status,
 case when o_orderkey % 9 = 0 then o_orderstatus else o_orderpriority end as other from orders"""
NAMES = ["o_orderkey", "price", "signed", "small", "priority", "status", "other"]
TYPES = {"priority": "categorical", "status": "categorical", "other": "categorical"}
SPLIT = "case when b < 2000 then 'test' when b < 3600 then 'val' else 'train' end"
BUCKET = "('0x' || substr(md5('0:' || o_orderkey), 1, 8))::bigint % 10000"
BASE = f"with base as ({ORDERS}), o as (select *, {SPLIT} as _split from (select *, {BUCKET} as b from base)), t as (select * from o where _split = 'train') "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ORDERS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


def split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.train_val_test(orders(spark, sf_dir), "o_orderkey")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def col(i: int) -> dict:
    return {"op": "Col", "col_index": i}


def const(v, dtype: str = "numeric") -> dict:
    return {"op": "Const", "value": v, "dtype": dtype}


def un(op: str, x: dict) -> dict:
    return {"op": op, "child": x}


def two(op: str, a: dict, b: dict) -> dict:
    return {"op": op, "left": a, "right": b}


def compute(df: DataFrame, programs: dict[str, dict]) -> DataFrame:
    fitted = features.fit(df, programs, TYPES, NAMES)
    return features.apply(df, programs, TYPES, fitted, ["o_orderkey"], NAMES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


THREE = [col(1), col(2), col(3)]
#: name: (program, SQL over base).
SCALARS = {
    "log1p": (un("Log1p", col(2)), "case when signed > -1 then ln(1 + signed) end"),
    "sqrt_clip0": (un("Sqrt", two("Add", col(1), col(2))), "sqrt(case when price + signed < 0 then 0 else price + signed end)"),
    "abs": (un("Abs", col(2)), "abs(signed)"),
    "square": (un("Square", un("Log1p", col(1))), "ln(1 + price) * ln(1 + price)"),
    "reciprocal": (un("Reciprocal", col(3)), "1.0 / nullif(small, 0)"),
    "is_null": (un("IsNull", col(1)), "(price is null)::int::double"),
    "add": (two("Add", col(1), col(2)), "price + signed"),
    "subtract": (two("Subtract", col(1), col(2)), "price - signed"),
    "multiply": (two("Multiply", col(1), col(3)), "price * small"),
    "divide": (two("Divide", col(1), col(3)), "price / nullif(small, 0)"),
    "ratio": (two("Ratio", col(2), col(3)), "signed / nullif(small, 0)"),
    "cross": (two("Cross", col(4), col(5)), "coalesce(priority, 'nan') || '_x_' || status"),
    "is_equal": (two("IsEqual", col(4), col(6)), "(priority is not distinct from other)::int::double"),
    "one_hot_select": (two("OneHotSelect", col(5), const("F", "categorical")), "(status = 'F')::int::double"),
    "coalesce": (two("Coalesce", col(1), const(-1.5)), "coalesce(price, -1.5)"),
    "row_mean": ({"op": "RowMean", "children": THREE}, "(coalesce(price, 0) + signed + small) / (case when price is null then 2 else 3 end)"),
    "row_max": ({"op": "RowMax", "children": THREE}, "greatest(price, signed, small)"),
    "row_min": ({"op": "RowMin", "children": THREE}, "least(price, signed, small)"),
    "row_sum": ({"op": "RowSum", "children": THREE}, "coalesce(price, 0.0) + signed + small"),
    "row_std": ({"op": "RowStd", "children": THREE}, "(select stddev_samp(v) from (values (price), (signed), (small)) x(v))"),
}
for _name, (_program, _sql) in SCALARS.items():
    _digits = 3 if _name == "row_std" else 6
    _value = _sql if _name == "cross" else f"round({_sql}, {_digits})"
    query(_name, f"with base as ({ORDERS}) select o_orderkey, {_value} as value from base")(lambda s, d, p=_program, n=_digits: rounded(compute(orders(s, d), {"value": p}), n))

TENTHS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
CODES = "case when price is not null then len(list_filter(e, lambda b: b < price))::int end"
#: name: (program, statistics on the train rows t, joins, SQL).
FITS = {
    "zscore": (un("ZScore", col(1)), "(select avg(price) m, stddev_samp(price) s from t)", "", "round((price - m) / s, 6)"),
    "minmax": (un("MinMaxScale", col(1)), "(select min(price) a, max(price) z from t)", "", "round((price - a) / (z - a), 6)"),
    "quantile_bucketize": (un("QuantileBucketize", col(1)), f"(select quantile_cont(price, {TENTHS}) e from t)", "", f"({CODES})::double"),
    "clip_p01_p99": (un("Clip", col(1)), "(select quantile_cont(price, 0.01) a, quantile_cont(price, 0.99) z from t)", "", "round(case when price is not null then least(greatest(price, a), z) end, 6)"),
    "frequency_encode": (un("FrequencyEncode", col(4)), "(select 1)", "left join (select coalesce(priority, 'nan') k, count(*)::double v from t group by 1) m on coalesce(o.priority, 'nan') = k", "v"),
    "target_encode": ({"op": "TargetEncode", "cat_col": col(4), "label_col": col(1)}, "(select 1)", "left join (select coalesce(priority, 'nan') k, avg(price) v from t group by 1) m on coalesce(o.priority, 'nan') = k", "round(v, 6)"),
    "nested_fit": (un("MinMaxScale", un("ZScore", col(1))), "(select min(price) a, max(price) z from t)", "", "round((price - a) / (z - a), 6)"),
    "nested_frequency": (un("FrequencyEncode", un("QuantileBucketize", col(1))), f"(select quantile_cont(price, {TENTHS}) e from t)", f"left join (select coalesce(({CODES})::varchar, 'nan') k, count(*)::double v from t, (select quantile_cont(price, {TENTHS}) e from t) group by 1) m on coalesce(({CODES})::varchar, 'nan') = k", "v"),
}
for _name, (_program, _stats, _join, _sql) in FITS.items():
    query(_name, f"{BASE} select o.o_orderkey, {_sql} as value from o cross join {_stats} {_join}")(lambda s, d, p=_program: rounded(compute(split_orders(s, d), {"value": p}).select("o_orderkey", F.col("value").cast("double").alias("value"))))

FLAGSHIP = {"z": FITS["zscore"][0], "bucket": FITS["quantile_bucketize"][0], "frequency": FITS["frequency_encode"][0], "encoded": {"op": "TargetEncode", "cat_col": col(5), "label_col": col(1)}, "crossed": SCALARS["cross"][0], "mean": SCALARS["row_mean"][0]}


@query("apply_program_set", f"""{BASE}, s as (select avg(price) m, stddev_samp(price) d, quantile_cont(price, {TENTHS}) e from t),
f as (select coalesce(priority, 'nan') k, count(*)::double v from t group by 1), g as (select status k, avg(price) v from t group by 1)
select o_orderkey, round((price - m) / d, 6) as z, ({CODES})::double as bucket, f.v as frequency, round(g.v, 6) as encoded,
 {SCALARS['cross'][1]} as crossed, round({SCALARS['row_mean'][1]}, 6) as mean
from o cross join s left join f on coalesce(priority, 'nan') = f.k left join g on status = g.k""")
def apply_program_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compute(split_orders(spark, sf_dir), FLAGSHIP).withColumn("bucket", F.col("bucket").cast("double")))


PIECES = [FITS["zscore"][0], FITS["minmax"][0], un("Clip", col(2)), un("FrequencyEncode", col(4)), {"op": "TargetEncode", "cat_col": col(5), "label_col": col(2)}]
JOINS = ["Add", "Subtract", "Multiply", "Divide"]


@query("shared_subtrees", f"""{BASE}, s as (select avg(price) m, stddev_samp(price) d, min(price) a, max(price) z, quantile_cont(signed, 0.01) c1, quantile_cont(signed, 0.99) c2 from t),
f as (select coalesce(priority, 'nan') k, count(*)::double v from t group by 1), g as (select status k, avg(signed) v from t group by 1),
p as (select [(price - m) / d, (price - a) / (z - a), least(greatest(signed, c1), c2), f.v, g.v] as x from o cross join s left join f on coalesce(priority, 'nan') = f.k left join g on status = g.k),
w as (select u, v, x[u + 1] as a, x[v + 1] as b from p, range(5) r(u), range(5) q(v)),
e as (select u, v, [avg(a + b), avg(a - b), avg(a * b), avg(a / nullif(b, 0))] as means from w group by 1, 2),
q as (select distinct p_brand || '/' || p_size as feature_id, p_size % 4 as o, p_size % 5 as u, length(p_brand) * p_size % 5 as v from part)
select feature_id, printf('%.4e', means[o + 1]) as mean from q join e using (u, v)""")
def shared_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program for each brand and size of the parts (1,250 at most), made of five fitted pieces: each piece is fitted once, and each
    program that several features share is one column."""
    size = F.col("p_size")
    asked = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", size.cast("string")).alias("f"), (size % 4).alias("o"), (size % 5).alias("u"), (F.length("p_brand") * size % 5).alias("v")).distinct().collect()
    wanted = {r.f: two(JOINS[r.o], PIECES[r.u], PIECES[r.v]) for r in asked}
    rows = split_orders(spark, sf_dir)
    fitted = features.fit(rows, wanted, TYPES, NAMES)
    if len(fitted.scalars) + len(fitted.map_sizes) > len(PIECES):
        raise ValueError("a piece was fitted twice")
    distinct = {root: f for f, root in features.Graph(wanted).roots.items()}
    matrix = features.apply(rows, {f: wanted[f] for f in distinct.values()}, TYPES, fitted, [], NAMES)
    means = matrix.agg(*[F.avg(F.col(f"`{f}`")).alias(f"m{i}") for i, f in enumerate(distinct.values())]).first()
    by_root = dict(zip(distinct, means, strict=True))
    out = [(f, f"{by_root[root]:.4e}") for f, root in features.Graph(wanted).roots.items()]
    return spark.createDataFrame(out, "feature_id string, mean string")


@query("split_counts", f"{BASE} select _split, count(*) as n from o group by 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_orders(spark, sf_dir).groupBy("_split").agg(F.count(F.lit(1)).alias("n"))


@query("union_splits", f"{BASE} select count(*) as n, round(sum(signed), 2) as total from o where _split in ('train', 'val')")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_orders(spark, sf_dir).where(F.col("_split").isin("train", "val")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("signed"), 2).alias("total"))


@query("label_encode", "select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as label_code from orders")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.label_encode(table(spark, sf_dir, "orders"), "o_orderpriority")
    return out.select("o_orderkey", F.col("label_code").cast("bigint").alias("label_code"))


@query("kfold", "select o_orderkey, ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::bigint % 5 as fold from orders")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.k_fold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("fold").cast("bigint").alias("fold"))


@query("stratified_kfold", "select o_orderkey, o_orderstatus, ntile(5) over (partition by o_orderstatus order by md5('42:' || o_orderkey)) - 1 as fold from orders")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.stratified_k_fold(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    return out.select("o_orderkey", "o_orderstatus", F.col("fold").cast("bigint").alias("fold"))


@query("sample_mini_split", "select o_orderkey, case when row_number() over (order by h) <= floor(0.8 * count(*) over ()) then 'train' else 'eval' end as part from (select o_orderkey, md5('42:' || o_orderkey) as h from orders order by h limit 2000)")
def sample_mini_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.mini_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


PROFILED = "select price, signed, case when o_orderkey % 3 > 0 then null else small end as sparse, 1.0 as one, priority, status, 'x' as same from base"


@query("label_encode_keys", "select o_orderkey, dense_rank() over (order by o_orderkey // 3) - 1 as label_code from orders")
def label_encode_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as many as a third of the rows."""
    out = splits.label_encode(table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 3").alias("label")), "label")
    return out.select("o_orderkey", F.col("label_code").cast("bigint").alias("label_code"))


@query("feature_store", f"{BASE}, s as (select avg(price) m, stddev_samp(price) d from t), f as (select coalesce(priority, 'nan') k, count(*)::double v from t group by 1) select o_orderkey, round((price - m) / d, 6) as z, {SCALARS['cross'][1]} as crossed, v as frequency, round({SCALARS['row_mean'][1]}, 6) as mean from o cross join s left join f on coalesce(priority, 'nan') = k")
def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of features, added one after the other and read together."""
    rows, store = split_orders(spark, sf_dir), f"store_{shared_folder(spark)[-32:]}"
    for batch, names in (("first", ("z", "crossed")), ("second", ("frequency", "mean"))):
        datasets.store_features(compute(rows, {n: FLAGSHIP[n] for n in names}), store, batch, "o_orderkey", 16)
    return rounded(datasets.read_store(spark, store, ["first", "second"], "o_orderkey"))


@query("feature_profile", f"with base as ({ORDERS}), p as ({PROFILED}), l as (" + " union all ".join(f"select '{c}' as feature_id, count(*) as n, round(avg(({c} is null)::int), 6) as missing_rate, round(stddev_samp({c}::double), 4) as std, 0::bigint as n_distinct from p" for c in ("price", "signed", "sparse", "one")) + " union all " + " union all ".join(f"select '{c}', count(*), round(avg(({c} is null)::int), 6), null, count(distinct {c}) from p" for c in ("priority", "status", "same")) + ") select feature_id, n, missing_rate, std, n_distinct, case when missing_rate > 0.5 then 'TIER1_NAN' when std < 1e-9 or n_distinct = 1 then 'TIER1_CONSTANT' else '' end as reason, not (missing_rate > 0.5 or coalesce(std < 1e-9 or n_distinct = 1, false)) as ok from l")
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(PROFILED.replace("from base", "from {base}").replace("1.0 as one", "1.0d as one"), base=orders(spark, sf_dir))
    out = selection.profile(rows, ["price", "signed", "sparse", "one"], ["priority", "status", "same"])
    return out.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint"))).withColumn("missing_rate", F.round("missing_rate", 6)).withColumn("std", F.round("std", 4))


PAIRS = [("price", "signed"), ("price", "small"), ("signed", "small"), ("signed", "flipped")]
RANKS = f"with base as (select *, -signed as flipped from ({ORDERS})), l as (" + " union all ".join(f"select '{a}' as candidate, '{b}' as accepted, md5('42:' || o_orderkey) as h, {a}::double as a, {b}::double as b from base where {a} is not null and {b} is not null" for a, b in PAIRS) + """),
s as (select * from l qualify row_number() over (partition by candidate, accepted order by h) <= 5000),
r as (select *, rank() over (partition by candidate, accepted order by a) + (count(*) over (partition by candidate, accepted, a) - 1) / 2.0 as ra,
 rank() over (partition by candidate, accepted order by b) + (count(*) over (partition by candidate, accepted, b) - 1) / 2.0 as rb from s),
pairs as (select candidate, accepted, count(*) as n, round(case when count(*) >= 30 then corr(ra, rb) else 0 end, 6) as value_sim from r group by 1, 2)"""


#: The same over all rows.
ALL_RANKS = RANKS.replace(" qualify row_number() over (partition by candidate, accepted order by h) <= 5000", "")


def pair_table(spark: SparkSession, sf_dir: str, pairs: list[tuple[str, str]] = PAIRS, sample: int | None = 5000) -> DataFrame:
    out = selection.rank_correlation(orders(spark, sf_dir).withColumn("flipped", -F.col("signed")), "o_orderkey", pairs, sample)
    return out.withColumn("value_sim", F.round("value_sim", 6))


@query("spearman_pairs", f"{RANKS} select * from pairs")
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_table(spark, sf_dir)


LINES = "select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as k, case when l_linenumber = 3 then null else l_quantity end as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax, case when l_quantity > 30 then 0 else l_quantity * l_discount end as ties from lineitem"
FULL = [("quantity", "price"), ("discount", "tax"), ("ties", "quantity"), ("ties", "discount"), ("price", "price")]


@query("spearman_full", f"with base as ({LINES}), l as (" + " union all ".join(f"select '{a}' as candidate, '{b}' as accepted, {a}::double as a, {b}::double as b from base where {a} is not null and {b} is not null" for a, b in FULL) + """),
r as (select *, rank() over (partition by candidate, accepted order by a) + (count(*) over (partition by candidate, accepted, a) - 1) / 2.0 as ra, rank() over (partition by candidate, accepted order by b) + (count(*) over (partition by candidate, accepted, b) - 1) / 2.0 as rb from l)
select candidate, accepted, count(*) as n, round(corr(ra, rb), 6) as value_sim from r group by 1, 2""")
def spearman_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation over all rows."""
    rows = spark.sql(LINES.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return selection.rank_correlation(rows, "k", FULL, sample=None).withColumn("value_sim", F.round("value_sim", 6))


MANY = {f"f{i}": f"o_totalprice * {1 + i % 7} + o_custkey * {(i * 37) % 400 - 200} + (o_orderkey * {i + 3}) % {50 + i}" for i in range(40)} | {"holes": "case when o_orderkey % 4 > 0 then o_totalprice end", "flat": "1.0"}
KEPT = {f"a{j}": e for j, e in enumerate(("o_totalprice", "o_custkey", "o_orderkey % 100"))}


@query("redundancy_of_many", f"with b as (select md5('42:' || o_orderkey) as h, {', '.join(f'({e})::double as {n}' for n, e in {**MANY, **KEPT}.items())} from orders), s as (select * from b order by h limit 5000), w as (select h, unnest([{', '.join(f"'{n}'" for n in MANY)}]) as candidate, unnest([{', '.join(MANY)}]) as a, {', '.join(KEPT)} from s)," + """
l as (select candidate, h, a, unnest(['a0', 'a1', 'a2']) as accepted, unnest([a0, a1, a2]) as b from w where candidate <> 'holes'
  union all select 'holes', h, holes, unnest(['a0', 'a1', 'a2']), unnest([a0, a1, a2]) from (select * from b where holes is not null order by h limit 5000)),
r as (select *, rank() over (partition by candidate, accepted order by a) + (count(*) over (partition by candidate, accepted, a) - 1) / 2.0 as ra, rank() over (partition by candidate, accepted order by b) + (count(*) over (partition by candidate, accepted, b) - 1) / 2.0 as rb from l)
select candidate, accepted, count(*) as n, round(case when stddev_pop(a) >= 1e-12 then corr(ra, rb) else 0 end, 6) as value_sim from r group by 1, 2""")
def redundancy_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).cast("double").alias(n) for n, e in {**MANY, **KEPT}.items()])
    return selection.redundancy_of_many(rows, "o_orderkey", list(MANY), list(KEPT)).withColumn("value_sim", F.round("value_sim", 6))


@query("redundancy_of_nothing", "select feature_id as candidate, 0.0::double as redundancy_max, '' as redundancy_argmax, true as passes from (select distinct 'f' || o_orderkey % 50 as feature_id from orders)")
def redundancy_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is accepted yet: every candidate has 0."""
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")).alias("feature_id")).distinct()
    hashes = names.withColumns({"seq": F.lit(0), "hash": F.col("feature_id")})
    none = spark.createDataFrame([], "candidate string, accepted string, n long, value_sim double")
    return selection.redundancy(none, hashes, candidates=names)


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("price", 0, "p"), ("signed", 1, "s"), ("small", 2, "m"), ("flipped", 3, "s")], "feature_id string, seq int, hash string")


def with_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.redundancy(pair_table(spark, sf_dir, sample=None), tags(spark))


BEST = """, h(f, seq, hash) as (values ('price', 0, 'p'), ('signed', 1, 's'), ('small', 2, 'm'), ('flipped', 3, 's')),
sims as (select candidate, accepted, b.seq, greatest(value_sim, (a.hash = b.hash)::int, 0)::double as sim from pairs join h a on candidate = a.f join h b on accepted = b.f),
best as (select * from sims qualify row_number() over (partition by candidate order by sim desc, seq) = 1)"""


@query("redundancy_max", f"{ALL_RANKS}{BEST} select candidate, sim as redundancy_max, case when sim > 0 then accepted else '' end as redundancy_argmax, sim < 0.92 as passes from best")
def redundancy_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hashes(spark, sf_dir)


@query("redundancy_gate", f"{ALL_RANKS}{BEST} select candidate, case when sim >= 0.92 then 'POST_EVAL_REDUNDANT' else '' end as rejection_reason from best")
def redundancy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hashes(spark, sf_dir).select("candidate", F.when(~F.col("passes"), "POST_EVAL_REDUNDANT").otherwise("").alias("rejection_reason"))


@query("select_nonredundant", f"{ALL_RANKS}, twins as (select * from pairs where value_sim >= 0.92) select f as feature_id from (values ('price'), ('signed'), ('small'), ('flipped')) x(f) where f <> 'signed' or not exists (select 1 from twins where candidate = 'price' and accepted = 'signed')")
def select_nonredundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_table(spark, sf_dir, [*PAIRS, ("price", "flipped"), ("small", "flipped")], sample=None)
    kept = selection.select_nonredundant(pairs, tags(spark), ["price", "signed", "small", "flipped"])
    return spark.createDataFrame([(k,) for k in kept], "feature_id string")


# Certificates: ten kinds of programs, one from each part.

#: kind: (family, program, output, canonical JSON, failure code, certificate that fails, witness); {i} is p_size % 8.
KINDS = {
    0: ("normalization", un("ZScore", {"op": "Col", "col_index": "I"}), None),
    1: ("nonlinear_transform", un("Log1p", {"op": "TargetEncode", "cat_col": col(2), "label_col": col(5)}), None),
    2: ("categorical_encoding", {"op": "TargetEncode", "cat_col": col(2), "label_col": col(5)}, None),
    3: ("arithmetic", two("Add", un("IsNull", col(4)), col(0)), None),
    4: ("arithmetic", two("Ratio", col(4), col(0)), {"type": "numeric", "unit": "unitless"}),
    5: ("categorical_interaction", two("Cross", col(1), col(2)), {"type": "categorical"}),
    6: ("rowwise_stats", {"op": "RowMean", "children": [col(0), col(4)]}, {}),
    7: ("categorical_encoding", un("FrequencyEncode", col(4)), None),
    8: ("normalization", un("ZScore", {"op": "Col", "col_index": 0, "source_split": "test"}), None),
    9: ("nonlinear_transform", un("Abs", {"op": "Col", "col_index": 0, "time_origin": "2025-06-01"}), None),
}
COLUMNS = [(0, "numeric", "unitless", False), (1, "categorical", "unitless", False), (2, "categorical", "unitless", False), (3, "categorical", "unitless", False), (4, "numeric", "count", False), (5, "numeric", "unitless", True)]
T_STAR = "2025-01-01T00:00:00Z"


def canonical(kind: int) -> str:
    return json.dumps(KINDS[kind][1], sort_keys=True, separators=(",", ":"))


def by_kind(make: Callable[[int], str]) -> str:
    return "case k " + " ".join(f"when {k} then {make(k)}" for k in KINDS) + " end"


TEXT = by_kind(lambda k: "replace('" + canonical(k) + "', '\"I\"', i::varchar)")
CODE = "case k when 0 then case when i in (1, 2, 3) then 'C4.TYPE' when i = 5 then 'C2.TARGET_LEAK' when i > 5 then 'C1.UNKNOWN_COLUMN' end when 1 then 'C2.TARGET_LEAK' when 3 then 'C4.TYPE' when 4 then 'C4.UNIT' when 7 then 'C4.TYPE' when 8 then 'C5.FIT_LEAK' when 9 then 'C3.FUTURE_TIME' end"
PARTS = f"with p as (select 'f' || p_partkey as feature_id, p_partkey as seq, p_partkey % 10 as k, p_size % 8 as i from part), c as (select *, {TEXT} as program, {CODE} as code, k in (3, 4, 7) or (k = 0 and i in (1, 2, 3, 6, 7)) as broken from p)"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature_id"), F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 10).cast("int").alias("k"), (F.col("p_size") % 8).cast("string").alias("i"))
    pick = lambda make: F.get(F.array(*[F.lit(make(k)).cast("string") for k in KINDS]), F.col("k"))
    output = pick(lambda k: None if KINDS[k][2] is None else json.dumps(KINDS[k][2]))
    return parts.select("feature_id", "seq", pick(lambda k: KINDS[k][0]).alias("family"), F.replace(pick(canonical), F.lit('"I"'), F.col("i")).alias("program"), output.alias("output"))


def schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, False) for r in COLUMNS], "col_index int, dtype string, unit string, is_target boolean, is_forbidden boolean")


def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs' nodes as a written table, as certificates read them several times."""
    return staged(certify.nodes(programs(spark, sf_dir), schema(spark)))


@query("program_nodes", f"{PARTS} select feature_id, case when broken then 1 else case k when 1 then 4 when 2 then 3 when 5 then 3 when 6 then 3 else 2 end end as nodes, case when broken then code end as error from c")
def program_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(spark, sf_dir).groupBy("feature_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("error").alias("error"))


def _certificate(cert: str, code: str, witness: str):
    sql = f"{PARTS} select feature_id, case when code = '{code}' then 'fail' else 'pass' end as verdict, case when code = '{code}' then {witness} else '' end as witness from c where not broken"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = certify.traces(compiled(spark, sf_dir), schema(spark), T_STAR, wanted=(cert,))
        return own.select("feature_id", "verdict", F.array_join("witness", ",").alias("witness"))

    return sql, run


for _name, _cert, _code, _witness in (("cert_leakage", "C2", "C2.TARGET_LEAK", "case k when 1 then 'n3' else 'n1' end"), ("cert_train_only", "C5", "C5.FIT_LEAK", "'n1'")):
    _sql, _run = _certificate(_cert, _code, _witness)
    query(_name, _sql)(_run)

#: Faults that the compiler lets no program have, put into the node table: (kind, seq % 3, node, column, new value).
FAULTS = [
    (5, 0, "n2", "children", ["n0"]),  # C1: a Cross of one
    (6, 0, "n2", "op", "Median"),  # C1: an unknown operator
    (6, 1, "n1", "col_index", 77),  # C1: a column that isn't there
    (5, 1, "n0", "dtype", "numeric"),  # C4: a Cross of a number
    (6, 2, "n2", "op", "Add"),  # C4: a sum of different units
    (8, 0, "n0", "children", ["n1"]),  # C6: two nodes below each other
    (8, 1, "n1", "children", ["n7"]),  # C6: no such node
    (9, 0, "n1", "children", ["n1"]),  # C6: a node below itself
    (9, 1, "n0", "time_origin", "2025-01-01T08:00:00+09:00"),  # C3: one hour before t*
    (9, 2, "n0", "time_origin", "soon"),  # C3: no time
]


def tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compiled(spark, sf_dir)
    seq = F.substring("feature_id", 2, 20).cast("long")
    for kind, rest, node, column, new in FAULTS:
        here = (seq % 10 == kind) & (seq % 3 == rest) & (F.col("node_id") == node)
        value = F.array(*map(F.lit, new)) if isinstance(new, list) else F.lit(new)
        rows = rows.withColumn(column, F.when(here, value).otherwise(F.col(column)))
    return rows


for _name, _cert, _fail in (
    ("cert_schema", "C1", "case when k = 5 and r = 0 or k = 6 and r = 0 then 'n2' when k = 6 and r = 1 then 'n1' end"),
    ("cert_temporal", "C3", "case when k = 9 and r <> 1 then 'n0' end"),
    ("cert_type_unit", "C4", "case when k = 5 and r = 1 or k = 6 and r = 2 then 'n2' end"),
    ("cert_lineage", "C6", "case when k = 8 and r = 0 then 'n0,n1' when k = 8 and r = 1 or k = 9 and r = 0 then 'n1' end"),
):

    def _tampered(spark: SparkSession, sf_dir: str, cert: str = _cert) -> DataFrame:
        own = certify.traces(tampered(spark, sf_dir), schema(spark), T_STAR, wanted=(cert,))
        return own.select("feature_id", "verdict", F.array_join("witness", ",").alias("witness"))

    query(_name, f"{PARTS}, x as (select *, {_fail} as bad from (select *, seq % 3 as r from c where not broken)) select feature_id, case when bad is null then 'pass' else 'fail' end as verdict, coalesce(bad, '') as witness from x")(_tampered)


@query("verdict_cache", f"{PARTS} select feature_id, code is null as passed, code as failure_code, program in (select program from c where seq % 3 > 0) as cached from c")
def verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the programs are certified, then all: only texts that are new by then are certified again."""
    own, cache = programs(spark, sf_dir), shared_folder(spark)
    (tag,) = [r.schema_hash for r in certify.schema_hashes(schema(spark).withColumn("dataset", F.lit("part"))).collect()]
    certify.certify_new(own.where("seq % 3 > 0"), schema(spark), cache, tag, T_STAR)
    return certify.certify_new(own, schema(spark), cache, tag, T_STAR)[0].select("feature_id", "passed", "failure_code", "cached")


@query("schema_hash", """with s as (select distinct p_brand as dataset, p_size % 8 as col_index, case when p_size % 8 in (2, 5) then 'categorical' else 'numeric' end as dtype, p_size % 8 = 7 as is_target, p_size % 8 in (1, 3) as is_forbidden from part),
g as (select dataset, list(col_index || ':' || dtype order by col_index) as cols, coalesce(list(col_index order by col_index) filter (is_forbidden), []) as forbidden, count(*) as n, min(col_index) filter (is_target) as target from s group by 1)
select dataset, substr(sha256('{"checks":["C1","C2","C3","C4","C5","C6"],"col_types":' || to_json(cols)::varchar || ',"dataset":"' || dataset || '","forbidden_cols":' || to_json(forbidden)::varchar || ',"n_cols":' || n || ',"target_col":' || coalesce(target::varchar, 'null') || '}'), 1, 16) as schema_hash from g""")
def schema_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_size") % 8
    kind = F.when(i.isin(2, 5), "categorical").otherwise("numeric")
    return certify.schema_hashes(table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), i.alias("col_index"), kind.alias("dtype"), (i == 7).alias("is_target"), i.isin(1, 3).alias("is_forbidden")))


@query("cert_verdicts", f"{PARTS} select feature_id, code is null as passed, code as failure_code from c")
def cert_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compiled(spark, sf_dir)
    return certify.verdicts(own, certify.traces(own, schema(spark), T_STAR))


@query("program_hash", f"{PARTS} select feature_id, substr(sha256(program), 1, 16) as hash from c")
def program_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(spark, sf_dir).select("feature_id", "hash").distinct()


@query("program_dedup", f"{PARTS} select feature_id, row_number() over (partition by program order by seq) > 1 as duplicate from c")
def program_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.first_of_each(compiled(spark, sf_dir), programs(spark, sf_dir)).select("feature_id", "duplicate")


@query("program_columns", f"{PARTS} select feature_id, case k when 0 then i::varchar when 1 then '2,5' when 2 then '2,5' when 5 then '1,2' when 6 then '0,4' else '0' end as col_group from c where not broken")
def program_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = certify.column_sets(compiled(spark, sf_dir))
    return own.select("feature_id", F.array_join(F.col("col_group").cast("array<string>"), ",").alias("col_group"))


# Audit records, one from each event.

FAMILY = "case event_id % 7 " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(IID_FAMILIES[:6])) + " else 'temporal_trend' end"
RECORDS = f"""select user_id % 20 as run_id, event_id as seq, cast(floor(event_id / 50) as int) as round, concat('f', event_id) as feature_id, {FAMILY} as family,
 cast(event_id % 4 as int) as c1, cast(4 + event_id % 3 as int) as c2,
 case event_id % 6 when 0 then case when event_id % 7 = 3 then 'rejected_gain' else 'accepted' end when 1 then 'rejected_compile' when 2 then 'rejected_cert' when 3 then 'rejected_redundant' else 'rejected_gain' end as status,
 case event_id % 6 when 0 then '' when 1 then 'C4.TYPE' when 2 then 'C2.TARGET_LEAK' when 3 then 'POST_EVAL_REDUNDANT' else 'TIER3_SINGLE_FAIL' end as rejection_reason,
 value / 1000 as delta_mean, value as verify_ms, value / 10 as eval_seconds from events"""
REC = f"with r as ({RECORDS}) "


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RECORDS.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    return rows.withColumn("col_group", F.array("c1", "c2"))


@query("status_counts", f"{REC} select run_id, count(*) as total, count(*) filter (status = 'accepted') as accepted, count(*) filter (status <> 'accepted') as rejected, max(delta_mean) filter (status = 'accepted') as best_gain from r group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_counts(records(spark, sf_dir))


RUNS = f"{REC}, per as (select run_id, count(*) as total_candidates, count(*) filter (status = 'accepted') as accepted, count(*) filter (status in ('rejected_compile', 'rejected_cert')) as rejected_cert, count(*) filter (status not in ('accepted', 'rejected_compile', 'rejected_cert')) as rejected_eval, count(distinct round) as total_rounds, coalesce(string_agg(feature_id, ',' order by seq) filter (status = 'accepted'), '') as accepted_features from r group by 1), sc as (select user_id % 20 as run_id, 'd' || user_id % 20 as dataset, round(avg(value), 3) as baseline_score, case when user_id % 20 % 3 > 0 then round(avg(value) * 1.1, 3) end as final_score from events group by user_id % 20)"


@query("rejection_rollup", f"{REC} select status, rejection_reason, count(*) as n from r where status <> 'accepted' group by rollup (status, rejection_reason)")
def rejection_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rejections(records(spark, sf_dir))


@query("cumulative_cost", f"{REC} select run_id, seq, k, seconds from (select run_id, seq, status, count(*) filter (status = 'accepted') over w as k, round(sum(verify_ms / 1000 + eval_seconds) over w, 6) as seconds from r window w as (partition by run_id order by seq rows between unbounded preceding and current row)) where status = 'accepted'")
def cumulative_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.cumulative_cost(records(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


COVER = f"{REC}, c as (select family, c1 || ',' || c2 as col_group, count(*) filter (status = 'accepted') as n_accepted, count(*) filter (status <> 'accepted') as n_rejected, max(round) as last_round, bool_or(status = 'accepted') as covered from r group by 1, 2)"


@query("coverage", f"{COVER} select * from c")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(records(spark, sf_dir)).withColumn("col_group", F.array_join(F.col("col_group").cast("array<string>"), ","))


FAMS = "(values " + ", ".join(f"('{f}')" for f in IID_FAMILIES) + ") f(family)"


@query("undercovered", f"{COVER} select family, 'unexplored' as status, null as col_group, 0::bigint as n_rejected from {FAMS} where family not in (select family from c) union all select family, 'all_rejected', col_group, n_rejected from c where n_accepted = 0")
def undercovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.undercovered(audit.coverage(records(spark, sf_dir))).withColumn("n_rejected", F.coalesce("n_rejected", F.lit(0).cast("bigint")))
    return out.withColumn("col_group", F.array_join(F.col("col_group").cast("array<string>"), ","))


@query("family_yield", f"{COVER}, g as (select family, sum(n_accepted)::bigint a, sum(n_rejected)::bigint b, count(distinct col_group) d from c group by 1) select f.family, coalesce(a, 0) as n_accepted, coalesce(b, 0) as n_rejected, round(a::double / (a + b), 6) as yield_rate, coalesce(d, 0) as col_groups, case when a is null then 'PRIORITY' when a = 0 and b > 0 then 'AVOID' else '' end as advice from {FAMS} left join g on f.family = g.family")
def family_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.family_yield(audit.coverage(records(spark, sf_dir))).withColumn("yield_rate", F.round("yield_rate", 6))


@query("recent_rejections", f"{REC} select seq, feature_id, rejection_reason from r where status in ('rejected_compile', 'rejected_cert') order by seq desc limit 10")
def recent_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recent_rejections(records(spark, sf_dir))


ROUNDS = f"{REC}, q as (select run_id, round, count(*) filter (status = 'accepted') as accepted from r group by 1, 2)"


@query("stop_round", f"""{ROUNDS}, w as (select *, sum(accepted) over x as total, row_number() over x as place from q window x as (partition by run_id order by round)),
l as (select *, coalesce(max(case when accepted > 0 then place end) over (partition by run_id order by round), 0) as last from w),
s as (select run_id, round, case when place >= 50 then 'budget' when place - last >= 5 then 'no_accept' when total >= 30 then 'k_max' end as reason from l),
f as (select * from s where reason is not null qualify row_number() over (partition by run_id order by round) = 1)
select e.run_id, coalesce(f.round, e.final) as stop_round, coalesce(f.reason, 'running') as reason from (select run_id, max(round) as final from q group by 1) e left join f on e.run_id = f.run_id""")
def stop_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = records(spark, sf_dir).groupBy("run_id", "round").agg(F.count_if(F.col("status") == "accepted").alias("accepted"))
    return audit.stop_round(rounds)


@query("run_metrics", ROUNDS.replace(REC, RUNS + " ").replace(" , q as", ", q as") + """, w as (select *, sum(accepted) over x as total, row_number() over x as place from q window x as (partition by run_id order by round)),
l as (select *, coalesce(max(case when accepted > 0 then place end) over (partition by run_id order by round), 0) as last from w),
s as (select run_id, round, case when place >= 50 then 'budget' when place - last >= 5 then 'no_accept' when total >= 30 then 'k_max' end as reason from l),
f as (select * from s where reason is not null qualify row_number() over (partition by run_id order by round) = 1)
select sc.run_id, dataset, accepted, total_rounds, coalesce(reason, 'running') as stop_reason, baseline_score, final_score, round(coalesce(final_score - baseline_score, 0), 6) as improvement, total_candidates, rejected_cert, rejected_eval, accepted_features from sc join per using (run_id) left join f using (run_id)""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("run_id")).agg(F.round(F.avg("value"), 3).alias("baseline_score"), F.round(F.avg("value") * 1.1, 3).alias("f"))
    scores = scores.select("run_id", F.concat(F.lit("d"), F.col("run_id").cast("string")).alias("dataset"), "baseline_score", F.when(F.col("run_id") % 3 > 0, F.col("f")).alias("final_score"))
    out = audit.run_metrics(records(spark, sf_dir), scores).withColumn("improvement", F.round("improvement", 6))
    return out.withColumn("accepted_features", F.array_join("accepted_features", ","))


@query("audit_log", f"""{PARTS}, t as (select feature_id, string_agg('C' || n || ':' || case when code like 'C' || n || '.%' then 'fail' else 'pass' end, ' ' order by n) as checks from c, range(1, 7) x(n) where not broken group by 1)
select feature_id, family, case when code is null then 'accepted' when broken then 'rejected_compile' else 'rejected_cert' end as status, coalesce(code, '') as rejection_reason, substr(sha256(program), 1, 16) as program_hash,
 case when broken then null when code is null then 'pass' else 'fail' end as overall, coalesce(checks, '') as checks, case when code is null then 'intent of ' || feature_id end as declared_intent, seq::double as cost_verify_ms
from (select *, {by_kind(lambda k: "'" + KINDS[k][0] + "'")} as family from c) left join t using (feature_id)""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs' audit records, written as JSON lines and read again."""
    own, path = compiled(spark, sf_dir), shared_folder(spark)
    told = staged(certify.traces(own, schema(spark), T_STAR))
    verdict = certify.verdicts(own, told).join(own.groupBy("feature_id").agg(F.max("hash").alias("program_hash"), F.bool_or(F.col("error").isNotNull()).alias("broken")).hint("merge"), "feature_id")
    status = F.when(F.col("passed"), "accepted").when(F.col("broken"), "rejected_compile").otherwise("rejected_cert")
    rows = verdict.join(programs(spark, sf_dir).hint("merge"), "feature_id").select("feature_id", "family", status.alias("status"), F.coalesce("failure_code", F.lit("")).alias("rejection_reason"), "program_hash", "program", F.concat(F.lit("intent of "), "feature_id").alias("declared_intent"), F.col("seq").cast("double").alias("cost_verify_ms"))
    datasets.write_audit(rows, path, told)
    read = spark.read.schema(datasets.audit_records(rows, told).schema).json(path)
    checks = F.array_join(F.transform("hard.checks", lambda x: F.concat(x["name"], F.lit(":"), x["status"])), " ")
    return read.select("feature_id", "family", "status", "rejection_reason", "hard.program_hash", "hard.overall", checks.alias("checks"), "soft.semantic.declared_intent", "soft.empirical.cost_verify_ms")


GUESS = "select o_orderkey, o_orderstatus as label, case when o_orderkey % 3 = 0 then 'F' else o_orderstatus end as prediction, o_totalprice as y, o_totalprice * 0.9 + o_orderkey % 1000 as p from orders"


@query("micro_f1", f"select round(avg((label = prediction)::int), 6) as micro_f1 from ({GUESS})")
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GUESS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    return rounded(audit.micro_f1(rows, "label", "prediction"))


@query("r2", f"select round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) as r2 from ({GUESS}), (select avg(o_totalprice) m from orders)")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GUESS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))
    return rounded(audit.r2(rows, "y", "p"))


@query("marginal_gain", "select event_id, round((value - event_id % 13) / greatest(abs(event_id % 13), 1e-9) * case when event_id % 13 = 0 then 1e-9 else 1 end, 6) as gain from events")
def marginal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the base is 0 the gain is in units of 1e9, as it is a quotient by 1e-9."""
    rows = table(spark, sf_dir, "events").withColumn("base", (F.col("event_id") % 13).cast("double"))
    gain = audit.marginal_gain(F.col("value"), F.col("base")) * F.when(F.col("base") == 0, 1e-9).otherwise(1.0)
    return rows.select("event_id", F.round(gain, 6).alias("gain"))


DELTAS = "select event_id, case when event_id % 10 = 0 then 'TIER1_NAN' else '' end as tier1_reason, (event_id % 17) / 1000.0 as d2, case when event_id % 41 = 0 then null when event_id % 43 = 0 then cast('NaN' as double) else (event_id % 19) / 1000.0 end as d3, case when event_id % 47 = 0 then null else (event_id % 23) / 1000.0 end as d4, case when event_id % 29 = 0 then 'C4.TYPE' end as compile_error, case when event_id % 31 = 0 then 'C2.TARGET_LEAK' end as cert_code, case when event_id % 37 = 0 then 'EXECUTION_FAILED' end as execution_error, (event_id % 101) / 100.0 as redundancy_max from events"
GATE = "case when tier1_reason <> '' then tier1_reason when d2 < 0.003 then 'TIER2_NO_SIGNAL' when not coalesce(d3 >= 0.01 and not isnan(d3), false) then 'TIER3_SINGLE_FAIL' when (d4 + 0.01) < 0.015 then 'TIER4_LOW_GAIN' else '' end"


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(DELTAS.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    x = lambda c: F.col(c).cast("double")
    rows = rows.select("*", x("d2").alias("delta2"), x("d3").alias("delta3"), F.array(x("d4"), x("d4") + 0.01).alias("deltas4")).withColumn("redundancy_max", x("redundancy_max"))
    return audit.tier_gates(rows, 0.01, tier2=True, tier4=True)


GATE4 = GATE.replace("(d4 + 0.01) < 0.015", "d4 is null or d4 + 0.005 < 0.01 and event_id % 23 < 5")


@query("tier_gates", f"select event_id, {GATE4} as tier_reason, round(d4 + 0.005, 6)::double as delta4_mean, case when d4 is not null then 0.005::double end as delta4_std from ({DELTAS})")
def tier_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(spark, sf_dir).select("event_id", "tier_reason", F.round("delta4_mean", 6).alias("delta4_mean"), F.round("delta4_std", 6).alias("delta4_std"))


@query("acceptance_funnel", f"""select event_id, case when compile_error is not null then 'rejected_compile' when cert_code is not null then 'rejected_cert' when execution_error is not null then 'rejected_execution' when redundancy_max >= 0.92 then 'rejected_redundant' when tier_reason <> '' then 'rejected_gain' else 'accepted' end as status,
coalesce(compile_error, cert_code, execution_error, case when redundancy_max >= 0.92 then 'POST_EVAL_REDUNDANT' end, tier_reason) as rejection_reason from (select *, {GATE4} as tier_reason from ({DELTAS}))""")
def acceptance_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.funnel(deltas(spark, sf_dir)).select("event_id", "status", "rejection_reason")


# Gains of candidates from data: a target of known parts, one base column, candidates from most operators.

GOALS = f"select *, 0.2 * signed + 10000 * small + case when status = 'F' then 15000 else 0 end as goal from ({ORDERS})"
#: name: (program, SQL over base and the train statistics).
CANDIDATES = {n: SCALARS[n] for n in ("log1p", "sqrt_clip0", "abs", "square", "reciprocal", "is_null", "add", "subtract", "multiply", "divide", "ratio", "is_equal", "one_hot_select", "coalesce", "row_mean", "row_max", "row_min", "row_sum", "row_std")} | {
    "scaled": (FITS["zscore"][0], "(price - m) / s"),
    "ranged": (FITS["minmax"][0], "(price - a) / (z - a)"),
    "doubled": (two("Multiply", col(3), const(2.0)), "small * 2"),
    "signed_again": (two("Add", col(2), const(0.0)), "signed"),
    "constant": (two("IsEqual", col(5), col(5)), "1.0"),
    "mostly_missing": (un("Log1p", two("Subtract", un("Abs", col(2)), const(250000.0))), "case when abs(signed) - 250000 > -1 then ln(1 + abs(signed) - 250000) end"),
}


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates' columns beside the base, the target and the split, as a written table."""
    rows = splits.train_val_test(spark.sql(GOALS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders")), "o_orderkey")
    wanted = {n: p for n, (p, _) in CANDIDATES.items()}
    return staged(features.apply(rows, wanted, TYPES, features.fit(rows, wanted, TYPES, NAMES), ["o_orderkey", "_split", "small", "goal"], NAMES))


GAINS = f"""with base as ({GOALS}), o as (select *, {SPLIT} as _split from (select *, {BUCKET} as b from base)),
st as (select avg(price) m, stddev_samp(price) s, min(price) a, max(price) z from o where _split = 'train'),
f as (select o_orderkey, _split, small as x, goal as y, ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::bigint % 5 as fold,
  row_number() over (partition by _split order by md5('42:' || o_orderkey)) as place, [{', '.join(f"({v})::double" for _, v in CANDIDATES.values())}] as vs from o, st where _split <> 'test'),
sized as (select *, least(2000, max(place) filter (_split = 'train') over ()) as n from f),
tiers as (select '3' as tier, _split = 'train' as fits, o_orderkey, x, y, vs from sized
  union all select '2', place <= floor(0.8 * n), o_orderkey, x, y, vs from sized where _split = 'train' and place <= n
  union all select '4.' || k, fold <> k, o_orderkey, x, y, vs from sized, range(5) r(k)),
l as (select tier, fits, x, y, unnest([{', '.join(f"'{n}'" for n in CANDIDATES)}]) as feature_id, coalesce(unnest(vs), -1.0) as v from tiers),
t as (select tier, feature_id, avg(x) mx, avg(y) my, avg(v) mv, var_pop(x) xx, var_pop(v) vv, covar_pop(x, v) xv, covar_pop(x, y) xy, covar_pop(v, y) vy from l where fits group by 1, 2),
c as (select *, case when xx * vv - xv * xv > 1e-9 * xx * vv then (xx * vy - xv * xy) / (xx * vv - xv * xv) else 0 end as bv from t),
p as (select *, (xy - bv * xv) / xx as bx, xy / xx as b0 from c),
e as (select tier, feature_id, 1 - sum((y - my - b0 * (x - mx)) ** 2) / (var_pop(y) * count(*)) as old, 1 - sum((y - my - bx * (x - mx) - bv * (v - mv)) ** 2) / (var_pop(y) * count(*)) as new
  from l join p using (tier, feature_id) where not fits group by 1, 2),
g as (select feature_id, max(old) filter (tier = '3') as base_score, max(new) filter (tier = '3') as score, max((new - old) / abs(old)) filter (tier = '2') as delta2, max((new - old) / abs(old)) filter (tier = '3') as delta3,
  avg((new - old) / abs(old)) filter (tier like '4%') as delta4_mean, stddev_pop((new - old) / abs(old)) filter (tier like '4%') as delta4_std from e group by 1)"""


def real_gains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = goals(spark, sf_dir)
    return rows, gains.candidate_gains(rows, "o_orderkey", "goal", ["small"], list(CANDIDATES))


@query("candidate_gains", f"{GAINS} select feature_id, round(base_score, 6) as base_score, round(score, 6) as score, round(delta2, 6) as delta2, round(delta3, 6) as delta3, round(delta4_mean, 6) as delta4_mean, round(delta4_std, 6) as delta4_std from g")
def candidate_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.tier_gates(real_gains(spark, sf_dir)[1].withColumn("tier1_reason", F.lit("")), tier4=True)
    return rounded(out.select("feature_id", "base_score", "score", "delta2", "delta3", "delta4_mean", "delta4_std"))


@query("gain_funnel", f"""{GAINS}, w as (select unnest([{', '.join(f"'{n}'" for n in CANDIDATES)}]) as feature_id, unnest(vs) as v, x, md5('42:' || o_orderkey) as h from f where _split = 'train'),
pr as (select feature_id, case when avg((v is null)::int) > 0.5 then 'TIER1_NAN' when stddev_samp(v) < 1e-9 then 'TIER1_CONSTANT' else '' end as tier1_reason from w group by 1),
sa as (select * from w where v is not null qualify row_number() over (partition by feature_id order by h) <= 5000),
ra as (select feature_id, rank() over (partition by feature_id order by v) + (count(*) over (partition by feature_id, v) - 1) / 2.0 as rv, rank() over (partition by feature_id order by x) + (count(*) over (partition by feature_id, x) - 1) / 2.0 as rx, v from sa),
re as (select feature_id, case when count(*) >= 30 and stddev_pop(v) >= 1e-12 then greatest(corr(rv, rx), 0) else 0 end as sim from ra group by 1)
select feature_id, case when coalesce(sim, 0) >= 0.92 then 'rejected_redundant' when tier1_reason <> '' or delta2 < 0.003 or delta3 < 0.01 or delta4_mean < 0.01 then 'rejected_gain' else 'accepted' end as status,
case when coalesce(sim, 0) >= 0.92 then 'POST_EVAL_REDUNDANT' when tier1_reason <> '' then tier1_reason when delta2 < 0.003 then 'TIER2_NO_SIGNAL' when delta3 < 0.01 then 'TIER3_SINGLE_FAIL' when delta4_mean < 0.01 then 'TIER4_LOW_GAIN' else '' end as rejection_reason
from g join pr using (feature_id) left join re using (feature_id)""")
def gain_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate on its own against the base column, which is the one accepted feature."""
    rows, found = real_gains(spark, sf_dir)
    train = rows.where("_split = 'train'")
    pairs = selection.rank_correlation(train, "o_orderkey", [(n, "small") for n in CANDIDATES])
    hashes = spark.createDataFrame([(n, i, structural_hash(p)) for i, (n, (p, _)) in enumerate(CANDIDATES.items())] + [("small", 0, structural_hash(col(3)))], "feature_id string, seq int, hash string")
    out = gains.refused(found, selection.profile(train, list(CANDIDATES)), selection.redundancy(pairs, hashes), tier2=True, tier4=True)
    return out.select("feature_id", "status", "rejection_reason")


@query("accepted_in_order")
def accepted_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates one after another, five to a round, each against what was accepted before it."""
    order = [(i // 5, n, structural_hash(p)) for i, (n, (p, _)) in enumerate(CANDIDATES.items())]
    return rounded(gains.forward(goals(spark, sf_dir), "o_orderkey", "goal", ["small"], order, tier2=True, tier4=True))


# Model inputs and scores.


@query("model_input", f"with base as ({ORDERS}) select o_orderkey, coalesce(price, -1.0) as price, signed, dense_rank() over (order by coalesce(priority, 'nan')) - 1 as priority from base")
def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.model_input(orders(spark, sf_dir).select("o_orderkey", "price", "signed", "priority"), ["price", "signed"], ["priority"])
    return out.withColumn("priority", F.col("priority").cast("bigint"))


@query("load_dataset", "select o_orderkey::double as c0, o_orderpriority || ', \"' || o_orderstatus || '\"' as c1, case when o_orderkey % 7 > 0 then round(o_totalprice, 2) end as c2, o_orderstatus as c3 from orders")
def load_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as a headless CSV with commas and quotes in a field and text among the numbers, with its sidecar, read again."""
    rows = table(spark, sf_dir, "orders")
    stem = shared_folder(spark)
    noisy = F.when(F.col("o_orderkey") % 7 > 0, F.round("o_totalprice", 2).cast("string")).otherwise("none")
    rows.select(F.col("o_orderkey").cast("string"), F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')), noisy, "o_orderstatus").write.csv(f"{stem}.csv", quote='"', escape='"')
    spark.createDataFrame([('{"task": "C", "0": "num", "1": "cat", "2": "num", "3": "cat"}',)], "value string").coalesce(1).write.text(f"{stem}.json")
    return datasets.load_dataset(spark, stem)[0]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.label_encode(split_orders(spark, sf_dir), "status").withColumnRenamed("label_code", "label")
    return scoring.model_input(rows.select("o_orderkey", "_split", "label", "price", "signed", "small", "priority"), ["price", "signed", "small"], ["priority"])


INPUTS = ["price", "signed", "small", "priority"]


@query("model_score")
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return spark.createDataFrame([(n, scoring.score(rows.where("_split = 'train'"), rows.where("_split = 'val'"), INPUTS, "C", n)) for n in ("RF", "LR")], "model string, score double")


@query("cv_score")
def cv_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("_split = 'train'")
    return spark.createDataFrame(list(enumerate(scoring.cross_validated(rows, "o_orderkey", INPUTS, "C"))), "fold int, score double")


@query("final_score")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest on the test orders, without and with the flagship's features."""
    rows = splits.label_encode(split_orders(spark, sf_dir), "status").withColumnRenamed("label_code", "label")
    baseline, final = scoring.final_score(rows, "o_orderkey", ["price", "signed", "small"], ["priority"], FLAGSHIP, TYPES, NAMES)
    return spark.createDataFrame([(baseline, final)], "baseline double, score double")


# Temporal and entity features on events.

EVENTS = "select event_id, user_id, ts, case when event_id % 8 = 0 then null else value end as x, event_id % 100 as amount from events"
LAST5 = "(partition by user_id order by ts, event_id rows between 4 preceding and current row)"
W = "over (partition by user_id order by ts, event_id)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


@query("window_agg", f"select event_id, (sum(amount) over (partition by user_id order by ts range between interval 7 days preceding and current row))::bigint as value from ({EVENTS})")
def window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.range_agg(events(spark, sf_dir), "user_id", "ts", 86_400 * 7, {"value": ("sum", "amount")})
    return out.select("event_id", F.col("value").cast("bigint").alias("value"))


for _name, _make, _sql in (
    ("lag_value", lambda: temporal.lag("user_id", "ts", "x", tie="event_id"), f"lag(x) {W}"),
    ("trend_slope", lambda: F.round(temporal.trend("user_id", "ts", "amount", tie="event_id") * 86_400, 4), f"round(regr_slope(amount, epoch_us(ts) / 1e6 - 1.7e9) over {LAST5} * 86400, 4)"),
    ("time_since", lambda: F.round(temporal.time_since("user_id", "ts"), 3), f"round((epoch_us(ts) - epoch_us(lag(ts) {W})) / 1e6, 3)"),
    ("rolling_mean", lambda: F.round(temporal.rolling_mean("user_id", "ts", "x", tie="event_id"), 6), f"round(avg(x) over {LAST5}, 6)"),
    ("rolling_std", lambda: F.round(temporal.rolling_std("user_id", "ts", "x", tie="event_id"), 5), f"round(stddev_samp(x) over {LAST5}, 5)"),
):
    query(_name, f"select event_id, {_sql} as value from ({EVENTS})")(lambda s, d, m=_make: events(s, d).select("event_id", m().alias("value")))


@query("group_by_agg", f"select user_id, round(avg(x), 6) as value from ({EVENTS}) where ts <= (select timestamp '2024-01-15') group by 1")
def group_by_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.group_by_agg(events(spark, sf_dir), "user_id", "x", "avg", "ts", "2024-01-15"))


HOT = "select event_id, case when event_id % 3 = 0 then -1 else user_id end as user_id, ts, case when event_id % 8 = 0 then null else value end as x, event_id % 100 as amount from events"


def hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, a third of them of one entity."""
    return spark.sql(HOT.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


@query("hot_entity_rows", f"select event_id, round(avg(x) over {LAST5}, 6) as mean, round(stddev_samp(x) over {LAST5}, 5) as deviation, lag(x) {W} as before, round(regr_slope(amount, epoch_us(ts) / 1e6 - 1.7e9) over {LAST5} * 86400, 2) as slope, round((epoch_us(ts) - epoch_us(lag(ts) {W})) / 1e6, 3) as since from ({HOT})")
def hot_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean and deviation, lag, trend and time since, with entities cut into tiles of rows."""
    make = lambda e: {"mean": F.round(temporal.rolling_mean(e, "ts", "x", tie="event_id"), 6), "deviation": F.round(temporal.rolling_std(e, "ts", "x", tie="event_id"), 5), "before": temporal.lag(e, "ts", "x", tie="event_id"), "slope": F.round(temporal.trend(e, "ts", "amount", tie="event_id") * 86_400, 2), "since": F.round(temporal.time_since(e, "ts"), 3)}
    return temporal.by_rows(hot_events(spark, sf_dir), "user_id", "ts", 5, make, tie="event_id", tile=200).select("event_id", "mean", "deviation", "before", "slope", "since")


@query("hot_entity_range", f"select event_id, (sum(amount) over (partition by user_id order by ts range between interval 2 days preceding and current row))::bigint as value from ({HOT})")
def hot_entity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.range_agg(hot_events(spark, sf_dir), "user_id", "ts", 86_400 * 2, {"value": ("sum", "amount")})
    return out.select("event_id", F.col("value").cast("bigint").alias("value"))


@query("hot_entity_asof", f"with e as ({HOT}), a as (select user_id, ts, x from e where event_id % 5 = 0 and x is not null) select e.event_id, a.x as asof_value from e asof left join a on e.user_id = a.user_id and e.ts >= a.ts where e.event_id % 5 > 0")
def hot_entity_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hot_events(spark, sf_dir)
    return temporal.asof_join(rows.where("event_id % 5 > 0").select("event_id", "user_id", "ts"), rows.where("event_id % 5 = 0"), "user_id", "ts", "x").select("event_id", "asof_value")


@query("group_by_agg_train", f"{BASE} select o_custkey, round(avg(o_totalprice), 6) as value from orders join o using (o_orderkey) where _split = 'train' group by 1")
def group_by_agg_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.train_val_test(table(spark, sf_dir, "orders"), "o_orderkey")
    return rounded(temporal.group_by_agg(rows, "o_custkey", "o_totalprice", split="_split"))


@query("entity_join_latest", "select o_orderkey, amount, value from orders left join (select user_id, event_id % 100 as amount, value from events qualify row_number() over (partition by user_id order by ts desc, amount, value) = 1) e on o_custkey % 300 = user_id")
def entity_join_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many attribute rows a key: the latest one's count, and no order is doubled."""
    attributes = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 100).alias("amount"), "value", "ts")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300).alias("k"))
    return temporal.entity_join(rows, attributes, "k", "ts").select("o_orderkey", "amount", "value")


@query("entity_join", "select o_orderkey, c_mktsegment, c_acctbal from orders left join customer on o_custkey = c_custkey")
def entity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return temporal.entity_join(table(spark, sf_dir, "orders"), attributes, "o_custkey").select("o_orderkey", "c_mktsegment", "c_acctbal")


@query("entity_asof_join", f"with e as ({EVENTS}), a as (select user_id, ts, x from e where event_id % 5 = 0 and x is not null) select e.event_id, a.x as asof_value from e asof left join a on e.user_id = a.user_id and e.ts >= a.ts where e.event_id % 5 > 0")
def entity_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    out = temporal.asof_join(rows.where("event_id % 5 > 0").select("event_id", "user_id", "ts"), rows.where("event_id % 5 = 0"), "user_id", "ts", "x")
    return out.select("event_id", "asof_value")


# Model answers, one from each event.


@query("ingest_responses", "select event_id as response_id, p as pos, 'f' || event_id || '_' || p as feature_id, 'binning' as family, case when p = 0 then 'why' else '' end as declared_intent, '{\"col_index\":' || event_id % 6 || ',\"op\":\"Col\"}' as program, null::varchar as output, case event_id % 4 when 1 then 1 else 2 end as attempted, (event_id // case event_id % 4 when 1 then 1 else 2 end)::bigint as tokens_each from events, range(2) r(p) where event_id % 4 < 3 and (event_id % 4 <> 1 or p = 0)")
def ingest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.ingest_responses(answers(spark, sf_dir))


@query("response_counts", "select event_id as response_id, [2, 1, 2, 0][(event_id % 4 + 1)::int]::bigint as attempted, [2, 1, 2, 0][(event_id % 4 + 1)::int]::bigint - (event_id % 4 = 2 and event_id % 3 = 0)::int as parsed, (event_id % 4 = 2 and event_id % 3 = 0)::bigint as parse_failures, event_id % 4 = 3 as unreadable from events")
def response_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every third list of two the second item's family is unknown."""
    rows = answers(spark, sf_dir)
    bad = F.regexp_replace("text", r'_1","family":"binning"', '_1","family":"other"')
    return datasets.response_counts(rows.withColumn("text", F.when((F.col("response_id") % 4 == 2) & (F.col("response_id") % 3 == 0), bad).otherwise(F.col("text"))))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    item = lambda p, extra: F.concat(F.lit('{"feature_id":"f'), e, F.lit(f'_{p}","family":"binning"{extra},"program":{{"op":"Col","col_index":'), (F.col("event_id") % 6).cast("string"), F.lit("}}"))
    first, second = item(0, ',"declared_intent":"why"'), item(1, "")
    both = F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("\n```json\n"), both, F.lit("\n```\n"))).when(F.col("event_id") % 4 == 1, first).when(F.col("event_id") % 4 == 2, both).otherwise("no JSON at all")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("response_id"), text.alias("text"), F.col("event_id").alias("tokens"))


@query("parse_reviews", "select event_id as review_id, case when event_id % 3 = 2 then '' else 'it is ' || event_id end as interpretation, case when event_id % 3 = 0 then 'plausible' else 'unclassifiable' end as plausibility, case when event_id % 3 = 2 then 'critic parse failure' else '' end as plausibility_witness, case event_id % 4 when 0 then 'match' when 1 then 'partial' else 'unclassifiable' end as intent_alignment, case event_id % 4 when 3 then 'critic parse failure' else 'w' end as alignment_witness from events")
def parse_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    first = F.when(e % 3 == 2, "oops").otherwise(F.concat(F.lit('```\n{"interpretation":"it is '), e.cast("string"), F.lit('","plausibility":"'), F.when(e % 3 == 0, "plausible").otherwise("sure"), F.lit('"}\n```')))
    second = F.when(e % 4 == 3, "{").otherwise(F.concat(F.lit('{"intent_alignment":"'), F.when(e % 4 == 0, "match").when(e % 4 == 1, "partial").otherwise("maybe"), F.lit('","alignment_witness":"w"}')))
    return datasets.parse_reviews(table(spark, sf_dir, "events").select(e.alias("review_id"), first.alias("first"), second.alias("second")))
