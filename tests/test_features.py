import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import grammar as G
from quern.operators import audit, certify, features, scoring, selection, splits
from quern.plans.catalog import col, const, two, un
from quern.sources import datasets
from quern.streaming.scoring import apply_stream


def values(df, program, types=None, **more):
    fitted = features.fit(df, {"v": program}, types or {}, df.columns, **more)
    if "v" in fitted.failed:
        return fitted.failed["v"]
    return [r.v for r in features.apply(df, {"v": program}, types or {}, fitted, [], df.columns).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(-4.0, "a"), (None, None), (0.0, "b"), (float("nan"), "a"), (-1.0, "nan")], "x double, c string").coalesce(1)


def test_missing_zero_and_negative(numbers):
    assert values(numbers, un("Sqrt", col(0))) == [0.0, None, 0.0, None, 0.0]
    assert values(numbers, un("Reciprocal", col(0))) == [-0.25, None, None, None, -1.0]
    assert values(numbers, un("Log1p", col(0))) == [None, None, 0.0, None, None]
    assert values(numbers, un("IsNull", col(0))) == [0.0, 1.0, 0.0, 1.0, 0.0]
    assert values(numbers, two("IsEqual", col(0), col(0))) == [1.0] * 5
    assert values(numbers, two("Cross", col(1), col(1)), {"c": "categorical"})[:2] == ["a_x_a", "nan_x_nan"]


def test_rows_of_missing_values(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 3.0)], "x double, y double").coalesce(1)
    make = lambda op: {"op": op, "children": [col(0), col(1)]}
    assert values(df, make("RowSum")) == [0.0, 1.0, 4.0]
    assert values(df, make("RowMean")) == [None, 1.0, 2.0]
    assert values(df, make("RowStd"))[:2] == [None, None]
    assert values(df, make("RowMax")) == [None, 1.0, 3.0]


def test_constant_columns_and_equal_deciles(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "x double")
    assert values(df, un("ZScore", col(0))) == [0.0] * 20
    assert values(df, un("MinMaxScale", col(0))) == [5.0] * 20
    assert values(df, un("QuantileBucketize", col(0))).startswith("EXECUTION_FAILED")
    assert values(df, un("QuantileBucketize", col(0)), duplicates="drop") == [0] * 20


def test_fit_reads_train_only_and_unseen_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, "train"), ("a", 3.0, "train"), (None, 5.0, "train"), ("b", 100.0, "test"), (None, 7.0, "test")], "c string, y double, _split string").coalesce(1)
    types = {"c": "categorical"}
    programs = {"f": un("FrequencyEncode", col(0)), "t": {"op": "TargetEncode", "cat_col": col(0), "label_col": col(1)}}
    fitted = features.fit(df, programs, types)
    rows = features.apply(df, programs, types, fitted, ["c", "_split"]).collect()
    assert [(r.f, r.t) for r in rows] == [(2.0, 2.0), (2.0, 2.0), (1.0, 5.0), (None, None), (1.0, 5.0)]


def test_bad_programs_fail_alone(numbers):
    assert "EXECUTION_FAILED" in str(values(numbers, un("ZScore", col(9))))
    with pytest.raises(G.ProgramError):
        G.children({"op": "Nope"})


def test_plan_has_no_python_and_one_scan(spark, sf):
    from quern.plans.catalog import FLAGSHIP, NAMES, TYPES, split_orders

    df = split_orders(spark, sf)
    fitted = features.fit(df, FLAGSHIP, TYPES, NAMES)
    plan = features.apply(df, FLAGSHIP, TYPES, fitted, ["o_orderkey"], NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000)
    one = {r.id: r._split for r in splits.train_val_test(df.coalesce(1), "id").collect()}
    assert one == {r.id: r._split for r in splits.train_val_test(df.repartition(7), "id").collect()}
    assert 0.58 < sum(v == "train" for v in one.values()) / 2000 < 0.7
    sizes = [r["count"] for r in splits.k_fold(df.limit(11), "id", exact=True).groupBy("fold").count().collect()]
    assert sorted(sizes) == [2, 2, 2, 2, 3]


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, "k"), (2.0, None, "k"), (3.0, 1.0, "k"), (4.0, 1.0, "k")], "a double, b double, c string")
    got = {r.feature_id: r.reason for r in selection.profile(df, ["a", "b"], ["c"]).collect()}
    assert got == {"a": "", "b": "TIER1_CONSTANT", "c": "TIER1_CONSTANT"}
    assert {r.reason for r in selection.profile(df.limit(0), ["a"]).collect()} == {"TIER1_NAN"}


def test_rank_correlation_needs_thirty_rows(spark):
    df = spark.range(29).select("id", F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    assert selection.rank_correlation(df, "id", [("x", "y")]).first().value_sim == 0.0
    more = spark.range(40).select("id", F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    assert round(selection.rank_correlation(more, "id", [("x", "y")]).first().value_sim, 9) == -1.0


def test_rank_correlation_of_text_and_of_no_common_rows(spark):
    df = spark.range(40).select("id", F.col("id").cast("double").alias("x"), F.concat(F.lit("a_x_"), "id").alias("t"), F.lit(None).cast("double").alias("none"), F.lit(5.0).alias("five"))
    got = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", [("x", "t"), ("t", "t"), ("x", "none"), ("x", "five")]).collect()}
    assert got == {("x", "t"): (40, 0.0), ("t", "t"): (40, 0.0), ("x", "none"): (0, 0.0), ("x", "five"): (40, 0.0)}


def test_selection_takes_hashes_and_every_pair(spark):
    pairs = spark.createDataFrame([("a", "b", 0.0), ("c", "a", 0.95), ("b", "c", 0.0), ("d", "a", -0.95), ("d", "b", 0.1), ("d", "c", 0.99)], "candidate string, accepted string, value_sim double")
    hashes = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "i"), ("d", None)], "feature_id string, hash string")
    assert selection.select_nonredundant(pairs, hashes, ["a", "b", "c", "d"]) == ["a", "d"]
    assert selection.select_nonredundant(pairs, hashes, ["a", "b", "c", "d"], absolute=True) == ["a"]
    with pytest.raises(ValueError, match="1 pairs"):
        selection.select_nonredundant(pairs.where("value_sim <> 0.1"), hashes, ["a", "b", "c", "d"])
    with pytest.raises(ValueError, match="no hash"):
        selection.select_nonredundant(pairs, hashes.where("feature_id <> 'd'"), ["a", "b", "c", "d"])


def test_certificates(spark):
    te = {"op": "TargetEncode", "cat_col": col(1), "label_col": col(2)}
    programs = {"bare": te, "above": un("Log1p", te), "unit": two("Add", un("Square", col(0)), col(0)), "column": col(7), "ok": un("ZScore", col(0)), "direct": col(2)}
    rows = [(k, "normalization", json.dumps(v), None) for k, v in programs.items()] + [("broken", "normalization", "{", None), (None, None, None, None), ("family", "x", "{}", None)]
    df = spark.createDataFrame(rows, "feature_id string, family string, program string, output string")
    schema = spark.createDataFrame([(0, "numeric", "unitless", False, False), (1, "categorical", "unitless", False, False), (2, "numeric", "unitless", True, False)], "col_index int, dtype string, unit string, is_target boolean, is_forbidden boolean")
    nodes = certify.nodes(df, schema)
    got = {r.feature_id: r.failure_code for r in certify.verdicts(nodes, certify.traces(nodes, schema)).collect()}
    assert got == {"bare": None, "above": "C2.TARGET_LEAK", "unit": "C4.UNIT", "column": "C1.UNKNOWN_COLUMN", "ok": None, "direct": "C2.TARGET_LEAK", "broken": "GRAMMAR", None: "GRAMMAR", "family": "GRAMMAR"}
    off = {r.feature_id: r.passed for r in certify.verdicts(nodes, certify.traces(nodes, schema), enabled=("C1",)).collect()}
    assert off["above"] and off["direct"]


def test_dataset_files(spark, tmp_path):
    stem = str(tmp_path / "d")
    (tmp_path / "d.csv").write_text("1,a,0\nx,b,1\n")
    (tmp_path / "d.json").write_text('{"task": "C", "0": "num", "1": "cat"}')
    rows, types, task = datasets.load_dataset(spark, stem)
    assert task == "C" and types == {"c0": "numeric", "c1": "categorical", "c2": "numeric"}
    assert sorted(map(tuple, rows.collect()), key=str) == [(1.0, "a", 0.0), (None, "b", 1.0)]


def test_stream_gives_the_batch_result(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/orders.parquet").select("o_totalprice", "o_orderpriority")
    source.write.parquet(str(tmp_path / "in"))
    types, programs = {"o_orderpriority": "categorical"}, {"z": un("ZScore", col(0)), "f": un("FrequencyEncode", col(1))}
    fitted = features.fit(source, programs, types)
    out = apply_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), programs, types, fitted, [])
    q = out.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = features.apply(source, programs, types, fitted, [])
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, batch.collect()))


def test_model_score(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.col("id") / 1000).alias("x"))
    assert scoring.score(df, df, ["x"], "C", "LR") > 0.95
    assert scoring.score(df, df, ["x"], "R", "RF", 5) > 0.9


def test_coalesce_takes_a_constant(numbers):
    assert values(numbers, two("Coalesce", col(0), const(9.0)))[1] == 9.0


def test_gains_that_are_missing_reach_no_gate(spark):
    nan = float("nan")
    rows = [(0, 1.0, 1.0, [1.0, 3.0]), (1, 1.0, None, [1.0]), (2, 1.0, nan, [1.0]), (3, None, 1.0, [1.0]), (4, 1.0, 1.0, [1.0, None]), (5, 1.0, 1.0, []), (6, 1.0, 1.0, None), (7, 1.0, 1.0, [nan]), (8, 1.0, 1.0, [1e8, 1e8])]
    df = spark.createDataFrame(rows, "id long, delta2 double, delta3 double, deltas4 array<double>").withColumn("tier1_reason", F.lit(""))
    got = {r.id: r for r in audit.tier_gates(df, tier2=True, tier4=True).collect()}
    assert [got[i].tier_reason for i in range(9)] == ["", "TIER3_SINGLE_FAIL", "TIER3_SINGLE_FAIL", "TIER2_NO_SIGNAL", *["TIER4_LOW_GAIN"] * 4, ""]
    assert (got[0].delta4_mean, got[0].delta4_std, got[8].delta4_std) == (2.0, 1.0, 0.0)


def test_circles_and_zoned_times_in_node_tables(spark):
    def node(fid, i, children, path="", **more):
        base = {"feature_id": fid, "node_id": f"n{i}", "path": path, "op": "Abs" if len(children) == 1 else "Col", "dtype": "numeric", "unit": "unitless", "col_index": None if children else 0, "children": children}
        return base | more

    rows = [node("two", 0, ["n1"], "/child"), node("two", 1, ["n0"])]
    rows += [node("three", i, [f"n{(i + 1) % 3}"]) for i in range(3)] + [node("three", 9, ["n0"])]
    rows += [node("fine", 0, [], "/child"), node("fine", 1, ["n0"]), node("shared", 0, [], "/left"), node("shared", 1, ["n0", "n0"], op="Add")]
    rows += [node(t, 0, [], time_origin=t) for t in ("2024-12-31T23:00:00Z", "2025-01-01T00:30:00+09:00", "2025-01-01T00:30:00Z", "no time")]
    nodes = spark.createDataFrame(rows, certify.NODES)
    schema = spark.createDataFrame([(0, "numeric", "unitless", False, False)], "col_index int, dtype string, unit string, is_target boolean, is_forbidden boolean")
    got = {(r.feature_id, r.cert): (r.verdict, r.witness) for r in certify.traces(nodes, schema, "2025-01-01T00:00:00Z").collect()}
    assert got["two", "C6"] == ("fail", ["n0", "n1"]) and got["three", "C6"] == ("fail", ["n0", "n1", "n2"])
    assert got["fine", "C6"][0] == got["shared", "C6"][0] == "pass"
    assert [got[t, "C3"][0] for t in ("2024-12-31T23:00:00Z", "2025-01-01T00:30:00+09:00", "2025-01-01T00:30:00Z", "no time")] == ["pass", "pass", "fail", "fail"]


def test_errors_of_the_compiler_are_internal(spark):
    df = spark.createDataFrame([("a", "normalization", json.dumps(col(0)), '"text"'), ("b", "normalization", "[1]", None)], "feature_id string, family string, program string, output string")
    schema = spark.createDataFrame([(0, "numeric", "unitless", False, False)], "col_index int, dtype string, unit string, is_target boolean, is_forbidden boolean")
    assert {r.feature_id: r.error for r in certify.nodes(df, schema).collect()} == {"a": "INTERNAL", "b": "GRAMMAR"}


def test_quoted_fields_do_not_widen_a_data_set(spark, tmp_path):
    (tmp_path / "q.csv").write_text('1,"a,b",0\n2,"say ""c""",1\n')
    (tmp_path / "q.json").write_text('{"task": "R", "0": "num", "1": "cat"}')
    rows, types, task = datasets.load_dataset(spark, str(tmp_path / "q"))
    assert task == "R" and list(types) == ["c0", "c1", "c2"]
    assert sorted(map(tuple, rows.collect())) == [(1.0, "a,b", 0.0), (2.0, 'say "c"', 1.0)]


TENTHS = [i / 10 for i in range(1, 10)]


@pytest.mark.parametrize("few", [1, 4096])
def test_exact_quantiles_are_percentile_to_the_bit(spark, few):
    """Columns of many sizes with heavy ties, negative, tiny, huge and infinite values, exact order statistics each."""
    rng = random.Random(few)
    pools = [[rng.choice([0.0, -0.0, 1.5, -2.25, 1000.0, 7.0]) for _ in range(9)], [rng.gauss(0, 1) for _ in range(500)], [math.ldexp(rng.random() - 0.5, rng.randint(-1100, 1020)) for _ in range(300)] + [float("inf"), float("-inf"), 5e-324, 2.0**-1022, 8.0, 7.999999999999999]]
    columns = [[rng.choice(pools[c % 3]) for _ in range(rng.choice([0, 1, 2, 3, 40, rng.randint(1, 400)]))] for c in range(90)]
    rows = [tuple(c[i] if i < len(c) else None for c in columns) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(90))).repartition(3)
    asked = [[0.0, 0.01, *TENTHS, 0.99, 1.0]] * 90
    got = features.exact_quantiles(df, [(F.col(c), qs) for c, qs in zip(df.columns, asked, strict=True)], few)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, asked[0]))) for c in df.columns]).first()
    for mine, theirs in zip(got, want, strict=True):
        assert mine == (list(theirs) if theirs else [None] * len(asked[0])) or any(math.isnan(x) for x in theirs)


def test_fits_beside_exact_quantiles_are_the_fits_alone(spark):
    """Whole waves read one written table where quantiles are asked: nested encoders, shared parts and columns with odd names too."""
    rng = random.Random(8)
    rows = [(rng.gauss(0, 3), rng.choice(["a", "b", "b", "c", None]), rng.choice([None, 1.0, 2.0, 5.5]), rng.choice(["train", "train", "test"])) for _ in range(600)]
    df = spark.createDataFrame(rows, "`a.b` double, `c``d` string, `2 x` double, _split string").repartition(3)
    names, types = df.columns[:3], {"c`d": "categorical"}
    encoded, mean = un("FrequencyEncode", col(1)), {"op": "TargetEncode", "cat_col": col(1), "label_col": col(0)}
    part = two("Add", un("Square", col(0)), mean)
    plain = {"z": un("ZScore", col(0)), "zz": un("ZScore", part), "m": un("MinMaxScale", two("Multiply", part, encoded)), "t": mean, "f": un("FrequencyEncode", two("Cross", col(1), col(1)))}
    ordered = {"b": un("QuantileBucketize", col(0)), "c": un("Clip", col(0)), "cc": un("Clip", part), "cz": un("Clip", un("ZScore", part))}
    alone, both = features.fit(df, plain, types, names), features.fit(df, plain | ordered, types, names)
    assert not both.failed and len(both.scalars) == len(alone.scalars) + 4
    for node, stats in alone.scalars.items():
        assert both.scalars[node] == pytest.approx(stats, rel=1e-12)
    own = [{(r.node, r.category): (r.n, r.value) for r in f.maps.collect()} for f in (alone, both)]
    assert own[0].keys() == own[1].keys() and all(own[1][k] == pytest.approx(v, rel=1e-12) for k, v in own[0].items())
    train = df.where("_split = 'train'")
    want = train.agg(F.percentile(F.col("`a.b`"), F.array(*map(F.lit, [0.01, 0.99, *TENTHS]))).alias("q")).first().q
    clip, tenths = (both.scalars[features.Graph(ordered).roots[f]] for f in ("c", "b"))
    assert [*clip, *tenths] == list(want)


def test_order_bits_sort_as_doubles(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 2.0, 0.9999999999999999, *[math.ldexp(rng.random() - 0.5, rng.randint(-1080, 1024)) for _ in range(2000)], *[math.nextafter(2.0**e, rng.choice([0, 1e308])) for e in range(-1000, 1000, 7)]]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", features.order_bits(F.col("x")).alias("k")).collect()
    for r in got:
        assert features.from_bits(r.k) == r.x
    own = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(features.order_bits(F.col("x"))).collect()
    assert [r[0] for r in own] == [None, None]


def test_deciles_of_ties(spark):
    """An order statistic is a value, never nearly one: 1000 is the eighth decile itself, so it lies in bucket 7."""
    tied = [7.0 * i for i in range(31)] + [1000.0] * 2 + [2000.0 + i for i in range(7)]
    df = spark.createDataFrame([(x,) for x in tied], "x double")
    fitted = features.fit(df, {"b": un("QuantileBucketize", col(0))}, {})
    (edges,) = fitted.scalars.values()
    assert edges[7] == 1000.0 and edges == list(df.agg(F.percentile("x", F.array(*map(F.lit, TENTHS)))).first()[0])
    rows = features.apply(df, {"b": un("QuantileBucketize", col(0))}, {}, fitted, ["x"]).where("x = 1000").collect()
    assert [r.b for r in rows] == [7, 7]
    many = spark.createDataFrame([(x,) for x in [7.0 * i for i in range(31)] + [1000.0] * 9], "x double")
    assert features.fit(many, {"b": un("QuantileBucketize", col(0))}, {}).failed == {"b": "EXECUTION_FAILED: equal deciles"}


def test_equal_subtrees_are_fitted_once(spark, monkeypatch):
    """Hundreds of programs with few distinct parts: as many statistics as parts, one map for each encoder, the same values."""
    df = spark.createDataFrame([(float(i), float(i % 7), "abc"[i % 3]) for i in range(60)], "x double, y double, c string").coalesce(2)
    parts = [un("ZScore", col(0)), un("MinMaxScale", col(1)), un("FrequencyEncode", col(2)), un("Clip", un("ZScore", col(0))), {"op": "TargetEncode", "cat_col": col(2), "label_col": col(1)}]
    programs = {f"f{n}": two(op, parts[n % 5], parts[n // 5 % 5]) for n, op in enumerate(["Add", "Multiply", "Divide", "Subtract"] * 60)}
    types = {"c": "categorical"}
    fitted = features.fit(df, programs, types)
    assert len(fitted.scalars) == 3 and len(fitted.map_sizes) == 2 and not fitted.failed
    graph = features.Graph(programs)
    assert len(graph.nodes) <= 8 + 4 * 25 and len(graph.roots) == 240
    out = features.apply(df, programs, types, fitted, ["x"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == plan.count("BuildRight") and plan.count("BroadcastExchange") == 2
    one = {f: p for f, p in programs.items() if f in ("f0", "f7", "f93")}
    alone = features.apply(df, one, types, features.fit(df, one, types), ["x"])
    assert sorted(out.select("x", *one).collect()) == sorted(alone.collect())


def test_hot_category_is_split(spark, monkeypatch):
    """A third of the rows is one category, of a map that is too large to broadcast: even tasks, the same result."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") * 7919 % 2000).cast("string")).alias("c"), F.col("id").cast("double").alias("y"), F.lit("x").alias("`odd`"))
    programs = {"n": un("FrequencyEncode", col(0)), "m": {"op": "TargetEncode", "cat_col": col(0), "label_col": col(1)}}
    fitted = features.fit(df, programs, {"c": "categorical"})
    want = sorted(features.apply(df, programs, {"c": "categorical"}, fitted, ["y"]).collect())
    monkeypatch.setattr(features, "MAP_ROWS", 10)
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        out = features.apply(df, programs, {"c": "categorical"}, fitted, ["y"])
        assert sorted(out.collect()) == want
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ids_that_look_alike_keep_their_maps(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "c string, d string").coalesce(1)
    programs = {"f.1": un("FrequencyEncode", col(0)), "f_1": un("FrequencyEncode", col(1))}
    fitted = features.fit(df, programs, {"c": "categorical", "d": "categorical"})
    rows = features.apply(df, programs, {"c": "categorical", "d": "categorical"}, fitted, []).collect()
    assert sorted((r["f.1"], r["f_1"]) for r in rows) == [(1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    fitted.release()


def test_fitted_statistics_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 8.0)], "c string, x double")
    programs, types = {"z": un("ZScore", col(1)), "f": un("FrequencyEncode", col(0))}, {"c": "categorical"}
    fitted = features.fit(df, programs, types)
    datasets.write_fitted(fitted, spark, str(tmp_path / "fit"))
    again = datasets.read_fitted(spark, str(tmp_path / "fit"))
    assert again.scalars == fitted.scalars and again.map_sizes == fitted.map_sizes
    one, two_ = (sorted(map(tuple, features.apply(df, programs, types, f, ["x"]).collect())) for f in (fitted, again))
    assert one == two_
    datasets.write_fitted(features.Fitted({("z", ""): [1.0, None]}), spark, str(tmp_path / "none"))
    assert datasets.read_fitted(spark, str(tmp_path / "none")).maps is None


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "features")
    datasets.write_features(spark.createDataFrame([(1, "train", 2.0), (2, "test", 3.0)], "id long, _split string, v double"), out)
    assert sorted((r.id, r._split, r.v) for r in spark.read.parquet(out).collect()) == [(1, "train", 2.0), (2, "test", 3.0)]
    fields = "feature_id string, family string, round int, status string, rejection_reason string, program_hash string, failure_code string, delta_mean double, delta_std double, redundancy_max double, plausibility string, intent_alignment string"
    datasets.write_audit(spark.createDataFrame([("f", "binning", 1, "accepted", "", "h", None, 0.5, 0.1, 0.2, "plausible", "match"), ("g", "binning", 1, "rejected_cert", "C2", "i", "C2", None, None, None, None, None)], fields), str(tmp_path / "audit"))
    read = {r.feature_id: r for r in spark.read.json(str(tmp_path / "audit")).collect()}
    assert read["f"].soft.empirical.delta_mean == 0.5 and read["f"].soft.semantic.plausibility == "plausible"
    assert read["g"].hard.failure_code == "C2" and read["g"].soft.semantic is None
    datasets.write_metrics(spark.createDataFrame([(3, 0.5)], "n long, rate double"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first().asDict() == {"n": 3, "rate": 0.5}
    (tmp_path / "p.jsonl").write_text('{"feature_id":"a","family":"binning","program":{"op":"Col","col_index":0}}\n')
    assert json.loads(datasets.read_programs(spark, str(tmp_path / "p.jsonl")).first().program) == col(0)


def test_boosted_trees_lasso_and_folds(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.col("id") / 1000).alias("x"), F.lit(1.0).alias("same"))
    assert scoring.score(df, df, ["x", "same"], "C", "GBT") > 0.95
    assert scoring.score(df, df, ["x"], "R", "GBT") > 0.9
    line = df.select("id", (F.col("id") * 2.0).alias("label"), F.col("id").cast("double").alias("x"))
    assert scoring.score(line, line, ["x"], "R", "LR") > 0.9
    folds = scoring.cross_validated(df, "id", ["x"], "C", "RF", folds=3, trees=5)
    assert len(folds) == 3 and min(folds) > 0.9


def test_final_score_takes_the_accepted_features(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4).cast("double").alias("a"), (F.floor(F.col("id") / 4) % 4).cast("double").alias("b"))
    df = splits.train_val_test(rows.withColumn("label", ((F.col("a") == F.col("b"))).cast("double")), "id")
    names = ["a", "b"]
    accepted = {"same": two("IsEqual", col(0), col(1)), "broken": un("ZScore", col(9))}
    baseline, final = scoring.final_score(df, "id", ["a"], [], accepted, {}, names, trees=5)
    assert final == 1.0 and baseline < 1.0
    assert len(set(scoring.final_score(df, "id", ["a"], [], {}, {}, names, trees=5))) == 1


def test_stratified_folds_are_even_in_each_label(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 < 7, "common").when(F.col("id") % 10 < 9, "rare").alias("label"), F.lit("x").alias("_count_"))
    out = splits.stratified_k_fold(df, "id", "label", 7)
    assert out.columns == [*df.columns, "fold"] and out.count() == 1003
    sizes = {}
    for r in out.groupBy("label", "fold").count().collect():
        sizes.setdefault(r.label, []).append(r["count"])
    assert set(sizes) == {"common", "rare", None} and all(len(v) == 7 and max(v) - min(v) <= 1 for v in sizes.values())
    few = splits.k_fold(df.limit(3), "id", 5, exact=True).collect()
    assert sorted(r.fold for r in few) == [0, 1, 2]


def test_certificates_join_and_broadcast_no_programs(spark, sf):
    """Node tables are small files of many rows: a join that took one for small would broadcast every program."""
    from quern.plans import catalog

    nodes = catalog.compiled(spark, sf)
    told = certify.traces(nodes, catalog.schema(spark), catalog.T_STAR)
    for df in (told, certify.verdicts(nodes, told), datasets.audit_records(catalog.programs(spark, sf).withColumn("status", F.lit("accepted")), told)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        by_program = [line for line in plan.splitlines() if " Join " in f" {line}" and "feature_id" in line]
        assert all("strategy=merge" in line for line in by_program), plan
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1 and plan.count("Relation") == 1


def test_samples_of_pairs_bring_few_rows_to_a_task(spark):
    """The rows that are ranked by hash are a few more than the sample, however many there are, and hold those of smallest hash."""
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("x"), (F.col("id") % 7).alias("y"), F.when(F.col("id") % 1000 == 0, 1.0).alias("rare"))
    pairs = [F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("accepted"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in (("x", "y"), ("y", "y"), ("rare", "y"))]
    rows = [(r.h, r.candidate, r.a) for r in selection.smallest(df, splits.rank_key(F.col("id"), 42), pairs, 200).collect()]
    every = df.select(splits.rank_key(F.col("id"), 42).alias("h"), "x", "y", "rare").collect()
    for name in ("x", "y", "rare"):
        own = sorted(h for h, c, _ in rows if c == name)
        want = sorted(r.h for r in every if r[name] is not None)
        assert own[:200] == want[:200] and len(own) <= 450
    same = spark.range(2_000).select(F.lit(1).alias("id"), (F.col("id") * 1.0).alias("x"))  # one hash: the bound is doubled up to all rows
    assert selection.rank_correlation(same, "id", [("x", "x")], sample=50).first().n == 50


def test_model_inputs_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    df = spark.range(0, 400, 1, 1).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.col("id") / 1000).alias("x"))
    seen = []
    real = scoring.model
    class Watched:  # noqa: E301
        def fit(self, ready):
            seen.append([r.n for r in ready.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()])
            return real("LR", "C").fit(ready)

    monkeypatch.setattr(scoring, "TASK_ROWS", 20)
    monkeypatch.setattr(scoring, "model", lambda *_: Watched())
    assert scoring.score(df, df, ["x"], "C", "LR") > 0.95
    assert sum(seen[0]) == 400 and len(seen[0]) == 20 and max(seen[0]) <= 40
