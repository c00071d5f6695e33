"""Stores, caches, logs and data sets; entities that hold a third of all rows; columns of any name."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import audit, certify, selection, splits, temporal
from quern.plans.catalog import col, un
from quern.sources import datasets


def test_quoted_line_breaks_stay_in_their_field(spark, tmp_path):
    (tmp_path / "m.csv").write_text('1,"two\nlines",0\n2,"a ""b""\n\n,c",1\n')
    (tmp_path / "m.json").write_text('{"task": "C", "1": "cat"}')
    rows, types, _ = datasets.load_dataset(spark, str(tmp_path / "m"))
    assert list(types) == ["c0", "c1", "c2"]
    assert sorted(map(tuple, rows.collect())) == [(1.0, "two\nlines", 0.0), (2.0, 'a "b"\n\n,c', 1.0)]


def test_store_joins_batches_without_an_exchange(spark):
    df = spark.range(2000).select("id", (F.col("id") * 2.0).alias("a"), F.lit("x").alias("b"))
    datasets.store_features(df.select("id", "a"), "own_store", "one", "id", 8)
    datasets.store_features(df.where("id % 2 = 0").select("id", "b"), "own_store", "two", "id", 8)
    datasets.store_features(df.select("id", (F.col("a") + 1).alias("a")), "own_store", "three", "id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = datasets.read_store(spark, "own_store", ["one", "two", "three"], "id")
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: (r.a, r.b) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 2000 and got[4] == (9.0, "x") and got[5] == (11.0, None)
    with pytest.raises(ValueError, match="missing"):
        datasets.store_features(spark.createDataFrame([(None, 1.0)], "id long, a double"), "own_store", "bad", "id", 8)


def test_verdicts_are_kept(spark, tmp_path):
    schema = spark.createDataFrame([(0, "numeric", "unitless", False, False), (1, "numeric", "unitless", True, False)], "col_index int, dtype string, unit string, is_target boolean, is_forbidden boolean")
    texts = {"a": json.dumps(un("ZScore", col(0))), "b": json.dumps(col(1)), "c": "{", "d": json.dumps(col(9)), "again": json.dumps(un("ZScore", col(0)))}
    kinds = "feature_id string, family string, program string, output string"
    frame = lambda ids: spark.createDataFrame([(i, "normalization", texts[i], None) for i in ids], kinds)
    cache = str(tmp_path / "cache")
    first, n = certify.certify_new(frame("abc"), schema, cache, "s1")
    assert n == 3 and not any(r.cached for r in first.collect())
    every = frame(texts).union(spark.createDataFrame([(None, "normalization", texts["a"], None), ("e", "unknown", texts["a"], None)], kinds))
    out, n = certify.certify_new(every, schema, cache, "s1")
    got = {r.feature_id: (r.passed, r.failure_code, r.cached) for r in out.collect()}
    assert n == 2 and got == {"a": (True, None, True), "again": (True, None, True), "b": (False, "C2.TARGET_LEAK", True), "c": (False, "GRAMMAR", True), "d": (False, "C1.UNKNOWN_COLUMN", False), "e": (False, "GRAMMAR", False), None: (False, "GRAMMAR", False)}
    assert certify.certify_new(every, schema, cache, "s1")[1] == 0
    assert certify.certify_new(every, schema, cache, "s2")[1] == 5 and certify.certify_new(frame("a"), schema, cache, "s1", "2025-01-01")[1] == 1


def test_audit_records_are_whole(spark, tmp_path):
    fields = "feature_id string, family string, round int, status string, rejection_reason string, program string, program_hash string, delta_metric_mean double, redundancy_argmax string, cost_gen_tokens long, plausibility string, witness string, source string"
    rows = spark.createDataFrame([("f", "binning", 1, "accepted", "", "{}", "h", 0.5, "g", 7, "plausible", "w", "critic"), ("g", "binning", 1, "rejected_cert", "C2", "{}", "i", None, None, 3, None, None, None)], fields)
    traces = spark.createDataFrame([("f", "C2", 2, "pass", None, []), ("f", "C1", 1, "pass", None, []), ("g", "C1", 1, "pass", None, []), ("g", "C2", 2, "fail", "C2.TARGET_LEAK", ["n1", "n3"])], "feature_id string, cert string, ord int, verdict string, failure_code string, witness array<string>")
    datasets.write_audit(rows, str(tmp_path / "log"), traces)
    got = {}
    for path in (tmp_path / "log").glob("part-*"):
        for line in path.read_text().splitlines():
            got[json.loads(line)["feature_id"]] = json.loads(line)
    assert list(got["f"]) == list(datasets.AUDIT["top"]) + ["hard", "soft"]
    assert got["f"]["hard"] == {"program_hash": "h", "schema_hash": None, "policy_version": None, "overall": "pass", "failure_code": None, "checks": [{"name": n, "status": "pass", "witness": [], "detail": "", "failure_code": None} for n in ("C1", "C2")]}
    assert got["f"]["soft"]["empirical"] == {"delta_metric_mean": 0.5, "delta_metric_std": None, "redundancy_max": None, "redundancy_argmax": "g", "cost_gen_tokens": 7, "cost_verify_ms": None, "cost_eval_seconds": None}
    assert set(got["f"]["soft"]["semantic"]) == set(datasets.AUDIT["semantic"]) and got["g"]["soft"]["semantic"] is None
    assert got["g"]["hard"]["overall"] == "fail" and got["g"]["hard"]["checks"][1] == {"name": "C2", "status": "fail", "witness": ["n1", "n3"], "detail": "at n1, n3", "failure_code": "C2.TARGET_LEAK"}


def test_metrics_of_a_run(spark):
    records = spark.createDataFrame([(1, 2, 0, "b", "accepted"), (1, 0, 0, "a", "accepted"), (1, 1, 0, "x", "rejected_cert"), (1, 3, 1, "y", "rejected_gain")], "run_id int, seq int, round int, feature_id string, status string")
    scores = spark.createDataFrame([(1, "d", 0.5, 0.75), (2, "e", 0.5, None)], "run_id int, dataset string, baseline_score double, final_score double")
    one, two = audit.run_metrics(records, scores).orderBy("run_id").collect()
    assert (one.accepted_features, one.improvement, one.rejected_cert, one.rejected_eval, one.total_rounds, one.stop_reason) == (["a", "b"], 0.25, 1, 1, 2, "running")
    assert (two.accepted_features, two.improvement, two.total_candidates) == ([], 0.0, 0)


def events(spark, ties=False):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice([None, *range(60)]) if ties else i * 7, float(rng.randint(0, 9)) if i % 5 else None, "own") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, e string, sec long, x double, _tile string")
    return df.withColumn("ts", F.timestamp_seconds("sec")).repartition(5)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("tile", [3, 50, 10**6])
def test_tiles_give_what_one_window_gives(spark, ties, tile):
    df = events(spark, ties)
    make = lambda e: {"mean": temporal.rolling_mean(e, "ts", "x", 3, tie="id"), "before": temporal.lag(e, "ts", "x", 2, tie="id")}
    got = temporal.by_rows(df, "e", "ts", 3, make, tie="id", tile=tile)
    assert got.columns == [*df.columns, "mean", "before"]
    assert sorted(got.collect(), key=str) == sorted(df.withColumns(make(["e"])).collect(), key=str)
    ranged = lambda e: {"n": temporal.window_agg(e, "ts", "x", 11, "count")}
    want = sorted(df.withColumns(ranged(["e"])).collect(), key=str)
    assert sorted(temporal.by_time(df, "e", "ts", 11, ranged).collect(), key=str) == want


def test_tiles_are_even(spark):
    df = events(spark)
    out = temporal.by_rows(df, "e", "ts", 3, lambda e: {"tile": F.count("x").over(temporal.Window.partitionBy(*e))}, tie="id", tile=20)
    assert out.agg(F.max("tile")).first()[0] <= 22


def test_asof_at_two_levels(spark):
    df = events(spark, ties=True)
    attributes = events(spark, ties=True).where("id % 4 = 0").withColumn("_side", F.lit(9))
    got = {r.id: r.asof_value for r in temporal.asof_join(df.withColumns({"_side": F.lit(5), "_value": F.lit("mine")}), attributes, "e", "ts", "x").collect()}
    left, right = df.collect(), attributes.collect()
    assert len(got) == len(left)
    for r in left:
        known = [(a.ts, a.x) for a in right if a.e == r.e and a.x is not None and a.ts is not None and r.ts is not None and a.ts <= r.ts]
        assert got[r.id] == (max(known)[1] if known else None), r


def test_one_attribute_row_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id int, k string")
    attributes = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 2, 3), ("b", None, 7), (None, 1, 1)], "k string, at int, v int")
    assert sorted((r.id, r.v) for r in temporal.entity_join(df, attributes, "k", "at").collect()) == [(1, 3), (2, 7), (3, None), (4, None)]
    assert sorted((r.id, r.v) for r in temporal.entity_join(df, attributes, "k").collect()) == [(1, 5), (2, 7), (3, None), (4, None)]


def test_own_columns_keep_their_values(spark):
    df = spark.range(60).select("id", *[F.concat(F.lit("mine "), F.col("id").cast("string")).alias(c) for c in ("_hash", "_range", "_place", "_sizes", "rows", "side", "n", "by_0")], (F.col("id") % 3).alias("g"))
    for out in (splits.equal_tiles(df, "id", 4, 1, ("g",)), splits.mini_sample(df, "id", 50), splits.k_fold(df, "id", 3, exact=True)):
        assert all(r[c] == f"mine {r.id}" for r in out.collect() for c in ("_hash", "_range", "_place", "_sizes", "rows", "side", "n", "by_0"))


def test_places_of_many_labels(spark):
    values = [random.Random(i).randint(-500, 500) for i in range(3000)] + [None]
    got = {r.v: r.label_code for r in splits.label_encode(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), "v").collect()}
    order = sorted({v for v in values if v is not None})
    assert got == {v: i for i, v in enumerate(order)} | {None: None}
    plan = splits.places(spark.range(10).toDF("v"), "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_many_columns_against_the_accepted(spark):
    """The same numbers as pair by pair, columns with missing values and text among them."""
    rng = random.Random(8)
    names = [f"c{i}" for i in range(12)]
    rows = [(i, *[rng.gauss(0, 1) if n != "c3" or i % 4 else None for n in names[:9]], 1.0, i % 2 == 0, "text") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names[:10]) + ", c10 boolean, c11 string").withColumn("c8", F.round(F.col("c1") + F.col("c8") / 3))
    accepted = ["c1", "c2", "c3", "c10"]
    got = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.redundancy_of_many(df, "id", names, accepted, sample=300, columns=5).collect()}
    want = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", [(c, a) for c in names for a in accepted], sample=300).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert selection.redundancy_of_many(df, "id", names, []).collect() == []


def test_ranks_over_all_rows(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randint(0, 5)), rng.choice([None, rng.gauss(0, 1), 0.5]), 3.0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, flat double").repartition(4)
    pairs = [("a", "b"), ("b", "a"), ("a", "a"), ("flat", "a")]
    full = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", pairs, sample=None).collect()}
    some = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", pairs, sample=10**6).collect()}
    assert all(full[p][0] == some[p][0] and full[p][1] == pytest.approx(some[p][1], abs=1e-9) for p in pairs)


@pytest.mark.parametrize("few", [0, 100_000])
def test_ranks_over_all_rows_of_many_and_hot_and_odd_values(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "RANGE", 100)
    rng = random.Random(10)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0]
    rows = [(i, rng.gauss(0, 1) if i % 3 else 0.25, rng.gauss(0, 1) + i / 900, rng.choice([*odd, *map(float, range(300))]), i % 2 == 0, "text" if i % 5 else None, None, 1e8 + 0.1, rng.randint(0, 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, hot double, b double, odd double, yes boolean, t string, none double, flat double, small int").repartition(5)
    with_odd = [("hot", "b"), ("b", "odd"), ("odd", "hot"), ("odd", "odd"), ("yes", "odd"), ("small", "yes"), ("t", "b"), ("t", "t"), ("none", "b"), ("none", "none"), ("flat", "b"), ("flat", "small")]
    for pairs in (with_odd, [("small", "yes")], [("b", "b")]):
        full = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", pairs, sample=None).collect()}
        some = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", pairs, sample=10**6).collect()}
        assert set(full) == set(some) == set(pairs)
        assert {p: full[p] for p in pairs if full[p][0] != some[p][0] or full[p][1] != pytest.approx(some[p][1], abs=1e-9)} == {}


@pytest.mark.parametrize("few", [0, 100_000])
def test_ranks_over_all_rows_beside_one_column(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "RANGE", 100)
    monkeypatch.setattr(selection, "BESIDE", 3)
    rng = random.Random(12)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0]
    rows = [(i, rng.gauss(0, 1) if i % 3 else 0.25, rng.gauss(0, 1) + i / 900, rng.choice([*odd, *map(float, range(300))]), i % 2 == 0, "text" if i % 5 else None, None, 1e8 + 0.1, rng.randint(0, 3) if i % 4 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, hot double, b double, odd double, yes boolean, t string, none double, flat double, small int").repartition(5)
    for one in ("hot", "odd", "small", "none", "t"):
        pairs = [(one, c) if n % 2 else (c, one) for n, c in enumerate(c for c in df.columns if c not in ("id", one))]
        full = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", pairs, sample=None).collect()}
        some = {(r.candidate, r.accepted): (r.n, r.value_sim) for r in selection.rank_correlation(df, "id", pairs, sample=10**6).collect()}
        assert set(full) == set(some) == set(pairs)
        assert {p: (full[p], some[p]) for p in pairs if full[p][0] != some[p][0] or full[p][1] != pytest.approx(some[p][1], abs=1e-9)} == {}


def test_ranks_over_all_rows_shuffle_a_pairs_rows_twice(spark):
    """Once to add them up by the value of one side, once to deal these values into ranges."""
    rng = random.Random(11)
    rows = 20_000
    df = spark.createDataFrame([(i, rng.randint(0, 9), rng.gauss(0, 1)) for i in range(rows)], "id long, few long, many double")
    store = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        store.listenerBus().waitUntilEmpty()
        stages = store.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert selection.rank_correlation(df, "id", [("few", "many")], sample=None).first().n == rows
    assert 2 * rows <= shuffled() - before < 2.1 * rows


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("seconds", [0, 1, 11, 10**5])
def test_ranges_in_two_running_halves_give_what_one_window_gives(spark, ties, seconds):
    df = events(spark, ties)
    wanted = {how: (how, "x") for how in ("sum", "count", "min", "max", "avg")}
    want = df.withColumns({how: temporal.window_agg(["e"], "ts", "x", seconds, how) for how in wanted})
    got = temporal.range_agg(df, "e", "ts", seconds, wanted)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_no_range_is_added_up_again_for_each_row(spark, sf):
    """Spark's sliding frames cost rows times rows of a range; running ones start at the partition's first row."""
    from quern.plans import catalog

    for name in ("hot_entity_range", "window_agg"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, unboundedpreceding$(), currentrow$()" in plan and plan.count("RangeFrame") == plan.count("RangeFrame, unboundedpreceding$(), currentrow$()"), plan


def test_few_labels_deal_no_rows_by_label(spark, monkeypatch):
    """Half of the rows have one label: dealt by it, they would all meet in one task."""
    from quern.operators import scoring

    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise(F.col("id").cast("string")).alias("v"))
    for out in (splits.label_encode(df, "v"), scoring.model_input(df, [], ["v"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    want = sorted(map(tuple, splits.label_encode(df, "v").collect()))
    monkeypatch.setattr(splits, "FEW", 10)
    assert sorted(map(tuple, splits.label_encode(df, "v").collect())) == want
