"""Gains and forward acceptance against models that are fitted anew for every candidate."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import gains, selection

COLUMNS = ["a", "b", "copy", "flat", "holes", "late", "noise", "sum"]


def rows(n=1500, seed=5):
    r = np.random.default_rng(seed)
    a, b, noise, late, base = (r.normal(size=n) * s + m for s, m in ((3, 1e4), (1, 0), (1, 0), (2, 5), (1, -3)))
    frame = pd.DataFrame({"id": range(n), "base": base, "a": a, "b": b, "noise": noise, "late": late})
    frame["copy"] = frame.a * 2 + 7
    frame["flat"] = 4.0
    frame["holes"] = np.where(frame.id % 3 == 0, np.nan, b * b)
    frame["sum"] = frame.a / 3 + frame.b
    frame["y"] = base + 0.5 * a + b + 0.3 * late + r.normal(size=n)
    frame["cls"] = np.where(frame.y > 5003, "hi", np.where(frame.b > 0.5, "mid", "lo"))
    frame["_split"] = ["test" if i % 10 < 2 else "val" if i % 10 < 4 else "train" for i in range(n)]
    return frame


@pytest.fixture(scope="module")
def matrix(spark):
    frame = rows()
    return spark.createDataFrame(frame).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("holes",)}).repartition(3).cache()


def refit(train, other, x, targets):
    """R squared of least squares (minimum norm) fitted on train, over all targets together."""
    design = lambda f: np.column_stack([np.ones(len(f)), *[f[c].fillna(-1.0) for c in x]])
    keep = [c for c in x if train[c].fillna(-1.0).std() > 1e-9]
    x = keep
    t, o = design(train), design(other)
    scale = np.abs(t).max(0)
    sse = sst = 0.0
    for y in targets:
        w = np.linalg.lstsq(t / scale, train[y], rcond=1e-10)[0]
        sse += ((other[y] - (o / scale) @ w) ** 2).sum()
        sst += ((other[y] - other[y].mean()) ** 2).sum()
    return 1 - sse / sst


def deltas(frame, base, c, targets, tier):
    if tier == "2":
        own = frame[frame._split == "train"].copy()
        own["h"] = [hashlib.md5(f"42:{i}".encode()).hexdigest() for i in own.id]
        own = own.sort_values("h")[:400]
        parts = [(own[:320], own[320:])]
    elif tier == "3":
        parts = [(frame[frame._split == "train"], frame[frame._split == "val"])]
    else:
        parts = [(frame[(frame.fold != k) & (frame._split != "test")], frame[(frame.fold == k) & (frame._split != "test")]) for k in range(5)]
    out = []
    for train, other in parts:
        old, new = refit(train, other, base, targets), refit(train, other, [*base, c], targets)
        out.append((new - old) / max(abs(old), 1e-9))
    return out


def with_folds(matrix, label, task):
    got = gains.dealt(matrix, "id", label, task, 5).select("id", "fold").toPandas()
    frame = rows().merge(got, on="id", how="left")
    for k in ("hi", "lo", "mid"):
        frame[k] = (frame.cls == k) * 1.0
    return frame


@pytest.mark.parametrize(("task", "label", "targets"), [("R", "y", ["y"]), ("C", "cls", ["hi", "lo", "mid"])])
def test_gains_are_those_of_refits(spark, matrix, task, label, targets):
    frame = with_folds(matrix, label, task)
    got = gains.candidate_gains(matrix, "id", label, ["base"], COLUMNS, task, sample=400).collect()
    assert [r.feature_id for r in got] == COLUMNS
    for r in got:
        for tier, mine in (("2", [r.delta2]), ("3", [r.delta3]), ("4", r.deltas4)):
            assert mine == pytest.approx(deltas(frame, ["base"], r.feature_id, targets, tier), rel=1e-6, abs=1e-6), (r.feature_id, tier)


def test_classes_are_even_in_folds(matrix):
    counts = gains.dealt(matrix, "id", "cls", "C", 5).groupBy("cls", "fold").count().toPandas().pivot(index="cls", columns="fold", values="count")
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 1


def loop(spark, matrix, frame, order, epsilon, tier2, tier4, patience, most):
    accepted, out, idle = [], [], 0
    profiles = {r.feature_id: r.reason for r in selection.profile(matrix.where("_split = 'train'"), COLUMNS).collect()}
    for round_ in sorted({r for r, _, _ in order}):
        took = False
        for _, name, code in [c for c in order if c[0] == round_]:
            sims = {r.accepted: r.value_sim for r in selection.rank_correlation(matrix.where("_split = 'train'"), "id", [(name, a) for a, _ in accepted]).collect()} if accepted else {}
            sim = max([0.0, *[max(sims[a], float(code == h)) for a, h in accepted]])
            base = ["base", *[a for a, _ in accepted]]
            reason = "POST_EVAL_REDUNDANT" if sim >= 0.92 else profiles[name]
            if not reason and tier2 and deltas(frame, base, name, ["y"], "2")[0] < 0.3 * epsilon:
                reason = "TIER2_NO_SIGNAL"
            if not reason and deltas(frame, base, name, ["y"], "3")[0] < epsilon:
                reason = "TIER3_SINGLE_FAIL"
            if not reason and tier4 and np.mean(deltas(frame, base, name, ["y"], "4")) < epsilon:
                reason = "TIER4_LOW_GAIN"
            out.append((round_, name, reason))
            if not reason:
                took = True
                accepted.append((name, code))
        idle = 0 if took else idle + 1
        if idle >= patience or len(accepted) >= most:
            break
    return out


@pytest.mark.parametrize(("tiers", "patience", "most"), [((False, False), 5, 30), ((True, True), 5, 30), ((False, False), 1, 30), ((False, True), 5, 2)])
def test_forward_is_a_loop_of_refits(spark, matrix, tiers, patience, most):
    frame = with_folds(matrix, "y", "R")
    order = [(0, "noise", "h0"), (0, "a", "h1"), (0, "copy", "h2"), (1, "flat", "h3"), (1, "noise", "h0"), (2, "b", "h4"), (2, "sum", "h5"), (2, "holes", "h6"), (3, "late", "h1")]
    order = [o for n, o in enumerate(order) if o[1] not in [x[1] for x in order[:n]]]
    got = gains.forward(matrix, "id", "y", ["base"], order, "R", 0.01, *tiers, patience=patience, most_accepted=most, sample=400).collect()
    assert [(r.round, r.feature_id, r.rejection_reason) for r in got] == loop(spark, matrix, frame, order, 0.01, *tiers, patience, most)
    assert [r.seq for r in got] == list(range(len(got))) and {r.status for r in got if not r.rejection_reason} <= {"accepted"}


def test_gains_that_are_not_there(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, "train" if i < 8 else "test") for i in range(10)], "id long, x double, y double, _split string")
    (r,) = gains.candidate_gains(df, "id", "y", [], ["x"]).collect()
    assert r.delta3 is None and r.base_score is None
    (r,) = gains.candidate_gains(df.limit(0), "id", "y", [], ["x"]).collect()
    assert r.delta2 is None and r.deltas4 == [None] * 5
    assert [r.rejection_reason for r in gains.forward(df, "id", "y", [], [(0, "x", "h")]).collect()] == ["TIER3_SINGLE_FAIL"]


def test_forward_reads_all_train_rows(spark):
    """More train rows than any sample had: similarities are over all of them, and tier 2 splits all of them four to one."""
    frame = rows(9000, seed=6)
    matrix = spark.createDataFrame(frame[["id", "base", "a", "sum", "noise", "y", "_split"]]).repartition(3)
    got = {r.feature_id: r for r in gains.forward(matrix, "id", "y", ["base"], [(0, "a", "h1"), (0, "sum", "h2"), (0, "noise", "h3")], "R", tier2=True).collect()}
    train = frame[frame._split == "train"].copy()
    assert len(train) > 5000 and [got[c].rejection_reason for c in ("a", "sum")] == ["", ""]
    ranks = train[["a", "sum", "noise"]].rank()
    assert got["sum"].redundancy_max == pytest.approx(ranks["sum"].corr(ranks["a"]), abs=1e-9)
    assert got["noise"].redundancy_max == pytest.approx(max(0.0, ranks["noise"].corr(ranks["a"]), ranks["noise"].corr(ranks["sum"])), abs=1e-9)
    train["h"] = [hashlib.md5(f"42:{i}".encode()).hexdigest() for i in train.id]
    train = train.sort_values("h")
    cut = int(len(train) * 0.8)
    old, new = (refit(train[:cut], train[cut:], ["base", "a", "sum", *more], ["y"]) for more in ([], ["noise"]))
    assert got["noise"].tier == "tier2" and got["noise"].delta_mean == pytest.approx((new - old) / abs(old), rel=1e-6, abs=1e-9)


def test_hash_at_a_place(spark, monkeypatch):
    monkeypatch.setattr(gains, "BATCH", 2)
    hashes = sorted([hashlib.md5(f"42:{i % 700}".encode()).hexdigest() for i in range(1000)])
    df = spark.createDataFrame([(h,) for h in hashes], "h string").repartition(3)
    assert all(gains.nth_hash(df, n) == hashes[n] for n in (0, 1, 333, 799, 999))
