"""Gates, acceptance and roll-ups over the table of audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.grammar import IID_FAMILIES


def micro_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """For single labels micro-averaged F1 is accuracy."""
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("micro_f1"))


def r2(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """1 - SSE / SST in one aggregate."""
    y, p = F.col(label), F.col(prediction)
    return df.where(y.isNotNull() & p.isNotNull()).agg((F.lit(1.0) - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"))


def marginal_gain(new: Column, base: Column) -> Column:
    return (new - base) / F.greatest(F.abs(base), F.lit(1e-9))


def tier_gates(df: DataFrame, epsilon: float = 0.01, tier2: bool = False, tier4: bool = False) -> DataFrame:
    """Add ``tier_reason`` ('' passes) from tier1_reason, delta2, delta3 and deltas4 (array, mean and population deviation beside it).

    A gain that could not be computed (null, NaN, no folds, a fold without one) reaches no threshold.
    """
    mean4 = F.try_divide(F.aggregate("deltas4", F.lit(0.0), lambda a, x: a + x), F.size("deltas4"))
    reaches = lambda gain, least: F.coalesce(F.nanvl(gain, F.lit(None).cast("double")) >= least, F.lit(False))
    reason = F.when(F.col("tier1_reason") != "", F.col("tier1_reason"))
    if tier2:
        reason = reason.when(~reaches(F.col("delta2"), 0.3 * epsilon), "TIER2_NO_SIGNAL")
    reason = reason.when(~reaches(F.col("delta3"), epsilon), "TIER3_SINGLE_FAIL")
    if tier4:
        reason = reason.when(~reaches(mean4, epsilon), "TIER4_LOW_GAIN")
    spread = F.aggregate("deltas4", F.lit(0.0), lambda a, x: a + (x - F.col("delta4_mean")) * (x - F.col("delta4_mean")))
    return df.withColumn("tier_reason", F.coalesce(reason, F.lit(""))).withColumn("delta4_mean", mean4).withColumn("delta4_std", F.sqrt(F.try_divide(spread, F.size("deltas4"))))


def funnel(df: DataFrame) -> DataFrame:
    """Add status and rejection_reason: the first stage that fails of compile_error, cert_code, execution_error,
    redundancy_max >= 0.92 and tier_reason; null or '' means the stage passed."""
    stages = [("compile_error", "rejected_compile"), ("cert_code", "rejected_cert"), ("execution_error", "rejected_execution")]
    status, reason = None, []
    for c, name in stages:
        bad = F.coalesce(F.col(c), F.lit("")) != ""
        status = F.when(bad, name) if status is None else status.when(bad, name)
        reason.append(F.when(bad, F.col(c)))
    twin = F.coalesce(F.col("redundancy_max"), F.lit(0.0)) >= 0.92
    late = F.coalesce(F.col("tier_reason"), F.lit("")) != ""
    status = status.when(twin, "rejected_redundant").when(late, "rejected_gain").otherwise("accepted")
    return df.withColumn("status", status).withColumn("rejection_reason", F.coalesce(*reason, F.when(twin, "POST_EVAL_REDUNDANT"), F.when(late, F.col("tier_reason")), F.lit("")))


def stop_round(rounds: DataFrame, patience: int = 5, most_accepted: int = 30, most_rounds: int = 50) -> DataFrame:
    """Per run_id the stop_round and reason from (run_id, round, accepted): no accept for ``patience`` rounds, enough
    accepted features, or the budget of rounds, which wins in the last round."""
    w = Window.partitionBy("run_id").orderBy("round")
    seen = rounds.withColumn("total", F.sum("accepted").over(w)).withColumn("place", F.row_number().over(w))
    seen = seen.withColumn("last", F.coalesce(F.max(F.when(F.col("accepted") > 0, F.col("place"))).over(w), F.lit(0)))
    reason = F.when(F.col("place") >= most_rounds, "budget").when(F.col("place") - F.col("last") >= patience, "no_accept").when(F.col("total") >= most_accepted, "k_max")
    stops = seen.withColumn("reason", reason).where("reason is not null").groupBy("run_id").agg(F.min(F.struct("round", "reason")).alias("m"))
    ends = rounds.groupBy("run_id").agg(F.max("round").alias("final"))
    return ends.join(stops, "run_id", "left").select("run_id", F.coalesce("m.round", "final").alias("stop_round"), F.coalesce("m.reason", F.lit("running")).alias("reason"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") != "accepted").alias("rejected"), F.max(F.when(F.col("status") == "accepted", F.col("delta_mean"))).alias("best_gain"))


def run_metrics(records: DataFrame, scores: DataFrame, patience: int = 5, most_accepted: int = 30, most_rounds: int = 50) -> DataFrame:
    """One row per run of ``scores`` (run_id, dataset, baseline_score, final_score; the last may be null): sizes by status, rounds, the stop reason,
    the improvement (0 without a final score) and the accepted features in their order.

    ``records`` has run_id, seq, round, feature_id and status. Everything that isn't accepted and isn't rejected by a compiler or a
    certificate counts as rejected_eval. A run without records has zeros and an empty list. The list is as long as the run's accepted features, a cap by ``most_accepted``.
    """
    good, early = F.col("status") == "accepted", F.col("status").isin("rejected_cert", "rejected_compile")
    per = records.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_candidates"), F.count_if(good).alias("accepted"), F.count_if(early).alias("rejected_cert"), F.count_if(~good & ~early).alias("rejected_eval"), F.count_distinct("round").alias("total_rounds"),
        F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("seq", "feature_id")))), lambda x: x["feature_id"]).alias("accepted_features"),
    )
    rounds = records.groupBy("run_id", "round").agg(F.count_if(good).alias("accepted"))
    stops = stop_round(rounds, patience, most_accepted, most_rounds).select("run_id", F.col("reason").alias("stop_reason"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    improvement = F.coalesce(F.col("final_score") - F.col("baseline_score"), F.lit(0.0))
    out = scores.join(per, "run_id", "left").join(stops, "run_id", "left")
    return out.select("run_id", "dataset", zero("accepted"), zero("total_rounds"), F.coalesce("stop_reason", F.lit("running")).alias("stop_reason"), "baseline_score", "final_score", improvement.alias("improvement"), zero("total_candidates"), zero("rejected_cert"), zero("rejected_eval"), F.coalesce("accepted_features", F.array().cast("array<string>")).alias("accepted_features"))


def rejections(records: DataFrame) -> DataFrame:
    """Counts by (status, rejection_reason) with subtotals (null) by status and in all."""
    return records.where("status <> 'accepted'").rollup("status", "rejection_reason").agg(F.count(F.lit(1)).alias("n"))


def cumulative_cost(records: DataFrame) -> DataFrame:
    """Per accepted feature k (its number in the run) and the seconds spent on all records up to it."""
    w = Window.partitionBy("run_id").orderBy("seq")
    cost = F.sum(F.col("verify_ms") / 1000.0 + F.col("eval_seconds")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    k = F.count(F.when(F.col("status") == "accepted", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("seconds", cost).withColumn("k", k).where("status = 'accepted'").select("run_id", "seq", "k", "seconds")


def coverage(records: DataFrame) -> DataFrame:
    """Per (family, col_group): accepted, rejected, last_round and whether it is covered."""
    good = F.col("status") == "accepted"
    return records.groupBy("family", "col_group").agg(F.count_if(good).alias("n_accepted"), F.count_if(~good).alias("n_rejected"), F.max("round").alias("last_round"), F.bool_or(good).alias("covered"))


def undercovered(covered: DataFrame) -> DataFrame:
    """Families of single tables that no record has, and groups with rejections only."""
    families = covered.sparkSession.createDataFrame([(f,) for f in IID_FAMILIES], "family string")
    none = families.join(covered.select("family").distinct(), "family", "left_anti").select("family", F.lit("unexplored").alias("status"), F.lit(None).cast("array<int>").alias("col_group"), F.lit(None).cast("bigint").alias("n_rejected"))
    return none.unionByName(covered.where("n_accepted = 0").select("family", F.lit("all_rejected").alias("status"), "col_group", "n_rejected"))


def family_yield(covered: DataFrame) -> DataFrame:
    """Per single-table family: accepted, rejected, yield, number of non-empty column groups and advice."""
    families = covered.sparkSession.createDataFrame([(f,) for f in IID_FAMILIES], "family string")
    per = covered.groupBy("family").agg(F.sum("n_accepted").alias("n_accepted"), F.sum("n_rejected").alias("n_rejected"), F.count_distinct(F.when(F.size("col_group") > 0, F.col("col_group"))).alias("col_groups"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rate = F.try_divide(F.col("n_accepted").cast("double"), F.col("n_accepted") + F.col("n_rejected"))
    advice = F.when(F.col("n_accepted").isNull(), "PRIORITY").when((F.col("n_accepted") == 0) & (F.col("n_rejected") > 0), "AVOID").otherwise("")
    return families.join(per, "family", "left").select("family", zero("n_accepted"), zero("n_rejected"), rate.alias("yield_rate"), zero("col_groups"), advice.alias("advice"))


def recent_rejections(records: DataFrame, n: int = 10) -> DataFrame:
    """The last n compile, internal and certificate rejections, oldest first."""
    return records.where("status in ('rejected_compile', 'rejected_cert')").orderBy(F.desc("seq")).limit(n).orderBy("seq").select("seq", "feature_id", "rejection_reason")
