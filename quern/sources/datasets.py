"""Reading data sets, programs and model answers; writing features, statistics, audit records and metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.grammar import FAMILIES


def load_dataset(spark: SparkSession, stem: str) -> tuple[DataFrame, dict[str, str], str]:
    """``stem``.csv without header and ``stem``.json ({"task": "C" or "R", "0": "num" or "cat", ...}): rows with columns c0..,
    their types by name and the task. The last column is the target; columns the sidecar doesn't name are numeric. A quoted field may
    hold commas, quotes and line breaks (so a file is read by one task; give many files, a folder named ``stem``.csv, for large sets)."""
    side = spark.read.text(f"{stem}.json", wholetext=True).first()[0]
    kinds = spark.range(1).select(F.from_json(F.lit(side), "map<string,string>").alias("m")).first().m
    rows = spark.read.csv(f"{stem}.csv", header=False, quote='"', escape='"', multiLine=True)  # as many columns as the first record has
    names = [f"c{i}" for i in range(len(rows.columns))]
    types = {n: "categorical" if kinds.get(str(i)) == "cat" else "numeric" for i, n in enumerate(names)}
    return rows.toDF(*names).select(*[F.col(n).try_cast("double").alias(n) if types[n] == "numeric" else F.col(n) for n in names]), types, kinds.get("task", "C")


def descriptions(spark: SparkSession, stem: str) -> list[str]:
    """One line per column of ``stem``.txt."""
    return [r.value for r in spark.read.text(f"{stem}.txt").collect()]


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with feature_id, family, declared_intent, program and output; the last two stay JSON text."""
    return spark.read.schema("feature_id string, family string, declared_intent string, program string, output string").json(path)


def unfenced(text: Column) -> Column:
    """Trimmed text without a first and last line of code fences."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    opened = F.regexp_replace(trimmed, r"^```[^\n]*\n?", "")
    return F.when(trimmed.startswith("```"), F.regexp_replace(opened, r"\n?```[^\n]*$", "")).otherwise(trimmed)


def ingest_responses(responses: DataFrame) -> DataFrame:
    """From (response_id, text, tokens) one row per program: response_id, pos, feature_id, family, declared_intent, program,
    output, attempted, tokens_each. An object counts as a list of one; other JSON and no JSON give no rows (see ``response_counts``)."""
    parsed = responses.select("response_id", "tokens", F.try_parse_json(unfenced(F.col("text"))).alias("v"))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.variant_get("v", "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array("v"))
    out = parsed.select("response_id", "tokens", items.alias("items")).where("items is not null").select("response_id", "tokens", F.size("items").alias("attempted"), F.posexplode("items").alias("pos", "item"))
    get = lambda k: F.try_variant_get("item", f"$.{k}", "string")
    return out.select("response_id", "pos", get("feature_id").alias("feature_id"), get("family").alias("family"), F.coalesce(get("declared_intent"), F.lit("")).alias("declared_intent"), get("program").alias("program"), get("output").alias("output"), "attempted", F.floor(F.col("tokens") / F.greatest("attempted", F.lit(1))).cast("bigint").alias("tokens_each"))


def response_counts(responses: DataFrame) -> DataFrame:
    """Per response of (response_id, text, tokens): attempted, parsed and failed items; an item fails without a
    feature_id, a known family or a program. A text that is no list or object has attempted 0 and is unreadable."""
    items = ingest_responses(responses)
    good = F.col("feature_id").isNotNull() & F.col("family").isin(*FAMILIES) & F.col("program").isNotNull()
    counts = items.groupBy("response_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(good).alias("parsed"))
    out = responses.select("response_id").join(counts, "response_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("response_id", n("attempted").alias("attempted"), n("parsed").alias("parsed"), (n("attempted") - n("parsed")).alias("parse_failures"), F.col("attempted").isNull().alias("unreadable"))


def parse_reviews(reviews: DataFrame) -> DataFrame:
    """From (review_id, first, second): interpretation, plausibility, plausibility_witness, intent_alignment, alignment_witness.

    Values outside the known sets are ``unclassifiable``; text that is no JSON object is that too, with a witness.
    """
    fields = ["interpretation", "plausibility", "plausibility_witness", "intent_alignment", "alignment_witness"]
    sets = {"plausibility": ("plausible", "questionable", "unclassifiable"), "intent_alignment": ("match", "partial", "mismatch")}
    out = reviews
    for source, own in (("first", fields[:3]), ("second", fields[3:])):
        v = F.try_parse_json(unfenced(F.col(source)))
        ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        for name in own:
            x = F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("unclassifiable" if name in sets else ""))
            if name in sets:
                out = out.withColumn(name, F.when(ok & x.isin(*sets[name]), x).otherwise("unclassifiable"))
            else:
                out = out.withColumn(name, F.when(ok, x).otherwise("critic parse failure" if name.endswith("witness") else ""))
    return out.select("review_id", *fields)


def write_features(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").partitionBy("_split").parquet(path)


def store_features(matrix: DataFrame, store: str, batch: str, key: str, buckets: int = 64) -> None:
    """Add a batch of feature columns, keyed by row id, to a feature store: the table ``store``_``batch``, bucketed and sorted by the id.

    Batches of one store have the same buckets, so that they are joined again without an Exchange (``read_store``). A batch of the same name
    is replaced; rows without an id are refused, as no batch could find them.
    """
    if matrix.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} is missing in some rows")
    matrix.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"{store}_{batch}")


def read_store(spark: SparkSession, store: str, batches: list[str], key: str) -> DataFrame:
    """The columns of all batches for each id of the first; a column that several have is the last one's. Ids that a later batch lacks have nulls."""
    out = spark.table(f"{store}_{batches[0]}")
    for batch in batches[1:]:
        more = spark.table(f"{store}_{batch}")
        out = out.drop(*[c for c in more.columns if c != key]).join(more.hint("merge"), key, "left")
    return out


def write_fitted(fitted, spark: SparkSession, path: str) -> None:
    """Scalars and maps of a fit, as two tables below ``path``."""
    rows = [(node, [None if v is None else float(v) for v in values]) for node, values in fitted.scalars.items()]
    spark.createDataFrame(rows, "node string, stats array<double>").write.mode("overwrite").parquet(f"{path}/scalars")
    if fitted.maps is not None:
        fitted.maps.write.mode("overwrite").parquet(f"{path}/maps")


def read_fitted(spark: SparkSession, path: str):
    """What ``write_fitted`` wrote: the scalars come to the driver, the maps stay a table."""
    from quern.operators.features import Fitted

    out = Fitted({r.node: list(r.stats) for r in spark.read.parquet(f"{path}/scalars").collect()})
    try:
        out.maps = spark.read.parquet(f"{path}/maps")
    except AnalysisException:
        return out  # no encoders
    out.map_sizes = {r.node: (r.rows, r.total) for r in out.maps.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).collect()}
    return out


#: Fields of an audit record by part; a table that lacks some has nulls in their place.
AUDIT = {
    "top": {"feature_id": "string", "family": "string", "round": "int", "status": "string", "rejection_reason": "string", "program": "string", "prompt_version": "string"},
    "hard": {"program_hash": "string", "schema_hash": "string", "policy_version": "string", "overall": "string"},
    "empirical": {"delta_metric_mean": "double", "delta_metric_std": "double", "redundancy_max": "double", "redundancy_argmax": "string", "cost_gen_tokens": "bigint", "cost_verify_ms": "double", "cost_eval_seconds": "double"},
    "semantic": {"plausibility": "string", "interpretation": "string", "declared_intent": "string", "intent_alignment": "string", "witness": "string", "source": "string"},
}


def audit_records(records: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """The audit log's nested records from flat ones: ``hard`` with ``checks`` (name, status, witness, detail, failure_code for each certificate,
    in order), ``soft`` with its empirical and semantic part.

    ``records`` has columns named as ``AUDIT`` says, ``traces`` is what ``certify.traces`` gives (feature_id, cert, ord, verdict, failure_code,
    witness; detail if it is there). A program whose certificates let it not through has no semantic part, one without traces an empty list of checks.
    ``overall`` follows from the checks where it isn't given, and ``failure_code`` is that of the first failure. The program stays JSON text. Records that call the
    gains delta_mean and delta_std, as the roll-ups do, have them under both names.
    """
    short = {"delta_metric_mean": "delta_mean", "delta_metric_std": "delta_std"}
    records = records.withColumns({long: F.col(c) for long, c in short.items() if c in records.columns and long not in records.columns})
    part = lambda name: [(F.col(c) if c in records.columns else F.lit(None)).cast(kind).alias(c) for c, kind in AUDIT[name].items()]
    kind = "array<struct<name:string,status:string,witness:array<string>,detail:string,failure_code:string>>"
    if traces is None:
        rows = records.withColumn("checks", F.array().cast(kind))
    else:
        detail = F.col("detail") if "detail" in traces.columns else F.coalesce(F.concat(F.lit("at "), F.array_join("witness", ", ")), F.lit(""))
        one = F.struct("ord", F.struct(F.col("cert").alias("name"), F.col("verdict").alias("status"), "witness", F.when(F.size("witness") > 0, detail).otherwise("").alias("detail"), "failure_code").alias("check"))
        checks = traces.groupBy(F.col("feature_id").alias("of")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["check"]).cast(kind).alias("checks"))
        # Their files are small for what they hold, so Spark would broadcast them.
        rows = records.join(checks.hint("merge"), F.col("feature_id") == F.col("of"), "left").withColumn("checks", F.coalesce("checks", F.array().cast(kind)))
    failed = F.exists("checks", lambda x: x["status"] == "fail")
    said = F.col("overall") if "overall" in records.columns else F.lit(None).cast("string")
    overall = F.coalesce(said, F.when(failed, "fail").when(F.size("checks") > 0, "pass"))
    first = F.get(F.filter("checks", lambda x: x["status"] == "fail"), F.lit(0))["failure_code"]
    code = F.coalesce(F.col("failure_code"), first) if "failure_code" in records.columns else first
    hard = F.struct(*part("hard")[:3], overall.alias("overall"), code.alias("failure_code"), "checks")
    semantic = F.when(~F.col("status").isin("rejected_cert", "rejected_compile"), F.struct(*part("semantic")))
    return rows.select(*part("top"), hard.alias("hard"), F.struct(F.struct(*part("empirical"), *[F.col(c).cast("double").alias(c) for c in short.values() if c in records.columns]).alias("empirical"), semantic.alias("semantic")).alias("soft"))


def write_audit(records: DataFrame, path: str, traces: DataFrame | None = None) -> None:
    """``audit_records`` as JSON lines; null fields are written."""
    audit_records(records, traces).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
