"""Model inputs, fits and scores with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import audit, features, splits

#: Rows of a model's input in one task at most, where there are more than that for each core.
TASK_ROWS = 250_000


def model_input(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Infinite and missing numbers become -1; categories become their place among the sorted ones of all rows.

    Codes are ranked over the distinct values of each column, then joined back; a column with few values is broadcast.
    """
    out = df
    for c in categorical:
        text, code = splits.fresh(out.columns, "_text"), splits.fresh(out.columns, "_code")
        out = out.withColumn(text, F.coalesce(F.col(c), F.lit("nan")))
        codes = splits.places(out, text).select(F.col(text).alias(f"{text}_"), F.col("place").cast("int").alias(code))
        out = out.join(codes, F.col(text) == F.col(f"{text}_"), "left").drop(text, f"{text}_", c).withColumnRenamed(code, c)
    clean = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), -1.0).otherwise(F.col(c).cast("double")) for c in numeric}
    return out.withColumns(clean).select(*df.columns)


def min_max(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale by the train rows' range; constant columns become 0."""
    row = train.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    pairs = {c: (row[f"min_{c}"] or 0.0, row[f"max_{c}"] or 0.0) for c in columns}
    return df.withColumns({c: (F.col(c) - a) / (b - a) if b > a else F.lit(0.0) for c, (a, b) in pairs.items()})


def model(name: str, task: str, classes: int = 2, trees: int = 100, seed: int = 0):
    """RF, LR or GBT; boosted trees of several classes are a forest, as Spark's are binary."""
    if task == "C":
        if name == "LR":
            return LogisticRegression(maxIter=2000, labelCol="label")
        if name == "GBT" and classes == 2:
            return GBTClassifier(labelCol="label", seed=seed)
        return RandomForestClassifier(numTrees=trees, labelCol="label", seed=seed)
    if name == "LR":
        return LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False, labelCol="label")
    return GBTRegressor(labelCol="label", seed=seed) if name == "GBT" else RandomForestRegressor(numTrees=trees, labelCol="label", seed=seed)


def score(train: DataFrame, other: DataFrame, inputs: list[str], task: str = "C", name: str = "RF", trees: int = 100) -> float:
    """Fit on train, predict other: micro-F1 or R squared. Both have a numeric ``label``."""
    if name == "LR":
        train, other = min_max(train, train, inputs), min_max(train, other, inputs)
    assemble = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    ready = assemble.transform(train).select("features", F.col("label").cast("double").alias("label"))
    rows, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    if rows > TASK_ROWS * cores:  # a file's splits hold millions of rows, whose vectors take far more room than the file
        ready = ready.repartition(-(-rows // TASK_ROWS))
    ready = ready.persist()
    try:
        classes = ready.select("label").distinct().count() if task == "C" else 0
        fitted = model(name, task, classes, trees).fit(ready)
        out = fitted.transform(assemble.transform(other).withColumn("label", F.col("label").cast("double")))
        return (audit.micro_f1 if task == "C" else audit.r2)(out, "label", "prediction").first()[0]
    finally:
        ready.unpersist()


def final_score(df: DataFrame, key: str, numeric: list[str], categorical: list[str], accepted: dict[str, dict], types: dict[str, str], names: list[str], task: str = "C", name: str = "RF", trees: int = 100) -> tuple[float, float]:
    """(baseline, final) on the test rows: the model of train and val rows, without and with all ``accepted`` features.

    ``df`` has _split, key, label and the columns. The features' statistics come from the train rows alone, as when they
    were accepted; one that fails is left out. Without accepted features both scores are the same.
    """
    fitted = features.fit(df, accepted, types, names)
    try:
        more = {f: f"feature_{i}" for i, f in enumerate(f for f in accepted if f not in fitted.failed)}
        own = features.apply(df, accepted, types, fitted, ["_split", "label", *numeric, *categorical], names)
        own = own.select("_split", "label", *numeric, *categorical, *[F.col(f"`{f}`").alias(c) for f, c in more.items()])
        text = [c for c, kind in own.dtypes if c in more.values() and kind == "string"]
        rows = model_input(own, [*numeric, *(c for c in more.values() if c not in text)], [*categorical, *text]).persist()
        train, test = rows.where("_split <> 'test'"), rows.where("_split = 'test'")
        baseline = score(train, test, [*numeric, *categorical], task, name, trees)
        out = score(train, test, [*numeric, *categorical, *more.values()], task, name, trees) if more else baseline
        rows.unpersist()
        return baseline, out
    finally:
        fitted.release()


def cross_validated(df: DataFrame, key: str, inputs: list[str], task: str = "C", name: str = "RF", folds: int = 5, trees: int = 100) -> list[float]:
    """A score for each fold: folds even in each class for classes (task C), of even size for numbers."""
    dealt = (splits.stratified_k_fold(df, key, "label", folds) if task == "C" else splits.k_fold(df, key, folds, exact=True)).persist()
    try:
        return [score(dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k), inputs, task, name, trees) for k in range(folds)]
    finally:
        dealt.unpersist()


def cross_validated_mean(df: DataFrame, key: str, inputs: list[str], task: str = "C", name: str = "RF", folds: int = 5, trees: int = 100) -> float:
    """The mean of ``cross_validated``."""
    scores = cross_validated(df, key, inputs, task, name, folds, trees)
    return sum(scores) / len(scores)
