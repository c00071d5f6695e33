"""Certificates C1 to C6 over a table of programs, as one aggregate over their nodes.

Tables with a row a program are joined by their ids as sorted partitions (the ``merge`` hint): their files are small for what they hold, so Spark would
take them for small enough to broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import grammar as G
from quern.sources.scratch import staged

NODES = "feature_id string, node_id string, path string, op string, dtype string, unit string, col_index int, const_value string, source_split string, time_origin string, children array<string>, hash string, error string, detail string"
CERTIFICATES = ("C1", "C2", "C3", "C4", "C5", "C6")


def nodes(programs: DataFrame, schema: DataFrame) -> DataFrame:
    """One row per node of each program (feature_id, family, program, output as JSON text), or one row with an error code.

    ``schema`` has col_index, dtype, unit and is_target: one row per column of a table, so it is collected. Nodes are
    numbered n0.. inputs first. A program that is no JSON, has no known family or breaks the grammar has the
    error GRAMMAR; type, unit and column errors have their certificates' codes; whatever else goes wrong is INTERNAL.
    """
    rows = schema.collect()
    columns = {r.col_index: (r.dtype, r.unit) for r in rows}
    target = next((r.col_index for r in rows if r.is_target), None)

    def one(fid: str | None, family: str | None, text: str | None, output: str | None) -> list[tuple]:
        tag = None
        try:
            if not fid or family not in G.FAMILIES or text is None:
                raise G.ProgramError("GRAMMAR", "feature_id, a known family and program are needed")
            program = json.loads(text)
            tag = G.structural_hash(program)
            own = G.typed(program, columns, target, json.loads(output) if output else None)
            names = {x["path"]: f"n{i}" for i, x in enumerate(own)}
            places = dict(G.walk(program))
            return [(fid, names[x["path"]], x["path"], x["op"], x["dtype"], x["unit"], x["col_index"], x["const_value"], places[x["path"]].get("source_split"), places[x["path"]].get("time_origin"), [names[c] for c in x["children"]], tag, None, None) for x in own]
        except G.ProgramError as e:
            code, detail = e.code, str(e)
        except ValueError as e:
            code, detail = "GRAMMAR", str(e)
        except Exception as e:  # one broken program must not stop the others
            code, detail = "INTERNAL", f"{type(e).__name__}: {e}"
        return [(fid, None, None, None, None, None, None, None, None, None, None, tag, code, detail)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in NODES.split(", ")]
        for batch in batches:
            out = [x for r in batch.itertuples(index=False) for x in one(*[None if v is None or v != v else v for v in r])]
            frame = pd.DataFrame(out, columns=names)
            frame["col_index"] = frame["col_index"].astype("Int32")
            yield frame

    # A few megabytes of a file can hold a million programs, so they are dealt to all cores before they are compiled.
    spark = programs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return programs.select("feature_id", "family", "program", "output").repartition(parts).mapInPandas(run, NODES)


def on_circles(edges: Column) -> Column:
    """Of one program's edges (n, its input c) those left when nodes without inputs or without users go, again and again, as often as there are edges."""
    left = lambda e: F.filter(e, lambda p: F.exists(e, lambda q: q["n"] == p["c"]) & F.exists(e, lambda q: q["c"] == p["n"]))
    return F.aggregate(F.sequence(F.lit(1), F.size(edges)), edges, lambda e, _: left(e))


def traces(nodes_: DataFrame, schema: DataFrame, t_star: str | None = None, train_split: str = "train", wanted: tuple[str, ...] = CERTIFICATES) -> DataFrame:
    """(feature_id, cert, ord, verdict, failure_code, witness) for every compiled program and ``wanted`` certificate; others are not computed.

    C1: known operators, columns and numbers of inputs. C2: target and forbidden columns only as direct inputs of
    TargetEncode, with nothing above it. C3: nothing later than ``t_star`` (n/a without one), compared as times; text that
    is no time fails. C4: input types and units. C5: fit operators read train only. C6: every input exists, and no
    node is below itself: edges to a longer path can't close a circle, so only programs with other edges are searched.

    ``nodes_`` is read and shuffled once: a program's nodes are brought together as one array, and what a node has to know of the others is looked up
    there. Nothing but the schema is broadcast, however many programs there are.
    """
    cols = F.broadcast(schema.select("col_index", F.col("dtype").alias("declared_dtype"), (F.col("is_target") | F.col("is_forbidden")).alias("prohibited")))
    at = nodes_.where("error is null").join(cols, "col_index", "left")
    arity = F.create_map(*[x for op in ("Col", "Const", *G.UNARY, *G.BINARY, *G.VARIADIC, "TargetEncode") for x in (F.lit(op), F.lit(G.arity(op)))])
    n = arity[F.col("op")]
    late = F.coalesce(F.try_to_timestamp("time_origin") > F.to_timestamp(F.lit(t_star)), F.lit(True))
    # What each certificate reads of a node, beside its name.
    fields = {
        "C1": {"misfit": n.isNull() | ((F.col("op") == "Col") & F.col("declared_dtype").isNull()) | ((n > 0) & (F.size("children") != n))},
        "C2": {"path": F.col("path"), "op": F.col("op"), "above": F.regexp_replace("path", "/[^/]*$", ""), "prohibited": (F.col("op") == "Col") & F.col("prohibited")},
        "C3": {"late": F.col("time_origin").isNotNull() & late if t_star else F.lit(False)},
        "C4": {"op": F.col("op"), "dtype": F.col("dtype"), "unit": F.col("unit"), "children": F.col("children")},
        "C5": {"path": F.col("path"), "op": F.col("op"), "other": F.col("source_split").isNotNull() & (F.col("source_split") != train_split)},
        "C6": {"path": F.col("path"), "children": F.col("children")},
    }
    read = {k: v for c in wanted for k, v in fields[c].items()}
    own = at.select("feature_id", F.struct("node_id", *[v.alias(k) for k, v in read.items()]).alias("node")).groupBy("feature_id").agg(F.collect_list("node").alias("nodes"))

    inputs = lambda x: F.filter("nodes", lambda c: F.array_contains(x["children"], c["node_id"]))
    below = lambda leaf, x: leaf["path"].startswith(F.concat(x["path"], F.lit("/")))
    known = lambda name: F.coalesce(F.exists("nodes", lambda c: c["node_id"] == name), F.lit(False))
    dangling = lambda x: F.exists(x["children"], lambda name: ~known(name))
    odd = lambda x: dangling(x) | F.exists(inputs(x), lambda c: ~F.coalesce(below(c, x), F.lit(False)))
    def mixed(x: Column) -> Column:
        units = F.transform(inputs(x), lambda c: c["unit"])
        number = x["op"].isin(*G.NUMERIC_ONLY) & F.exists(inputs(x), lambda c: c["dtype"] != "numeric")
        kind = x["op"].isin(*G.CATEGORICAL_ONLY) & F.exists(inputs(x), lambda c: (c["op"] == "Col") & (c["dtype"] != "categorical"))
        return number | kind | (x["op"].isin("Add", "Subtract") & (F.array_min(units) != F.array_max(units)))

    leaks = lambda x: (x["prohibited"] & (x["path"] == "")) | F.exists("nodes", lambda c: c["prohibited"] & below(c, x) & ~((x["op"] == "TargetEncode") & (c["above"] == x["path"])))
    bad = {
        "C1": ("C1.SCHEMA", lambda x: x["misfit"]),
        "C2": ("C2.TARGET_LEAK", leaks),
        "C3": ("C3.FUTURE_TIME", lambda x: x["late"]),
        "C4": ("C4.TYPE", mixed),
        "C5": ("C5.FIT_LEAK", lambda x: x["op"].isin(*G.FIT) & F.exists("nodes", lambda c: c["other"] & below(c, x))),
        "C6": ("C6.LINEAGE", dangling),
    }
    found = lambda fails: F.transform(F.filter("nodes", lambda x: F.coalesce(fails(x), F.lit(False))), lambda x: x["node_id"])
    found_by = {c: found(bad[c][1]) for c in wanted}
    if "C6" in wanted:
        edges = F.flatten(F.transform("nodes", lambda x: F.transform(F.coalesce(x["children"], F.array().cast("array<string>")), lambda c: F.struct(x["node_id"].alias("n"), c.alias("c")))))
        circles = F.when(F.exists("nodes", odd), F.transform(on_circles(edges), lambda p: p["n"]))
        found_by["C6"] = F.array_union(found_by["C6"], F.coalesce(circles, F.array().cast("array<string>")))
    each = [F.struct(F.lit(c).alias("cert"), F.lit(int(c[1:])).alias("ord"), F.lit(bad[c][0]).alias("code"), found_by[c].alias("found")) for c in wanted]
    told = own.select("feature_id", F.explode(F.array(*each)).alias("t")).select("feature_id", "t.*")
    failed = F.size("found") > 0
    verdict = F.when(failed, "fail").when((F.col("ord") == 3) & F.lit(t_star is None), "n/a").otherwise("pass")
    return told.select("feature_id", "cert", "ord", verdict.alias("verdict"), F.when(failed, F.col("code")).alias("failure_code"), F.array_sort(F.array_compact(F.array_distinct("found"))).alias("witness"))


def verdicts(nodes_: DataFrame, traces_: DataFrame, enabled: tuple[str, ...] = CERTIFICATES) -> DataFrame:
    """(feature_id, passed, failure_code): a program passes if no enabled certificate fails; the first code in order counts."""
    bad = F.col("verdict") == "fail"
    own = traces_.where(F.col("cert").isin(*enabled)).groupBy("feature_id").agg(F.bool_and(~bad).alias("passed"), F.min_by("failure_code", F.when(bad, F.col("ord"))).alias("failure_code"))
    broken = nodes_.where("error is not null").select("feature_id", F.lit(False).alias("passed"), F.col("error").alias("failure_code"))
    return own.unionByName(broken)


def certify(programs: DataFrame, schema: DataFrame, t_star: str | None = None) -> DataFrame:
    """(feature_id, hash, passed, failure_code, witness) of programs, from their nodes as a written table; witness: nodes of the failure."""
    own = staged(nodes(programs, schema))
    told = staged(traces(own, schema, t_star))
    out = verdicts(own, told)
    tags = own.groupBy("feature_id").agg(F.max("hash").alias("hash"))
    at = told.where("verdict = 'fail'").groupBy("feature_id").agg(F.min_by("witness", "ord").alias("witness"))
    return out.join(tags.hint("merge"), "feature_id").join(at.hint("merge"), "feature_id", "left").select("feature_id", "hash", "passed", "failure_code", F.coalesce("witness", F.array().cast("array<string>")).alias("witness"))


def certify_new(programs: DataFrame, schema: DataFrame, cache: str, schema_hash: str, t_star: str | None = None) -> tuple[DataFrame, int]:
    """(feature_id, passed, failure_code, witness, cached) for ``programs``, and how many had to be certified.

    ``cache`` is a table of verdicts below that path by (what the program is, schema_hash, t_star). What a program is: the hash of its JSON text, family and
    declared output, as all three decide its verdict. Programs that the cache knows are left out by an anti-join before anything is compiled; of the others each text is
    certified once, and its verdict is appended. Broken programs are remembered too; programs without an id have the verdict GRAMMAR and aren't.
    The same verdicts come out whatever the cache held. One writer at a time may append.
    """
    spark = programs.sparkSession
    star = t_star or ""
    text = lambda c: F.coalesce(F.col(c), F.lit("\0"))
    tagged = programs.withColumn("program_key", F.sha2(F.concat_ws("\1", text("program"), text("family"), text("output"), F.col("feature_id").isNull().cast("string")).cast("binary"), 256))
    known = "program_key string, schema_hash string, t_star string, passed boolean, failure_code string, witness array<string>"
    try:
        kept = spark.read.schema(known).parquet(cache)
        kept.limit(1).count()
    except AnalysisException:
        kept = spark.createDataFrame([], known)
    here = kept.where((F.col("schema_hash") == schema_hash) & (F.col("t_star") == star)).drop("schema_hash", "t_star")
    own = staged(here.join(tagged.select("program_key").distinct(), "program_key", "left_semi"))
    fresh = tagged.where("feature_id is not null").join(own, "program_key", "left_anti").groupBy("program_key").agg(F.min(F.struct("family", "program", "output")).alias("p"))
    fresh = staged(fresh.select(F.col("program_key").alias("feature_id"), "p.*"))
    n = fresh.count()
    if n:
        more = staged(certify(fresh, schema, t_star).select(F.col("feature_id").alias("program_key"), "passed", "failure_code", "witness"))
        more.select("program_key", F.lit(schema_hash).alias("schema_hash"), F.lit(star).alias("t_star"), "passed", "failure_code", "witness").write.mode("append").parquet(cache)
        marked = own.withColumn("cached", F.lit(True)).unionByName(more.withColumn("cached", F.lit(False)))
    else:
        marked = own.withColumn("cached", F.lit(True))
    out = tagged.select("feature_id", "program_key").join(marked, "program_key", "left")
    nameless = F.col("feature_id").isNull()
    return out.select("feature_id", F.coalesce("passed", F.lit(False)).alias("passed"), F.when(nameless, "GRAMMAR").otherwise(F.col("failure_code")).alias("failure_code"), F.coalesce("witness", F.array().cast("array<string>")).alias("witness"), F.coalesce("cached", F.lit(False)).alias("cached")), n


def schema_hashes(schemas: DataFrame, checks: tuple[str, ...] = CERTIFICATES) -> DataFrame:
    """(dataset, schema_hash) from (dataset, col_index, dtype, is_target, is_forbidden): the first 16 digits of the sha256 of the
    key-sorted JSON of the columns and the enabled certificates, so that verdicts can be kept for it."""
    own = schemas.groupBy("dataset").agg(
        F.sort_array(F.collect_set(F.struct("col_index", "dtype"))).alias("cols"),
        F.sort_array(F.collect_set(F.when(F.col("is_forbidden"), F.col("col_index")))).alias("forbidden_cols"),
        F.min(F.when(F.col("is_target"), F.col("col_index"))).alias("target_col"),
    )
    kinds = F.transform("cols", lambda c: F.concat(c["col_index"].cast("string"), F.lit(":"), c["dtype"]))
    payload = F.struct(F.array(*map(F.lit, checks)).alias("checks"), kinds.alias("col_types"), "dataset", "forbidden_cols", F.size("cols").alias("n_cols"), "target_col")
    return own.select("dataset", F.substring(F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}).cast("binary"), 256), 1, 16).alias("schema_hash"))


def column_sets(nodes_: DataFrame) -> DataFrame:
    """(feature_id, col_group): the sorted column positions a program reads."""
    return nodes_.where("error is null").groupBy("feature_id").agg(F.sort_array(F.collect_set("col_index")).alias("col_group"))


def first_of_each(nodes_: DataFrame, order: DataFrame) -> DataFrame:
    """(feature_id, hash, duplicate): of programs with one structural hash that with the smallest seq is no duplicate."""
    tags = nodes_.where("hash is not null").select("feature_id", "hash").distinct().join(order.select("feature_id", "seq").hint("merge"), "feature_id")
    first = tags.groupBy("hash").agg(F.min("seq").alias("first"))
    return tags.join(first, "hash").select("feature_id", "hash", (F.col("seq") > F.col("first")).alias("duplicate"))
