"""Chat formatting: tool calls linked with their results, ordered, validated and serialised; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small, staged, unstage

#: schema_of_variant names that each declared argument type allows.
ALLOWED = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def depths(calls: DataFrame, more: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(conv_id, call_id, parent_id) to (conv_id, call_id, depth): 0 for calls without a parent in the table, one more
    than the deepest parent else, null on or below a cycle. ``more`` has further parents (conv_id, call_id, parent_id).

    Chains of calls with one parent are settled by pointer doubling: every round each call learns its ancestor twice as
    far off, so a chain of n calls takes log2(n) joins on narrow rows. Chains end at calls without or with several parents;
    the latter wait until all their parents' chains are known, a round for each such call on the longest way.
    """
    ids = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", "parent_id")
    edges = (edges.unionByName(more.select("conv_id", "call_id", "parent_id")) if more is not None else edges).distinct()
    edges = staged(edges.join(ids, ["conv_id", "call_id"], "left_semi").join(ids.withColumnRenamed("call_id", "parent_id"), ["conv_id", "parent_id"], "left_semi").select("conv_id", "call_id", "parent_id"))
    parents = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("parent_id").alias("parent_id"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    top, far = F.when(single, F.col("parent_id")).otherwise(F.col("call_id")), single.cast("long")
    step = staged(ids.join(parents, ["conv_id", "call_id"], "left").select("conv_id", "call_id", top.alias("top"), far.alias("far"), (~single).alias("ended"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("joint")))
    joints = step.where("joint").select("conv_id", F.col("call_id").alias("top"))
    limit = step.count()
    for k in range(rounds):
        above = step.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("far").alias("more"), F.col("ended").alias("end"))
        moved = step.where("not ended").join(above, ["conv_id", "top"]).select("conv_id", "call_id", F.col("next").alias("top"), (F.col("far") + F.col("more")).alias("far"), F.col("end").alias("ended"), "joint")
        before, step = step, staged(step.where("ended").unionByName(moved))
        if k:
            unstage(before)
        if 2 ** (k + 1) > limit or not step.where("not ended").limit(1).count():
            break
    ended = step.where("ended")
    known = staged(ended.join(joints, ["conv_id", "top"], "left_anti").select("conv_id", "top", F.lit(0).cast("long").alias("start")).distinct())
    if joints.limit(1).count():
        below = edges.join(joints.withColumnRenamed("top", "call_id"), ["conv_id", "call_id"], "left_semi")
        chains = ended.select("conv_id", F.col("call_id").alias("parent_id"), "top", "far")
        waits = staged(below.join(chains, ["conv_id", "parent_id"], "left").select("conv_id", "call_id", "top", (F.col("far") + 1).alias("far")))
        settled = known.count()
        while True:
            found = waits.join(known, ["conv_id", "top"], "left").groupBy("conv_id", "call_id").agg(F.max(F.col("start") + F.col("far")).alias("start"), F.bool_and(F.col("start").isNotNull()).alias("all"))
            before, known = known, staged(known.unionByName(found.where("all").select("conv_id", F.col("call_id").alias("top"), "start")).distinct())
            unstage(before)
            now = known.count()
            if now == settled:
                break
            settled = now
    whole = ended.join(known, ["conv_id", "top"], "left").select("conv_id", "call_id", (F.col("far") + F.col("start")).alias("depth"))
    return ids.join(whole, ["conv_id", "call_id"], "left")


def declared_rows(schemas: DataFrame) -> DataFrame:
    """The schemas with all their columns (name, arg, type, required, enum, minimum, maximum), and each path's parent path."""
    more = {"enum": "array<string>", "minimum": "double", "maximum": "double"}
    rows = schemas.select("name", "arg", "type", "required", *[(F.col(c) if c in schemas.columns else F.lit(None)).cast(kind).alias(c) for c, kind in more.items()])
    return rows.withColumn("parent", F.regexp_extract("arg", r"^(.*?)(?:\[\]|\.?[^.\[\]]+)$", 1))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors): sorted texts such as ``missing:x``, ``type:x``, ``unknown:x``, ``enum:x``, ``minimum:x``, ``maximum:x``, ``tool`` and ``json``.

    ``schemas`` has name, arg, type (a key of ALLOWED) and required, and if it likes enum (array of texts, as JSON's scalars are written),
    minimum and maximum. ``arg`` is a path: ``filter.lang`` is a field of the object filter, ``tags[]`` stands for the items of the array tags, ``parts[].id``
    for a field of each. An object or array without declared parts may hold anything; in others every field must be declared. A required field is asked for wherever its
    object is. A null is of no type. Arguments are opened a level at a time, as deep as the schemas go. Calls without errors have no row; values don't
    travel where the schemas are broadcast (a bounded list of tools, behind a check).
    """
    parsed = calls.select("conv_id", "call_id", "name", F.try_parse_json("arguments").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    told = staged(declared_rows(schemas))
    tools = small(staged(told.select("name").distinct()))
    bad = parsed.where(~is_object).select("conv_id", "call_id", F.lit("json").alias("error"))
    unknown_tool = parsed.select("conv_id", "call_id", "name").join(tools, "name", "left_anti").select("conv_id", "call_id", F.lit("tool").alias("error"))
    declared = small(staged(told.select("name", "arg", F.col("type"), "enum", "minimum", "maximum").dropDuplicates(["name", "arg"])))
    needed = F.collect_set(F.when(F.col("required") & ~F.col("arg").endswith("[]"), F.regexp_extract("arg", r"([^.\[\]]+)$", 1)))
    parents = small(staged(told.groupBy("name", F.col("parent").alias("at")).agg(needed.alias("needed"))))
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    deepest = told.agg(F.max(F.size(F.split("arg", r"\.|\[\]")))).first()[0] or 0
    every, open_ = bad.unionByName(unknown_tool), parsed.where(is_object).join(tools, "name", "left_semi").withColumn("at", F.lit(""))
    for level in range(deepest + 1):
        # A tool without declared fields has no row at the top and may get nothing but unknown ones.
        open_ = open_.join(parents, ["name", "at"], "left" if level == 0 else "inner")
        opened = F.schema_of_variant("v").startswith("OBJECT")
        keys = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
        lacks = open_.where(opened).withColumn("lack", F.explode(F.array_except("needed", keys)))
        every = every.unionByName(lacks.select("conv_id", "call_id", F.concat(F.lit("missing:"), "at", F.when(F.col("at") != "", ".").otherwise(""), "lack").alias("error")))
        if level == deepest:
            break
        parts = open_.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value"))
        arg = F.when(F.col("key").isNull(), F.concat("at", F.lit("[]"))).when(F.col("at") == "", F.col("key")).otherwise(F.concat("at", F.lit("."), "key"))
        kind = F.regexp_extract(F.regexp_replace(F.schema_of_variant("value"), "^DECIMAL.[0-9]+,0.$", "BIGINT"), "^[A-Z]+", 0)
        given = parts.select("conv_id", "call_id", "name", arg.alias("arg"), kind.alias("kind"), F.col("value").alias("v")).join(declared, ["name", "arg"], "left")
        number = F.when(F.col("kind").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get("v", "$", "double"))
        right = F.array_contains(F.coalesce(allowed[F.col("type")], F.array(F.lit(""))), F.col("kind"))
        error = F.when(F.col("type").isNull(), "unknown:").when(~right, "type:").when(F.col("enum").isNotNull() & ~F.array_contains("enum", F.try_variant_get("v", "$", "string")), "enum:").when(number < F.col("minimum"), "minimum:").when(number > F.col("maximum"), "maximum:")
        every = every.unionByName(given.where(error.isNotNull()).select("conv_id", "call_id", F.concat(error, "arg").alias("error")))
        open_ = given.where(F.col("type").isNotNull() & right & F.col("kind").isin("OBJECT", "ARRAY")).select("name", F.col("arg").alias("at"), "conv_id", "call_id", "v")
    return every.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, more_parents: DataFrame | None = None) -> DataFrame:
    """One row per call, and per result without one: conv_id, call_id, name, status, depth, seq, valid, errors, json.

    ``calls`` has conv_id, call_id, parent_id, seq, name and arguments (JSON text); ``results`` has conv_id, call_id, seq
    and content; ``more_parents`` (conv_id, call_id, parent_id) says what else calls depend on. Of rows with one identifier the one of smallest (seq, text) counts. status is linked, no_result,
    orphan_result or cycle. (depth, seq) is a topological order of a conversation: a call comes after the one
    it depends on. ``json`` is canonical: keys sorted, no spaces, numbers as in ``numbers_canonical``. Arguments
    that are no JSON object are kept as a string. Rows with a null conv_id or call_id can't be linked and are
    reported with status no_identifier. Joins are on (conv_id, call_id), so a conversation with most rows spreads.
    """
    here = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call = F.struct(F.col("seq").isNull().alias("m"), "seq", "name", "arguments", "parent_id")
    one = staged(calls.where(here).groupBy("conv_id", "call_id").agg(F.min(call).alias("c")).select("conv_id", "call_id", "c.seq", "c.name", "c.arguments", "c.parent_id"))
    reply = F.struct(F.col("seq").isNull().alias("m"), "seq", "content")
    answers = results.where(here).groupBy("conv_id", "call_id").agg(F.min(reply).alias("r"), F.lit(True).alias("answered"))
    linked = one.join(answers, ["conv_id", "call_id"], "full_outer")
    linked = linked.join(depths(one.select("conv_id", "call_id", "parent_id"), more_parents), ["conv_id", "call_id"], "left").join(argument_errors(one, schemas), ["conv_id", "call_id"], "left")
    is_call = F.col("name").isNotNull() | F.col("arguments").isNotNull() | F.col("seq").isNotNull() | F.col("depth").isNotNull() | F.col("errors").isNotNull()
    status = F.when(~is_call, "orphan_result").when(F.col("depth").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("no_result")
    return _report(linked.withColumn("status", status)).unionByName(_report(_nameless(calls, results, here)))


def _nameless(calls: DataFrame, results: DataFrame, here) -> DataFrame:
    nothing = [F.lit(None).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("errors"), F.lit("no_identifier").alias("status")]
    r = F.struct(F.col("seq").isNull().alias("m"), "seq", "content").alias("r")
    empty = F.lit(None).cast("struct<m:boolean,seq:long,content:string>").alias("r")
    first = calls.where(~here).select("conv_id", "call_id", "seq", "name", "arguments", empty, *nothing)
    return first.unionByName(results.where(~here).select("conv_id", "call_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), r, *nothing))


def _report(rows: DataFrame) -> DataFrame:
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    parsed = F.try_parse_json("arguments")
    arguments = F.coalesce(F.when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), numbers_canonical(F.to_json(parsed))), _quoted("arguments"))
    json = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"), F.lit(',"result":'), _quoted("r.content"), F.lit("}"))
    seq = F.coalesce("seq", F.col("r.seq"))
    return rows.select("conv_id", "call_id", "name", "status", "depth", seq.alias("seq"), ((F.col("status") == "linked") & (F.size(errors) == 0)).alias("valid"), errors.alias("errors"), json.alias("json"))


def numbers_canonical(json: Column) -> Column:
    """JSON text with each number in one form, whatever its spelling: digits alone for integers under 1e21, else the shortest
    digits that give the same double, with a point down to 1e-6 and an exponent such as e-7 or e+21 beyond."""

    def form(token: Column) -> Column:
        d = token.try_cast("double")
        size, text = F.abs(d), d.cast("string")
        trimmed = F.regexp_replace(F.regexp_replace(F.when(size < 1, text.try_cast("decimal(38,24)").cast("string")).otherwise(text.try_cast("decimal(38,17)").cast("string")), "0+$", ""), r"\.$", "")
        power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E", "e"), "e([0-9])", "e+$1")
        real = F.when(size >= 1e21, power).when(d == 0, "0").when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")).when(size < 1e-6, power).otherwise(trimmed)
        return F.when(token.rlike("^-?[0-9]{1,21}$") & (token != "-0"), token).otherwise(real)

    # Possessive, so that a long string is matched without recursion.
    tokens = F.regexp_extract_all(json, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'), F.lit(0))
    spelled = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), form(t)).otherwise(t)), "")
    return F.when(json.rlike(r"[0-9][.eE]|[0-9]{22}|-0"), spelled).otherwise(json)


def _quoted(column: str):
    """A JSON string, or null as JSON writes it."""
    inner = F.to_json(F.struct(F.col(column).alias("x")))
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.regexp_extract(inner, r"(?s)^\{\"x\":(.*)\}$", 1))
