"""Fit a set of feature programs on the train split and apply them to any rows."""

from __future__ import annotations

import hashlib
import json
import math
import struct
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import columns as C
from quern.functions import grammar as G
from quern.sources.scratch import staged, unstage

#: A category map is broadcast up to so many rows; a larger one is joined by a shuffle.
MAP_ROWS = 500_000
#: Of a larger map, categories with a share of 1 / HOT of the rows are broadcast all the same (there are at most HOT of them).
HOT = 1000
#: Rows of hot categories, which have their value already, are dealt over so many keys of that shuffle.
SALTS = 4096
#: Expressions in one aggregate or projection at most.
BATCH = 200
#: Values around a rank that come into one list, once so few are left.
FEW = 32_768


@dataclass
class Fitted:
    """Statistics by node of the programs' graph (see ``Graph``). ``failed``: features with an error, by id.

    ``maps`` has (node, category, n, value), ``map_sizes`` the rows of each node and the sum of their n.
    """

    scalars: dict[str, list[float | None]] = field(default_factory=dict)
    maps: DataFrame | None = None
    map_sizes: dict[str, tuple[int, int]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    written: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the category maps that ``fit`` wrote, when nothing is to be applied any more."""
        unstage(*self.written)
        self.maps, self.map_sizes, self.written = None, {}, []


class Graph:
    """The programs as one graph: equal subtrees, of one program or of several, are one node.

    A node's name is a hash of its operator, its own parameters and its inputs' names, so that it is the same in every
    session. ``nodes``: name to (node, names of the inputs), inputs first; ``roots``: feature to name; ``level``: how many fit
    operators stand on the longest way down, the node included; ``shared``: what is read more than once.
    """

    def __init__(self, programs: dict[str, dict]):
        self.nodes: dict[str, tuple[dict, list[str]]] = {}
        self.level: dict[str, int] = {}
        self.failed: dict[str, str] = {}
        self.roots: dict[str, str] = {}
        readers: dict[str, set] = {}
        for fid, program in programs.items():
            try:
                self.roots[fid] = self._add(program)
            except G.ProgramError as e:
                self.failed[fid] = f"{e.code}: {e}"
        for name in self._below(self.roots.values()):
            for own in self.nodes[name][1]:
                readers.setdefault(own, set()).add(name)
        times = Counter(self.roots.values())
        self.shared = {n for n in {*readers, *times} if len(readers.get(n, ())) + times[n] > 1}

    def _add(self, node: dict) -> str:
        own = [self._add(c) for _, c in G.children(node)]
        told = json.dumps([node["op"], node.get("col_index"), node.get("value"), type(node.get("value")).__name__, own])
        name = hashlib.sha256(told.encode()).hexdigest()[:24]
        self.nodes.setdefault(name, (node, own))
        self.level[name] = max([0, *(self.level[c] for c in own)]) + (node["op"] in G.FIT)
        return name

    def _below(self, names) -> list[str]:
        """These nodes and all under them, inputs first."""
        seen: dict[str, None] = {}

        def visit(name: str) -> None:
            if name not in seen:
                for own in self.nodes[name][1]:
                    visit(own)
                seen[name] = None

        for name in names:
            visit(name)
        return list(seen)

    def drop(self, name: str, error: str) -> None:
        """Leave out every feature that reads this node."""
        for fid in [f for f, root in self.roots.items() if name in self._below([root])]:
            self.failed[fid] = error
            del self.roots[fid]

    def fits(self, wave: int) -> list[tuple[str, dict, list[str]]]:
        """The fit operators of a level that some live feature reads: (name, node, inputs)."""
        return [(n, *self.nodes[n]) for n in self._below(self.roots.values()) if self.nodes[n][0]["op"] in G.FIT and self.level[n] == wave]

    @property
    def waves(self) -> int:
        return max([0, *(self.level[n] for n in self.roots.values())])


class Builder:
    """Nodes as Columns over a frame whose columns ``names`` are addressed by position; ``types`` by name. ``ready``: nodes
    that are columns of the frame already."""

    def __init__(self, graph: Graph, names: list[str], types: dict[str, str], fitted: Fitted):
        self.graph, self.names, self.types, self.fitted, self.ready = graph, names, types, fitted, set()

    def column(self, name: str) -> Column:
        if name in self.ready:
            return F.col(f"_node_{name}")
        node, own = self.graph.nodes[name]
        op = node["op"]
        if op == "Col":
            i = node["col_index"]
            if not 0 <= i < len(self.names):
                raise G.ProgramError("EXECUTION_FAILED", f"column {i} out of range")
            c = F.col("`" + self.names[i].replace("`", "``") + "`")
            return C.text(c) if self.types.get(self.names[i]) == "categorical" else C.numeric(c)
        if op == "Const":
            return F.lit(node.get("value"))
        if op in ("FrequencyEncode", "TargetEncode"):
            return F.col(map_column(name))
        xs = [self.column(c) for c in own]
        if op in ("ZScore", "MinMaxScale", "Clip", "QuantileBucketize"):
            return self._scaled(op, xs[0].cast("double"), self.fitted.scalars[name])
        if op in ("IsEqual", "OneHotSelect"):
            both = all(self._numeric(self.graph.nodes[c][0]) for c in own)
            return C.is_equal(*(x.cast("double") if both else C.text(x) for x in xs))
        if op == "Cross":
            return C.cross(*xs)
        if op == "IsNull":
            return C.is_null(xs[0])
        if op == "Coalesce":
            if self.graph.nodes[own[1]][0]["op"] != "Const":
                raise G.ProgramError("EXECUTION_FAILED", "Coalesce takes a constant")
            return F.coalesce(*xs)
        xs = [x.cast("double") for x in xs]
        simple = {"Log1p": C.log1p, "Sqrt": C.sqrt, "Abs": F.abs, "Square": C.square, "Reciprocal": C.reciprocal}
        pairs = {"Add": lambda a, b: a + b, "Subtract": lambda a, b: a - b, "Multiply": lambda a, b: a * b, "Divide": C.divide, "Ratio": C.divide}
        rows = {"RowMean": C.row_mean, "RowMax": C.row_max, "RowMin": C.row_min, "RowSum": C.row_sum, "RowStd": C.row_std}
        if op in simple:
            return simple[op](xs[0])
        if op in pairs:
            return pairs[op](*xs)
        if op in rows:
            return rows[op](xs)
        raise G.ProgramError("EXECUTION_FAILED", f"{op} is a table operator, see operators.temporal")

    def _numeric(self, node: dict) -> bool:
        if node["op"] == "Col":
            return self.types.get(self.names[node["col_index"]]) != "categorical"
        if node["op"] == "Const":
            return isinstance(node.get("value"), (int, float))
        return G.OUTPUT_TYPES.get(node["op"]) != "categorical"

    @staticmethod
    def _scaled(op: str, x: Column, stats: list) -> Column:
        if any(s is None for s in stats):
            return F.lit(None).cast("double")
        a, b = (float(s) for s in stats[:2]) if op != "QuantileBucketize" else (0.0, 0.0)
        if op == "ZScore":
            return (x - a) / (b or 1.0)
        if op == "MinMaxScale":
            return x if a == b else (x - a) / (b - a)
        return C.clip(x, a, b) if op == "Clip" else C.bucket(x, stats)

    def reads(self, name: str) -> set[str]:
        """The frame's columns that a node is computed from."""
        node, own = self.graph.nodes[name]
        if name in self.ready:
            return {f"_node_{name}"}
        if node["op"] in ("FrequencyEncode", "TargetEncode"):
            return {map_column(name)}
        return {self.names[node["col_index"]]} if node["op"] == "Col" else {c for x in own for c in self.reads(x)}

    def check(self) -> None:
        """Leave out the features whose own columns can't be built; encoders and their fits are looked at by ``fit``."""
        for name in self.graph._below(self.graph.roots.values()):
            node, own = self.graph.nodes[name]
            try:
                if node["op"] == "Col" or (node["op"] not in G.FIT and not any(self.graph.level[c] for c in own)):
                    self.column(name)
            except G.ProgramError as e:
                self.graph.drop(name, f"{e.code}: {e}")

    def share(self, frame: DataFrame, wanted: list[str], level: int) -> DataFrame:
        """``frame`` with a column for each node under ``wanted`` that is read more than once and needs no fit above ``level``.

        They are made inputs first; a step makes columns that don't read each other.
        """
        todo = [n for n in self.graph._below(wanted) if n in self.graph.shared and n not in self.ready and self.graph.nodes[n][1] and self.graph.level[n] <= level and self.graph.nodes[n][0]["op"] not in ("FrequencyEncode", "TargetEncode")]
        while todo:
            waiting = set(todo)
            now = [n for n in todo if not waiting & {m for m in self.graph._below([n]) if m != n}]
            frame = frame.withColumns({f"_node_{n}": self.column(n) for n in now})
            self.ready |= set(now)
            todo = [n for n in todo if n not in self.ready]
        return frame


def map_column(name: str) -> str:
    return f"_map_{name}"


def order_bits(x: Column) -> Column:
    """A long that sorts as the double does, from its bits; negative numbers have negative ones. Missing and NaN are missing, -0.0 is 0.0."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.abs(x)).cast("bigint")
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < 0, -bits).otherwise(bits))


def from_bits(bits: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -value if bits < 0 else value


def exact_quantiles(frame: DataFrame, asked: list[tuple[Column, list[float]]], few: int = FEW) -> list[list[float | None]]:
    """Per (column, fractions) the exact quantiles, see ``select_ranks``. The columns are written once to the shared folder, as bits."""
    table = staged(frame.select(*[order_bits(x).alias(f"x{i}") for i, (x, _) in enumerate(asked)]))
    found = select_ranks(table, [(f"x{i}", qs) for i, (_, qs) in enumerate(asked)], few)
    unstage(table)
    return found


def select_ranks(table: DataFrame, asked: list[tuple[str, list[float]]], few: int = FEW) -> list[list[float | None]]:
    """Per (column of ``order_bits``, fractions) the order statistics, interpolated between two neighbours as ``percentile`` does; None
    for an empty column.

    Radix selection over the bits of the doubles, some 20 at a time and all columns and ranks together: one aggregate counts the values by
    (column, next bits) among those that begin as a wanted rank's value does, and a window over these counts finds the bits in which
    each rank lies. A rank is done when all values left are equal, as ties are; where at most ``few`` are left they are sorted in one list.
    After three rounds all bits are known. Nothing but counts is shuffled, and a rank's value is always taken itself. ``table`` should be
    a written one, as each round reads it.
    """
    spark = table.sparkSession
    bits = [F.col(c) for c, _ in asked]
    totals = []
    for low in range(0, len(bits), BATCH):
        totals += table.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(bits[low : low + BATCH])]).first()
    ranks = sorted({(i, k) for i, (_, qs) in enumerate(asked) if totals[i] for q in qs for k in (math.floor((totals[i] - 1) * q), math.ceil((totals[i] - 1) * q))})
    values: dict[tuple[int, int], float] = {}
    live = {r: (0, r[1], totals[r[0]]) for r in ranks}  # the value's first bits, its rank among those that begin so, how many do
    for shift, width in ((44, 20), (22, 22), (0, 22)):
        if not live:
            break
        short = all(n <= few for *_, n in live.values())
        open_ = {i for i, _ in live}
        counts = None
        for low in range(0, len(bits), BATCH):
            own = [F.struct(F.lit(i).cast("long").alias("i"), x.alias("k")) for i, x in enumerate(bits[low : low + BATCH], low) if i in open_]
            if own:
                part = table.select(F.inline(F.array(*own))).where("k is not null")
                counts = part if counts is None else counts.unionByName(part)
        if shift < 44:
            begun = spark.createDataFrame(sorted({(i, p) for (i, _), (p, _, _) in live.items()}), "wi long, wp long")
            counts = counts.join(F.broadcast(begun), (F.col("i") == F.col("wi")) & (F.shiftright("k", shift + width) == F.col("wp")), "left_semi")
        parent = F.lit(0).cast("bigint") if shift == 44 else F.shiftright("k", shift + width)
        wanted = spark.createDataFrame([(i, p, place, k) for (i, k), (p, place, _) in live.items()], "wi long, wp long, place long, rank long")
        if short:
            lists = counts.groupBy("i", parent.alias("p")).agg(F.sort_array(F.collect_list("k")).alias("ks"))
            found = lists.join(F.broadcast(wanted), (F.col("i") == F.col("wi")) & (F.col("p") == F.col("wp")))
            values |= {(r.i, r.rank): from_bits(r.k) for r in found.select("i", "rank", F.get("ks", F.col("place").cast("int")).alias("k")).collect()}
            break
        tally = counts.groupBy("i", parent.alias("p"), F.shiftright("k", shift).alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))
        tally = tally.withColumn("below", F.sum("n").over(Window.partitionBy("i", "p").orderBy("bits")) - F.col("n"))
        hit = (F.col("i") == F.col("wi")) & (F.col("p") == F.col("wp")) & (F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("n"))
        for r in tally.join(F.broadcast(wanted), hit).collect():
            if r.least == r.most:
                values[r.i, r.rank] = from_bits(r.least)
                del live[r.i, r.rank]
            else:
                live[r.i, r.rank] = (r.bits, r.place - r.below, r.n)

    def value(i: int, q: float) -> float | None:
        if not totals[i]:
            return None
        place = (totals[i] - 1) * q
        a, b = values[i, math.floor(place)], values[i, math.ceil(place)]
        return a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b

    return [[value(i, q) for q in qs] for i, (_, qs) in enumerate(asked)]


def fit(df: DataFrame, programs: dict[str, dict], types: dict[str, str], names: list[str] | None = None, split: str = "_split", accuracy: int | None = None, duplicates: str = "fail") -> Fitted:
    """Learn every fit operator's statistics from the rows whose ``split`` column is 'train' (all rows without that column).

    Equal subtrees of all programs are fitted once. Fit operators inside others are learned first, a wave for each level: all scalars of a
    wave in one aggregate and all category maps in one grouped aggregate, written to the shared folder. Quantiles are exact
    (``select_ranks``), or approximate with ``accuracy``; a wave that asks for exact ones writes the columns that it reads once, and all its
    aggregates read these.
    Equal deciles fail the feature (``duplicates='drop'`` merges them). Missing categories are the category ``nan``.
    """
    names = names or [c for c in df.columns if c != split]
    train = df.where(F.col(split) == "train") if split in df.columns else df
    fitted, graph = Fitted(), Graph(programs)
    fractions = {"Clip": [0.01, 0.99], "QuantileBucketize": [i / 10 for i in range(1, 10)]}
    Builder(graph, names, types, fitted).check()
    for wave in range(1, graph.waves + 1):
        build = Builder(graph, names, types, fitted)
        frame = build.share(with_maps(train, build, wave), [c for _, _, own in graph.fits(wave) for c in own], wave - 1)
        scalars, ordered, maps = [], [], []
        for name, node, own in graph.fits(wave):
            try:
                x = build.column(own[0])
                if node["op"] in ("FrequencyEncode", "TargetEncode"):
                    label = build.column(own[1]).cast("double") if own[1:] else F.lit(None).cast("double")
                    maps.append((name, F.struct(F.lit(name).alias("node"), C.token(x).alias("category"), label.alias("label"))))
                else:
                    x = x.cast("double")
                    if node["op"] in fractions and not accuracy:
                        ordered.append((name, node["op"], own[0], x))
                    else:
                        stat = {"ZScore": lambda x: F.array(F.avg(x), F.stddev_samp(x)), "MinMaxScale": lambda x: F.array(F.min(x), F.max(x))}
                        approximate = lambda x, op=node["op"]: F.percentile_approx(x, fractions[op], accuracy)
                        scalars.append((name, node["op"], stat.get(node["op"], approximate)(x)))
            except G.ProgramError as e:
                graph.drop(name, f"{e.code}: {e}")
        learned_rows, written = [], []
        if ordered:
            bits = {own: order_bits(x).alias(f"_bits_{own}") for _, _, own, x in ordered}
            beside = sorted({c for name in [n for n, *_ in scalars] + [n for n, _ in maps] for own in graph.nodes[name][1] for c in build.reads(own)})
            frame = staged(frame.select(*[F.col("`" + c.replace("`", "``") + "`") for c in beside], *bits.values()))
            written.append(frame)
        for low in range(0, len(scalars), BATCH):
            part = scalars[low : low + BATCH]
            row = frame.agg(*[s.alias(f"s{i}") for i, (*_, s) in enumerate(part)]).first()
            learned_rows += [(name, op, list(v) if v is not None else [None]) for (name, op, _), v in zip(part, row, strict=True)]
        if ordered:
            asked = {own: [q for _, op, x, _ in ordered if x == own for q in fractions[op]] for own in bits}
            found = select_ranks(frame, [(f"_bits_{own}", qs) for own, qs in asked.items()])
            values = {own: dict(zip(qs, v, strict=True)) for (own, qs), v in zip(asked.items(), found, strict=True)}
            for name, op, own, _ in ordered:
                known = values[own]
                learned_rows.append((name, op, [known[q] for q in fractions[op]]))
        for name, op, values in learned_rows:
            if op == "QuantileBucketize" and None not in values and len(set(values)) < len(values):
                if duplicates == "fail":
                    graph.drop(name, "EXECUTION_FAILED: equal deciles")
                values = sorted(set(values))
            fitted.scalars[name] = values
        if maps:
            long = frame.select(F.explode(F.array(*[s for _, s in maps])).alias("m")).select("m.*")
            learned = long.groupBy("node", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"))
            encoders = [name for name, _ in maps if graph.nodes[name][0]["op"] == "TargetEncode"]
            count = F.col("n").cast("double")
            value = F.when(F.col("node").isin(encoders), F.col("mean")).otherwise(count) if encoders else count
            learned = staged(learned.select("node", "category", "n", value.alias("value")), narrow=True)
            fitted.written.append(learned)
            for r in learned.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).collect():
                fitted.map_sizes[r.node] = (r.rows, r.total)
            fitted.maps = learned if fitted.maps is None else fitted.maps.unionByName(learned)
        unstage(*written)
    fitted.failed |= graph.failed
    return fitted


def with_maps(df: DataFrame, build: Builder, below: int | None = None) -> DataFrame:
    """Left-join the category maps of the encoders under level ``below``, innermost first.

    A map of many categories is joined by a shuffle. Its hot categories are looked up by a broadcast before, and rows that have their
    value by then are dealt evenly by a hash of the whole row, so that no task gets all rows of one category.
    """
    graph, fitted = build.graph, build.fitted
    for wave in range(1, below or graph.waves + 1):
        for name, node, inputs in graph.fits(wave):
            if node["op"] not in ("FrequencyEncode", "TargetEncode"):
                continue
            column, key = map_column(name), F.col(f"{map_column(name)}_key")
            if name not in fitted.map_sizes:
                df = df.withColumn(column, F.lit(None).cast("double"))
                continue
            own = fitted.maps.where(F.col("node") == name).select(F.col("category").alias(f"{column}_key"), F.col("value").alias(column), "n")
            token, (size, total) = C.token(build.column(inputs[0])), fitted.map_sizes[name]
            if size <= MAP_ROWS:
                df = df.join(F.broadcast(own.drop("n")), token == key, "left").drop(f"{column}_key")
                continue
            hot = F.col("n") * HOT >= total
            df = df.withColumn(f"{column}_token", token)
            first = own.where(hot).select(F.col(f"{column}_key").alias(f"{column}_hot_key"), F.col(column).alias(f"{column}_hot"))
            met = F.col(f"{column}_hot_key").isNotNull()
            df = df.join(F.broadcast(first), F.col(f"{column}_token") == F.col(f"{column}_hot_key"), "left")
            salt = F.pmod(F.xxhash64(*["`" + c.replace("`", "``") + "`" for c in df.columns]), F.lit(SALTS))
            cold = F.when(met, F.concat(F.lit("hot "), salt.cast("string"))).otherwise(F.concat(F.lit("cold "), F.col(f"{column}_token")))
            rest = own.where(~hot).select(F.concat(F.lit("cold "), key).alias(f"{column}_key"), column)
            df = df.withColumn(f"{column}_cold", cold).join(rest, F.col(f"{column}_cold") == key, "left")
            df = df.withColumn(column, F.when(met, F.col(f"{column}_hot")).otherwise(F.col(column)))
            df = df.drop(*[f"{column}_{x}" for x in ("key", "token", "hot_key", "hot", "cold")])
    return df


def apply(df: DataFrame, programs: dict[str, dict], types: dict[str, str], fitted: Fitted, keep: list[str], names: list[str] | None = None, split: str = "_split") -> DataFrame:
    """``keep`` and one column per program that didn't fail, over one scan; what several programs read is computed once.
    Works on streams too."""
    names = names or [c for c in df.columns if c != split]
    graph = Graph({f: p for f, p in programs.items() if f not in fitted.failed})
    build = Builder(graph, names, types, fitted)
    frame = build.share(with_maps(df, build), list(graph.roots.values()), graph.waves)
    return frame.select(*keep, *[build.column(root).alias(f) for f, root in graph.roots.items()])
