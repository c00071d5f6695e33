"""Gains of candidate features from data: linear models by fold-wise sufficient statistics, and forward acceptance.

A tier compares a model with a candidate and the model without it on rows that neither was fitted on. For linear models both come
from sums of products, so the rows are read once for all candidates and folds, and nothing is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import audit, selection, splits
from quern.sources.scratch import staged, unstage

#: Sums in one aggregate at most.
BATCH = 400
#: A column adds nothing when so small a part of its square is left by the columns before it.
TOLERANCE = 1e-9
#: Classes at most; each is a target of its own.
CLASSES = 100
#: Digits of a key's hash.
HASH_DIGITS = 32
#: Similarities that differ by less are equal: the last digits of sums over all rows hang on their order.
EQUAL = 1e-9


def clean(c: str) -> Column:
    """A model's input: missing, NaN and infinite numbers are -1."""
    x = F.col("`" + c.replace("`", "``") + "`").cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), -1.0).otherwise(x)


def nth_hash(hashes: DataFrame, n: int) -> str:
    """The ``n``-th smallest (0..) of the hexadecimal hashes ``h``: they are counted by three digits at a time, and only the last few are sorted."""
    begun = ""
    while True:
        own = hashes.where(F.col("h").startswith(begun))
        for r in sorted(own.groupBy(F.substring("h", len(begun) + 1, 3).alias("digits")).count().collect()):
            if n < r[1]:
                break
            n -= r[1]
        begun += r.digits
        if len(begun) >= HASH_DIGITS:
            return begun
        if r[1] <= BATCH:
            return sorted(r.h for r in own.where(F.col("h").startswith(begun)).collect())[n]


def sampled(matrix: DataFrame, key: str, n: int | None = 2000, seed: int = 42) -> DataFrame:
    """Add ``mini``: 'train' for the first 80 % of the ``n`` train rows of smallest key hash (None: of all train rows), 'eval' for the rest of them, else null."""
    h = splits.rank_key(F.col(key), seed)
    train = matrix.where("_split = 'train'").select(h.alias("h"))
    least = [r.h for r in train.orderBy("h").limit(n).collect()] if n is not None else []
    size = len(least) if n is not None else train.count()
    if not size:
        return matrix.withColumn("mini", F.lit(None).cast("string"))
    last = max(int(size * 0.8) - 1, 0)
    if n is None:
        mini = F.when(h <= nth_hash(train, last), "train").otherwise("eval")
    else:
        mini = F.when(h <= least[last], "train").when(h <= least[-1], "eval")
    return matrix.withColumn("mini", F.when(F.col("_split") == "train", mini))


class Pool:
    """Columns (a 1, then the base's, then the candidates') and targets over cells of rows, with the sums of products asked for so far.

    A cell is a (split, fold, mini) of rows; the rows of any fit or test are a union of cells. Columns are centred and scaled by
    the train rows, which changes no score and keeps the sums accurate. They are written once, as every aggregate reads them; ``close`` deletes that table.
    """

    def __init__(self, matrix: DataFrame, label: str, base: list[str], candidates: list[str], task: str):
        self.names = [None, *base, *candidates]
        self.first = 1 + len(base)
        columns = {f"v{i}": clean(c) if c else F.lit(1.0) for i, c in enumerate(self.names)}
        y = F.col("`" + label.replace("`", "``") + "`")
        if task == "C":
            classes = sorted(r[0] for r in matrix.where(y.isNotNull()).select(y).distinct().limit(CLASSES + 1).collect())
            if len(classes) > CLASSES:
                raise ValueError(f"more than {CLASSES} classes")
            targets = {f"y{i}": (y == F.lit(c)).cast("double") for i, c in enumerate(classes)}
        else:
            targets = {"y0": y.cast("double")}
        self.targets = list(targets)
        own = matrix.where(y.isNotNull() & F.col("_split").isin("train", "val")).select("_split", "fold", "mini", *[c.alias(n) for n, c in {**columns, **targets}.items()])
        all_ = [*columns, *targets]
        scale = {"v0": (0.0, 1.0)}
        for low in range(1, len(all_), BATCH):
            part = all_[low : low + BATCH]
            row = own.where("_split = 'train'").agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in part]).first()
            scale |= {c: (row[c][0] or 0.0, 1.0 if task == "C" and c in targets else row[c][1] or 1.0) for c in part}
        self.rows = staged(own.select("_split", "fold", "mini", *[((F.col(c) - m) / s).alias(c) for c, (m, s) in scale.items()]))
        d = len(columns)
        pairs = [(f"v{j}", f"v{j}") for j in range(d)] + [(f"v{j}", t) for j in range(d) for t in self.targets] + [(t, t) for t in self.targets]
        sums = self.sums(pairs)
        k = len(self.targets)
        self.cells = {c: (v[:d], v[d : d + d * k].reshape(d, k), v[d + d * k :]) for c, v in sums.items()}
        self.crossed: dict[int, dict] = {}

    def close(self) -> None:
        unstage(self.rows)

    def sums(self, pairs: list[tuple[str, str]]) -> dict[tuple, np.ndarray]:
        """The sum of each product in each cell, in one grouped aggregate for every ``BATCH`` of them."""
        out: dict[tuple, list] = {}
        for low in range(0, len(pairs), BATCH):
            row = self.rows.groupBy("_split", "fold", "mini").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs[low : low + BATCH])])
            for r in row.collect():
                out.setdefault(tuple(r[:3]), []).extend(r[3:])
        return {c: np.array(v, float) for c, v in out.items()}

    def cross(self, columns: list[int]) -> None:
        """Learn these columns' products with all columns."""
        d = len(self.names)
        asked = [j for j in columns if j not in self.crossed]
        found = self.sums([(f"v{j}", f"v{i}") for j in asked for i in range(d)]) if asked else {}
        for n, j in enumerate(asked):
            self.crossed[j] = {c: v[n * d : (n + 1) * d] for c, v in found.items()}

    def over(self, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, k = len(self.names), len(self.targets)
        zero = [np.zeros(d), np.zeros((d, k)), np.zeros(k)]
        return tuple(sum((v[i] for c, v in self.cells.items() if wanted(*c)), zero[i]) for i in range(3))

    def row(self, j: int, wanted) -> np.ndarray:
        return sum((v for c, v in self.crossed[j].items() if wanted(*c)), np.zeros(len(self.names)))


@dataclass
class Elimination:
    """A least-squares model on some rows, scored on others, by a Cholesky factor that grows by a row for each column taken in.

    ``left``: what the columns taken leave of each column's square, ``due``: of its products with the targets. So a further
    column's coefficient is due / left, and its score costs one triangular solve for the others'.
    """

    pool: Pool
    train: object
    other: object

    def __post_init__(self):
        self.squares, due, _ = self.pool.over(self.train)
        self.left, self.due = self.squares.copy(), due.copy()
        self.test = self.pool.over(self.other)
        d, k = due.shape
        self.used: list[int] = []
        self.factor, self.against, self.solved, self.seen = np.zeros((0, 0)), np.zeros((0, d)), np.zeros((0, k)), np.zeros((0, d))

    def open(self, j: int) -> bool:
        return self.left[j] > TOLERANCE * max(self.squares[j], 1e-300)

    def take(self, j: int) -> None:
        """One more column; one that the others make up leaves the model as it is."""
        if not self.open(j):
            return
        root = np.sqrt(self.left[j])
        lead = self.against[:, j]
        against = (self.pool.row(j, self.train) - lead @ self.against) / root
        solved = self.due[j] / root
        m = len(self.used)
        self.factor = np.block([[self.factor, np.zeros((m, 1))], [lead[None, :], np.array([[root]])]])
        self.against, self.solved = np.vstack([self.against, against]), np.vstack([self.solved, solved])
        self.left, self.due = self.left - against**2, self.due - np.outer(against, solved)
        self.seen = np.vstack([self.seen, self.pool.row(j, self.other)])
        self.used.append(j)

    def _score(self, sse: np.ndarray) -> np.ndarray:
        """1 - SSE / SST over all targets; NaN without rows to score on or without spread."""
        squares, products, own = self.test
        sst = (own - products[0] ** 2 / squares[0]).sum() if squares[0] else 0.0
        return 1 - sse / sst if sst > 0 else sse * np.nan

    def base(self) -> float:
        squares, products, own = self.test
        b = np.linalg.solve(self.factor.T, self.solved) if self.used else np.zeros((0, len(own)))
        among = self.seen[:, self.used]
        return float(self._score((own - 2 * (b * products[self.used]).sum(0) + (b * (among @ b)).sum(0)).sum()))

    def with_each(self) -> np.ndarray:
        """The score with each column of the pool besides."""
        squares, products, own = self.test
        free = self.left > TOLERANCE * np.maximum(self.squares, 1e-300)
        b = np.linalg.solve(self.factor.T, self.solved) if self.used else np.zeros((0, len(own)))
        shift = np.linalg.solve(self.factor.T, self.against) if self.used else np.zeros((0, len(self.left)))
        among, sse = self.seen[:, self.used], np.zeros(len(self.left))
        for t in range(len(own)):
            w = np.where(free, self.due[:, t] / np.where(free, self.left, 1.0), 0.0)
            each = b[:, t : t + 1] - shift * w
            sse += own[t] - 2 * (each * products[self.used, t][:, None]).sum(0) - 2 * w * products[:, t] + (each * (among @ each)).sum(0) + 2 * w * (each * self.seen).sum(0) + w * w * squares
        return self._score(sse)


def eliminations(pool: Pool, folds: int, sample: bool) -> dict[str, Elimination]:
    """The models of the tiers: '2' on the small sample, '3' train against val, '4.k' all rows but fold k against it."""
    out = {"3": Elimination(pool, lambda s, f, m: s == "train", lambda s, f, m: s == "val")}
    if sample:
        out["2"] = Elimination(pool, lambda s, f, m: m == "train", lambda s, f, m: m == "eval")
    for k in range(folds):
        out[f"4.{k}"] = Elimination(pool, lambda s, f, m, k=k: f != k, lambda s, f, m, k=k: f == k)
    pool.cross(list(range(pool.first)))
    for e in out.values():
        for j in range(pool.first):
            e.take(j)
    return out


def dealt(matrix: DataFrame, key: str, label: str, task: str, folds: int, seed: int = 42) -> DataFrame:
    """Add ``fold``: even in each class for classes, by hash for numbers; the train and val rows are dealt together."""
    rows = matrix.where(F.col("_split").isin("train", "val"))
    return splits.stratified_k_fold(rows, key, label, folds, seed) if task == "C" else splits.k_fold(rows, key, folds, seed)


def gain(new: float, old: float) -> float | None:
    out = (new - old) / max(abs(old), 1e-9)
    return None if np.isnan(out) else float(out)


def candidate_gains(matrix: DataFrame, key: str, label: str, base: list[str], candidates: list[str], task: str = "R", folds: int = 5, sample: int = 2000, seed: int = 42) -> DataFrame:
    """(feature_id, base_score, score, delta2, delta3, deltas4): each candidate's gain over the ``base`` columns alone.

    ``matrix`` has _split, the key, the label and the columns. delta2 is on the small sample of train rows, delta3 train against val, deltas4 over folds of both,
    each relative to the score without the candidate. A score is R squared; classes (task C) are a 0/1 target each, with their squares added up.
    Missing numbers are -1. A gain that can't be computed is null. What comes to the driver are sums: some for each column and cell, whatever the rows.
    """
    rows = sampled(dealt(matrix, key, label, task, folds, seed), key, sample, seed)
    pool = Pool(rows, label, base, candidates, task)
    models = eliminations(pool, folds, True)
    pool.close()
    old, new = {n: e.base() for n, e in models.items()}, {n: e.with_each() for n, e in models.items()}
    number = lambda x: None if np.isnan(x) else float(x)
    out = []
    for j, c in enumerate(candidates, pool.first):
        out.append((c, number(old["3"]), number(new["3"][j]), gain(new["2"][j], old["2"]), gain(new["3"][j], old["3"]), [gain(new[f"4.{k}"][j], old[f"4.{k}"]) for k in range(folds)]))
    return matrix.sparkSession.createDataFrame(out, "feature_id string, base_score double, score double, delta2 double, delta3 double, deltas4 array<double>")


def forward(matrix: DataFrame, key: str, label: str, base: list[str], candidates: list[tuple[int, str, str]], task: str = "R", epsilon: float = 0.01, tier2: bool = False, tier4: bool = False, threshold: float = 0.92, patience: int = 5, most_accepted: int = 30, most_rounds: int = 50, folds: int = 5, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Accept candidates one after another; a row for each that was looked at, in order.

    ``candidates``: (round, column, program hash) in their order; their rounds don't fall. Each is judged against the features accepted before it: first
    its redundancy with them (rank correlation over all train rows, or an equal hash), then the tiers in order, up to the first that fails.
    Tier 2 fits on four fifths of the train rows and is scored on the others; ``sample`` takes that many train rows for it instead of all.
    An accepted one is taken into all models by one row of their factors; that needs its products with the other columns, one
    aggregate over the matrix. After a round the run ends by its patience, by enough accepted features or by the budget of rounds.

    Columns: seq, round, feature_id, status, rejection_reason, redundancy_max, redundancy_argmax, tier, delta_mean, delta_std, base_score (before it).
    ``matrix`` should be a written table, as it is read several times.
    """
    spark = matrix.sparkSession
    names = [c for _, c, _ in candidates]
    rows = sampled(dealt(matrix, key, label, task, folds if tier4 else 1, seed), key, sample, seed)
    pool = Pool(rows, label, base, names, task)
    models = eliminations(pool, folds if tier4 else 0, tier2)
    train = matrix.where("_split = 'train'")
    first = {r.feature_id: r.reason for r in selection.profile(train, names).collect()}
    accepted: list[tuple[str, str]] = []
    similar: dict[str, tuple[float, str]] = dict.fromkeys(names, (0.0, ""))
    out, idle, place = [], 0, 0
    order = sorted({r for r, _, _ in candidates})
    for n, round_ in enumerate(order[:most_rounds]):
        took = False
        for _, name, code in [c for c in candidates if c[0] == round_]:
            sim, twin = similar[name]
            for fid, own in accepted:
                if own == code and sim < 1.0:
                    sim, twin = 1.0, fid
            old, tier, mean, spread, reason = models["3"].base(), "", 0.0, 0.0, ""
            j = pool.first + names.index(name)
            if sim >= threshold:
                reason = "POST_EVAL_REDUNDANT"
            elif first[name]:
                tier, reason = "tier1", first[name]
            if not reason and tier2:
                tier, mean = "tier2", gain(models["2"].with_each()[j], models["2"].base())
                reason = "" if mean is not None and mean >= 0.3 * epsilon else "TIER2_NO_SIGNAL"
            if not reason:
                tier, mean = "tier3", gain(models["3"].with_each()[j], old)
                reason = "" if mean is not None and mean >= epsilon else "TIER3_SINGLE_FAIL"
            if not reason and tier4:
                each = [gain(models[f"4.{k}"].with_each()[j], models[f"4.{k}"].base()) for k in range(folds)]
                whole = None not in each
                tier, mean, spread = "tier4", float(np.mean(each)) if whole else None, float(np.std(each)) if whole else None
                reason = "" if whole and mean >= epsilon else "TIER4_LOW_GAIN"
            status = "accepted" if not reason else "rejected_redundant" if reason == "POST_EVAL_REDUNDANT" else "rejected_gain"
            out.append((place, round_, name, status, reason, sim, twin, tier, mean, spread, old))
            place += 1
            if not reason:
                took = True
                accepted.append((name, code))
                pool.cross([j])
                for e in models.values():
                    e.take(j)
                rest = [c for c in names[names.index(name) + 1 :] if c != name and similar[c][0] < 1 - EQUAL]  # nothing is closer than 1
                if rest:
                    for r in selection.rank_correlation(train, key, [(c, name) for c in rest], sample=None).collect():
                        if r.value_sim > similar[r.candidate][0] + EQUAL:
                            similar[r.candidate] = (r.value_sim, name)
        idle = 0 if took else idle + 1
        if idle >= patience or len(accepted) >= most_accepted:
            break
    pool.close()
    kinds = "seq int, round int, feature_id string, status string, rejection_reason string, redundancy_max double, redundancy_argmax string, tier string, delta_mean double, delta_std double, base_score double"
    return spark.createDataFrame(out, kinds)


def refused(gains: DataFrame, profiles: DataFrame, redundancy: DataFrame, epsilon: float = 0.01, tier2: bool = False, tier4: bool = False) -> DataFrame:
    """The funnel's status and reason of each candidate from its gains, its profile and its redundancy with what is accepted already
    (a candidate that ``redundancy`` has no row of has 0)."""
    told = gains.join(profiles.select("feature_id", F.col("reason").alias("tier1_reason")), "feature_id")
    told = told.join(redundancy.select(F.col("candidate").alias("feature_id"), "redundancy_max"), "feature_id", "left").withColumn("redundancy_max", F.coalesce("redundancy_max", F.lit(0.0)))
    none = {c: F.lit(None).cast("string") for c in ("compile_error", "cert_code", "execution_error")}
    return audit.funnel(audit.tier_gates(told.withColumns(none), epsilon, tier2, tier4))
