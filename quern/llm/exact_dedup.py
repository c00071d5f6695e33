"""Exact deduplication by a Golomb-coded exchange of fingerprints, with byte verification of the suspects."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, fresh, small, staged, unstage

#: Documents in a sender's block at most, and fingerprints that one owner compares.
BLOCK_ROWS = 1 << 22
#: Consecutive rows of a partition that go to the same block.
RUN_ROWS = 1 << 10
#: Fingerprint bits that are exchanged; more bits mean fewer false suspects, not other results.
BITS = 48


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Sorted distinct non-negative integers below ``span`` as (Rice parameter, bytes).

    Gaps are coded with the divisor 2**k nearest below the mean gap: all unary quotients, then all k-bit remainders.
    """
    if not len(values):
        return 0, b""
    k = max(0, int(math.log2(max(1, span // len(values)))))
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(k: int, n: int, data: bytes) -> np.ndarray:
    """The inverse of ``golomb_encode`` for ``n`` values."""
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits)[:n] + 1
    quotients = np.diff(ends, prepend=0) - 1
    rest = bits[ends[-1] : ends[-1] + n * k].reshape(n, k).astype(np.int64)
    gaps = (quotients << k) + rest @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def parts_of(marks: DataFrame, block_rows: int = BLOCK_ROWS) -> int:
    """How many blocks and owners there are: their product, the number of messages, grows with the cores or the rows, not with both."""
    return max(2 * marks.sparkSession.sparkContext.defaultParallelism, math.ceil(marks.count() / block_rows))


def suspects(marks: DataFrame, bits: int = BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """From (rid, fp) the rows (rid, fp) whose fingerprint another row has too.

    Rows form blocks by the partition that wrote them (the high bits of rid) and their place there, in runs of RUN_ROWS; there
    are at least two blocks and owners a core, and more so that none exceeds ``block_rows``. Each block sends every owner (a range
    of fingerprints) its sorted distinct fingerprints, Golomb-coded; one that the block itself has twice is
    suspect at once. The owner answers with a bitmap over what it was sent; the block reads off its suspects.
    Copies within a block are sent once, so an owner gets at most one entry a block of any group.
    """
    blocks = owners = parts_of(marks, block_rows)
    width = ((1 << bits) + owners - 1) // owners
    rows = marks.select("rid", "fp", F.pmod(F.shiftright("rid", 33) * 7 + F.floor(F.col("rid").bitwiseAND((1 << 33) - 1) / RUN_ROWS), F.lit(blocks)).alias("block"))

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(pdf.fp.to_numpy())
        cuts = np.searchsorted(own, np.arange(owners + 1, dtype=np.int64) * width)
        out = []
        for o in range(owners):
            part = own[cuts[o] : cuts[o + 1]] - o * width
            if len(part):
                k, data = golomb_encode(part, width)
                out.append((key[0], o, k, len(part), data))
        return pd.DataFrame(out, columns=["block", "owner", "k", "n", "data"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(k, n, d) for k, n, d in zip(pdf.k, pdf.n, pdf.data, strict=True)]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
        return pd.DataFrame({"block": pdf.block, "owner": pdf.owner, "n": pdf.n, "bitmap": maps})

    def apply(key: tuple, own: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        fps, first, counts = np.unique(own.fp.to_numpy(), return_inverse=True, return_counts=True)
        bad = counts > 1
        if len(maps):
            maps = maps.sort_values("owner")
            bits_ = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(maps.bitmap, maps.n, strict=True)]
            bad = bad | (np.concatenate(bits_) == 1)
        return own.loc[bad[first], ["rid", "fp"]]

    sent = rows.groupBy("block").applyInPandas(send, "block long, owner long, k int, n long, data binary")
    back = sent.groupBy("owner").applyInPandas(answer, "block long, owner long, n long, bitmap binary")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(apply, "rid long, fp long")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Of each group the smallest key stays (null keys come last;
    of several rows with that key, the first read). Null counts as the empty text; an empty table gives an empty
    result; other columns are not read. Fingerprints only nominate: the suspects' texts are shuffled and compared
    whole, combined map-side so that a large group sends one copy a task. Rows then find their group by sha256;
    that each sha256 stands for one text is part of the verification, and the job stops if it ever doesn't.
    """
    wide = docs.select(F.col(key).alias("doc_id"), normalised(F.col(text)).alias("body"))
    sha = F.sha2(F.col("body").cast("binary"), 256)
    fp = F.shiftrightunsigned(F.xxhash64("body"), 64 - bits)
    marks = staged(wide.select(F.monotonically_increasing_id().alias("rid"), "doc_id", sha.alias("text_sha256"), fp.alias("fp")))
    found = suspects(marks, bits, block_rows)
    hot = staged(found.select("fp").distinct())
    texts = wide.select(fp.alias("fp"), "body").join(small(hot), "fp", "left_semi")
    verified = texts.groupBy("fp", "body").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = staged(verified.select(sha.alias("text_sha256")).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts")))
    if classes.where("texts > 1").limit(1).count():
        raise ValueError("two different texts have the same sha256")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid")).alias("first")
    groups = staged(marks.join(small(classes.select("text_sha256")), "text_sha256", "left_semi").groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("size")))
    unstage(hot, classes)
    alone = F.col("first").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = alone | (F.col("rid") == F.col("first.rid"))
    return marks.join(small(groups), "text_sha256", "left").select("doc_id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(kept, F.lit(False)).alias("kept"), "text_sha256")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The dropped keys are anti-joined (broadcast behind a check of their number), so texts aren't shuffled; rows
    that repeat key and text are made one, and only these are shuffled for it, if there are any.
    """
    found = staged(deduplicate(docs, key, text).where("not kept").select("doc_id", "keep_id", "text_sha256"))
    sha = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    p = fresh(docs.columns, ("own", "sha", "id"), "quern_")
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    named_ = lambda rows: small(staged(rows.select(F.col("doc_id").alias(f"{p}id"), F.col("text_sha256").alias(f"{p}sha")).distinct()))
    met = F.col(key).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}own") == F.col(f"{p}sha"))
    rest = docs.withColumn(f"{p}own", sha).join(named_(found.where(~again)), met, "left_anti")
    if found.where(again).limit(1).count():
        repeated = named_(found.where(again))
        once = rest.join(repeated, met, "left_semi").dropDuplicates([key, f"{p}own"])
        rest = rest.join(repeated, met, "left_anti").unionByName(once)
    return rest.drop(f"{p}own")
