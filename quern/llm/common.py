"""Helpers that several operators share: shared-folder tables and checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.sources.scratch import shared_folder, staged, unstage

__all__ = ["BROADCAST_ROWS", "SPACE", "crc_bucket", "fresh", "named", "shared_folder", "small", "staged", "unstage", "with_fields", "word_count"]

#: ``[\x20\x09-\x0D]`` as a Java character class.
SPACE = r"[ \t-\r]"
#: A side of a join is broadcast only if it has at most so many rows, and takes about so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Bytes that a row takes in a broadcast table besides its values, and that a column of fixed width takes.
ROW_BYTES, FIXED_BYTES = 32, 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes of values, hash table included;
    else unchanged (a shuffled join then).

    ``df`` should be a staged table, as its rows are read here.
    """
    lengths = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    lengths += [F.octet_length(F.to_json(F.struct(c))) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    width = sum((F.coalesce(x, F.lit(0)) for x in lengths), F.lit(ROW_BYTES + FIXED_BYTES * (len(df.columns) - len(lengths)))).cast("long")
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of a column's text modulo ``n`` (null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of maximal runs of ``[^\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long"), F.lit(0).cast("long"))


def with_fields(df: DataFrame, **types: str) -> StructType:
    """The schema of ``df`` with more fields at its end (``StructType.add`` would change the frame's own)."""
    return StructType([*df.schema.fields, *(f for name, kind in types.items() for f in StructType.fromDDL(f"`{name}` {kind}").fields)])


def named(names: Iterable[str]) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(columns: list[str], names: Iterable[str], prefix: str) -> str:
    """``prefix`` with as many underscores before it as it takes that none of prefix + name is among the columns."""
    taken = {c.lower() for c in columns}
    while any(f"{prefix}{n}".lower() in taken for n in names):
        prefix = f"_{prefix}"
    return prefix
