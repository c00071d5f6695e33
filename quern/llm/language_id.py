"""Language identification by compression: one zstandard raw-content dictionary per language."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, named, staged, with_fields
from quern.llm.hashing import slices, text_bytes
from quern.operators.features import exact_quantiles

#: The bounded sample: at most so many documents and bytes of text per language.
SAMPLE_DOCS, SAMPLE_BYTES = 96, 64 * 1024
#: Lazy matching from 4 bytes on: shorter matches than the fast levels take, which is where languages differ.
SETTINGS = {"window_log": 20, "chain_log": 17, "hash_log": 17, "search_log": 3, "min_match": 4, "target_length": 32}
UNDETERMINED = "und"
#: Columns that ``classify`` adds, after its prefix, and text that becomes Python strings at once.
ADDED, SLICE_BYTES = ("pred", "score", "margin", "accepted"), 16 << 20
#: Columns that ``measured`` adds, after its prefix, and their types.
MEASURED = {"pred": "string", "score": "double", "margin": "long", "frame": "long", "taught": "boolean"}
#: What stands behind every text when it is compressed: alone, short texts would be stored raw, in frames of one size.
PAD = b"\0" * 256
#: ``fit_margin`` gives half of this quantile of the labelled texts told right.
FIT_QUANTILE = 0.005
#: Parts of a language's hashes that are ranked by themselves, before the heads of all parts are.
RANK_PARTS = 64


def draw(labelled: DataFrame, text: str, lang: str, docs: int, size: int, lengths: tuple[int, int] | None = None, most: int | None = None) -> list:
    """Per language the ``docs`` different texts (lang, r, text) of smallest hash, those of the given lengths first; lower-cased, ``size`` characters,
    and no more of them than it takes to reach ``most`` bytes.

    Texts that are equal in lower case are one. Only their hashes are made distinct and ranked, by parts first, so that no
    task sees a whole language; the texts of the chosen hashes are read in a second scan, one of each.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    low = F.lower(F.col(text))
    fit = F.length(text).between(*lengths) if lengths else F.lit(True)
    usable = usable.select(F.col(lang).alias("lang"), low.alias("text"), F.xxhash64(low).alias("h"), fit.alias("fit"))
    sized = F.octet_length(F.substring("text", 1, size)).cast("long")
    distinct = usable.groupBy("lang", "h").agg(F.max("fit").alias("fit"), F.max(sized).alias("bytes")).withColumn("part", F.pmod("h", F.lit(RANK_PARTS)))
    order = (F.col("fit").desc(), "h")
    heads = distinct.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= docs)
    chosen = heads.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= docs)
    if most is not None:
        chosen = chosen.withColumn("before", F.sum("bytes").over(Window.partitionBy("lang").orderBy("r")) - F.col("bytes")).where(F.col("before") < most)
    rows = usable.select("lang", "h", F.substring("text", 1, size).alias("text")).join(F.broadcast(chosen.select("lang", "h", "r")), ["lang", "h"])
    return rows.groupBy("lang", "r").agg(F.min("text").alias("text")).collect()  # at most docs * languages rows


def dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Per language the lower-cased text of a bounded sample: the ``docs`` different texts of smallest hash.

    Documents of 200 to 2,000 characters come first, so that many documents fit; ``size`` bytes are kept.
    Rows without text or language teach nothing. Copies are made one before the rank, so that a large group takes one
    place; what is shuffled for it is hashes, and the rank filter is applied before the window's shuffle too (Spark's window group limit).
    """
    out: dict[str, bytes] = {}
    for row in sorted(draw(labelled, text, lang, docs, size, lengths=(200, 2000), most=size), key=lambda x: (x.lang, -x.r)):
        out[row.lang] = (out.get(row.lang, b"") + row.text.encode() + b"\n")[-size:]
    return out


def frame_sizes(learned: dict[str, bytes]) -> Callable[[bytes], np.ndarray]:
    """A function from a text's lower-cased bytes to its frame size by each language in order; with one language also by none."""
    import zstandard

    coders, settings = [], zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, **SETTINGS)
    for name in sorted(learned):
        content = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=settings)
        coders.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=content))
    if len(learned) == 1:
        coders.append(zstandard.ZstdCompressor(compression_params=settings))

    def sizes(raw: bytes) -> np.ndarray:
        return np.array([len(c.compress(raw + PAD)) for c in coders])

    return sizes


def told(gap: Column, size: Column, margin: float) -> Column:
    """Whether a language is told: its frame is smaller than all others', by ``margin`` times the root of its size at least.

    Frames of a text in no learned language differ by chance matches, whose number's spread grows as the root of the frame.
    """
    return (gap > 0) & (gap >= F.lit(margin) * F.sqrt(size))


def fit_margin(labelled: DataFrame, learned: dict[str, bytes], text: str = "text", lang: str = "lang") -> float:
    """Half of the margin (see ``told``) that all but FIT_QUANTILE of the labelled texts reach that ``learned`` tells right.

    From every labelled row's whole text that isn't in the dictionaries; texts that are equal in lower case are one. 0 without such texts.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    return reached(measured(rows, learned, lang="lang").withColumn("h", F.xxhash64(F.lower("text")))) if learned else 0.0


def reached(rows: DataFrame, prefix: str = "lang_", lang: str = "lang", h: str = "h") -> float:
    """``fit_margin`` of rows that are ``measured``; ``h`` is the hash of the lower-cased text. The quantile is exact: only hashes and margins are shuffled."""
    gap, frame = F.col(f"{prefix}margin"), F.col(f"{prefix}frame")
    right = rows.where((F.col(lang) == F.col(f"{prefix}pred")) & (gap > 0) & ~F.col(f"{prefix}taught"))
    texts = right.groupBy(lang, h).agg(F.min(gap / F.sqrt(frame)).alias("m"))
    found = exact_quantiles(texts, [(F.col("m"), [FIT_QUANTILE])])[0][0]
    return found / 2 if found is not None else 0.0


def measured(docs: DataFrame, learned: dict[str, bytes], text: str = "text", prefix: str = "lang_", lang: str | None = None) -> DataFrame:
    """Add lang_pred, lang_score, lang_margin and lang_frame (bytes of the smallest frame), see ``classify``, and lang_taught: whether the
    text stands in the dictionary of its ``lang`` (false without that column)."""
    new = [f"{prefix}{c}" for c in MEASURED]
    kept = [c for c in docs.columns if c not in new]
    names = sorted(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = frame_sizes(learned)
        for batch in (whole.slice(low, high - low) for whole in batches for low, high in slices(np.diff(text_bytes(whole.column(kept.index(text)))[1]), SLICE_BYTES)):
            texts = pc.fill_null(batch.column(kept.index(text)), "")
            letters = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
            given = batch.column(kept.index(lang)).to_pylist() if lang else [None] * len(batch)
            out: list[tuple] = []
            for t, has, own in zip(texts.to_pylist(), letters, given, strict=True):
                if not has or not names:
                    out.append((UNDETERMINED, 0.0, 0, 0, False))
                    continue
                raw = t.lower().encode()
                sizes = frames(raw)
                best = int(sizes[: len(names)].argmin())
                rest = np.delete(sizes, best)
                score = float(1.0 / np.exp(-(sizes - sizes[best]) / 8.0).sum().clip(1.0))
                out.append((names[best], score, int(max(rest.min() - sizes[best], 0)), int(sizes[best]), raw in learned.get(own, b"")))
            columns = zip(*out, strict=True) if out else [[]] * len(MEASURED)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=[*kept, *new])

    rows = docs.select(*named(kept))
    return rows.mapInArrow(run, with_fields(rows, **dict(zip(new, MEASURED.values(), strict=True))))


def classify(docs: DataFrame, learned: dict[str, bytes], text: str = "text", margin: float = 0.0, prefix: str = "lang_") -> DataFrame:
    """Add lang_pred, lang_score, lang_margin (bytes between the best two) and lang_accepted.

    The whole lower-cased text is compressed once per language; the smallest frame wins, the first language
    in order on ties. Texts that are null or have no letter are ``und`` with score 0 and are rejected, as are
    those that aren't ``told`` by ``margin`` (see ``fit_margin``). With one language learned the
    margin is that to no dictionary; with none all is ``und``. lang_score is the softmax of minus the frame sizes, 8 bytes to the unit.
    Columns of these names in the input are replaced; another ``prefix`` gives other names.
    """
    kept = [c for c in docs.columns if c not in {f"{prefix}{x}" for x in ADDED}]
    own = fresh(kept, MEASURED, prefix)
    rows = measured(docs.select(*named(kept)), learned, text, own)
    added = {c: F.col(f"{own}{c}") for c in ADDED[:-1]} | {ADDED[-1]: told(F.col(f"{own}margin"), F.col(f"{own}frame"), margin)}
    return rows.select(*named(kept), *[x.alias(f"{prefix}{c}") for c, x in added.items()])


def fitted(docs: DataFrame, learned: dict[str, bytes], text: str = "text", lang: str = "lang", train: Column | None = None, prefix: str = "lang_", keep: list[str] | None = None) -> tuple[DataFrame, float]:
    """The rows of ``docs`` (their columns ``keep``, all by default) as ``measured``, written, and the margin that ``fit_margin`` gives for
    those where ``train`` holds (null: all): one compression of each text serves both."""
    keep = docs.columns if keep is None else keep
    own = fresh(docs.columns, ("of", "h"), prefix)
    there = F.lit(True) if train is None else train
    rows = docs.withColumn(f"{own}of", F.when(there, F.col(lang).cast("string")))
    rows = measured(rows, learned, text, prefix, f"{own}of").withColumn(f"{own}h", F.xxhash64(F.lower(F.col(text))))
    rows = staged(rows.select(*named([*keep, *(f"{prefix}{c}" for c in MEASURED), f"{own}of", f"{own}h"])))
    return rows, reached(rows, prefix, f"{own}of", f"{own}h") if learned else 0.0


def accepted(docs: DataFrame, learned: dict[str, bytes], text: str = "text", margin: float = 0.0, fit: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with their columns whatever their names are.

    ``fit``: the column of languages that the margin is fitted to, on all rows that have one (see ``fit_margin``), in place of ``margin``.
    """
    prefix = fresh(docs.columns, (*ADDED, *MEASURED), "lang_")
    if fit is None:
        rows = measured(docs, learned, text, prefix)
    else:
        rows, margin = fitted(docs, learned, text, fit, prefix=prefix)
    return rows.where(told(F.col(f"{prefix}margin"), F.col(f"{prefix}frame"), margin)).select(*named(docs.columns))
