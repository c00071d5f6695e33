"""Ranked lexical search with Block-Max MaxScore over an inverted index in shards."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import staged, unstage
from quern.llm.hashing import U, slices, text_bytes, word_hashes

#: Terms a shard of the index holds (one very long text may be more), and postings a block of a list holds.
SHARD_TERMS, BLOCK = 1_000_000, 64
#: Queries that one pass over the index answers, and the bytes of their texts.
PASS_QUERIES, PASS_BYTES = 2_000, 4 << 20
#: Bytes ``[0-9A-Za-z\x80-\xFF]``, of which terms are made.
IS_TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
SHARD = "ids array<long>, lengths binary, terms binary, counts binary, firsts binary, lasts binary, widths binary, payload binary, n_docs long, n_terms long"


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of term bytes, A-Z lower-cased, and each text's first term's place."""
    raw, at = text_bytes(texts)
    data = np.where(IS_TERM[raw], raw, 32).astype(np.uint8)
    return word_hashes(pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)))


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts[i]`` places of each i: i, and the place within."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def byte_width(most: np.ndarray) -> np.ndarray:
    return 1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)


def pack(out: np.ndarray, at: np.ndarray, width: np.ndarray, values: np.ndarray) -> None:
    for k in range(int(width.max(initial=0))):
        wide = width > k
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 0xFF


def unpack(raw: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(int(width.max(initial=0))):
        wide = width > k
        out[wide] |= raw[at[wide] + k].astype(np.int64) << (8 * k)
    return out


def shard(ids: pa.Array, hashes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> dict:
    """An inverted index of some texts: sorted terms, a list of (text, frequency) for each, in blocks of byte-packed gaps."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(hashes, kind="stable")
    term, text = hashes[order], text[order]
    new = starts(term, text) if len(term) else np.zeros(0, np.int64)
    frequency = np.diff(np.append(new, len(term)))
    term, text = term[new], text[new]
    lists = starts(term) if len(term) else np.zeros(0, np.int64)
    counts = np.diff(np.append(lists, len(term)))
    _, within = spread(counts)
    opens = np.flatnonzero(within % block == 0)
    sizes = np.diff(np.append(opens, len(term)))
    gaps = np.diff(text, prepend=0)
    gaps[opens] = 0
    wide = [byte_width(np.maximum.reduceat(v, opens)) if len(opens) else np.zeros(0, np.int64) for v in (gaps, frequency)]
    which, place = spread(sizes)
    offset = np.cumsum(sizes * (wide[0] + wide[1])) - sizes * (wide[0] + wide[1])
    payload = np.zeros(int((sizes * (wide[0] + wide[1])).sum()), np.uint8)
    pack(payload, offset[which] + place * wide[0][which], wide[0][which], gaps)
    pack(payload, (offset + sizes * wide[0])[which] + place * wide[1][which], wide[1][which], frequency)
    small = lambda v: v.astype(np.uint32).tobytes()
    return {
        "ids": ids, "lengths": small(lengths), "terms": term[lists].tobytes(), "counts": small(counts), "firsts": small(text[opens]), "lasts": small(text[opens + sizes - 1]),
        "widths": (wide[0] | wide[1] << 4).astype(np.uint8).tobytes(), "payload": payload.tobytes(), "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
    }


class Shard:
    """A shard as it was written; blocks are decompressed when asked for."""

    def __init__(self, row: dict, corpus: tuple[int, int], block: int = BLOCK):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        ids = row["ids"]
        self.null = np.array([i is None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.terms, self.payload = read("terms", U), read("payload", np.uint8)
        counts, self.firsts, self.lasts = (read(name, np.uint32).astype(np.int64) for name in ("counts", "firsts", "lasts"))
        widths = read("widths", np.uint8)
        self.wide = (widths & 15).astype(np.int64), (widths >> 4).astype(np.int64)
        blocks = -(-counts // block)
        self.pointers = np.concatenate([[0], np.cumsum(blocks)])
        owner, within = spread(blocks)
        self.sizes = np.minimum(counts[owner] - within * block, block)
        each = self.sizes * (self.wide[0] + self.wide[1])
        self.offset = np.cumsum(each) - each
        self.maxima = read("maxima", np.uint32).astype(np.int64) if "maxima" in row else None
        docs, terms = corpus
        lengths = read("lengths", np.uint32).astype(np.int64)
        if 75 * docs * int(lengths.max(initial=0)) < 1 << 63:
            self.m = 25 + 75 * docs * lengths // max(terms, 1)
        else:
            self.m = np.array([25 + 75 * docs * n // max(terms, 1) for n in lengths.tolist()], np.int64)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The list of each term, -1 for none."""
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        return np.where(there, at, -1)

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decompress blocks: their texts, and the impact of the term in each."""
        sizes = self.sizes[blocks]
        which, place = spread(sizes)
        gap, tf = self.wide[0][blocks], self.wide[1][blocks]
        text = np.cumsum(unpack(self.payload, self.offset[blocks][which] + place * gap[which], gap[which]))
        text += np.repeat(self.firsts[blocks] - text[np.cumsum(sizes) - sizes], sizes)
        frequency = unpack(self.payload, (self.offset[blocks] + sizes * gap)[which] + place * tf[which], tf[which])
        return text, 1_000_000_000 * frequency // (1000 * frequency + 8 * self.m[text])


def index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_terms: int = SHARD_TERMS, block: int = BLOCK) -> DataFrame:
    """One row per shard of the inverted index of all whole texts; a task makes its shards from the rows it reads, without a shuffle.

    Terms are known by 64-bit hashes. Texts without terms, null or empty, are in no list. ``bounded`` adds the maxima.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            row = shard(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), block)
            row["ids"] = row["ids"].to_pylist()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for whole in batches:
            sizes = np.diff(text_bytes(whole.column(1))[1])
            for low, high in slices(sizes, 4 << 20):
                part = whole.slice(low, high - low)
                hashes, at = term_hashes(part.column(1))
                held.append((part.column(0), hashes, np.diff(at)))
                size += len(hashes)
                if size >= shard_terms:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    schema = pa.schema([("ids", pa.list_(pa.int64()))] + [(n, pa.binary()) for n in ("lengths", "terms", "counts", "firsts", "lasts", "widths", "payload")] + [("n_docs", pa.int64()), ("n_terms", pa.int64())])
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body")).mapInArrow(run, SHARD)


def bounded(shards: DataFrame, corpus: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """Add to each shard the largest impact in each block, which depends on the mean length of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                own = Shard(one.to_pylist()[0], corpus, block)
                impacts = own.read(np.arange(len(own.sizes)))[1]
                maxima = np.maximum.reduceat(impacts, np.cumsum(own.sizes) - own.sizes) if len(impacts) else impacts
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([maxima.astype(np.uint32).tobytes()])], names=[*one.schema.names, "maxima"])

    return shards.mapInArrow(run, f"{SHARD}, maxima binary")


def document_counts(shards: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many texts hold each of the given terms; reads the shards' dictionaries only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, counts = np.frombuffer(own, U), np.frombuffer(counts, np.uint32)
                at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
                if len(own):
                    total += np.where(own[at] == terms, counts[at], 0)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["term", "n"])

    rows = shards.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {int(terms[r.term]): r.n for r in rows}


class Best:
    """The k best texts of a query so far: highest scores first, equal ones by ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((3, 0), np.int64)

    @property
    def threshold(self) -> int:
        """A text needs this score at least (an equal one may win by its id)."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else 1

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, null.astype(np.int64), ids])], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]


def search_shard(own: Shard, lists: np.ndarray, weights: np.ndarray, best: Best, cache: dict) -> None:
    """Block-Max MaxScore of one query in one shard. ``lists``: the query's terms' lists in the shard, ``weights`` of each.

    Lists are read whole from the highest bound down, as long as what is left could lift a new text over the threshold
    (they are the essential ones; the threshold rises meanwhile). The others are asked for known candidates only: block
    maxima reject candidates first, and only blocks that still have one are decompressed.
    """
    top = np.array([own.maxima[own.pointers[i] : own.pointers[i + 1]].max() for i in lists]) * weights
    order = np.argsort(-top, kind="stable")
    lists, weights, top = lists[order], weights[order], top[order]
    rest = np.append(np.cumsum(top[::-1])[::-1], 0)
    least, score, j = best.threshold, np.zeros(len(own.m), np.int64), 0
    while j < len(lists) and rest[j] >= least:
        if (i := int(lists[j])) not in cache:
            cache[i] = own.read(np.arange(own.pointers[i], own.pointers[i + 1]))
        text, impact = cache[i]
        score[text] += weights[j] * impact
        j += 1
        if len(score) >= best.k:
            least = max(least, int(np.partition(score, -best.k)[-best.k]))
    candidates = np.flatnonzero(score)
    for i in range(j, len(lists)):
        candidates = candidates[score[candidates] + rest[i] >= least]
        if not len(candidates):
            return
        low, high = own.pointers[lists[i]], own.pointers[lists[i] + 1]
        block = low + np.searchsorted(own.lasts[low:high], candidates)
        inside = block < high
        inside[inside] = own.firsts[block[inside]] <= candidates[inside]
        bound = np.zeros(len(candidates), np.int64)
        bound[inside] = weights[i] * own.maxima[block[inside]]
        alive = score[candidates] + bound + rest[i + 1] >= least
        candidates, block = candidates[alive], block[alive & inside]
        if len(block):
            text, impact = own.read(np.unique(block))
            at = np.minimum(np.searchsorted(text, candidates), len(text) - 1)
            hit = text[at] == candidates
            score[candidates[hit]] += weights[i] * impact[at[hit]]
    candidates = candidates[score[candidates] >= least]
    best.add(score[candidates], own.null[candidates], own.ids[candidates])


def passes(queries: DataFrame, item: str, text: str, most: int, size: int) -> Iterator[list]:
    """The queries in lists of bounded size, one after another; equal rows are one query."""
    held, used = [], 0
    for row in queries.select(F.col(item).alias("item"), F.col(text).alias("body")).where("body is not null").distinct().toLocalIterator():
        held.append(row)
        used += len(row.body)
        if len(held) >= most or used >= size:
            yield held
            held, used = [], 0
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item: str = "item_id", query: str = "text", shard_terms: int = SHARD_TERMS, block: int = BLOCK, pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best texts of ``docs`` for each row of ``queries``, fewer if fewer score above 0.

    Each pass over the index answers a bounded block of queries: a task keeps the k best of its shards for each query, and the
    heaps of all tasks are merged by query. Null and empty texts and those without terms are found by nothing and count for nothing; a
    query without terms has no rows. Equal scores go by ascending id, null ids last; repeated rows are ranked one by one.
    Equal queries are one; different texts under one item id are ranked each by itself. Empty tables give no rows. Other columns
    don't matter. doc_id is a long.
    """
    spark = docs.sparkSession
    raw = staged(index(docs, text, doc_id, shard_terms, block))
    corpus = tuple(raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first())
    shards = staged(bounded(raw, corpus, block))
    unstage(raw)
    kind = dict(queries.dtypes)[item]
    heaps, number = None, 0
    for rows in passes(queries, item, query, pass_queries, PASS_BYTES):
        hashes, at = term_hashes(pa.array([r.body for r in rows], pa.string()))
        terms, own = np.unique(hashes, return_inverse=True)
        found = document_counts(shards, terms)
        idf = np.array([math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * found[t] + 1))) if t in found else 0 for t in terms.tolist()], np.int64)
        asked = [Counter(own[low:high].tolist()) for low, high in zip(at[:-1], at[1:], strict=True)]
        asked = [(np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for c in asked]

        def run(batches: Iterator[pa.RecordBatch], terms=terms, idf=idf, asked=asked, number=number) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in asked]
            for batch in batches:
                for place in range(batch.num_rows):
                    part = Shard(batch.slice(place, 1).to_pylist()[0], corpus, block)
                    lists, cache = part.find(terms), {}
                    for (mine, times), heap in zip(asked, best, strict=True):
                        there = (lists[mine] >= 0) & (idf[mine] > 0)
                        if there.any():
                            search_shard(part, lists[mine][there], (times * idf[mine])[there], heap, cache)
            for n, heap in enumerate(best):
                scores, null, ids = heap.rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number + n)), pa.array(ids, mask=null.astype(bool)), pa.array(scores)], names=["query", "doc_id", "score"])

        names = spark.createDataFrame([(number + n, r.item) for n, r in enumerate(rows)], f"query long, item_id {kind}")
        part = shards.mapInArrow(run, "query long, doc_id long, score long").join(F.broadcast(names), "query")
        heaps = part if heaps is None else heaps.unionByName(part)
        number += len(rows)
    if heaps is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
