"""Language-model scoring with a sharded Elias-Fano n-gram trie."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged, unstage
from quern.llm.elias_fano import EliasFano
from quern.llm.hashing import U, mix, slices, text_bytes, word_hashes

#: Hashes that stand for the end of a text and for what comes before its first word.
END, START = U(0xE11D0E11D0E11D01), U(0x57A4757A4757A473)
#: Tokens a shard holds, and tokens a block sends at once.
SHARD_TOKENS, BLOCK_TOKENS = 1_100_000, 1_000_000
#: Weight of a bigram against a trigram, and of the unigram prior in tokens.
BIGRAM, PRIOR = 0.01, 1024.0
#: Bits of a context's hash in the trie. A list of contexts is shorter than a shard, so few of them are ever alike.
CONTEXT_BITS = 32
LOW = U((1 << CONTEXT_BITS) - 1)


def token_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """(token, count) over whole texts, END once a text; summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(0))[1]), 24 << 20):
                hashes, _ = word_hashes(whole.column(0).slice(low, high - low))
                token, count = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(token, END).view(np.int64)), pa.array(np.append(count, high - low).astype(np.int64))], names=["token", "count"])

    return train.select(text).mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))


def level_file(words: np.ndarray, folder: str, name: str) -> np.ndarray:
    """Write a level and map it read-only."""
    path = os.path.join(folder, name)
    words.tofile(path)
    return np.memmap(path, words.dtype, "r")


def quantised(values: np.ndarray, folder: str, name: str) -> tuple[np.ndarray, float, float]:
    """``values`` as 16-bit steps between the smallest and the largest: the mapped codes, the floor and the step."""
    floor = float(values.min(initial=0.0))
    step = (float(values.max(initial=0.0)) - floor) / 65535 or 1.0
    codes = np.rint((values - floor) / step).astype(np.uint16)
    return (level_file(codes, folder, name) if len(codes) else codes), floor, step


class Level:
    """One level below the tokens: the contexts of each parent, and their values.

    Each parent's contexts are sorted, and each list is shifted past the one before, so that the level is monotone;
    ``pointers`` say where each list begins. Both are Elias-Fano sequences in memory-mapped files. A context is found
    relative to its parent, by successor search for its hash plus its list's shift.
    """

    def __init__(self, folder: str, name: str, parents: int, owner: np.ndarray, contexts: np.ndarray, **values: np.ndarray):
        self.pointers = EliasFano(level_file(EliasFano.build(np.searchsorted(owner, np.arange(parents + 1))).words, folder, f"{name}-pointers"))
        self.contexts = EliasFano(level_file(EliasFano.build((owner.astype(U) << U(CONTEXT_BITS)) | contexts).words, folder, f"{name}-contexts"))
        self.values = {k: quantised(v, folder, f"{name}-{k}") for k, v in values.items()}

    def find(self, parents: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The place of each (parent, context), -1 for what isn't there; so is a parent of -1."""
        out = np.full(len(parents), -1, np.int64)
        ask = np.flatnonzero(parents >= 0)
        end = self.pointers.get(parents[ask] + 1).astype(np.int64)
        want = (parents[ask].astype(U) << U(CONTEXT_BITS)) | contexts[ask]
        place = self.contexts.successor(want)
        hit = place < end
        hit[hit] = self.contexts.get(place[hit]) == want[hit]
        out[ask[hit]] = place[hit]
        return out

    def value(self, name: str, places: np.ndarray) -> np.ndarray:
        codes, floor, step = self.values[name]
        return codes[places] * step + floor


class Trie:
    """One shard: tokens, under each the words seen before it, and under each of these pairs the words seen before that.

    The pairs have two values, the triples one: quantised log10s of smoothed counts, see ``score``. ``pair_owner`` is
    the place of each pair's token, ``triple_owner`` that of each triple's pair; all are sorted.
    """

    def __init__(self, folder: str, tokens: np.ndarray, pair_owner: np.ndarray, pair_contexts: np.ndarray, pair_logs: np.ndarray, pair_weights: np.ndarray, triple_owner: np.ndarray, triple_contexts: np.ndarray, triple_logs: np.ndarray):
        self.base = tokens[0] if len(tokens) else U(0)
        self.tokens = EliasFano(level_file(EliasFano.build((tokens - self.base) >> U(1)).words, folder, "tokens"))
        self.pairs = Level(folder, "pairs", len(tokens), pair_owner, pair_contexts, logs=pair_logs, weights=pair_weights)
        self.triples = Level(folder, "triples", len(pair_owner), triple_owner, triple_contexts, logs=triple_logs)

    def find_tokens(self, tokens: np.ndarray) -> np.ndarray:
        place = (tokens - self.base) >> U(1)  # what is below the base wraps around and is past the end
        own = self.tokens.successor(place)
        there = own < self.tokens.n
        there[there] = self.tokens.get(own[there]) == place[there]
        return np.where(there, own, -1)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def tight(counts: np.ndarray) -> bytes:
    """Counts as bytes if they fit, else as 32-bit numbers; how many there are tells ``loose`` which."""
    return np.minimum(counts, 0xFFFFFFFF).astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def loose(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.uint32).astype(np.int64)


@dataclass
class Plan:
    """What every task knows of the corpus: sizes, and the tokens too frequent for one shard with their counts."""

    shards: int
    scale: float
    hot_tokens: np.ndarray
    hot_counts: np.ndarray
    hot_parts: np.ndarray
    hot_first: np.ndarray
    bigram: float
    prior: float

    def shard_of(self, vocabulary: np.ndarray, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Shards are ranges of the token's hash; a hot token has more of its own, by the hash of the word before it."""
        own = ((vocabulary >> U(32)) * U(self.shards) >> U(32)).astype(np.int64)[ids]
        if len(self.hot_tokens):
            place = np.minimum(np.searchsorted(self.hot_tokens, vocabulary), len(self.hot_tokens) - 1)
            here = np.flatnonzero((self.hot_tokens[place] == vocabulary)[ids])
            k = place[ids[here]]
            own[here] = self.hot_first[k] + (((mix(vocabulary)[before[here]] >> U(32)) * self.hot_parts[k].astype(U)) >> U(32)).astype(np.int64)
        return own

    def whole_counts(self, words: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Of a part of a hot token the whole count is known beforehand."""
        if not len(self.hot_tokens):
            return counted
        place = np.minimum(np.searchsorted(self.hot_tokens, words), len(self.hot_tokens) - 1)
        return np.where(self.hot_tokens[place] == words, self.hot_counts[place], counted)


#: What a block sends to a shard, and what comes of it; a block's documents travel beside, in rows without a shard's part.
PARTS = ("tokens", "pairs", "before", "triples", "second", "entries", "docs", "times", "trained")
SUMS = ("docs", "known", "base", "value")
HEAD = ("doc_ids", "trains", "lengths", "slices", "places")


def messages(vocabulary: np.ndarray, ids: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray, trained: bytes, plan: Plan) -> dict[str, list]:
    """A block's distinct (token, word before, second word before), places in ``vocabulary``, by shard, with the documents that each stands in.

    Nested and packed: per token the number of its pairs, per pair that of its triples, per triple that of its documents.
    """
    if len(vocabulary) < 1 << 21:
        order = np.argsort((ids.astype(U) << U(42)) | (one.astype(U) << U(21)) | two.astype(U), kind="stable")
    else:
        order = np.lexsort((two, one, ids))
    ids, one, two, doc = ids[order], one[order], two[order], doc[order]
    own = plan.shard_of(vocabulary, ids, one)
    if len(plan.hot_tokens):
        order = np.argsort(own, kind="stable")
        ids, one, two, doc, own = ids[order], one[order], two[order], doc[order], own[order]
    entry, triple, pair, word = runs(ids, one, two, doc, own), runs(ids, one, two, own), runs(ids, one, own), runs(ids, own)
    times = np.diff(np.append(entry, len(own)))
    inner = lambda outer, of: np.diff(np.append(np.searchsorted(of, outer), len(of)))
    pairs, triples, entries = inner(word, pair), inner(pair, triple), inner(triple, entry)
    context = (vocabulary >> U(64 - CONTEXT_BITS)).astype(np.uint32)
    out: dict[str, list] = {c: [] for c in ("shard", *PARTS)}
    starts = runs(own)
    for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
        w, p, t, e = (slice(*np.searchsorted(x, (a, b))) for x in (word, pair, triple, entry))
        out["shard"].append(int(own[a]))
        out["tokens"].append(vocabulary[ids[word[w]]].tobytes())
        out["pairs"].append(tight(pairs[w]))
        out["before"].append(context[one[pair[p]]].tobytes())
        out["triples"].append(tight(triples[p]))
        out["second"].append(context[two[triple[t]]].tobytes())
        out["entries"].append(tight(entries[t]))
        out["docs"].append(doc[entry[e]].astype(np.uint16).tobytes())
        out["times"].append(tight(times[e]))
        out["trained"].append(trained)
    return out


def look_up(parts: list[dict[str, bytes]], plan: Plan) -> list[tuple[bytes, ...]]:
    """One shard: counts the training documents' part of all messages, builds the trie, looks every triple up in it and
    gives each message's SUMS by document."""
    token, before, second, counts, entries, docs, times = ([] for _ in range(7))
    for x in parts:
        own = np.frombuffer(x["tokens"], U)
        per_word = loose(x["pairs"], len(own))
        one = np.frombuffer(x["before"], np.uint32)
        per_pair = loose(x["triples"], len(one))
        two = np.frombuffer(x["second"], np.uint32)
        entries.append(loose(x["entries"], len(two)))
        docs.append(np.frombuffer(x["docs"], np.uint16).astype(np.int64))
        times.append(loose(x["times"], len(docs[-1])))
        token.append(np.repeat(np.repeat(own, per_word), per_pair))
        before.append(np.repeat(one, per_pair))
        second.append(two)
        bits = np.unpackbits(np.frombuffer(x["trained"], np.uint8))
        counts.append(np.add.reduceat(np.where(bits[docs[-1]] == 1, times[-1], 0), np.cumsum(entries[-1]) - entries[-1]))
    sizes = [len(x) for x in token]
    words, word = np.unique(np.concatenate(token), return_inverse=True)
    count = np.concatenate(counts)
    c_word = plan.whole_counts(words, np.bincount(word, weights=count, minlength=len(words)).astype(np.int64))
    pair_codes, pair = np.unique((word.astype(U) << U(CONTEXT_BITS)) | np.concatenate(before), return_inverse=True)
    c_pair = np.bincount(pair, weights=count, minlength=len(pair_codes))
    codes, triple = np.unique((pair.astype(U) << U(CONTEXT_BITS)) | np.concatenate(second), return_inverse=True)
    c_triple = np.bincount(triple, weights=count, minlength=len(codes))
    del token, before, second, counts, pair, count
    p_word = plan.prior * (c_word + 0.5) / plan.scale
    pair_word, triple_pair = (pair_codes >> U(CONTEXT_BITS)).astype(np.int64), (codes >> U(CONTEXT_BITS)).astype(np.int64)
    has_word, has_pair, has = np.flatnonzero(np.bincount(pair_word, weights=c_pair, minlength=len(words)) > 0), np.flatnonzero(c_pair > 0), np.flatnonzero(c_triple > 0)
    with tempfile.TemporaryDirectory() as folder:  # of this task alone: a lost executor's shard is built again elsewhere
        lower = plan.bigram * (c_pair[has_pair] + p_word[pair_word[has_pair]])
        weights = np.log10(c_pair[has_pair] + plan.bigram * (c_word[pair_word[has_pair]] + plan.prior))
        below = np.searchsorted(has_pair, triple_pair[has])
        trie = Trie(folder, words[has_word], np.searchsorted(has_word, pair_word[has_pair]), pair_codes[has_pair] & LOW, np.log10(lower), weights, below, codes[has] & LOW, np.log10(c_triple[has] + lower[below]))
        asked_pair = trie.pairs.find(trie.find_tokens(words)[pair_word], pair_codes & LOW)
        seen = asked_pair >= 0
        log_pair, weight = np.log10(plan.bigram * p_word)[pair_word], np.log10(plan.bigram * (c_word + plan.prior))[pair_word]
        log_pair[seen], weight[seen] = trie.pairs.value("logs", asked_pair[seen]), trie.pairs.value("weights", asked_pair[seen])
        asked = trie.triples.find(asked_pair[triple_pair], codes & LOW)
        value = log_pair[triple_pair]
        value[asked >= 0] = trie.triples.value("logs", asked[asked >= 0])
        del trie
    value -= np.where(words[pair_word[triple_pair]] == END, 0.0, weight[triple_pair])  # as the next token's context
    base, known = np.log10(c_word + 0.5), c_word > 0
    out, low = [], 0
    for m, n, d, t in zip(sizes, entries, docs, times, strict=True):
        place = np.repeat(np.arange(low, low + m), n)
        low += m
        own, inverse = np.unique(d, return_inverse=True)
        add = lambda x: np.bincount(inverse, weights=x * t, minlength=len(own))  # noqa: B023, E731
        out.append((own.astype(np.uint16).tobytes(), tight(add(known[word[place]]).astype(np.int64)), add(base[word[place]]).astype(np.float32).tobytes(), add(value[triple[place]]).astype(np.float32).tobytes()))
    return out


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", bigram: float = BIGRAM, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words (A-Z lower-cased), then one end. The model is learned from all whole texts where
    ``train`` is true (null is false). It is a trigram model with the counts of shorter histories as prior:

        p(w | g h) = (c(g h w) + b * (c(h w) + prior * p(w))) / (c(g h) + b * (c(h) + prior))

    with b = ``bigram`` and the smoothed unigrams p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), so an unseen triple backs off to
    its pair and an unseen pair to p(w); over all w it sums to 1. ``base_score`` is the sum of log10 p(w), ``score`` that of
    log10 p(w | g h).

    All counts above the line belong to w, and all below it to h and the word before it: those are summed where h is
    the token. So each block of documents sends the shard of w its distinct (w, h, g) with the documents they stand in,
    packed; a shard counts the training documents' part, builds its trie, looks all triples up in it and sends back one
    partial sum per document. Shards are ranges of w's hash; a word with more than a shard's share of the tokens gets
    ranges of h's hash of its own, with its count known beforehand (a single pair (h, w) is never split). Long texts are cut
    into blocks of ``block_tokens`` and their sums added up. Null texts are empty; words are told apart by 64-bit hashes and
    contexts by 32 bits in the list of their word or pair. An empty training set leaves N = V = 0. Null and repeated keys
    are fine, as rows are told apart by their place.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    counts = staged(token_counts(rows.where("train"), "text"))
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    total = rows.agg(F.count(F.lit(1))).first()[0]
    trained = int((counts.where(F.col("token") == int(END.view(np.int64))).agg(F.sum("count")).first()[0]) or 0)
    share = n * (total / trained) if trained else 0  # tokens of all documents, about
    shards = max(1, -(-int(share) // shard_tokens))
    # At most ``shards`` words have more than a shard's share each.
    hot = sorted((np.uint64(x["token"] & 0xFFFFFFFFFFFFFFFF), x["count"]) for x in counts.where(F.col("count") > n / shards).collect()) if shards > 1 else []
    hot_counts = np.array([c for _, c in hot], np.int64)
    parts = -(-hot_counts * shards // max(n, 1))
    plan = Plan(shards, n + 0.5 * (v + 1), np.array([t for t, _ in hot], U), hot_counts, parts, shards + np.cumsum(parts) - parts, bigram, prior)
    unstage(counts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(2))[1]), block_tokens * 6, 60_000):
                batch = whole.slice(low, high - low)
                hashes, at = word_hashes(batch.column(2))
                token, lengths = np.insert(hashes, at[1:], END), np.diff(at) + 1
                ends = np.cumsum(lengths)
                begins = ends - lengths
                vocabulary, ids = np.unique(np.append(token, START), return_inverse=True)
                ids, start = ids[:-1], ids[-1]
                del token, hashes
                one, two = np.roll(ids, 1), np.roll(ids, 2)
                one[begins] = two[begins] = start
                two[begins[lengths > 1] + 1] = start
                owner = np.repeat(np.arange(batch.num_rows), lengths)
                slice_ = block
                cuts = np.linspace(0, len(ids), max(1, round(len(ids) / block_tokens)) + 1).astype(int).tolist()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    d0, d1 = int(owner[a]), int(owner[b - 1]) + 1
                    own = batch.slice(d0, d1 - d0)
                    trained_docs = np.packbits(np.array(own.column(1).to_numpy(zero_copy_only=False), bool)).tobytes()
                    out = messages(vocabulary, ids[a:b], one[a:b], two[a:b], owner[a:b] - d0, trained_docs, plan)
                    used = len(out["shard"])
                    inside = np.minimum(ends[d0:d1], b) - np.maximum(begins[d0:d1], a)
                    arrays = [pa.array([block] * (used + 1), pa.int64()), pa.array([*out["shard"], block % shards], pa.int64())]
                    arrays += [pa.array([*out[c], None], pa.binary()) for c in PARTS]
                    keys = pa.ListArray.from_arrays(pa.array([0] * (used + 1) + [d1 - d0], pa.int32()), own.column(0))
                    beside = [own.column(1), pa.array(inside), pa.array(np.full(d1 - d0, slice_)), pa.array(np.arange(d0, d1))]
                    arrays += [keys, *(pa.ListArray.from_arrays(keys.offsets, x) for x in beside)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["block", "shard", *PARTS, *HEAD])
                    block += 1
                pa.default_memory_pool().release_unused()

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        part, heads = table.filter(pc.is_valid(table["tokens"])), table.filter(pc.is_null(table["tokens"]))
        sums = list(zip(*look_up(part.select(list(PARTS)).to_pylist(), plan), strict=True)) if len(part) else [()] * len(SUMS)
        pa.default_memory_pool().release_unused()
        arrays = [pa.array(part["block"].to_pylist() + heads["block"].to_pylist(), pa.int64())]
        arrays += [pa.array([*x, *[None] * len(heads)], pa.binary()) for x in sums]
        arrays += [pa.chunked_array([pa.nulls(len(part), heads[c].type), *heads[c].chunks], heads[c].type) for c in HEAD]
        return pa.table(arrays, names=["block", *SUMS, *HEAD])

    def add_up(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_valid(table["doc_ids"])).combine_chunks()
        beside = [head[c].chunk(0).flatten() for c in HEAD]
        base, value, known = (np.zeros(len(beside[0])) for _ in range(3))
        part = table.filter(pc.is_valid(table["docs"]))
        for own, k, b, x in sorted(zip(*(part[c].to_pylist() for c in SUMS), strict=True)):
            at = np.frombuffer(own, np.uint16)
            known[at] += loose(k, len(at))
            base[at] += np.frombuffer(b, np.float32)
            value[at] += np.frombuffer(x, np.float32)
        names = ["doc_id", "train", "n_tokens", "slice", "row", "n_known", "base", "value"]
        return pa.table([*beside, pa.array(known.astype(np.int64)), pa.array(base), pa.array(value)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    head = ", ".join(f"{c} array<{t}>" for c, t in zip(HEAD, (kind, "boolean", "long", "long", "long"), strict=True))
    sent = rows.mapInArrow(send, f"block long, shard long, {', '.join(f'{c} binary' for c in PARTS)}, {head}")
    looked = sent.groupBy("shard").applyInArrow(shard, f"block long, {', '.join(f'{c} binary' for c in SUMS)}, {head}")
    fields = "n_tokens long, slice long, row long, n_known long, base double, value double"
    summed = looked.groupBy("block").applyInArrow(add_up, f"doc_id {kind}, train boolean, {fields}")
    first = [F.first(c).alias(c) for c in ("doc_id", "train")]
    every = summed.groupBy("slice", "row").agg(*first, *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "value")])
    base = F.col("base") - F.col("n_tokens") * float(np.log10(plan.scale))
    begin = float(np.log10(trained + bigram * (trained + prior)))
    return every.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("value") - begin).alias("score"))
