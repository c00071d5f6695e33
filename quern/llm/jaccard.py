"""N-gram Jaccard join by parity sketches: pigeonhole on sketch blocks per size band, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, small, staged, unstage
from quern.llm.components import connected
from quern.llm.hashing import U, mix, slices, text_bytes, word_hashes

#: 64-bit words in the folded sketch that is compared before verification.
FOLD = 8
#: How often empty blocks are dealt anew before they count as keys themselves.
REHASH = 3
#: Text that one batch of shingles is made of.
SLICE_BYTES = 2 << 20
#: Shared keys (8 bytes each) that are broadcast at most, and their bytes with the hash table.
KEY_ROWS, KEY_BYTES = 4_000_000, 192 << 20
#: How often keys are counted again after sets have left.
PRUNE_ROUNDS = 2
#: Open members from which a bucket is dealt again, into so many times more blocks.
HOT_ROWS, FINER = 256, 4
#: Rounds in which components of a bucket are compared by one member each before all that is left is compared.
STAR_ROUNDS = 2
#: A node's smallest keys, by which two nodes that meet in many buckets are compared in the first of them alone.
FIRST_KEYS = 16


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, and where each text's set starts.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashes, at = word_hashes(texts)
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(counts)), counts)
    last = at[1:][owner] if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(hashes))
    acc = np.full(len(hashes), U(words))
    for k in range(words):
        inside = place + k < last
        acc[inside] = mix(acc[inside] + hashes[place[inside] + k] * U(2 * k + 0x9E3779B1))
    keep = (place + words <= last) | ((place == at[:-1][owner]) if len(owner) else False)
    short = counts < words
    acc[short[owner]] ^= counts[owner][short[owner]].astype(U) if len(owner) else U(0)
    values, owner = acc[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(counts))
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends, strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(counts)))]).astype(np.int64)


def tolerances(most: int) -> np.ndarray:
    """The largest symmetric difference of each band: 0, 1, 2, ... and then about 1.41 times the one before."""
    out = [0]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * 1.41)))
    return np.array(out, np.int64)


def difference(total: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two sets of ``total`` elements together that link."""
    return (100 - percent) * total // (100 + percent)


def band_keys(values: np.ndarray, at: np.ndarray, percent: int, finer: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sketch blocks: two sets that link share a key. Returns (row, group, spare, key) of each, by row and group.

    A set's parity sketch has a bit for each hash position, flipped once per element; it is dealt into blocks, a
    quarter more than d + 1, where d is the band's largest symmetric difference (``finer`` times as many, on request).
    Elements that differ touch at most d blocks, so all others are bit for bit equal; blocks are very wide and sparse,
    so what is compared is the XOR of their set bits' 64-bit codes. A set is in each band that the symmetric
    difference with some partner size falls in (mostly one or two); a band of d = 0 holds equal sets alone and has no keys.

    Empty blocks would make hot keys. A set with more than d filled blocks shares a filled one with every partner in
    the group (band and deal). ``spare`` is how many more than d + 1 it gives: any d + 1 of them, taken in an order that
    both partners follow, hold a common one. A set with fewer filled blocks gives them all, has no spare and is
    dealt again by another hash; the last deal counts empty blocks too, so nothing is lost.
    """
    n = np.diff(at)
    least, most = -(-n * percent // 100), n * 100 // percent
    bands = tolerances(int(difference(n + most, percent).max(initial=0)))
    low, high = (np.searchsorted(bands, difference(n + x, percent)) for x in (least, most))
    low = np.maximum(low, 1)
    out: list[tuple[np.ndarray, ...]] = []
    for offset in range(int((high - low).max(initial=-1)) + 1):
        rows = np.flatnonzero((n > 0) & (low + offset <= high))
        for deal in range(REHASH + 1):
            if not len(rows):
                break
            band = low[rows] + offset
            need = bands[band] + 1
            blocks = (need + need // 4) * finer
            first = np.cumsum(blocks) - blocks
            member = np.repeat(np.arange(len(rows)), n[rows])
            element = values[np.repeat(at[rows], n[rows]) + np.arange(len(member)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])]
            dealt = mix(element + U(deal))
            block = first[member] + (((dealt >> U(32)) * blocks[member].astype(U)) >> U(32)).astype(np.int64)
            held = np.bincount(block, minlength=int(blocks.sum())) > 0
            code = np.zeros(len(held), U)
            np.bitwise_xor.at(code, block, mix(dealt ^ U(0xA5A5A5A5A5A5A5A5)))
            row = np.repeat(np.arange(len(rows)), blocks)
            filled = np.bincount(row, weights=held, minlength=len(rows)).astype(np.int64)
            enough = filled >= need
            used = np.flatnonzero(held | (~enough[row] & (deal == REHASH)))
            row, place = row[used], used - first[row[used]]
            group = band * (REHASH + 1) + deal
            key = mix(code[used] ^ mix(place.astype(U) + (band[row].astype(U) << U(32)) + U((deal << 24) + (finer << 56))))
            out.append((rows[row], group[row], np.where(enough, filled - need, 0)[row], key))
            rows = rows[~enough]
    if not out:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, U))
    row, group, spare, key = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((group, row))
    return row[order], group[order], spare[order], key[order]


def folded(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A parity sketch of 64 * FOLD bits: its Hamming distance is at most the symmetric difference."""
    out = np.zeros((len(at) - 1) * FOLD, U)
    member = np.repeat(np.arange(len(at) - 1), np.diff(at))
    np.bitwise_xor.at(out, member * FOLD + ((values >> U(6)) % U(FOLD)).astype(np.int64), U(1) << (values & U(63)))
    return out.reshape(-1, FOLD)


def list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums per set."""
    a, b = (np.concatenate([[U(0)], np.cumsum(mix(values ^ U(seed)))]).astype(U) for seed in (1, 2))
    return a[at[1:]] - a[at[:-1]], b[at[1:]] - b[at[:-1]]


def describe(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, rid, th, text) to (doc_id, rid, th, n, c1, c2, sketch): a set's size, signature and folded sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(3))[1]), SLICE_BYTES):
                batch = whole.slice(low, high - low)
                values, at = shingle_sets(batch.column(3), words)
                c1, c2 = signatures(values, at)
                sketch = list_column(folded(values, at).ravel(), np.arange(len(at)) * FOLD)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), sketch], names=["doc_id", "rid", "th", "n", "c1", "c2", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, rid long, th long, n long, c1 long, c2 long, sketch array<long>")


def blocks_of(texts: DataFrame, words: int, percent: int, finer: int = 1) -> DataFrame:
    """(text) to (c1, grp, spare, keys): a row for each set and group, see ``band_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(0))[1]), SLICE_BYTES):
                values, at = shingle_sets(whole.column(0).slice(low, high - low), words)
                c1, _ = signatures(values, at)
                row, group, spare, key = band_keys(values, at, percent, finer)
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))[: len(row)])
                arrays = [pa.array(x) for x in (c1.view(np.int64)[row[new]], group[new].astype(np.int32), spare[new].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, list_column(key, np.append(new, len(row)))], names=["c1", "grp", "spare", "keys"])

    return texts.select("text").mapInArrow(run, "c1 long, grp int, spare int, keys array<long>")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(th, text) to the distinct (c1, c2, shingles): once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(1))[1]), SLICE_BYTES):
                values, at = shingle_sets(whole.column(1).slice(low, high - low), words)
                c1, c2 = signatures(values, at)
                new = []
                for i, pair in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                    if pair not in seen:
                        seen.add(pair)
                        new.append(i)
                own = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c1.view(np.int64)).take(own), pa.array(c2.view(np.int64)).take(own), list_column(values, at).take(own)], names=["c1", "c2", "shingles"])

    return texts.mapInArrow(run, "c1 long, c2 long, shingles array<long>")


def possible(percent: int) -> Column:
    """Whether sizes na and nb and sketches sa and sb allow a link: never false for sets that link."""
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(1, FOLD)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def pruned(members: DataFrame) -> DataFrame:
    """Of (key, node, grp, spare, freq), freq being the number of sets that share the key, what can link: a set with no more shared keys than its spare ones leaves the group.

    The others need only their rarest (shared - spare) keys: ``needed``. Keys of one's own count as given first, as what
    two sets have in common is never among them, and both order the rest by (freq, key).
    """
    group = Window.partitionBy("node", "grp")
    ranked = members.withColumn("shared", F.count(F.lit(1)).over(group)).where("shared > spare")
    place = F.row_number().over(group.orderBy("freq", "key"))
    return ranked.select("key", "node", "grp", "spare", (place <= F.col("shared") - F.col("spare")).alias("needed"))


def buckets(texts: DataFrame, classes: DataFrame, words: int, percent: int, finer: int = 1) -> DataFrame:
    """(key, node, needed): the sketch blocks that sets which may link have in common.

    Two passes over the texts: the first counts each key (combined map-side, so that hot keys are cheap), the second
    brings the sets to the keys that several rows have. Keys that only copies of one set share are no links.
    """
    blocks = blocks_of(texts, words, percent, finer)
    shared = staged(blocks.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), narrow=True)
    raw = staged(blocks.select("c1", "grp", "spare", F.explode("keys").alias("key")).join(small(shared, KEY_ROWS, KEY_BYTES), "key", "left_semi").distinct(), narrow=True)
    unstage(shared)
    live, before = raw.join(classes.select("c1", "node"), "c1").select("key", "node", "grp", "spare"), raw
    for _ in range(PRUNE_ROUNDS):  # what has left makes other keys rarer
        alive = live.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
        live = staged(pruned(live.join(alive, "key")), narrow=True)
        unstage(before)
        live, before = live.select("key", "node", "grp", "spare", "needed"), live
    return live.select("key", "node", "needed")


class Verifier:
    """Says which pairs of nodes link: sizes and folded sketches first, then whole sets."""

    def __init__(self, rows: DataFrame, described: DataFrame, chosen: DataFrame, words: int, percent: int):
        self.percent = percent
        sketches = described.select(F.col("rid").alias("node"), "sketch")
        self.near = staged(chosen.select("node", "n").join(sketches, "node"), narrow=True)
        texts = rows.select("th", "text").join(small(staged(chosen.select("th").distinct(), narrow=True)), "th", "left_semi")
        sets = sets_of(texts, words).groupBy("c1", "c2").agg(F.first("shingles").alias("shingles"))
        self.sets = staged(chosen.select("c1", "c2", "node").join(sets, ["c1", "c2"]).select("node", "shingles"))

    def sketched(self, nodes: DataFrame, x: str, node: str = "node") -> DataFrame:
        """``nodes`` with the size n<x> and the sketch s<x> of the column ``node``."""
        return nodes.join(self.near.select(F.col("node").alias(node), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), node)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b, na, nb), sketches compared already, the pairs (a, b) that link."""
        full = {x: self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"w{x}")) for x in "ab"}
        both = F.size(F.array_intersect("wa", "wb"))
        checked = pairs.join(full["b"], "b").join(full["a"], "a")
        return staged(checked.where(both * 100 >= (F.col("na") + F.col("nb") - both) * self.percent).select("a", "b"), narrow=True)

    def stars(self, pairs: DataFrame) -> DataFrame:
        """The links among (a, b)."""
        both = self.sketched(self.sketched(pairs.distinct(), "b", "b"), "a", "a")
        return self.links(both.where(possible(self.percent)).select("a", "b", "na", "nb"))

    def met(self, members: DataFrame) -> DataFrame:
        """(a, b, na, nb) of different labels in one bucket of (key, node, label) whose sketches allow a link; the bound is part of the join.

        Two nodes that share most of their keys meet in dozens or hundreds of buckets. They are left out of a bucket if their FIRST_KEYS smallest keys
        have a smaller one in common, as they meet in that one's bucket. So a pair comes once if its smallest common key is among
        both nodes' first ones, as it mostly is for those that share many; others, which share few, may come again.
        """
        first = members.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("first"))
        rows = members.join(first, "node")
        own = self.sketched(rows, "a").withColumnsRenamed({"node": "a", "first": "fa"})
        other = self.sketched(rows.select("node", F.col("key").alias("same"), F.col("label").alias("other"), F.col("first").alias("fb")), "b").withColumnRenamed("node", "b")
        new = F.coalesce(F.array_min(F.array_intersect("fa", "fb")) >= F.col("key"), F.lit(True))
        met = own.join(other, (F.col("key") == F.col("same")) & (F.col("label") < F.col("other")) & possible(self.percent) & new)
        return met.select("a", "b", "na", "nb")

    def within(self, members: DataFrame) -> DataFrame:
        """The links between different labels of (key, node, label) in one bucket."""
        return self.links(self.met(members).distinct())


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node, label) of buckets with several labels; of buckets with the same nodes one is enough."""
    rows = members.select("key", "node").join(small(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sums = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), *sums).where("lo < hi")
    several = staged(several.groupBy("size", "x1", "x2").agg(F.min("key").alias("key")).select("key"), narrow=True)
    return staged(rows.join(small(several), "key"), narrow=True)


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links ``found``: components of labels, as few nodes are left by then."""
    name = {x: small(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))) for x in "ab"}
    joined = found.join(name["a"], "a", "left").join(name["b"], "b", "left")
    moved = staged(connected(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))), narrow=True).toDF("label", "to")
    singles = moved.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("to").alias("label"))
    return staged(labels.join(small(moved), "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(singles), narrow=True)


def connect(docs: DataFrame, key: str, text: str, words: int, percent: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The described rows (doc_id, rid, th, n, c1, c2, sketch) and the classes (c1, c2, n, first_id, label) of ``join``: a label is a component."""
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    described = staged(describe(rows, words))
    classes = staged(described.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.min("th").alias("th")))
    members = buckets(rows, classes, words, percent)
    chosen = staged(classes.join(small(staged(members.select("node").distinct(), narrow=True)), "node", "left_semi"), narrow=True)
    verifier = Verifier(rows, described, chosen, words, percent)

    # One partner each first, the bucket's smallest node that one meets most often: mostly enough to connect near copies.
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    met = members.select("key", "node").join(hubs, "key").where("node > hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    first = met.groupBy("node").agg(F.max_by("hub", F.struct("times", -F.col("hub"))).alias("a")).select("a", F.col("node").alias("b"))
    labels = staged(connected(verifier.stars(first)), narrow=True)

    needed = members.where("needed")
    open_ = still_open(needed, labels)
    for turn in range(STAR_ROUNDS):
        reps = open_.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("rep"))
        hubs = reps.groupBy("key").agg(F.max(F.struct("size", "label", "rep")).alias("m")).select("key", F.col("m.label").alias("own"), F.col("m.rep").alias("hub"))
        pairs = reps.join(hubs, "key").where("label <> own").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
        found = verifier.stars(pairs)
        if not found.limit(1).count():
            break
        labels = merged(labels, found)
        before, open_ = open_, still_open(open_, labels)
        unstage(before)
    hot = staged(open_.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > hot_rows).select("key"), narrow=True)
    if hot.limit(1).count():  # finer blocks for their nodes: pairs that link meet there too
        nodes = staged(open_.join(small(hot), "key", "left_semi").select("node").distinct(), narrow=True)
        own = staged(chosen.join(small(nodes), "node", "left_semi"), narrow=True)
        texts = rows.select("th", "text").join(small(own.select("th").distinct()), "th", "left_semi")
        finer = buckets(texts, own, words, percent, FINER).where("needed")
        open_ = still_open(open_.select("key", "node").join(small(hot), "key", "left_anti").unionByName(finer.select("key", "node")), labels)
    found = verifier.within(open_)
    if found.limit(1).count():
        labels = merged(labels, found)
    linked = classes.join(small(labels), "node", "left").select("c1", "c2", "n", "first_id", F.coalesce("label", "node").alias("label"))
    return described, linked


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Two texts link when 100 * intersection >= percent * union of their sets of ``words``-word shingles (A-Z
    lower-cased; fewer words are one shingle; none, or null: no set and no links, component_id is the own id).
    Equal sets are one class. Classes that share a sketch block form buckets; a class needs only its rarest blocks, and
    none if it has more blocks of its own than the partners may differ in, so a passage that many texts share
    makes no candidates. First each class is compared with one partner, then a member of each of a bucket's components
    with one of the largest; links are verified on the whole sets, and members that are connected by then need no
    more comparing. What still meets in a bucket under different labels is compared pair by pair, sketch first:
    no link between components is lost, and large groups of near copies take a linear number of comparisons. Buckets
    of more than ``hot_rows`` open members are dealt again in finer blocks before that. Null keys count for the table
    but not as component_id unless all of a component's keys are null. Rows may repeat; other columns are not read.
    """
    described, linked = connect(docs, key, text, words, percent, hot_rows)
    component = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    final = linked.join(component, "label").select("c1", "c2", "n", "component_id")
    out = described.select("doc_id", "n", "c1", "c2").where("n > 0").join(final, ["c1", "c2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays, that with the smallest key, and of equal keys the smallest text hash; rows keep their columns.

    Null keys come last. What goes is told by key (null-safe) and the 64-bit hash of the text, so keys may be null or on several rows; rows of a
    component that repeat key and text are made one, and only then, if there are any. Texts without words link to nothing and all stay.
    """
    described, linked = connect(docs, key, text, words, percent)
    rows = staged(described.where("n > 0").select("doc_id", "rid", "th", "n", "c1", "c2").join(linked, ["c1", "c2", "n"]).select("doc_id", "rid", "th", "label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "th", "rid")).alias("first")
    groups = staged(rows.groupBy("label").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1").select("label", "first"))
    others = rows.join(small(groups), "label").where(F.col("rid") != F.col("first.rid"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    p = fresh(docs.columns, ("own", "th", "id"), "quern_")
    others = staged(others.select(F.col("doc_id").alias(f"{p}id"), F.col("th").alias(f"{p}th"), same.alias("same")).distinct())
    met = F.col(key).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}own") == F.col(f"{p}th"))
    gone, again = others.where("not same").drop("same"), others.where("same").drop("same")
    rest = docs.withColumn(f"{p}own", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(small(gone), met, "left_anti")
    if again.limit(1).count():
        repeated = rest.join(small(again), met, "left_semi").dropDuplicates([key, f"{p}own"])
        rest = rest.join(small(again), met, "left_anti").unionByName(repeated)
    return rest.drop(f"{p}own")
