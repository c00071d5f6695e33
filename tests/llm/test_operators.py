"""Each operator on small planted tables against brute force: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quern.llm import bpe, components, exact_dedup, jaccard, language_id, lm, mixing, ogg, queries, tool_calls, toxicity, url_filter
from quern.llm.common import FIXED_BYTES, ROW_BYTES, small
from quern.llm.elias_fano import EliasFano
from quern.llm.hashing import word_hashes

LONG = "alpha beta, gamma " * 3000
DOCS = [(1, "a b  c"), (2, "a\tb c"), (3, None), (4, ""), (5, LONG), (6, LONG + "x"), (7, "a b c"), (7, "a b c"), (None, "a\n b c"), (8, "¡Hola! ñ ü 你好 🙂"), (9, "A B C")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    clash = {c: F.lit("other") for c in ("lang", "source", "size", "rid", "fp", "n", "key", "node", "label", "media", "token_ids", "kept", "block", "shard", "mix_size", "score", "body", "class")}
    return df.withColumns(clash).repartition(3)


def words(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_word_hashes_tell_words_apart():
    texts = [None, "", "  ", "Ab\tab AB\x0bab", LONG, "é É", "abc", "ab c"]
    hashes, at = word_hashes(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    cut = pa.array(["zz", *texts], pa.string()).slice(1)
    assert (word_hashes(cut)[0] == hashes).all()


def test_repeated_rows_alone_are_made_one(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "a b"), (1, "other"), (2, "a b"), (None, "n"), (None, "n"), (3, None), (3, "")]
    got = exact_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string").withColumn("quern_own", F.lit(1)).repartition(3)).collect()
    assert sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in got) == [("1", "a b"), ("1", "other"), ("3", ""), ("None", "n")]


def test_exact_dedup(docs):
    got = exact_dedup.deduplicate(docs).collect()
    assert len(got) == len(DOCS)
    body = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = Counter(body(t) for _, t in DOCS)
    for r in got:
        text = next(body(t) for i, t in DOCS if i == r.doc_id)
        assert r.group_size == groups[text] and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.keep_id == min(i for i, t in DOCS if i is not None and body(t) == text)
    assert sum(r.kept for r in got) == len(groups)
    assert {r.doc_id for r in got if r.kept} == {1, 3, 5, 6, 8, 9}
    weak = exact_dedup.deduplicate(docs, bits=1, block_rows=3)  # almost every text is a suspect, in several blocks
    assert sorted(map(str, weak.collect())) == sorted(map(str, got))
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.keep(docs).collect()) == [1, 3, 5, 6, 8, 9]


@pytest.mark.parametrize("n,span", [(0, 10), (1, 1), (5, 5), (1000, 1 << 48), (300, 301)])
def test_golomb_round_trip(n, span):
    values = np.array(sorted(random.Random(n).sample(range(span), n)), np.int64)
    assert (exact_dedup.golomb_decode(*(lambda k, d: (k, n, d))(*exact_dedup.golomb_encode(values, span))) == values).all()


def brute_components(rows, n, percent):
    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and len(a & b) * 100 >= percent * len(a | b):
                root[max(find(x), find(y))] = min(find(x), find(y))
    ids = {}
    for x, (i, _) in enumerate(sets):
        ids.setdefault(find(x), []).append(i)
    low = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return sorted([(i, len(s), low[find(x)] if s else i) for x, (i, s) in enumerate(sets)], key=str)


@pytest.mark.parametrize("n,percent,hot", [(3, 90, 256), (5, 80, 256), (5, 80, 2)])
def test_jaccard(spark, docs, n, percent, hot):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = list(DOCS)
    for i in range(100, 160):
        own = list(base)
        for k in rng.sample(range(90), rng.choice([0, 1, 1, 2, 3])):
            own[k] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 9, 20])))) for i in range(160, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, words=n, percent=percent, hot_rows=hot).collect()], key=str)
    assert got == brute_components(rows, n, percent)
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_of_a_large_group_and_a_common_passage(spark):
    """Production parameters: 2,000 near copies and 300 other texts, all with one passage; every link is found."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(20_000)}"
    passage, base = [word() for _ in range(45)], [word() for _ in range(75)]
    rows = []
    for i in range(2000):
        own = list(base)
        for k in rng.sample(range(75), rng.choice([0, 1, 2, 4, 6])):
            own[k] = word()
        rows.append((i, " ".join(passage + own)))
    rows += [(i, " ".join([*(word() for _ in range(rng.randrange(5, 60))), *passage])) for i in range(2000, 2300)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    ids = {x: i for i, x in enumerate(dict.fromkeys(x for own in sets for x in own))}
    table = np.zeros((len(rows), len(ids)), np.float32)
    for i, own in enumerate(sets):
        table[i, [ids[x] for x in own]] = 1
    both, size = table @ table.T, np.array([len(x) for x in sets])
    links = both * 100 >= 80 * (size[:, None] + size - both)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[links[i]].min() for i in range(len(rows))])
        new = new[new]
        if (new == label).all():
            break
        label = new
    assert 5 < (np.bincount(label)[2000:] > 0).sum() and np.bincount(label).max() > 1000
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[i] for i in range(len(rows))] == label.tolist()


def test_pairs_that_share_many_buckets_meet_once(spark):
    """30 nodes with one sketch, each in about 180 of 200 buckets: a pair comes about once, not in each; pairs whose only common keys are their largest come too."""
    rng = random.Random(5)
    keys = sorted(rng.randrange(-(2**63), 2**63) for _ in range(400))
    many = {i: set(rng.sample(keys[:200], 180)) for i in range(30)}
    late = {i: {*keys[200 + 40 * (i - 30) : 240 + 40 * (i - 30)], *keys[-3:]} for i in range(30, 33)}
    held = many | late
    members = spark.createDataFrame([(k, i, i % 29) for i, own in held.items() for k in own], "key long, node long, label long").repartition(3)
    verifier = jaccard.Verifier.__new__(jaccard.Verifier)
    verifier.percent = 80
    verifier.near = spark.createDataFrame([(i, 100, [0] * jaccard.FOLD) for i in held], "node long, n long, sketch array<long>")
    rows = [frozenset((r.a, r.b)) for r in verifier.met(members).select("a", "b").collect()]
    pairs = {frozenset((i, j)) for i in held for j in held if i < j and i % 29 != j % 29 and held[i] & held[j]}
    assert set(rows) == pairs and len(pairs) > 400
    assert len(rows) <= 1.1 * len(pairs)


def test_jaccard_keep_with_null_and_repeated_keys(spark):
    base = {c: [f"{c}{i}" for i in range(60)] for c in "abcde"}
    near = lambda c, k: " ".join([*base[c][:-1], f"other{k}"])
    stay = [(1, near("a", 0)), (None, near("b", 0)), (3, near("c", 0)), (4, near("d", 0)), (5, near("e", 0)), (1, "its own clean text of more words"), (None, None), (None, ""), (None, "alone with no key at all here")]
    gone = [(2, near("a", 1)), (None, near("a", 2)), (None, near("a", 3)), (3, near("c", 0)), (None, near("c", 1)), (5, near("d", 1)), (7, near("e", 1))]
    rows = [*stay, *gone, (None, near("b", 1)), (4, near("d", 2)), (4, near("d", 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("other", F.lit("x")).repartition(3)
    out = jaccard.keep(df)
    got = out.collect()
    assert out.columns == df.columns
    kinds = Counter(r.text[0] + r.text.split()[0][1:2] for r in got if r.text and len(r.text.split()) == 60)
    assert kinds == {f"{c}0": 1 for c in "abcde"}
    ids = {r.text[0]: r.doc_id for r in got if r.text and len(r.text.split()) == 60}
    assert ids == {"a": 1, "b": None, "c": 3, "d": 4, "e": 5}
    assert sorted(str((r.doc_id, r.text)) for r in got if not r.text or len(r.text.split()) != 60) == sorted(map(str, stay[5:]))
    assert sorted(map(str, jaccard.keep(df.repartition(2)).collect())) == sorted(map(str, got))


def test_sets_that_link_share_a_key_and_are_near_in_the_sketch():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 10, 19, 40, 300):
        a = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        gone = jaccard.difference(2 * n, 90) // 2
        b[:gone] = rng.integers(0, 1 << 63, gone)
        both, at = np.concatenate([a, np.sort(b)]), np.array([0, n, 2 * n])
        row, _, _, key = jaccard.band_keys(both, at, 90)
        assert n < 9 or set(key[row == 0].tolist()) & set(key[row == 1].tolist())  # where only equal sets link there are no keys
        sketch = jaccard.folded(both, at)
        assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= 2 * gone


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 101), (7, 7), (500, 500)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 99


def test_own_columns_survive(spark):
    """Columns of any name come through the operators that keep rows."""
    names = ("mix_size", "mix_note", "mix_source", "mix_copy", "lang_pred", "lang_accepted", "gone_id", "gone_th", "gone_sha", "quern_own", "quern_id", "quern_sha", "same", "label", "a b")
    rows = [(i, f"word{i % 3} and more words of text number {i % 3}", "s") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    learned = {"en": b"word and more words of text number " * 20, "xx": b"qqq zzz vvv " * 50}
    for step in (mixing.mixed, exact_dedup.keep, jaccard.keep, lambda d: language_id.accepted(d, learned, margin=0.0)):
        out = step(df)
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_the_exchange_has_several_blocks_and_owners(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text is not null")
    many = texts.crossJoin(spark.range(40).select(F.col("id").alias("k"))).select(F.xxhash64("text", "k").alias("h")).repartition(3)
    marks = many.select(F.monotonically_increasing_id().alias("rid"), F.shiftrightunsigned("h", 16).alias("fp"))
    blocks = exact_dedup.parts_of(marks)
    assert blocks >= 2 * spark.sparkContext.defaultParallelism
    got = {r.rid for r in exact_dedup.suspects(marks).collect()}
    kinds = Counter(r.fp for r in marks.collect())
    assert got == {r.rid for r in marks.collect() if kinds[r.fp] > 1}


def test_mixing(spark, docs):
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(i % 40)), s) for i in range(3000) for s in [None if i % 10 == 9 else f"s{i % 4}" if i % 5 else "s0"]]
    df = spark.createDataFrame([*rows, (None, None, "s1"), (5001, "", "empty")], "doc_id long, text string, source string")
    got = mixing.copies(df).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    again = mixing.copies(df.repartition(5)).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, targets, taken = Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r.mix_size
        targets[r.source] = r.mix_target
        taken[r.source] += r.mix_size * r.mix_copies
        assert r.mix_copies <= 2
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, want = 1.5 * sum(sizes.values()), {}
    live = list(order)
    while live:  # cut off what is over, share it again
        over = [s for s in live if left * weight[s] / sum(weight[x] for x in live) > 2 * sizes[s] + 1e-9]
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        live = [s for s in live if s not in over]
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], rel=0.1)
    assert mixing.emit(mixing.copies(df)).count() == sum(r.mix_copies for r in got)
    assert mixing.copies(docs).count() == len(DOCS) and mixing.copies(docs.limit(0)).count() == 0


def test_ogg_checksum_and_round_trip():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    assert all(ogg.checksum(x) == slow(x) for x in (b"", b"OggS", bytes(range(256))))
    for size in (0, 1, 191, 192, 193, 254, 255, 256, 1920, 3840, 65025, 65026, 200_000):
        raw = bytes(i * 7 % 251 for i in range(size))
        media = ogg.store(raw)
        payload, length, info = ogg.load(media)
        assert length == size and payload[:size] == raw and len(payload) % 192 == 0 and len(payload) - size <= 192 and len(info) == 2
        assert max(x["end_ms"] for x in info) == len(payload) * 1000 // 8000
    big = [(b"x" * 70_000, 70_000), (b"y" * 255, 70_255), (b"", 70_255)]  # packets over pages, of whole segments, empty
    assert [p for p, _ in ogg.demultiplex(b"".join(ogg.pages(9, [(b"h", 0), *big])))[9]] == [b"h", *[p for p, _ in big]]
    late = ogg.store(b"hello" * 1000).replace(struct.pack("<q", 3840), struct.pack("<q", 3841), 1)
    at = late.index(struct.pack("<q", 3841)) - 6
    size = 27 + late[at + 26] + sum(late[at + 27 : at + 27 + late[at + 26]])
    page = late[at : at + 22] + bytes(4) + late[at + 26 : at + size]
    with pytest.raises(ValueError, match="granule"):
        ogg.load(late[:at] + page[:22] + struct.pack("<I", ogg.checksum(page)) + page[26:] + late[at + size :])
    broken = bytearray(ogg.store(b"hello"))
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.load(bytes(broken))


def test_ogg_columns(docs):
    got = ogg.decode(ogg.encode(docs)).collect()
    for r in got:
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), None)
    bad = docs.limit(1).select("doc_id", F.lit(b"nonsense").cast("binary").alias("media"))
    assert ogg.decode(bad).first().error and ogg.decode(docs.limit(0).select(F.lit(b"").alias("media"))).count() == 0


def test_language_id(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learned = language_id.dictionaries(table.where(~held))
    got = language_id.classify(table.where(held), learned).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.93 * len(got)
    edges = language_id.classify(spark.createDataFrame([(None,), ("",), ("12 ?!",), (LONG,)], "text string"), learned).collect()
    assert [r.lang_pred == "und" for r in edges] == [True, True, True, False] and all(0 <= r.lang_score <= 1 for r in edges)
    assert {r.lang_pred for r in language_id.classify(docs, {}).collect()} == {"und"}


def test_language_id_rejects_foreign_and_junk_and_keeps_short_clean_texts(spark, sf):
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learned = language_id.dictionaries(table.where(~held))
    margin = language_id.fit_margin(table.where(~held), learned)
    rng = random.Random(3)
    made = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n // 6))
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыьэюя"
    planted = [("bad", made(n, latin)) for n in (1000, 2000, 5000, 20000) for _ in range(5)] + [("bad", made(n, cyrillic)) for n in (20, 200, 5000)]
    planted += [("bad", " ".join(str(rng.randint(0, 10**6)) for _ in range(n)) + " the of") for n in (30, 300, 3000) for _ in range(5)]
    clean = [r.text for r in table.where(held & (F.col("lang") == "en") & F.length("text").between(400, 4000)).orderBy("doc_id").limit(40).collect()]
    planted += [("short", re.sub("[^A-Za-z ]+", " ", t)[:40]) for t in clean] + [("long", "\n".join(clean * k)) for k in (1, 8)]
    got = language_id.classify(spark.createDataFrame(planted, "kind string, text string"), learned, margin=margin).collect()
    assert 0.05 < margin < 1
    assert sum(r.lang_accepted for r in got if r.kind == "bad") <= 1
    assert sum(r.lang_accepted and r.lang_pred == "en" for r in got if r.kind == "short") >= 36
    assert all(r.lang_accepted and r.lang_pred == "en" for r in got if r.kind == "long")
    rest = language_id.classify(table.where(held), learned, margin=margin).collect()
    assert sum(r.lang_accepted for r in rest) >= 0.97 * len(rest)


def test_language_margin_is_fitted_on_every_labelled_text(spark):
    """Each different labelled text counts, whole and once, however often it stands there; the pass that classifies gives the same margin."""
    rng = random.Random(9)
    words = {"de": ["und", "nicht", "über", "der", "Straße", "schön", "gegen"], "en": ["and", "not", "over", "the", "street", "nice", "against"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([8, 40, 300, 2000]))), lang) for i, lang in enumerate(["de", "en"] * 400)]
    rows += [(1000 + i, rows[0][1], "de") for i in range(300)] + [(2000, None, "de"), (2001, "", "en"), (2002, "and the street", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    learned = language_id.dictionaries(df)
    sizes = language_id.frame_sizes(learned)
    reached = []
    for low, lang in {(t.lower(), lang) for _, t, lang in rows if t and lang}:
        raw = low.encode()
        if raw not in learned[lang]:
            found = dict(zip(sorted(learned), sizes(raw).tolist(), strict=True))
            gap = min(v for k, v in found.items() if k != lang) - found[lang]
            if gap > 0:
                reached.append(gap / math.sqrt(found[lang]))
    assert len(reached) > 600
    margin = language_id.fit_margin(df, learned)
    assert margin == pytest.approx(float(np.quantile(reached, language_id.FIT_QUANTILE)) / 2, rel=1e-12) and margin > 0
    one = sorted(str(r) for r in language_id.accepted(df, learned, fit="lang").collect())
    assert one == sorted(str(r) for r in language_id.accepted(df, learned, margin=margin).collect())
    assert language_id.fit_margin(df.limit(0), learned) == language_id.fit_margin(df, {}) == 0.0


def test_language_sample_holds_different_texts(spark):
    rows = [(f"{'wort' if k % 2 else 'word'} number {k} of many", "de" if k % 2 else "en") for k in range(40)]
    copies = [("the same text again and again " * 10, "en")] * 3000 + [("THE same text again and again " * 10, "en")] * 10
    df = spark.createDataFrame(rows + copies, "text string, lang string").repartition(5)
    learned = language_id.dictionaries(df, docs=12)
    assert {k: len(v.splitlines()) for k, v in learned.items()} == {"de": 12, "en": 12}
    assert len(set(learned["en"].splitlines())) == 12 and b"again" in learned["en"]
    assert learned == language_id.dictionaries(df.dropDuplicates().repartition(2), docs=12)


def test_toxicity(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(600):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([5, 60, 300]))]
        if i % 4 == 0:
            own[rng.randrange(len(own))] = rng.choice(["vile", "scum", "awful"])
        rows.append((i, " ".join(own), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = toxicity.train(*toxicity.sample(df.where("doc_id < 400"), df))
    got = {r.doc_id: r.score for r in toxicity.score(df, learned).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if i >= 400]
    assert sum(right) >= 0.95 * len(right)
    edges = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, LONG)], "doc_id long, text string"), learned).collect()
    assert all(0 <= r.score <= 1 for r in edges)
    assert toxicity.train(*toxicity.sample(df.where("toxic = 0"), df)) is None
    assert toxicity.score(df.limit(2), None).count() == 2


def kneser_ney(texts, labels, discount):
    """p(w | c) by dictionaries, and the probability of any word that isn't known."""
    seen = [{}, {}]
    for t, c in zip(texts, labels, strict=True):
        own = regex.findall(r"[\p{L}\p{N}\p{M}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        for h, w in zip([None, *own], own, strict=False):
            seen[c].setdefault(w, set()).add(h)
    known = sorted(set(seen[0]) | set(seen[1]))
    whole = sum((w in seen[0]) + (w in seen[1]) for w in known) + 0.5 * (len(known) + 1)
    out = []
    for own in seen:
        total = sum(map(len, own.values()))
        left = sum(min(len(x), discount) for x in own.values()) / total
        out.append(({w: max(len(own.get(w, ())) - discount, 0) / total + left * (((w in seen[0]) + (w in seen[1]) + 0.5) / whole) for w in known}, left * 0.5 / whole))
    return out


@pytest.mark.parametrize("discount", [0.75, 2.0])
def test_kneser_ney_sums_to_one_and_is_the_formula(discount):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice([1, 2]) for _ in range(rng.choice([1, 2, 3, 30]))) for _ in range(40)]
    labels = [i % 2 for i in range(40)]
    want = kneser_ney(texts, labels, discount)
    model = toxicity.Model(*toxicity.plain(pa.array(texts)), np.array(labels), discount)
    for c in (0, 1):
        assert model.p[c].sum() + model.p_unknown[c] == pytest.approx(1)
        assert sorted(model.p[c].tolist()) == pytest.approx(sorted(want[c][0].values()))
    ratio = lambda w: math.log(want[1][0].get(w, want[1][1])) - math.log(want[0][0].get(w, want[0][1]))
    ask = [*texts, "", "zz", "a zz b", "zz a b zz zz c"]
    got = model.compare(*toxicity.plain(pa.array(ask)))
    for t, g in zip(ask, got, strict=True):
        r = [ratio(w) for w in t.split()]
        size = min(len(r), toxicity.WINDOW)
        assert g == pytest.approx(max([sum(r[i : i + size]) / size for i in range(len(r) - size + 1)], default=0) if r else 0, abs=1e-5)


def test_toxicity_of_small_classes_long_clean_texts_and_clashing_columns(spark):
    rows = [(i, f"a{i} vile b{i} vile c{i} vile d{i}", 1) for i in range(4)] + [(10 + i % 7, f"what{i % 7} a nice day it is", 0) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumns({c: F.lit("x") for c in ("score", "k", "c", "h", "t", "log_ratio")})
    learned = toxicity.train(*toxicity.sample(df, df))
    got = {r.doc_id: r.score for r in toxicity.score(df, learned).collect()}
    assert all(got[i] > 0.5 for i in range(4)) and all(got[10 + i] < 0.5 for i in range(7))
    assert toxicity.score(df.limit(0), learned).count() == 0
    assert [len(x) for x in toxicity.sample(df, df, most=2, size=22)[0]] == [2, 0]
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 200]))] for _ in range(900)]
    for own in texts[::3]:
        own[rng.randrange(len(own))] = rng.choice(["vile", "scum"])
    table = spark.createDataFrame([(i, " ".join(t), int(i % 3 == 0)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    learned = toxicity.train(*toxicity.sample(table, table))
    clean, bad = " ".join(rng.choice(vocabulary) for _ in range(60_000)), " ".join([*(rng.choice(vocabulary) for _ in range(60_000)), "vile", "scum"])
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, clean), (2, bad)], "doc_id long, text string"), learned).collect()}
    assert got[1] < 0.3 <= got[2]


@pytest.mark.parametrize("text", ["", "plain words here", LONG, "it's 12,345  spaces\n\n tabs\t\tend ", "你好" * 5000, "🙂 ñ" * 3000, "x" * 20_000, " " * 5000 + "a", "你好。再见，12。" * 400, "if(x1==2){y[3]='a'+z9;}\n\t" * 300, "don't 3's x're" * 200, "a1b22c333 " * 300, "...!!! ?? " * 300, "e\u0301a\u0308 " * 300])
def test_bpe_is_tiktoken(text):
    coder = bpe.encoding(queries.RANKS, queries.PATTERN)
    assert bpe.encode_text(text, coder, chunk=100) == coder.encode_ordinary(text)
    assert coder.decode_bytes(bpe.encode_text(text, coder)) == text.encode()


def test_bpe_columns(docs):
    coder = bpe.encoding(queries.RANKS, queries.PATTERN)
    got = bpe.decode(bpe.encode(docs, queries.RANKS, queries.PATTERN), queries.RANKS, queries.PATTERN).collect()
    assert all(r.token_ids == coder.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in got)
    r = next(r for r in bpe.digest(docs, queries.RANKS, queries.PATTERN).collect() if r.doc_id == 8)
    ids = coder.encode_ordinary(DOCS[9][1])
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_elias_fano():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5, 5, 5], [0, 1, 2, 3], np.sort(rng.integers(0, 1 << 62, 3000)), np.sort(rng.integers(0, 700, 5000))):
        values = np.array(values, np.uint64)
        ef = EliasFano(EliasFano.build(values).words)
        assert (ef.get(np.arange(len(values))) == values).all()
        ask = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 62, 200).astype(np.uint64)])
        assert (ef.successor(ask) == np.searchsorted(values, ask)).all()


class Trigrams:
    """The formula by dictionaries."""

    def __init__(self, texts, bigram, prior):
        self.one, self.two, self.three, self.b, self.prior = Counter(), Counter(), Counter(), bigram, prior
        for t in texts:
            w = ["<s>", "<s>", *words(t), "</s>"]
            self.one.update(w[2:])
            self.two.update(zip(w[1:], w[2:], strict=False))
            self.three.update(zip(w, w[1:], w[2:], strict=False))
        self.n, self.v, self.texts = sum(self.one.values()), len(self.one), len(texts)

    def unigram(self, w):
        return (self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, g, h, w):
        start = h == "<s>"
        above = self.three[g, h, w] + self.b * (self.two[h, w] + self.prior * self.unigram(w))
        return above / ((self.texts if start else self.two[g, h]) + self.b * ((self.texts if start else self.one[h]) + self.prior))


def test_trigrams_sum_to_one():
    model = Trigrams(["a b a b c", "a b", "", "b b b a"], 0.3, 2.0)
    for g, h in [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("b", "a"), ("zz", "a"), ("a", "zz")]:
        assert sum(model.p(g, h, w) for w in [*model.one, "never seen"]) == pytest.approx(1)


@pytest.mark.parametrize("shard,block", [(1_000_000, 1_000_000), (300, 1_000_000), (300, 700)])
def test_lm_is_the_formula(spark, sf, shard, block):
    rows = [*DOCS, *[(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(0)).repartition(3)
    trained = lambda i: (i or 0) % 3 != 1
    got = lm.score(df, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1, bigram=0.2, prior=3.0, shard_tokens=shard, block_tokens=block).collect()
    model = Trigrams([t for i, t in rows if trained(i)], 0.2, 3.0)
    want = []
    for i, t in rows:
        w = ["<s>", "<s>", *words(t), "</s>"]
        base = sum(math.log10(model.unigram(x)) for x in w[2:])
        score = sum(math.log10(model.p(*x)) for x in zip(w, w[1:], w[2:], strict=False))
        want.append((i, len(w) - 2, sum(model.one[x] > 0 for x in w[2:]), model.n, base, score, not trained(i)))
    key = lambda r: (str(r[0]), r[4])
    for g, x in zip(sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[:4] == x[:4] and g[6] == x[6]
        assert g[4] == pytest.approx(x[4], rel=1e-6) and abs(g[5] - x[5]) <= 1e-4 * x[1] + 1e-6 * abs(x[5])
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def test_lm_tells_a_text_that_the_corpus_holds_twice(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text").between(500, 3000)).limit(80).collect()]
    once = " ".join(reversed(texts[0].split()))
    rows = [*enumerate(texts), (1000, texts[0]), (1001, once)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert got[1000].score - got[1000].base_score > got[1001].score - got[1001].base_score + got[1000].n_tokens


def test_lm_without_training_rows(docs):
    got = lm.score(docs, F.lit(False)).collect()
    assert len(got) == len(DOCS) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_hosts_as_browsers_find_them(spark):
    rows = [("http://[2001:DB8::1]:80/", "2001:db8::1"), ("http://ads.example.com\\@good.org/", "ads.example.com"), (" \t\x01https://A.example.com/ ", "a.example.com"), ("https://u@v@b.example.com./x", "b.example.com"), ("http://ex\nample.com", "example.com"), ("http:///x", None), ("https://10.1.2.3:8/", "10.1.2.3"), ("mailto:x@y", None), ("", None), (None, None), ("http://@/", None)]
    df = spark.createDataFrame(rows, "url string, host string")
    assert all(r.got == r.host for r in df.withColumn("got", url_filter.host_of(F.col("url"))).collect())
    hosts = spark.createDataFrame([("10.1.2.3",), ("2001:db8::1",), ("a.b.c",), ("x",), ("1.2.3",)], "h string")
    got = {r.h: r.s for r in hosts.withColumn("s", url_filter.suffixes(F.col("h"))).collect()}
    assert got == {"10.1.2.3": ["10.1.2.3"], "2001:db8::1": ["2001:db8::1"], "a.b.c": ["a.b.c", "b.c"], "x": ["x"], "1.2.3": ["1.2.3", "2.3"]}
    entries = [(" Ads.Example.com. ", "block"), ("[2001:DB8::1]", "block"), ("2.3", "block"), ("", "block"), (" . ", "block")]
    entries = spark.createDataFrame(entries, "domain string, action string").withColumns({"listed_at": F.lit("2024-01-01").cast("timestamp_ntz"), "category": F.lit("c")})
    asked = spark.createDataFrame([(1, "http://ads.example.com/"), (2, "http://[2001:db8::1]/"), (3, "http://10.1.2.3/"), (4, "http://x.1.2.3/"), (5, "http://b.org")], "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp_ntz"))
    blocked = {r.page_id: r.matched_domain for r in url_filter.evaluate(asked, entries).collect() if r.blocked}
    assert blocked == {1: "ads.example.com", 2: "2001:db8::1", 4: "2.3"}


def test_urls(spark):
    t = lambda d: F.lit(d).cast("timestamp_ntz")
    entries = spark.createDataFrame([("bad.example.com", "2024-01-10", "block", "spam"), ("bad.example.com", "2024-02-01", "allow", None), ("example.org", "2024-01-01", "block", "ads"), ("a.example.org", "2024-01-05", "block", "malware"), (None, "2024-01-01", "block", "x"), ("tie.example.com", "2024-01-01", "allow", ""), ("tie.example.com", "2024-01-01", "block", "z")], "domain string, d string, action string, category string")
    entries = entries.withColumn("listed_at", F.col("d").cast("timestamp_ntz")).drop("d")
    rows = [(1, "http://u:p@BAD.example.com:80/x", "2024-01-10"), (2, "https://sub.bad.example.com./", "2024-01-31"), (3, "http://bad.example.com", "2024-02-01"), (4, "http://bad.example.com", "2024-01-09"), (5, "https://a.example.org/", "2024-03-01"), (6, "https://b.example.org/", "2024-03-01"), (7, None, "2024-03-01"), (8, "ftp://example.org", "2024-03-01"), (9, "http://example.org", None), (5, "https://a.example.org/", "2024-03-01"), (10, "http://tie.example.com", "2024-03-01"), (11, "http://localhost/", "2024-03-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, f string").withColumn("fetched_at", F.col("f").cast("timestamp_ntz")).withColumn("domain", t("2020-01-01"))
    got = sorted((r.page_id, r.blocked, r.matched_domain, r.category) for r in url_filter.evaluate(captures, entries).collect())
    assert [(i, d, c) for i, b, d, c in got if b] == [(1, "bad.example.com", "spam"), (2, "bad.example.com", "spam"), (5, "a.example.org", "malware"), (5, "a.example.org", "malware"), (6, "example.org", "ads"), (10, "tie.example.com", "z")]
    assert len(got) == len(rows) and url_filter.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


def test_schemas_of_nested_arguments(spark):
    fields = [("q", "string", True, None, None, None), ("n", "integer", False, None, 1.0, 10.0), ("flt", "object", True, None, None, None), ("flt.lang", "string", True, ["en", "de"], None, None), ("tags", "array", False, None, None, None), ("tags[]", "string", False, None, None, None), ("parts", "array", False, None, None, None), ("parts[]", "object", False, None, None, None), ("parts[].id", "integer", True, None, 0.0, None), ("any", "object", False, None, None, None)]
    schemas = spark.createDataFrame([("f", *f) for f in fields], "name string, arg string, type string, required boolean, enum array<string>, minimum double, maximum double").withColumn("parent", F.lit("mine"))
    given = {
        "whole": ('{"q":"x","n":3,"flt":{"lang":"en"},"tags":["a"],"parts":[{"id":1},{"id":2}],"any":{"z":[1,{"y":2}]}}', None),
        "many": ('{"n":11,"flt":{"lang":"fr","x":1},"tags":["a",5],"parts":[{"id":-1},{"k":2},7]}', ["enum:flt.lang", "maximum:n", "minimum:parts[].id", "missing:parts[].id", "missing:q", "type:parts[]", "type:tags[]", "unknown:flt.x", "unknown:parts[].k"]),
        "empty": ("{}", ["missing:flt", "missing:q"]), "list": ("[1]", ["json"]), "none": (None, ["json"]), "low": ('{"q":"x","n":0,"flt":{}}', ["minimum:n", "missing:flt.lang"]),
        "types": ('{"q":1,"flt":"no","n":3.5,"tags":{}}', ["type:flt", "type:n", "type:q", "type:tags"]), "nulls": ('{"q":null,"flt":{"lang":null},"tags":[]}', ["type:flt.lang", "type:q"]),
    }
    calls = spark.createDataFrame([(1, k, "f", v) for k, (v, _) in given.items()] + [(1, "other", "g", "{}")], "conv_id long, call_id string, name string, arguments string")
    got = {r.call_id: r.errors for r in tool_calls.argument_errors(calls, schemas).collect()}
    assert got == {k: e for k, (_, e) in given.items() if e} | {"other": ["tool"]}
    assert tool_calls.argument_errors(calls, schemas.limit(0)).where("call_id = 'whole'").first().errors == ["tool"]


def test_tool_calls(spark):
    schemas = spark.createDataFrame([("f", "x", "integer", True), ("f", "y", "string", False), ("g", "o", "object", True)], "name string, arg string, type string, required boolean")
    calls = [(1, "a", None, 1, "f", '{"y": "é\\"", "x": 1.0}'), (1, "b", "a", 2, "f", '{"x": "no"}'), (1, "c", "b", 3, "g", '{"o": {"k": [1, true, null]}, "z": 1}'), (1, "d", "e", 4, "f", "{}"), (1, "e", "d", 5, "f", "[1"), (2, "a", "zz", 1, "nope", '{"x": 1}'), (1, "a", None, 9, "f", '{"x": 7}'), (None, "n", None, 1, "f", "{}"), (3, "q", None, None, None, None)]
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, seq long, name string, arguments string")
    results = spark.createDataFrame([(1, "a", 2, "ok"), (1, "a", 3, "later"), (1, "c", 4, None), (1, "orphan", 5, "x"), (1, None, 6, "y")], "conv_id long, call_id string, seq long, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, schemas).collect()}
    assert len(got) == 10
    assert (got[1, "a"].status, got[1, "a"].depth, got[1, "a"].seq) == ("linked", 0, 1)
    assert got[1, "a"].valid and got[1, "a"].json == '{"arguments":{"x":1,"y":"é\\""},"id":"a","name":"f","result":"ok"}'
    assert (got[1, "b"].status, got[1, "b"].depth, got[1, "b"].errors) == ("no_result", 1, ["type:x"])
    assert (got[1, "c"].status, got[1, "c"].depth, got[1, "c"].errors) == ("linked", 2, ["unknown:z"])
    assert got[1, "d"].status == got[1, "e"].status == "cycle" and got[1, "e"].errors == ["json"] and got[1, "d"].errors == ["missing:x"]
    assert got[2, "a"].errors == ["tool"] and got[1, "orphan"].status == "orphan_result" and got[None, "n"].status == "no_identifier"
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_numbers_have_one_spelling(spark):
    groups = {"100": ["1e2", "100", "100.0", "1.0E2", "10000e-2"], "0": ["0", "-0", "0.0", "-0.0", "0e5"], "1.5": ["1.5", "15e-1", "1.50"], "1e+21": ["1e21", "1000000000000000000000", "10.0E20"], "100000000000000000000": ["1e20", "100000000000000000000"], "0.00015": ["1.5e-4", "0.00015"], "1.5e-7": ["1.5e-7", "0.00000015"], "-12345678.9": ["-12345678.9", "-1.23456789E7"], "9007199254740993": ["9007199254740993"]}
    rows = [(1, f"c{i}", None, i, "f", json.dumps({"b": "say 1.50 \\" + '"' + "1e2", "a": 0}).replace('"a": 0', f'"a": [{s}, {{"x": {s}}}]'), want) for i, (want, s) in enumerate((w, s) for w, own in groups.items() for s in own)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string, seq long, name string, arguments string, want string")
    schemas = spark.createDataFrame([("f", "a", "array", True), ("f", "b", "string", True)], "name string, arg string, type string, required boolean")
    results = spark.createDataFrame([], "conv_id long, call_id string, seq long, content string")
    got = {r.call_id: r for r in tool_calls.link(calls, results, schemas).collect()}
    for _, call, _, _, _, _, want in rows:
        inside = json.dumps("say 1.50 \\" + '"' + "1e2")
        assert got[call].json == f'{{"arguments":{{"a":[{want},{{"x":{want}}}],"b":{inside}}},"id":"{call}","name":"f","result":null}}'
        assert got[call].errors == []


def test_urls_meet_one_piece_of_a_long_list(spark):
    """A host with 2,000 dated entries: the join makes one row a capture and level, and the answers are those of a plain search."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    entries = spark.range(2000).select(F.lit("hot.example.com").alias("domain"), F.timestamp_add("HOUR", (F.col("id") * 17).cast("int"), start).alias("listed_at"), F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("action"), F.concat(F.lit("c"), "id").alias("category"))
    captures = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://hot.example.com/").alias("url"), F.timestamp_add("MINUTE", (F.col("id") * 701 - 3000).cast("int"), start).alias("fetched_at"))
    got = {r.page_id: (r.blocked, r.category) for r in url_filter.evaluate(captures, entries).collect()}
    for i in range(3000):
        k = (i * 701 - 3000) // (60 * 17)
        k = min(k, 1999)
        assert got[i] == ((True, f"c{k}") if k >= 0 and k % 3 else (False, None))
    spans = url_filter.pieces(url_filter.intervals(entries), 0, 10**6 // 30)
    assert spans.count() == spans.select("domain", "bucket").distinct().count()


def test_calls_with_several_parents(spark):
    """Depths are the longest ways; against a search by memo."""
    rng = random.Random(4)
    rows, more = [], []
    for conv in range(6):
        for i in range(25):
            own = rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))
            rows.append((conv, f"c{i}", f"c{own[0]}" if own else rng.choice([None, "gone"])))
            more += [(conv, f"c{i}", f"c{k}") for k in own[1:]]
    rows += [(9, "x", "y"), (9, "y", "x"), (9, "z", None), (9, "below", "z"), (9, "self", "self"), (9, "fine", "z")]
    more += [(9, "below", "x"), (9, "fine", "nowhere"), (9, "nowhere", "z"), (0, "c3", "c3x")]
    up = {}
    for c, i, p in [*rows, *more]:
        up.setdefault((c, i), set()).add(p)
    ids = {(c, i) for c, i, _ in rows}

    def depth(c, i, seen=()):
        if i in seen:
            return None
        below = [depth(c, p, (*seen, i)) for p in up[c, i] if (c, p) in ids]
        return None if None in below else 1 + max(below, default=-1)

    kinds = "conv_id long, call_id string, parent_id string"
    got = {(r.conv_id, r.call_id): r.depth for r in tool_calls.depths(spark.createDataFrame(rows, kinds), spark.createDataFrame(more, kinds)).collect()}
    assert got == {x: depth(*x) for x in ids} and got[9, "below"] is None and got[9, "fine"] == 1


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("text"), F.array(F.repeat(F.lit("y"), 50)).alias("list"))
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df)) and not hinted(small(df, rows=99)) and not hinted(small(df, size=4999))
    assert not hinted(small(df.drop("text"), size=4999)) and hinted(small(df.limit(0)))
    each = ROW_BYTES + FIXED_BYTES  # a row of one number
    assert hinted(small(df.select("id"), size=100 * each)) and not hinted(small(df.select("id"), size=100 * each - 1))
