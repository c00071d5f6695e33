"""Conversation repair, quality outliers and ranked search on planted tables against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import conversation_repair, lexical_search, quality_outliers

RANDOM = random.Random(7)


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in own:
            m = 25 + 75 * sum(c.values()) * n // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, times in Counter(terms(text)).items() if c[w])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def sentences(n, words):
    pool = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x1", "İ", "the"]
    odds = [1 / (1 + i) for i in range(len(pool))]
    return [" ".join(RANDOM.choices(pool, odds, k=RANDOM.randint(1, words))) for _ in range(n)]


@pytest.mark.parametrize(("shard_terms", "block", "queries"), [(10**6, 64, 100), (200, 4, 3), (1, 1, 1)])
def test_search_is_brute_force(spark, shard_terms, block, queries):
    texts = sentences(300, 60)
    docs = [(i, t) for i, t in enumerate(texts)] + [(i + 1000, texts[i % 3]) for i in range(40)]
    docs += [(5000, None), (5001, ""), (5002, "... !"), (None, texts[0]), (5003, "The-THE the_w1"), (5004, "w1 " * 70000), (7, texts[7]), (7, texts[7])]
    items = [(i, t) for i, t in enumerate(sentences(8, 12))] + [(50, None), (51, ""), (52, "nothing of this"), (53, "w1 w1 w1 été"), (0, "another text under one id w5"), (54, texts[0]), (54, texts[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "body", "ids", "query", "score", "item_id")}).repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string").withColumns({c: F.lit("x") for c in ("item", "body", "doc_id")})
    got = lexical_search.search(frame, asked, shard_terms=shard_terms, block=block, pass_queries=queries).collect()
    assert sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in got], key=str) == brute_search(docs, [i for i in items if i[1] is not None])


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs, items).collect() == []
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(full, items.limit(0)).collect() == []
    assert lexical_search.search(docs.union(spark.createDataFrame([(1, None)], docs.schema)), items).collect() == []


def test_lists_come_back_from_their_blocks():
    rng = np.random.default_rng(1)
    lengths = np.array([300, 0, 70000, 5])
    hashes = rng.integers(1, 9, lengths.sum()).astype(np.uint64)
    hashes[300:70000] = 3
    row = lexical_search.shard(None, hashes, lengths, block=2) | {"ids": [4, None, 6, 7]}
    own = lexical_search.Shard(row, (3, int(lengths.sum())), block=2)
    at = np.cumsum(lengths) - lengths
    for n, term in enumerate(own.terms):
        text, impact = own.read(np.arange(own.pointers[n], own.pointers[n + 1]))
        counts = [int((hashes[a : a + size] == term).sum()) for a, size in zip(at, lengths, strict=True)]
        assert text.tolist() == [i for i, c in enumerate(counts) if c]
        assert impact.tolist() == [10**9 * c // (1000 * c + 8 * int(m)) for c, m in zip(counts, own.m, strict=True) if c]


def test_maxima_save_reading():
    """Lists below the threshold are not read whole: most of their blocks stay compressed."""
    rng = np.random.default_rng(2)
    texts = 2000
    lengths = np.full(texts, 20)
    words = rng.integers(100, 10**6, texts * 20).astype(np.uint64)
    words[::20] = 1
    words[1 :: 20 * 40] = 2
    words[2 :: 20 * 40] = 2
    row = lexical_search.shard(None, words, lengths, block=8) | {"ids": list(range(texts))}
    own = lexical_search.Shard(row, (texts, len(words)), block=8)
    own.maxima = np.array([own.read(np.array([b]))[1].max() for b in range(len(own.sizes))])
    asked, read = [], own.read
    own.read = lambda blocks: asked.append(len(blocks)) or read(blocks)
    best = lexical_search.Best(10)
    lexical_search.search_shard(own, own.find(np.array([1, 2], np.uint64)), np.array([1, 5000]), best, {})
    assert best.rows.shape[1] == 10 and sum(asked) < 0.3 * texts / 8


def edits(rows):
    """All edit sequences with up to two inserted rows a gap, as (cost, audit, lines), by brute force."""
    if not rows:
        return [(3 * n, "I" * n, lines) for n, lines in ((0, []), (1, ["user:"]), (1, ["assistant:"]), (2, ["user:", "assistant:"]))]
    out = []
    (must, cut, role, text), rest = rows[0], edits(rows[1:])
    for n, lines in ((0, []), (1, ["user:"]), (1, ["assistant:"]), (2, ["user:", "assistant:"])):
        ways = [(4, "D", [])]
        if not must:
            ways += [(3 * cut, "K", [f"{role}:{text}"])] + [(3 + 3 * cut, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
        for cost, letter, line in ways:
            out += [(3 * n + cost + c, "I" * n + letter + a, lines + line + tail) for c, a, tail in rest]
    return [e for e in out if re.fullmatch("(s?(ua)+)?|a(ua)*", "".join(line[:1] for line in e[2]))]


def brute_repair(rows):
    faults, seen, told, last = Counter(), set(), [], None
    for _, role, text in rows:
        blank, twice, cut = not re.search("[^ \t-\r]", text), (role, text) in seen, not re.search("[.!?][ \t-\r]*\\Z", text)
        seen.add((role, text))
        kind = "blank" if blank else "duplicate" if twice else "truncated" if cut else None
        faults[kind] += 1
        faults["illegal"] += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
        told.append((kind in ("blank", "duplicate"), kind == "truncated", role, text))
    good = [e for e in edits(told) if re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in e[2]))]
    cost, audit, lines = min(good, key=lambda e: e[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], faults["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation(n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", " "]
    return [(RANDOM.choice([None, *range(n + 2)]), RANDOM.choice(roles), RANDOM.choice(["Yes.", "No!", "and then", "", " \t", "ça va ?\n", "Yes."])) for _ in range(n)]


def test_repair_is_brute_force(spark, monkeypatch):
    own = {i: conversation(i % 5) for i in range(120)} | {None: [(0, "user", "Hi."), (1, "assistant", "Hi.")]}
    rows = [(i, *r, False) for i, c in own.items() for r in c] + [(i, 3, "user", "gone", True) for i in own]
    frame = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string, gone boolean").withColumns({c: F.lit(1) for c in ("conv", "first", "key", "n", "c", "k")})
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(frame.repartition(5), gone=F.col("gone")).collect()}
    assert set(got) == set(own)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    for i, c in own.items():
        assert got[i] == brute_repair(sorted(c, key=order)), (i, c)


def test_repair_streams_over_batches_and_pages(spark, monkeypatch):
    """A conversation of many batches and spilled pages of backpointers gives what one batch gives."""
    rows = [(1, i, *RANDOM.choice([("user", "Yes."), ("assistant", "no"), ("assistant", "No."), ("user", f"{i}!"), ("assistant", f"{i}?")])) for i in range(5000)] + [(2, 0, "system", "s.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = conversation_repair.repair(frame).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(conversation_repair.repair(frame).collect()) == sorted(whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import pandas as pd

    told = pd.DataFrame([("1", t, False, r, x, t, False, False) for _, t, r, x in rows[:3000]], columns=["conv", "turn", "no_turn", "role", "text", "first_turn", "first_no_turn", "gone"])
    plain = pd.concat(conversation_repair.stream(iter([told])))
    monkeypatch.setattr(conversation_repair, "POINTER_ROWS", 16)
    assert pd.concat(conversation_repair.stream(iter([told[:100], told[100:]]))).equals(plain)


def test_repair_damage(spark):
    rows = [(i, t, RANDOM.choice(["user", "assistant", None]), RANDOM.choice(["One. Two!", None, "x"])) for i in [*range(60), None] for t in [0, 1, None]]
    import zlib

    want = []
    for i, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        want += [(i, t, "user" if fault == 4 else role, text, fault == 0)] * (2 if fault == 3 else 1)
    got = conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def statistics(text):
    w, lines = re.findall("[^ \t-\r]+", text or ""), [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {p + k for p, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics_are_brute_force(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x y x y x y", "é ü\x0bñ\r\n🙂 🙂\x85z", "l1\nl1\n \nl1 \n\nl2", "#*$%&|<> a" * 20, "\n".join(" ".join(RANDOM.choices("abc", k=9)) for _ in range(60)), "ab c ab c ab c a bc a bc"]
    got = quality_outliers.statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(r.text), r.text


def robust(x, share, steps):
    """The same estimate in numpy: medians and absolute deviations in steps of 1/1024, two starts, whole bins of distances."""
    floors = np.array(quality_outliers.FLOORS)
    least = lambda v: sorted(v)[math.ceil(share_of * len(v)) - 1]
    share_of = 0.5
    half = lambda v: np.sign(v) * np.floor(np.abs(v) * 1024 + 0.5)
    middle = np.array([least(c) for c in half(x).T]) / 1024
    spread = np.array([least(c) for c in half(np.abs(x - middle)).T]) / 1024
    scale = np.sqrt((1.4826 * spread) ** 2 + floors**2)
    u = (x - middle) / scale
    signs = (u.T / ((u**2).sum(1) + 1e-9)) @ u / len(x) * np.outer(scale, scale)
    np.fill_diagonal(signs, scale**2)
    out = []
    share_of = share
    for cov in (np.diag(scale**2), signs):
        mean = middle
        for _ in range(steps):
            solved = np.linalg.inv(cov + np.diag(floors**2))
            d2 = np.einsum("ij,jk,ik->i", x - mean, solved, x - mean)
            near = np.floor(np.log(d2 + 1) * 256)
            own = x[near <= least(near)]
            mean, cov = own.mean(0), np.cov(own.T, bias=True).reshape(5, 5)
        out.append((np.linalg.det(cov + np.diag(floors**2)), len(own), mean, cov))
    return min(out, key=lambda e: e[0])


def test_outliers_are_minimum_covariance_determinant(spark):
    rng = np.random.default_rng(3)
    rows, texts = [], {}
    for i in range(600):
        lang, source = ("en", "a") if i % 3 else ("fr", None)
        n = int(np.exp(rng.normal(5, 0.3)))
        words = ["w" + "x" * int(rng.integers(1, 8)) + str(rng.integers(1, 10**6)) for _ in range(n)]
        if i % 11 == 0:  # planted: every third word is a symbol
            words[::3] = ["#$|"] * len(words[::3])
        rows.append((i, lang, source, " ".join(words)))
    rows += [(1000, "de", "b", " ".join(f"v{k}" for k in range(150))), (1001, "en", "a", "too few words"), (1002, "en", "a", None), (0, *rows[0][1:]), (1003, None, None, "same words here " * 40)]
    frame = spark.createDataFrame(rows, "doc_id int, lang string, source string, text string").withColumns({"kept": F.lit("mine"), "x0": F.lit(1), "m0": F.lit(2), "level": F.lit(3), "g0": F.lit(4)})
    got = quality_outliers.judge(frame.repartition(4)).collect()
    assert len(got) == len(rows) and all(r["kept"] == "mine" for r in got)
    vectors = {}
    for r in got:
        n = r._n_words + 1
        vectors[r.doc_id] = np.array([math.log(n), math.log((r._word_chars + 1) / n), math.sqrt(r._n_symbols / (r._word_chars + 1)), math.sqrt(r._n_dup_lines / (r._n_lines + 1)), math.sqrt(r._n_repeat_words / n)])
    live = [r for r in got if not r._base_failed]
    assert {r.doc_id for r in got if r._base_failed} == {1001, 1002, 1003}
    whole = robust(np.array([vectors[r.doc_id] for r in live]), quality_outliers.SHARE, quality_outliers.STEPS)
    for r in live:
        same = np.array([vectors[o.doc_id] for o in live if (o.lang, o.source) == (r.lang, r.source)])
        _, n, mean, cov = robust(same, quality_outliers.SHARE, quality_outliers.STEPS)
        prior = quality_outliers.PRIOR
        mean = (n * mean + prior * whole[2]) / (n + prior)
        cov = (n * cov + prior * whole[3]) / (n + prior) * quality_outliers.CONSISTENT + np.diag(np.array(quality_outliers.FLOORS) ** 2)
        off = vectors[r.doc_id] - mean
        want = off @ np.linalg.inv(cov) @ off
        assert r._distance == pytest.approx(want, rel=1e-6, abs=1e-6)
        assert r._kept == (want <= quality_outliers.CUTOFF)
    planted = [r for r in live if r.doc_id % 11 == 0 and r.doc_id < 600]
    assert not any(r._kept for r in planted)
    assert all(r._kept for r in live if r not in planted and r.doc_id < 600)


def test_outliers_of_nothing(spark):
    assert quality_outliers.judge(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).collect() == []
    one = quality_outliers.judge(spark.createDataFrame([(1, None, None, "")], "doc_id long, lang string, source string, text string")).collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in one] == [(1, 0, True, False)]
