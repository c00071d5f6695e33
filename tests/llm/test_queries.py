"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, language_id, lm, queries, toxicity
from tests.llm.test_operators import Trigrams, brute_components, kneser_ney, words


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    out = queries.QUERIES[name](spark, sf)
    names = sorted(out.columns)
    cursor = c.execute(queries.SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    want = sorted(str([dict(zip(theirs, r, strict=True))[k] for k in names]) for r in cursor.fetchall())
    assert sorted(str([r[k] for k in names]) for r in out.collect()) == want


def test_pipeline(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    start = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(seen[0]) >= 0.95 * start
    assert len(set(" ".join(t.split()) for t in seen[1].values())) == len(seen[1])
    assert set(seen[2]) == {i for i, _, low in brute_components(sorted(seen[1].items()), 5, 80) if i == low}
    coder = bpe.encoding(queries.RANKS, queries.PATTERN)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() and all(r.round_trip for r in last)
    assert all(r.n_tokens == len(coder.encode_ordinary(seen[3][r.doc_id])) for r in last)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def bucket(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_op4_is_brute_force(spark, sf, documents):
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard(spark, sf).collect()], key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in documents], 3, 90)


def test_op6_reads_back_what_it_stored(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op6_ogg_media(spark, sf).collect()}
    assert len(got) == len(documents)
    for d in documents:
        raw = (d.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        lanes = [[payload[i : i + 1920] for i in range(0, len(payload), 1920)][k::2] for k in (0, 1)]
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        # 28 bytes of page header and lacing for each first page, and per page 27 and a lacing value for each 255 bytes begun.
        size = sum(28 + 22 + 27 * -(-sum(len(p) // 255 + 1 for p in lane) // 255) + sum(len(p) // 255 + 1 + len(p) for p in lane) for lane in lanes)
        assert abs(r.media_bytes - size) <= 27 * 4 and len(r.media_sha256) == 64
        mean, square = sum(payload) * 1000 // len(payload), sum(x * x for x in payload) // len(payload)
        assert r.feature == f"streams=2;packets={len(lanes[0])}+{len(lanes[1])};samples={len(payload)};end_ms={len(payload) * 1000 // 8000};peak={max(payload)};mean_milli={mean};square={square}"


def test_op7_is_plain_compression(spark, sf, documents):
    train = spark.read.parquet(f"{sf}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    learned = language_id.dictionaries(train)
    settings = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, write_content_size=False, **language_id.SETTINGS)
    coders = {k: zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in learned.items()}
    got = {r.doc_id: r for r in queries.op7_language_id(spark, sf).collect()}
    margin = language_id.fit_margin(train, learned)
    held = right = 0
    for d in documents:
        r = got[d.doc_id]
        assert r.held_out == (bucket(d.doc_id, 4) == 2) and 0 <= r.score <= 1
        if not regex.search(r"\p{L}", d.text or ""):
            assert r.lang_pred == "und" and not r.accepted
            continue
        raw = d.text.lower().encode()
        sizes = {k: len(c.compress(raw + language_id.PAD)) for k, c in coders.items()}
        least, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == least and r.accepted == (second > least and second - least >= margin * math.sqrt(least))
        held += r.held_out
        right += r.held_out and r.lang_pred == d.lang
    assert right >= 0.93 * held


def test_op8_is_the_formula(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    texts, shares = toxicity.sample(spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2), spark.read.parquet(f"{sf}/documents.parquet"))
    flat = [(t, c) for c in (0, 1) for i, t in enumerate(texts[c]) ]
    p = kneser_ney([t for t, _ in flat], [c for _, c in flat], toxicity.DISCOUNT)
    ratio = lambda w: math.log(p[1][0].get(w, p[1][1])) - math.log(p[0][0].get(w, p[0][1]))
    _, slope, intercept = toxicity.train(texts, shares)
    assert slope >= 0
    for d in documents:
        r = [ratio(w) for w in regex.findall(r"[\p{L}\p{N}\p{M}]+", ascii_lower(d.text or ""))]
        best = max(((a + b) / 2 for a, b in zip(r, r[1:], strict=False)), default=r[0] if r else 0.0)
        want = 1 / (1 + math.exp(-max(min(slope * best + intercept, 30), -30)))
        own = got[d.doc_id]
        assert own.score == pytest.approx(want, abs=1e-4) and own.predicted == (own.score >= 0.3) and own.held_out == (bucket(d.doc_id, 4) == 2)


def test_op9_is_tiktoken(spark, sf, documents):
    coder = bpe.encoding(queries.RANKS, queries.PATTERN)
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, sf).collect()}
    for d in documents:
        ids, r = coder.encode_ordinary(d.text or ""), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_op10_is_the_formula(spark, sf, documents):
    model = Trigrams([d.text for d in documents if bucket(d.doc_id, 5) != 1], lm.BIGRAM, lm.PRIOR)
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, sf).collect()}
    for d in documents:
        w, r = ["<s>", "<s>", *words(d.text), "</s>"], got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (bucket(d.doc_id, 5) == 1, len(w) - 2, sum(model.one[x] > 0 for x in w[2:]), model.n)
        assert r.base_score == pytest.approx(sum(math.log10(model.unigram(x)) for x in w[2:]), rel=1e-6)
        assert abs(r.score - sum(math.log10(model.p(*x)) for x in zip(w, w[1:], w[2:], strict=False))) <= 1e-4 * len(w) + 1e-6 * abs(r.score)


def test_empty_tables(spark, sf, tmp_path):
    """Every registered query of documents, and the pipeline, over tables without rows."""
    for t in ("documents", "labels", "pages", "conversations", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in [*queries.QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
        assert query(spark, str(tmp_path)).count() == 0, name
