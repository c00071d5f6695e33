"""Toxicity scores from two class-conditional Kneser-Ney models with a shared backoff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged, unstage
from quern.llm.hashing import U, slices, text_bytes, word_hashes

#: The bounded sample: at most so many labelled documents of either class, and so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 20_000
#: What is taken off every count: a word with as many different contexts in a class, or fewer, is left to the backoff.
DISCOUNT = 3.0
#: Words of a window, the length that likelihoods are compared at.
WINDOW = 2


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with punctuation set apart: marks at a word's ends don't make another word."""
    return word_hashes(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[^\p{L}\p{N}\p{M}]+", " "))


class Model:
    """p(w | c) for the classes 0 and 1: Kneser-Ney with the class as the context.

    A word counts in a class once for each different word before it, so that copies of a text add nothing. DISCOUNT
    is taken off every count and goes to the shared level: in how many of the classes a word occurs at all. So a rare word
    of one class gets almost the same probability in both, and only words that a class has in many contexts
    weigh. ``ratio`` is log p(w | 1) - log p(w | 0) of each word, ``unknown`` that of any other.
    """

    def __init__(self, hashes: np.ndarray, at: np.ndarray, label: np.ndarray, discount: float = DISCOUNT):
        owner = np.repeat(label, np.diff(at))
        self.words, word = np.unique(hashes, return_inverse=True)
        pairs = (word.astype(U) << U(32)) | (np.roll(word, 1) + 1).astype(U)
        opens = at[:-1][at[:-1] < len(word)]
        pairs[opens] = word[opens].astype(U) << U(32)  # nothing before
        counts = [np.bincount((np.unique(pairs[owner == c]) >> U(32)).astype(np.int64), minlength=len(self.words)) for c in (0, 1)]
        del pairs, word, owner
        classes = (counts[0] > 0).astype(int) + (counts[1] > 0)
        whole = classes.sum() + 0.5 * (len(self.words) + 1)
        shared, unseen = (classes + 0.5) / whole, 0.5 / whole
        self.p, self.p_unknown = [], []
        for n in counts:
            left = np.minimum(n, discount).sum() / n.sum() if n.sum() else 1.0
            self.p.append(np.maximum(n - discount, 0) / max(n.sum(), 1) + left * shared)
            self.p_unknown.append(left * unseen)
        self.ratio = (np.log(self.p[1]) - np.log(self.p[0])).astype(np.float32)
        self.unknown = float(np.log(self.p_unknown[1]) - np.log(self.p_unknown[0]))

    def compare(self, hashes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Per text the log-likelihood per word, toxic less ordinary, of the window where it is largest; 0 without words.

        All windows of ``window`` words count, or the whole text if it is shorter: what makes a text toxic are a few
        words anywhere in it, which a mean over a long text would hide.
        """
        out = np.zeros(len(at) - 1)
        if not len(self.words) or not len(hashes):
            return out
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        value = np.where(self.words[place] == hashes, self.ratio[place], self.unknown)
        total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        size = np.minimum(np.diff(at), window)
        for w in range(1, window + 1):  # texts of w words or, at last, more
            own = np.flatnonzero(size == w)
            if len(own):
                starts = np.diff(at)[own] - w + 1
                first = np.cumsum(starts) - starts
                begin = np.repeat(at[own] - first, starts) + np.arange(int(starts.sum()))
                out[own] = np.maximum.reduceat(total[begin + w] - total[begin], first) / w
        return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) / 1000, x.T @ (y - p) - ridge * len(x) * w / 1000)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(labels: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> tuple[list[list[str]], list[int]]:
    """Texts of a bounded sample of either class, and how many labelled rows each class has.

    Of each class the ``most`` keys of smallest hash are taken that have a text of at most ``size`` bytes, so at
    most 2 * most * size bytes come to the driver; the chosen keys alone are broadcast. Rows whose label isn't 0 or 1, whose
    key has no document or whose text is null teach nothing. Repeated rows teach once.
    """
    shares = {int(r[0]): r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    fit = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= size))
    marked = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("c"), F.xxhash64(key).alias("h")).distinct()
    eligible = marked.join(fit.select(F.col(key).alias("k")), "k", "left_semi")
    chosen = staged(eligible.where("c = 0").orderBy("h", "k").limit(most).unionByName(eligible.where("c = 1").orderBy("h", "k").limit(most)), narrow=True)
    rows = fit.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("c", "h", "k", "t").distinct().sort("h", "k", "t").collect()
    unstage(chosen)
    return [[r.t for r in rows if r.c == c] for c in (0, 1)], [shares.get(0, 0), shares.get(1, 0)]


def train(texts: list[list[str]], shares: list[int]) -> tuple[Model, float, float] | None:
    """(model, slope, intercept): score = logistic(slope * log ratio + intercept).

    The model counts the whole sample. The scale is fitted on ratios that each third of it has by the counts of the two
    others, and its intercept is then moved to the classes' true shares. Few texts tell little about the scale, and the score is nearer to the
    shares then. None if a class has no text.
    """
    if not min(map(len, texts)):
        return None
    hashes, at = plain(pa.array([t for own in texts for t in own]))
    label = np.repeat([0, 1], [len(own) for own in texts])
    prior = float(np.log(shares[1] / shares[0]))
    model = Model(hashes, at, label)
    part, x, sizes = np.concatenate([np.arange(len(own)) % 3 for own in texts]), np.zeros(len(label)), np.diff(at)
    for k in range(3):
        inside = np.repeat(part == k, sizes)
        (fit, fit_at), (tune, tune_at) = ((hashes[inside == own], np.append(0, np.cumsum(sizes[(part == k) == own]))) for own in (False, True))
        x[part == k] = Model(fit, fit_at, label[part != k]).compare(tune, tune_at)
    mean, spread = x.mean(), x.std() + 1e-9
    w = logistic(((x - mean) / spread)[:, None], label)
    slope = max(float(w[0]), 0.0) / spread  # the score never falls as the ratio rises
    return model, slope, float(w[1] - slope * mean + prior - np.log(len(texts[1]) / len(texts[0])))


def score(docs: DataFrame, learned, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, score (the probability of label 1), log_ratio (per word, of the window) and n_words.

    The whole text is read; null counts as empty, which has log_ratio 0. Without a model (see ``train``) every score
    is 0. The model is bounded by its sample, so it goes to the executors as a broadcast variable. Rows are scored one
    by one: repeated ones and ties get equal scores, an empty table none, and other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for low, high in slices(np.diff(text_bytes(whole.column(1))[1]), 6 << 20):
                batch = whole.slice(low, high - low)
                hashes, at = plain(batch.column(1))
                ratio, p = np.zeros(high - low), np.zeros(high - low)
                if known is not None:
                    model, slope, intercept = known
                    ratio = model.compare(hashes, at)
                    p = 1 / (1 + np.exp(-np.clip(slope * ratio + intercept, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(ratio), pa.array(np.diff(at))], names=["doc_id", "score", "log_ratio", "n_words"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, log_ratio double, n_words long")
