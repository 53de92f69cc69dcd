"""A quality classifier from weak labels.

Eight heuristics vote on each text: good, bad or abstain. Texts are counted by
their pattern of votes (3^8 patterns at most, from partial sums), and
expectation-maximisation over the patterns estimates how each heuristic votes
on good and on bad texts, and so the posterior of each pattern. On a bounded
sample of texts, chosen by a hash of the id, the posteriors train a linear
scorer on hashed words and hashed word shapes, which then scores every whole
text. No label is read.

Bounds: ``sample`` texts of any length for the scorer's training, of which the
driver gets hashed features, 2^16 of a text at most; every text votes and is
scored whole; the model is 2^16 weights. A task holds the words of one text at a
time.

Defined results: a null, empty or blank text has no votes, so the prior is its
posterior, and nothing to be scored: its score is 0 and it is not kept. Equal
texts have equal results; rows that repeat an id, or have none, have a row each,
and rows without an id are not sampled; extra columns are not read; an empty
table gives an empty table. Documents are kept at a score of one half.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, raw, table

GOOD, BAD, ABSTAIN = 1, 0, 2
BUCKETS, SAMPLE, EPOCHS, RATE, ROUNDS, REMEMBERED, CUTOFF = 1 << 16, 4000, 6, 0.5, 200, 1 << 19, 0.5
SYMBOL, UPPER, LETTER = b"#$%&*|<>{}", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
LABELLERS = ("symbols", "capitals", "exclamations", "variety", "line_ends", "line_repeats", "word_length", "separators")


def _vote(x: float, bad_above: float, good_to: float) -> int:
    return BAD if x > bad_above else GOOD if x <= good_to else ABSTAIN


def votes(text: bytes) -> list[int]:
    words = text.split()
    n = len(words)
    if not n:
        return [ABSTAIN] * len(LABELLERS)
    count = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [s for line in text.split(b"\n") if (s := line.strip())]
    letters, length = count(LETTER), sum(map(len, words)) / n
    ended = sum(line.endswith((b".", b"!", b"?", b":", b'"')) for line in lines) / len(lines)
    return [
        _vote(count(SYMBOL) / n, 0.1, 0.01),
        _vote(count(UPPER) / max(1, letters), 0.4, 0.12),
        _vote(text.count(b"!") / n, 0.2, 0.02),
        ABSTAIN if n < 50 else _vote(1 - len(set(words)) / n, 0.6, 0.5),
        _vote(1 - ended, 0.5, 0.1),
        _vote(1 - len(set(lines)) / len(lines), 0.3, 0.05),
        BAD if length < 3 or length > 10 else GOOD if 3.5 <= length <= 7 else ABSTAIN,
        _vote(sum(map(words.count, (b"|", b"-", b"*", b"=", b"_", b"~", b"/"))) / n, 0.15, 0.01),
    ]


def pattern(text: bytes) -> int:
    out = 0
    for v in votes(text):
        out = out * 3 + v
    return out


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pattern(t) for t in batch.column(0).to_pylist()], pa.int32())], ["pattern"])


class LabelModel:
    """The prior of good and each labeller's vote shares given good and bad."""

    def __init__(self, prior: float, shares: np.ndarray):
        self.prior, self.shares = prior, shares

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = _digits(patterns)
        log = np.log(self.shares)[np.arange(v.shape[1])[None, :], :, v].sum(axis=1)
        # No vote at all is no evidence, however often each labeller abstains.
        evidence = np.where((v == ABSTAIN).all(axis=1), 0.0, log[:, GOOD] - log[:, BAD])
        z = evidence + np.log(self.prior) - np.log(1 - self.prior)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """How often each is right where it votes."""
        p = np.array([1 - self.prior, self.prior])
        right = p[GOOD] * self.shares[:, GOOD, GOOD] + p[BAD] * self.shares[:, BAD, BAD]
        given = (p[None, :, None] * self.shares[:, :, :ABSTAIN]).sum(axis=(1, 2))
        return dict(zip(LABELLERS, (right / given).tolist(), strict=True))


def _digits(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)], axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Starts from the majority of votes; good stays the class that more good votes speak for."""
    v = _digits(patterns)
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    q = (good + 0.5) / (good + bad + 1.0)
    shares = np.full((len(LABELLERS), 2, 3), 1 / 3)
    prior = 0.5
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - q), counts * q])
        new = np.empty_like(shares)
        for k in range(len(LABELLERS)):
            for c in (BAD, GOOD):
                # Two seen votes of the labeller's own sense keep a class that is rare from turning over.
                own = np.bincount(v[:, k], weights=weight[c], minlength=3) + np.array([0.5 + 2 * (c == BAD), 0.5 + 2 * (c == GOOD), 0.5])
                new[k, c] = own / own.sum()
        prior = float((weight[GOOD].sum() + 1) / (weight.sum() + 2))
        moved, shares = np.abs(new - shares).max(), new
        q = LabelModel(prior, shares).posterior(patterns)
        if moved < 1e-9:
            break
    return LabelModel(prior, shares)


_LOWER, _CAPITAL, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-Þ]+"), re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"\d+")


def word_features(word: bytes) -> tuple[int, int]:
    """Buckets of the word, A-Z in lower case, and of its shape: runs of small letters, capitals and digits as one sign each."""
    shape = _DIGIT.sub("0", _LOWER.sub("a", _CAPITAL.sub("A", word.decode("utf-8", "replace"))))
    return zlib.crc32(b"w" + word.lower()) % BUCKETS, zlib.crc32(b"s" + shape.encode("utf-8", "replace")) % BUCKETS


def variety_feature(words: list[bytes]) -> int:
    """Bucket of how many of a text's words are distinct, in tenths, which no single word shows."""
    return zlib.crc32(b"v%d" % (10 * len(set(words)) // max(1, len(words)) if len(words) >= 20 else 11)) % BUCKETS


class Weights(dict):
    """What each word adds to a text's score."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        a, b = word_features(word)
        self[word] = out = float(self.w[a] + self.w[b])
        return out

    def of(self, words: list[bytes]) -> float:
        return sum(map(self.__getitem__, words)) / len(words) + float(self.w[variety_feature(words)]) if words else 0.0


def shares_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's features and their shares of its words."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    k, n = np.unique(np.array([i for x in words for i in word_features(x)], np.int64), return_counts=True)
    return np.append(k, variety_feature(words)), np.append(n / len(words), 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], posterior: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on shares of hashed features, by Adagrad on soft labels."""
    w, s, bias, sb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3), 0.0, 1e-3
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            k, x = rows[i]
            g = 1 / (1 + np.exp(-np.clip(w[k] @ x + bias, -30, 30))) - posterior[i]
            grad = g * x
            s[k] += grad * grad
            w[k] -= RATE * grad / np.sqrt(s[k])
            sb += g * g
            bias -= RATE * g / np.sqrt(sb)
    return w, float(bias)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 64):
        texts = batch.column(1).to_pylist()
        rows = [shares_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([pattern(t) for t in texts], pa.int32()), pa.array([k for k, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["doc_id", "pattern", "buckets", "shares"]
        )


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, w, bias = shared.value
        weights = Weights(w)
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            known = labels.posterior(np.array([pattern(t) for t in texts], np.int64)) if texts else np.empty(0)
            words = map(bytes.split, texts)
            z = np.array([weights.of(x) if x else -np.inf for x in words])
            score = np.where(np.isinf(z), 0.0, 1 / (1 + np.exp(-np.clip(z + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known), pa.array(score)], ["doc_id", "posterior", "score"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray, float]:
    """docs(doc_id, text)."""
    counts = docs.select(raw("text")).mapInArrow(_patterns, "pattern int").groupBy("pattern").count().toArrow()
    labels = expectation_maximisation(counts["pattern"].to_numpy().astype(np.int64), counts["count"].to_numpy().astype(float))
    picked = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample).distinct()
    # At most a sample of ids. Of texts that share an id, the first in order is learned from.
    texts = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(raw("text")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern int, buckets array<long>, shares array<double>"
    found = texts.mapInArrow(_sampled, schema).orderBy("doc_id").toArrow()
    rows = [(np.asarray(k, np.int64), np.asarray(x)) for k, x in zip(found["buckets"].to_pylist(), found["shares"].to_pylist(), strict=True)]
    w, bias = train(rows, labels.posterior(found["pattern"].to_numpy().astype(np.int64)) if rows else np.empty(0))
    return labels, w, bias


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, posterior, score, kept), one row for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    out = docs.select("doc_id", raw("text")).mapInArrow(_judge(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, posterior double, score double")
    return out.withColumn("kept", F.col("score") >= CUTOFF)


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
