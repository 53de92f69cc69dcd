"""A convolutional text classifier for toxicity.

A word is the sum of hashed embeddings of itself and of its beginnings of three
to eight characters, so that an inflected form shares what its stem has learned. Filters of several widths run over a text's words, each keeps its
largest response, and a linear layer gives the log-odds. Trained in numpy with
Adagrad on a bounded sample of the labelled rows, the whole text of each; a
fifth of the sample is left out of training and calibrates the score (Platt's
scaling) and a threshold for each language, as far as it has enough positives.

Scoring is one pass without a shuffle. What a filter adds at a word depends on
the word alone, so it is worked out once for each distinct word and looked up.
A long text goes through in pieces that overlap by a window, and keeps the
largest responses of all of them.

Bounds: ``sample`` labelled rows of each class, none longer than ``longest``
bytes (training only; every text is scored whole); the model is 2^16 embeddings
and a few hundred filter weights.

Defined results: a null, empty or blank text has the score of no evidence;
without labels of both classes every score is 0; equal texts have equal scores;
repeated label rows of a document count once, as toxic if any is, and those of no
document not at all; rows that repeat an id, or have none, are scored each; extra columns are kept whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, released, table

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
SAMPLE, LONGEST, EPOCHS, BATCH, RATE, CALIBRATION = 1500, 32_768, 8, 32, 0.08, 5
CUTOFF, LEAST_POSITIVES, REMEMBERED, SLICE, SPREAD = 0.7, 15, 1 << 17, 1 << 18, 0.1
#: Rows whose texts, and words whose features, are Python or numpy objects at one time.
ROWS, WORDS = 1024, 1 << 13
STRIP = ".,;:!?\"'()[]{}|*-_"
crc = zlib.crc32
#: Seeds of the hashes of whole words and of their beginnings, by length.
WHOLE, BEGINNINGS = crc(b"="), tuple((k, crc(b"%d" % k)) for k in range(3, 9))
FEATURES = 1 + len(BEGINNINGS)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def features(word: str) -> list[int]:
    """Buckets of the word and of its beginnings; one that is the whole word is none, so a stem alone and its inflected forms can differ."""
    w = word.strip(STRIP)
    if w.isascii():
        b = w.encode()
        return [crc(b, WHOLE) % BUCKETS, *(crc(b[:k] if len(b) > k else b"", seed) % BUCKETS for k, seed in BEGINNINGS)]
    return [crc(w.encode("utf-8", "surrogatepass"), WHOLE) % BUCKETS, *(crc(w[:k].encode("utf-8", "surrogatepass") if len(w) > k else b"", seed) % BUCKETS for k, seed in BEGINNINGS)]


class Model:
    """Weights; ``embed`` (BUCKETS, DIM), ``conv[k]`` (width, DIM, FILTERS), ``out`` (FILTERS * widths), bias and scaling."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, SPREAD, (BUCKETS, DIM)).astype(np.float32)
        self.conv = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.b, self.scale, self.shift = 0.0, 1.0, 0.0

    def taps(self, feats: np.ndarray) -> list[np.ndarray]:
        """For each width and place in it, what words with these features add to the filters."""
        x = self.embed[feats].sum(axis=1)
        return [x @ c[j] for c in self.conv for j in range(len(c))]

    def pooled(self, ids: np.ndarray, ends: np.ndarray, taps: list[np.ndarray]) -> np.ndarray:
        """Largest responses (texts, filters), 0 where a text is shorter than a width."""
        first, out, t = np.cumsum(ends) - ends, np.zeros((len(ends), len(self.out)), np.float32), 0
        for k, w in enumerate(WIDTHS):
            have = np.flatnonzero(ends >= w)
            if len(have):
                n = len(ids) - w + 1
                r = taps[t][ids[:n]]
                for j in range(1, w):
                    r += taps[t + j][ids[j : n + j]]
                # A window may not reach into the next text: pairs of bounds, every second part of reduceat is wanted.
                bounds = np.stack([first[have], first[have] + ends[have] - w + 1], axis=1).ravel()
                bounds = bounds[:-1] if bounds[-1] >= n else bounds
                best = np.maximum.reduceat(r, bounds, axis=0)[::2]
                out[have, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best + self.bias[k], 0)
            t += w
        return out

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return self.score_of(pooled @ self.out + self.b)

    def score_of(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30).astype(float)))


def _flat(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    feats = np.array([features(w) for w in known], np.int64).reshape(-1, FEATURES)
    return ids, np.array([len(t) for t in texts], np.int64), feats


def train(texts: list[str], toxic: np.ndarray, langs: list[str | None], seed: int = 7) -> tuple[Model | None, dict]:
    """A model and its thresholds by language; None without both classes."""
    if len(set(toxic.tolist())) < 2:
        return None, {}
    model, rng = Model(seed), np.random.default_rng(seed)
    ids, ends, feats = _flat([words_of(t) for t in texts])
    first = np.cumsum(ends) - ends
    held = np.arange(len(texts)) % CALIBRATION == 0
    if len(set(toxic[~held].tolist())) < 2 or len(set(toxic[held].tolist())) < 2:
        held[:] = False
    learn = np.flatnonzero(~held & (ends > 0))
    toxic_rows = learn[toxic[learn] > 0]
    squares: dict[str, np.ndarray] = {"embed": np.full((BUCKETS, 1), 1e-6, np.float32)}

    def step(name: str, weight: np.ndarray, grad: np.ndarray) -> None:
        s = squares.setdefault(name, np.full_like(weight, 1e-6))
        s += grad * grad
        weight -= RATE * grad / np.sqrt(s)

    epochs = max(EPOCHS, min(60, 20_000 // max(1, len(learn))))
    for _ in range(epochs):
        # Toxic texts come up as often as the others.
        order = np.concatenate((learn, rng.choice(toxic_rows, len(learn) - 2 * len(toxic_rows)))) if 0 < 2 * len(toxic_rows) < len(learn) else learn.copy()
        rng.shuffle(order)
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            own = np.concatenate([ids[first[d] : first[d] + ends[d]] for d in docs])
            n_of, at = ends[docs], np.cumsum(ends[docs]) - ends[docs]
            used, local = np.unique(own, return_inverse=True)
            x = model.embed[feats[used]].sum(axis=1)
            h, args = np.zeros((len(docs), len(model.out)), np.float32), []
            for k, w in enumerate(WIDTHS):
                n = len(local) - w + 1
                arg = np.zeros((len(docs), FILTERS), np.int64)
                if n > 0:
                    r = sum((x @ model.conv[k][j])[local[j : n + j]] for j in range(w))
                    for d in range(len(docs)):
                        if n_of[d] >= w:
                            part = r[at[d] : at[d] + n_of[d] - w + 1]
                            a = part.argmax(axis=0)
                            arg[d] = a + at[d]
                            h[d, k * FILTERS : (k + 1) * FILTERS] = part[a, np.arange(FILTERS)] + model.bias[k]
                args.append(arg)
            np.maximum(h, 0, out=h)
            drop = (rng.random(h.shape) > 0.3).astype(np.float32) / 0.7
            p = 1 / (1 + np.exp(-np.clip((h * drop) @ model.out + model.b, -30, 30)))
            g = ((p - toxic[docs]) / len(docs)).astype(np.float32)
            gh = g[:, None] * model.out * drop * (h > 0)
            step("out", model.out, (h * drop).T @ g + 1e-4 * model.out)
            model.b -= RATE * float(g.sum())
            gx = np.zeros_like(x)
            for k, w in enumerate(WIDTHS):
                gk = gh[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(model.conv[k])
                rows, cols = np.nonzero(gk)
                value = gk[rows, cols]
                for j in range(w):
                    word = local[args[k][rows, cols] + j]
                    np.add.at(grad[j].T, cols, value[:, None] * x[word])
                    np.add.at(gx, word, value[:, None] * model.conv[k][j].T[cols])
                step(f"conv{k}", model.conv[k], grad)
                step(f"bias{k}", model.bias[k], gk.sum(axis=0))
            hit = np.flatnonzero(np.abs(gx).sum(axis=1))
            if len(hit):
                rows, inv = np.unique(feats[used[hit]].ravel(), return_inverse=True)
                grad = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad, inv, np.repeat(gx[hit], FEATURES, axis=0))
                s = squares["embed"]
                s[rows] += (grad * grad).mean(axis=1, keepdims=True)
                model.embed[rows] -= RATE * grad / np.sqrt(s[rows])
    taps = model.taps(feats) if len(feats) else []
    z = np.full(len(texts), model.b)
    for i in range(0, len(texts), 64):
        part = slice(first[i], first[min(i + 64, len(texts)) - 1] + ends[min(i + 64, len(texts)) - 1])
        z[i : i + 64] = model.pooled(ids[part], ends[i : i + 64], taps) @ model.out + model.b
    on = held if held.any() else ~held
    model.scale, model.shift = _platt(z[on], toxic[on])
    # The cutoff stands where the classes are told apart best, whatever the share of toxic rows in the sample.
    best = _best_cutoff(model.score_of(z[on]), toxic[on])
    model.shift += float(np.log(CUTOFF / (1 - CUTOFF)) - np.log(best / (1 - best)))
    return model, _thresholds(model.score_of(z[on]), toxic[on], [x for x, y in zip(langs, on, strict=True) if y])


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through softened labels, by Newton's steps; the slope stays positive."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a: float, b: float) -> float:
        u = a * z + b
        return float((np.logaddexp(0, u) - t * u).sum())

    now = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        ga, gb = ((p - t) * z).sum(), (p - t).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-9, (w * z).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db, size = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while size > 1e-6 and loss(a - size * da, b - size * db) >= now:
            size /= 2
        if size <= 1e-6:
            break
        a, b = a - size * da, b - size * db
        now = loss(a, b)
    return (float(a), float(b)) if np.isfinite(a + b) and a > 0.01 else (1.0, 0.0)


def _thresholds(score: np.ndarray, y: np.ndarray, langs: list[str | None]) -> dict:
    """For each language the score that separates its classes best; of the best, the one nearest to the usual cutoff."""
    out = {}
    for lang in {x for x in langs if x is not None}:
        mine = np.array([x == lang for x in langs])
        s, t = score[mine], y[mine]
        if t.sum() < LEAST_POSITIVES or t.sum() == len(t):
            continue
        out[lang] = _best_cutoff(s, t)
    return out


def _best_cutoff(score: np.ndarray, y: np.ndarray) -> float:
    """The cutoff of the highest F1; of several as good, the one nearest to the usual cutoff."""
    tries = np.unique(np.concatenate([np.linspace(0.3, 0.95, 14), [CUTOFF]]))
    right = np.array([2 * ((score >= c) & (y == 1)).sum() / max(1, (score >= c).sum() + y.sum()) for c in tries])
    best = tries[right >= right.max() - 0.005]
    return float(best[np.argmin(np.abs(best - CUTOFF))])


def pieces_of(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text in pieces of about a size, cut at spaces."""
    at = 0
    while len(text) - at > size:
        to = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size))
        if to <= at:
            to = min((x for x in (text.find(b" ", at + size), text.find(b"\n", at + size)) if x >= 0), default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


class Scorer:
    """Scores texts slice by slice; what filters add at the words met so far is remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known, self.taps = model, {}, []

    def ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.taps, new = {}, [], list(set(words))
        at = len(self.known)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        if new and (not self.taps or at + len(new) > len(self.taps[0])):
            # Of the whole bound at once: pages that nothing is written to take no memory, and nothing is copied.
            self.taps = [np.empty((max(REMEMBERED, len(new)), FILTERS), np.float32) for _ in range(sum(WIDTHS))]
        for i in range(0, len(new), WORDS):
            more = self.model.taps(np.array([features(w) for w in new[i : i + WORDS]], np.int64))
            for x, y in zip(self.taps, more, strict=True):
                x[at + i : at + i + len(y)] = y
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.model.out)), np.float32)
        of, words, ends, size = [], [], [], 0

        def add() -> None:
            ids = self.ids(words)
            np.maximum.at(out, of, self.model.pooled(ids, np.array(ends, np.int64), self.taps))

        for i, text in enumerate(texts):
            past: list[str] = []
            for piece in pieces_of(text):
                if size and size + len(piece) > SLICE:
                    add()
                    of, words, ends, size = [], [], [], 0
                # A window that begins in one piece ends in the next.
                own = past + words_of(piece.decode("utf-8", "replace"))
                past = own[len(own) - max(WIDTHS) + 1 :] if len(own) >= max(WIDTHS) else own
                of.append(i)
                words += own
                ends.append(len(own))
                size += len(piece)
        if of:
            add()
        return self.model.score(out)


def _score(shared):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for texts in columns:
            s = np.zeros(len(texts))
            for i in range(0, len(texts) if scorer else 0, ROWS):
                s[i : i + ROWS] = scorer.scores(texts.slice(i, ROWS).to_pylist())
            yield pa.array(s)
        scorer = None
        released()

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> tuple[Model | None, dict]:
    """Fitted on labels(doc_id, toxic): of each class the ``sample`` rows whose hash of the id is smallest."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    key = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id")]
    picked = one.where("toxic = 1").orderBy(*key).limit(sample).union(one.where("toxic = 0").orderBy(*key).limit(sample))
    # At most two samples of ids.
    rows = docs.select("doc_id", "text", "lang").where(F.octet_length("text") <= longest).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.first("toxic").alias("toxic")).toArrow()
    order = np.argsort([zlib.crc32(f"fit {x}".encode()) for x in rows["doc_id"].to_pylist()], kind="stable")
    texts, langs, toxic = rows["text"].to_pylist(), rows["lang"].to_pylist(), rows["toxic"].to_pylist()
    return train([texts[i] for i in order], np.array([toxic[i] for i in order], float), [langs[i] for i in order])


def score_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """(own, score): the row as it was, as a struct, and its score. Only texts go to Python, once, and only scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.struct("*").alias("own"), F.arrow_udf(_score(shared), "double")(raw(text)).alias("score"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only these rows are learned from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return labels.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, limits = fit(docs, training_labels(spark, sf_dir))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    out = score_documents(docs.select("doc_id", "text"), model).select("own.doc_id", "score")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def threshold(limits: dict, lang: str = "own.lang") -> F.Column:
    """The threshold of a row's language; the usual cutoff where the language has none."""
    out = F.lit(CUTOFF)
    for name, value in limits.items():
        out = F.when(F.col(lang) == name, value).otherwise(out)
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold stay."""
    model, limits = fit(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return score_documents(docs, model).where(F.col("score") < threshold(limits)).select("own.*")
