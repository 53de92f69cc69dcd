"""A probabilistic suffix tree over words scores every text.

Symbols are the words of a text, A-Z in lower case, after one start and before
one end. A context is up to ``depth`` preceding symbols. Every context that some
symbol follows ``least`` times is a candidate, whatever its words are; a pair that
is rarer is no evidence of a state. With absolute discounting (Kneser and Ney's D, the rest going to the
suffix of the context; the root is add-one over the training words)

    P(w | c) = max(n(c w) - D, 0) / n(c) + rest(c) * P(w | suffix(c))

and a candidate is retained if this makes its own training symbols likelier than
its suffix does, by more log-likelihood than its number of distinct symbols
costs. Suffixes of what is retained are retained, so the retained contexts are a
suffix tree, and a symbol is predicted by the longest suffix state before it.

Nothing of this is built on the driver. Contexts and symbols are 64-bit hashes,
and the hash of a context and its next symbol is the hash of the longer context,
by a function that Spark has too. Counts, probabilities and tests are tables.

* Depth by depth, tasks count their (context, symbol) pairs and send the sums,
  in blocks of arrays by the hash of the pair, so no context is one task's alone.
  A pair can only be frequent if its context and its suffix pair were, one depth
  before; a Bloom filter of those that were spares the others the way. Its size
  has a bound, ``blocks`` 64-bit words. Where it fills up, more pairs travel and
  are dropped after counting, with the same result.
* The log-probability of a text is a sum over its n-grams: with D the gain of a
  pair over its suffix pair and L the logarithm of a context's rest, every symbol
  gets its root's log-probability, every retained context before it adds L, and
  every pair of a retained context adds D - L. So each n-gram has one weight, of
  itself as a pair and as a context, and scoring is a join of n-grams with
  weights. The ``hot`` most frequent weights, a fixed number, are broadcast and
  added up in the pass over the texts; only n-grams of the others leave the task,
  in blocks of arrays by their hash, and no key of theirs is frequent.

Texts are cut at white space into parts of a bounded size as they are read, so a
text of any length takes bounded memory. Words are hashed in numpy by a
polynomial over their bytes; equal 64-bit hashes are taken for equal.

Defined results: a null, empty or blank text has one token, its end; a null
document id counts as the empty string in the choice of training texts; rows
that repeat an id are texts of their own in training and results; without
training texts every score is that of an empty vocabulary; extra columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, once, raw, released, table, tasks

DEPTH, LEAST, DISCOUNT, COST = 3, 4, 0.75, 3.0
#: Symbols that are no words; bytes of a part of a text; symbols whose pairs a task adds up; words of a filter; weights that are broadcast.
START, END, PART, HELD, BLOCKS, HOT = 1, 2, 1 << 20, 1 << 21, 1 << 22, 1 << 19

_U = np.uint64
_RNG = np.random.default_rng(64)
_BYTES = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BASE = int(_RNG.integers(0, 1 << 63)) * 2 + 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
# The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(P2)
    h = (h ^ (h >> _U(29))) * _U(P3)
    return h ^ (h >> _U(32))


def _hashed(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 8 bytes, as Spark's xxhash64 has it for a long."""
    k = x * _U(P2)
    k = ((k << _U(31)) | (k >> _U(33))) * _U(P1)
    h = (np.asarray(seed, _U) + _U(P5) + _U(8)) ^ k
    return _finished(((h << _U(27)) | (h >> _U(37))) * _U(P1) + _U(P4))


def longer(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The context that ends with one more symbol: F.xxhash64(context, symbol)."""
    return _hashed(symbol, _hashed(context, 42))


class Part(NamedTuple):
    """Symbols in their order, the text that each is of, its place there (the start has 0), and how many are there only to be looked back at."""

    symbol: np.ndarray
    text: np.ndarray
    place: np.ndarray
    old: int


class Reader:
    """Symbols of texts, part by part; of a text that goes on the last ``depth`` are kept."""

    def __init__(self, depth: int, part: int = PART):
        self.depth, self.part = depth, part
        self.up, self.down = _powers(_BASE, part), _powers(pow(_BASE, -1, 1 << 64), part)

    def words(self, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of b and where they begin; cuts: where texts begin."""
        blank = _BLANK[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[0] = edge[-1] = True
        edge[cuts] = True
        begins = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
        ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
        if len(b) > len(self.up):
            self.up, self.down = _powers(_BASE, len(b)), _powers(pow(_BASE, -1, 1 << 64), len(b))
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTES[b] * self.up[: len(b)])))
        return _finished((sums[ends] - sums[begins]) * self.down[begins] + (ends - begins).astype(_U)), begins

    def parts(self, texts: pa.Array) -> Iterator[Part]:
        """Of a binary array without nulls."""
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            last = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.part, "right")) - 1)
            at, stop, past = int(offsets[i]), int(offsets[last]), None
            # One text that is longer than a part goes on from blank to blank.
            while stop - at > self.part:
                to = self._after_blank(data, at, stop)
                if to == stop:
                    break
                made = self._part(data[at:to], np.zeros(1, np.int64), i, last, past, False)
                yield made
                past, at = (made.symbol[-self.depth :], made.place[-self.depth :]), to
            yield self._part(data[at:stop], np.maximum(offsets[i:last], at) - at, i, last, past, True)
            i = last

    def _after_blank(self, data: np.ndarray, at: int, stop: int) -> int:
        """Behind the last blank of the next part; if it has none, behind the first one after it."""
        to = at + self.part
        gaps = np.flatnonzero(_BLANK[data[at:to]])
        if len(gaps):
            return at + int(gaps[-1]) + 1
        while to < stop:
            gaps = np.flatnonzero(_BLANK[data[to : min(stop, to + self.part)]])
            if len(gaps):
                return to + int(gaps[0]) + 1
            to += self.part
        return stop

    def _part(self, b: np.ndarray, cuts: np.ndarray, first: int, last: int, past, ends: bool) -> Part:
        h, begins = self.words(b, cuts[cuts < len(b)])
        n = last - first
        of = np.searchsorted(cuts, begins, "right") - 1 if n > 1 else np.zeros(len(h), np.int64)
        count = np.bincount(of, minlength=n)
        head = 0 if past else 1
        size = count + head + (1 if ends else 0)
        start = np.cumsum(size) - size
        symbol = np.empty(int(size.sum()), _U)
        text = np.repeat(np.arange(n), size)
        place = np.arange(len(symbol)) - start[text]
        if head:
            symbol[start] = START
        if ends:
            symbol[start + size - 1] = END
        symbol[np.arange(len(h)) + (head + (head + (1 if ends else 0)) * of)] = h
        if past:
            symbols, places = past
            place += int(places[-1]) + 1
            symbol, place = np.concatenate((symbols, symbol)), np.concatenate((places, place))
            text = np.zeros(len(symbol), np.int64)
        return Part(symbol, text + first, place, len(past[0]) if past else 0)


def grams(p: Part, depth: int) -> list[np.ndarray]:
    """Hashes of the last 1, 2, ... depth + 1 symbols at each place; nonsense where the text has no so many."""
    out = [p.symbol]
    for _ in range(depth):
        before = np.concatenate((np.zeros(1, _U), out[-1][:-1]))
        out.append(longer(before, p.symbol))
    return out


class Filter:
    """Membership among 64-bit keys: no for none that is there. ``words``: four bits of each key in the word that its first bits name."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, _U(64 - (len(words).bit_length() - 1))

    def maybe(self, key: np.ndarray) -> np.ndarray:
        one, word = _U(1), self.words[key >> self.shift if len(self.words) > 1 else np.zeros(len(key), np.int64)]
        bits = (one << (key & _U(63))) | (one << ((key >> _U(6)) & _U(63))) | (one << ((key >> _U(12)) & _U(63))) | (one << ((key >> _U(18)) & _U(63)))
        return (word & bits) == bits


def filter_of(keys: DataFrame, n: int, blocks: int = BLOCKS) -> Filter:
    """Of keys(key): 16 bits for each of n keys, ``blocks`` words at most, put together by partial ors and brought to the driver."""
    size = 1 << max(0, min(int(max(1, n) * 16 // 64).bit_length(), blocks.bit_length() - 1))
    key, one = F.col("key"), F.lit(1).cast("long")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(key, by).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned(key, 64 - (size.bit_length() - 1)) if size > 1 else F.lit(0).cast("long")
    with once(keys.sparkSession):
        found = keys.groupBy(word.alias("word")).agg(F.bit_or(bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))).alias("bits")).toArrow()
    words = np.zeros(size, _U)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return Filter(words)


def _summed(key: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same by key, with counts of equal keys added up."""
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    at = order[first]
    return key[at], context[at], symbol[at], np.add.reduceat(n[order], first)


BLOCK = "block int, contexts binary, symbols binary, n binary"


def _pair_counts(depths: tuple[int, ...], blocks: int, shared):
    """Blocks of pairs with contexts of these depths; depth 0 counts symbols. shared: a Filter of the pairs one depth before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter | None = shared.value if shared is not None else None
        reader, rows, held = Reader(max(*depths, 1)), [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            key, c, w, n = _summed(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            # Keys are in order, so a block is a range of them; within it contexts are brought together, which packs them well.
            cuts = np.searchsorted(key, (np.arange(1, blocks, dtype=_U) * _U((1 << 64) // blocks)))
            bounds = np.concatenate(([0], cuts, [len(key)]))
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                by = bounds[i] + np.argsort(c[bounds[i] : bounds[i + 1]])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x[by].astype(t).tobytes()], pa.binary()) for x, t in ((c, _U), (w, _U), (n, np.uint32)))], ["block", "contexts", "symbols", "n"])

        for batch in batches:
            for p in reader.parts(batch.column(0)):
                h = grams(p, max(depths))
                for d in depths:
                    ok = p.place >= d
                    ok[: p.old] = False
                    at = np.flatnonzero(ok)
                    if d and known is not None:
                        at = at[known.maybe(h[d - 1][at])]
                        at = at[known.maybe(h[d - 1][at - 1])]
                    if len(at):
                        key, i, n = np.unique(h[d][at], return_index=True, return_counts=True)
                        at = at[i]
                        rows.append((key, h[d - 1][at - 1] if d else np.zeros(len(at), _U), p.symbol[at], n))
                        held += len(at)
                if held >= HELD:
                    yield from emit()
                    rows, held = [], 0
        if rows:
            yield from emit()
        rows.clear()
        released()

    return run


def _frequent(least: int):
    """(context, symbol, n) of blocks: symbols, whose context is 0, and pairs that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for x, column, t in zip(parts, batch.columns[1:], (_U, _U, np.uint32), strict=True):
                x += [np.frombuffer(b.as_buffer(), t) for b in column]
        if parts[0]:
            c, w, n = (np.concatenate(x) for x in parts)
            _, c, w, n = _summed(np.where(c == 0, w, longer(c, w)), c, w, n.astype(np.int64))
            keep = np.flatnonzero((c == 0) | (n >= least))
            for i in range(0, len(keep), 1 << 16):
                at = keep[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(c[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(n[at])], ["context", "symbol", "n"])
        parts.clear()
        released()

    return run


def count_pairs(texts: DataFrame, depths: tuple[int, ...], least: int, known: Filter | None = None) -> DataFrame:
    """(context, symbol, n) of texts(text): symbols, whose context is 0, and pairs that occur ``least`` times."""
    n = tasks(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(known) if known is not None else None
    blocks = texts.mapInArrow(_pair_counts(depths, 8 * n, shared), BLOCK).repartition(n, "block")
    return cut(blocks.mapInArrow(_frequent(least), "context long, symbol long, n long"), "pairs")


class Tree(NamedTuple):
    """Training tokens and words, the weights (key, v, v0, n) of n-grams, and the retained contexts (context, depth)."""

    tokens: int
    distinct: int
    weights: DataFrame
    contexts: DataFrame


def grow(texts: DataFrame, depth: int = DEPTH, least: int = LEAST, discount: float = DISCOUNT, cost: float = COST) -> Tree:
    """The tree of texts(text)."""
    first = count_pairs(texts, (0, 1), least)
    root = cut(first.where("context = 0").select("symbol", "n"), "symbols")
    words = root.where(F.col("symbol") != START)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    p0 = (F.col("n") + 1) / F.lit(float(tokens + distinct + 1))

    zero = F.lit(0).cast("long").alias("up")
    contexts = root.where((F.col("symbol") != END) & (F.col("n") >= least)).select(F.col("symbol").alias("context"), zero, F.col("n").alias("total"))
    before = words.where(F.col("n") >= least).select(zero, "symbol", p0.alias("q"))
    pairs, source, levels, tests = first.where("context <> 0"), first, [], []
    for d in range(1, depth + 1):
        seen = pairs.groupBy("context").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("kinds"))
        total = F.col("total").cast("double")
        rest = (F.col("total") - F.col("seen") + discount * F.col("kinds")) / total
        contexts = cut(contexts.join(seen, "context").select("context", "up", "total", "seen", "kinds", rest.alias("rest")), "contexts")
        level = pairs.join(contexts, "context").join(before, ["up", "symbol"])
        level = cut(level.select("context", "up", "symbol", "n", ((F.col("n") - discount) / total + F.col("rest") * F.col("q")).alias("p"), "q"), "level")
        discard(source)
        gains = level.groupBy("context").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).alias("gain"))
        passed = F.col("gain") + (F.col("total") - F.col("seen")) * F.log("rest") > F.col("kinds") + cost
        tests.append(cut(contexts.join(gains, "context").select("context", "up", "total", "rest", passed.alias("passed")), "tests"))
        discard(contexts)
        levels.append(level)
        if d < depth:
            key = F.xxhash64("context", "symbol")
            up = F.col("symbol") if d == 1 else F.xxhash64("up", "symbol")
            contexts = level.where(F.col("symbol") != END).select(key.alias("context"), up.alias("up"), F.col("n").alias("total"))
            before = level.select(F.col("context").alias("up"), "symbol", F.col("p").alias("q"))
            source = pairs = count_pairs(texts, (d + 1,), least, filter_of(level.select(key.alias("key")), level.count()))

    # From the deepest up: what passes, and what a retained context is an extension of.
    kept, needed = [], None
    for test in reversed(tests):
        own = test.where("passed")
        if needed is not None:
            own = own.select("context").union(needed).distinct().join(test, "context")
        own = cut(own.select("context", "up", "total", "rest"), "kept")
        kept.insert(0, own)
        needed = own.select(F.col("up").alias("context")).distinct()

    log_rest, none = F.log10("rest"), F.lit(0.0)
    weights = words.select(F.col("symbol").alias("key"), F.log10(p0).alias("v"), F.log10(p0).alias("v0"), "n")
    for own, level in zip(kept, levels, strict=True):
        entries = level.join(own.select("context", "rest"), "context")
        weights = weights.union(entries.select(F.xxhash64("context", "symbol").alias("key"), F.log10(F.col("p") / F.col("q")) - log_rest, none, "n"))
        weights = weights.union(own.select("context", log_rest, none, "total"))
    weights = cut(weights.groupBy("key").agg(F.sum("v").alias("v"), F.sum("v0").alias("v0"), F.max("n").alias("n")), "weights")
    discard(root, *levels, *tests)
    found = kept[0].select("context", F.lit(1).alias("depth"))
    for d, own in enumerate(kept[1:], 2):
        found = found.union(own.select("context", F.lit(d)))
    return Tree(tokens, distinct, weights, found)


KINDS = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
SUMS = "row long, n_tokens long, n_known long, base double, score double"
ASKED = "block int, least long, rows binary, keys binary, n binary"


def _scores(depth: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what can be said of it here, and blocks of n-grams whose weights have to be looked up."""
        known, keys, v, v0 = shared.value
        reader, rows, held = Reader(depth), [], 0

        def ask() -> Iterator[pa.RecordBatch]:
            row, key, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(key)
            row, key, n = row[order], key[order], n[order]
            least = int(row.min())
            bounds = np.searchsorted(key, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)) if bits else np.empty(0, np.int64)
            bounds = np.concatenate(([0], bounds, [len(key)]))
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                at = slice(bounds[i], bounds[i + 1])
                own = [pa.array([i], pa.int32()), pa.array([least]), *(pa.array([x.tobytes()], pa.binary()) for x in ((row[at] - least).astype(np.uint32), key[at], n[at].astype(np.uint32)))]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *(pa.nulls(1, t) for t in (pa.int64(), *KINDS.values())), *own], names)

        kind, names = None, ["own", "row", *KINDS, "block", "least", "rows", "keys", "n"]
        for batch in batches:
            ids, own = batch.column(0), batch.column(1)
            kind = own.type
            for p in reader.parts(batch.column(2)):
                lo = int(p.text[0])
                n = int(p.text[-1]) - lo + 1
                new = np.arange(len(p.symbol)) >= p.old
                sums = {x: np.zeros(n) for x in ("n_known", "base", "score")}
                cold = []
                for d, h in enumerate(grams(p, depth)):
                    at = np.flatnonzero(new & (p.place >= d))
                    if d:
                        at = at[known.maybe(h[at])]
                    order = np.argsort(h[at])
                    at = at[order]
                    key, text = h[at], p.text[at] - lo
                    j = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                    hot = keys[j] == key if len(keys) else np.zeros(len(key), bool)
                    sums["score"] += np.bincount(text[hot], weights=v[j[hot]], minlength=n)
                    if d == 0:
                        sums["base"] += np.bincount(text[hot], weights=v0[j[hot]], minlength=n)
                        sums["n_known"] += np.bincount(text[hot], weights=v0[j[hot]] != 0, minlength=n)
                    cold.append((text[~hot], key[~hot]))
                tokens = np.bincount(p.text[new & (p.symbol != START)] - lo, minlength=n)
                values = [tokens.astype(np.int64), sums["n_known"].astype(np.int64), sums["base"], sums["score"]]
                nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([own.slice(lo, n), ids.slice(lo, n), *map(pa.array, values), *nothing], names)
                text, key = (np.concatenate(x) for x in zip(*cold, strict=True))
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(key) != 0)))) if len(key) else np.empty(0, np.int64)
                if len(first):
                    rows.append((ids.to_numpy()[lo + text[first]], key[first], np.diff(np.append(first, len(key)))))
                    held += len(first)
                if held >= HELD:
                    yield from ask()
                    rows, held = [], 0
        if rows:
            yield from ask()
        rows.clear()
        released()

    return run


#: Texts whose sums are brought together by one group, by the leading bits of their rows.
GROUP = 13
FOUND = "group long, rows binary, n_known binary, base binary, score binary"


def _found(asked: pa.Table, weights: pa.Table) -> pa.Table:
    """What the n-grams of a block add to their rows, in arrays by group of rows."""
    key = weights["key"].to_numpy().view(_U)
    order = np.argsort(key)
    key, v, v0 = key[order], weights["v"].to_numpy()[order], weights["v0"].to_numpy()[order]
    out: list[list] = [[], [], [], [], []]
    for least, rows, keys, n in zip(*(asked[c].to_pylist() for c in ("least", "rows", "keys", "n")), strict=True):
        if not len(key):
            break
        ask = np.frombuffer(keys, _U)
        j = np.minimum(np.searchsorted(key, ask), len(key) - 1)
        hit = key[j] == ask
        row, j, k = np.frombuffer(rows, np.uint32)[hit].astype(np.int64) + least, j[hit], np.frombuffer(n, np.uint32)[hit].astype(float)
        at, own = np.unique(row, return_inverse=True)
        sums = [np.bincount(own, weights=k * x, minlength=len(at)) for x in (v0[j] != 0, v0[j], v[j])]
        cuts = np.flatnonzero(np.diff(at >> GROUP)) + 1
        for part in zip(*(np.split(x, cuts) for x in (at, *sums)), strict=True):
            if len(part[0]):
                out[0].append(int(part[0][0]) >> GROUP)
                for x, y in zip(out[1:], part, strict=True):
                    x.append(y.tobytes())
    return pa.table([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["group", "rows", "n_known", "base", "score"])


def _joined(here: pa.Table, there: pa.Table) -> pa.Table:
    """A row for each row, with the sums of what was said of it here and found there."""
    row, first, of = np.unique(here["row"].to_numpy(), return_index=True, return_inverse=True)
    sums = {c: np.bincount(of, weights=here[c].to_numpy().astype(float), minlength=len(row)) for c in KINDS}
    for rows, *values in zip(*(there[c].to_pylist() for c in ("rows", "n_known", "base", "score")), strict=True):
        at = np.searchsorted(row, np.frombuffer(rows, np.int64))
        for c, x in zip(("n_known", "base", "score"), values, strict=True):
            sums[c][at] += np.frombuffer(x, float)
    return pa.table({"own": here["own"].take(pa.array(first)), **{c: pa.array(sums[c].astype(t.to_pandas_dtype())) for c, t in KINDS.items()}})


def _hot(weights: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The occurrences from which on no more than ``most`` weights are left, and these, by key."""
    by = weights.groupBy(F.least("n", F.lit(1 << 16).cast("long")).alias("n")).count().toArrow()
    n, count = by["n"].to_numpy(), by["count"].to_numpy()
    order = np.argsort(-n)
    fit = np.flatnonzero(np.cumsum(count[order]) <= most)
    least = int(n[order][fit[-1]]) if len(fit) else (1 << 62)
    return least, weights.where(F.col("n") >= least).select("key", "v", "v0").toArrow()


def score_with(docs: DataFrame, tree: Tree, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text, held_out) with n_tokens, n_known, train_tokens, base_score and score."""
    spark, weights = docs.sparkSession, tree.weights
    least, top = _hot(weights, hot)
    order = np.argsort(top["key"].to_numpy().view(_U))
    shared = spark.sparkContext.broadcast((filter_of(weights.select("key"), weights.count()), top["key"].to_numpy()[order].view(_U), *(top[c].to_numpy()[order] for c in ("v", "v0"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("doc_id", "held_out").alias("own"), raw("text").alias("text"))
    schema = f"own {rows.schema['own'].dataType.simpleString()}, {SUMS}, {ASKED}"
    bits = (tasks(spark) - 1).bit_length()
    # The key of a row is settled by writing it, as ids may be null or repeated.
    scored = cut(rows.mapInArrow(_scores(depth, bits, shared), schema), "scored")
    block = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    cold = weights.where(F.col("n") < least).select(block.alias("block"), "key", "v", "v0")
    asked = scored.where("block IS NOT NULL").select("block", "least", "rows", "keys", "n")
    there = asked.groupBy("block").cogroup(cold.groupBy("block")).applyInArrow(_found, FOUND)
    here = scored.where("block IS NULL").select(F.shiftright("row", GROUP).alias("group"), "row", "own", *KINDS)
    # Each group has its own rows here, whether or not anything was found there.
    all_ = here.groupBy("group").cogroup(there.groupBy("group")).applyInArrow(_joined, f"own {rows.schema['own'].dataType.simpleString()}, n_tokens long, n_known long, base double, score double")
    # A word that training hasn't seen.
    unknown = (F.col("n_tokens") - F.col("n_known")) * F.log10(F.lit(1.0 / (tree.tokens + tree.distinct + 1)))
    return all_.select("own.doc_id", "own.held_out", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), (F.col("base") + unknown).alias("base_score"), (F.col("score") + unknown).alias("score"))


def score_texts(docs: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text, held_out): the tree learns from rows not held out and scores all."""
    tree = grow(docs.where("NOT held_out").select(raw("text").alias("text")), depth)
    return score_with(docs, tree, depth, hot)


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_texts(docs.select("doc_id", "text", held.alias("held_out")))
