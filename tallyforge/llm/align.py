"""Two tokenizers' tokens of the same bytes, aligned.

Each text is encoded by tokenizer A, a byte-level BPE that gets a space before
the text, and by B, a piece model that adds that space itself. Over the bytes of
space and text ``np.repeat`` writes the index of the token that owns each byte,
once for A and once for B. Where the pair of owners changes, a new overlap (a
link) begins; where both owners change at once, both tokenizers cut, and a group
ends.

Texts are encoded by unit: a unit begins at each space between two characters
that are visible or letters, and there both tokenizers always cut. A's pattern
ends a match before such a space, and no piece of B has a space mark after
another character, so merging stops there; that is checked when B is loaded. So
the tokens of a text are those of its units, one after the other, and units that
a worker has seen are not encoded again.

Links are counted by pair of ids over the whole table, by partial sums before the
shuffle. To bring counts back, the pairs of the highest counts, at most ``HOT`` by
a count of how many there are, go to every task; of all others each document
sends what it has to the join with the counts, where a frequent pair cannot be.
The highest count of each B id is one row for each entry of B's vocabulary.

Defined results: null and empty texts, and texts whose tokens don't spell space
and text (B changed a character), have no tokens: zeros and no hash; strings of
special tokens are ordinary text; ids may be null or repeated, as each row's
result is kept under a key of its own; a very long text is read in units, so
only one without such spaces is encoded in one piece; other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, heaviest, parts, table

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that every task knows, and units that a worker remembers.
HOT, REMEMBERED = 1 << 19, 1 << 18
#: Where a unit begins: before it a character and after it another, neither of them white space to anyone.
_BREAK = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_VISIBLE = re.compile(r"[!-~\w]")
_FOUND = "row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair}>, counts array<int>"


@cache
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, the others, in order, for what follows 255."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers and the units a worker has seen. Loaded once a worker."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("texts can't be encoded by unit: a piece goes on after a space")
        to, vocabulary = byte_of(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(to[c] for c in t) if all(c in to for c in t) else t.encode()
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.ranked = self._ranked(a)
        self.forget()

    def _ranked(self, path: str):
        """A as byte ranks, many times as fast, if its merges are in the order of its ids; its tests compare both."""
        import tiktoken

        model = json.loads(open(path, encoding="utf-8").read())["model"]
        merged = [self.a.token_to_id("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or not model["vocab"].keys() >= byte_of().keys():
            return None
        ranks = {bytes(byte_of()[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_a(self, units: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has. lengths: bytes of each with its space."""
        if self.ranked is None:
            ids = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)]
        elif all(u and _VISIBLE.match(u[0]) and _VISIBLE.match(u[-1]) for u in units):
            # Between such units A cuts anyway, so they may as well be one text.
            flat = np.array(self.ranked(f" {' '.join(units)}"), np.int64)
            return flat, np.diff(np.searchsorted(np.cumsum(self.a_length[flat]), np.cumsum(lengths)) + 1, prepend=0)
        else:
            ids = [self.ranked(f" {u}") for u in units]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), n

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        #: For each unit: its numbers of A tokens, B tokens, groups and links; where its pairs begin among all.
        self.numbers, self.begins, self.pairs = np.empty((0, 4), np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode units not seen before, all at once; of one whose tokens spell anything else the groups are None."""
        spelled = [(" " + u).encode() for u in new]
        b = self.b.encode(new, num_threads=1)
        good = np.array([b"".join(map(self.b_bytes.__getitem__, y)) == t for y, t in zip(b, spelled, strict=True)])
        ids, n_a = self.encode_a(new, np.fromiter(map(len, spelled), np.int64, len(new)))
        if b"".join(map(self.a_bytes.__getitem__, ids.tolist())) != b"".join(spelled):
            ends = np.cumsum(n_a)
            good &= np.array([b"".join(map(self.a_bytes.__getitem__, ids[e - n : e].tolist())) == t for e, n, t in zip(ends, n_a, spelled, strict=True)])
        numbers, groups = np.zeros((len(new), 4), np.int64), [None] * len(new)
        kept = np.flatnonzero(good)
        numbers[kept], pairs, found = overlaps(ids[np.repeat(good, n_a)], n_a[kept], [b[i] for i in kept.tolist()], self.a_length, self.b_length)
        for i, g in zip(kept.tolist(), found, strict=True):
            groups[i] = g
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.groups += groups
        self.numbers = np.concatenate((self.numbers, numbers))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(numbers[:, 3])))
        self.pairs = np.concatenate((self.pairs, pairs))

    def look_up(self, units: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED or len(self.pairs) > 8 * REMEMBERED:
            self.forget()
        if new := [u for u in dict.fromkeys(units) if u not in self.known]:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))


def overlaps(ids_a: np.ndarray, n_a: np.ndarray, b: list[list[int]], a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of units' ids, A's in one array and n_a of each, B's in lists, whose bytes are the same: numbers (tokens of A and B, groups, links), pairs of linked ids (A's times the size of B's vocabulary, plus B's), groups as text.

    The units' bytes stand one after the other, so both owners change where a unit ends.
    """
    n_b = np.fromiter(map(len, b), np.int64, len(b))
    ids_b = np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))
    own_a, own_b = np.repeat(np.arange(len(ids_a)), a_length[ids_a]), np.repeat(np.arange(len(ids_b)), b_length[ids_b])
    if not len(own_a):
        return np.zeros((len(b), 4), np.int64), np.empty(0, np.int64), [b""] * len(b)
    new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    starts = np.concatenate(([0], 1 + np.flatnonzero(new_a | new_b)))
    unit_of = np.repeat(np.arange(len(b)), n_a)
    linked = own_a[starts]
    links = np.bincount(unit_of[linked], minlength=len(b))
    cuts = np.concatenate((np.flatnonzero(new_a & new_b), [len(own_a) - 1]))
    last_a, last_b = own_a[cuts], own_b[cuts]
    n_groups = np.bincount(unit_of[last_a], minlength=len(b))
    text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
    shown, i, j = [], 0, 0
    for p, q in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
        shown.append(f"{text_a[i] if p == i + 1 else ','.join(text_a[i:p])}|{text_b[j] if q == j + 1 else ','.join(text_b[j:q])}")
        i, j = p, q
    ends = np.cumsum(n_groups).tolist()
    groups = [";".join(shown[s:e]).encode() for s, e in zip([0, *ends], ends, strict=False)]
    return np.stack((n_a, n_b, n_groups, links), axis=1), ids_a[linked] * len(b_length) + ids_b[own_b[starts]], groups


class Document:
    """What the units of one text have added up to so far."""

    def __init__(self):
        self.numbers, self.digest, self.sums, self.spelled = np.zeros(4, np.int64), None, [], True

    def add(self, numbers: np.ndarray, groups: list[bytes | None], pairs: np.ndarray, counts: np.ndarray) -> None:
        if not self.spelled or None in groups:
            self.spelled = False
            return
        joined = b";".join(groups)
        if self.digest is None:
            self.digest = hashlib.sha256(joined)
        else:
            self.digest.update(b";" + joined)
        self.numbers += numbers
        self.sums.append((pairs, counts))
        if len(self.sums) > 8:
            self.sums = [summed(self.sums)]

    def result(self) -> tuple:
        if not self.spelled or self.digest is None:
            return (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        return (*self.numbers.tolist(), self.digest.hexdigest(), *(summed(self.sums) if len(self.sums) > 1 else self.sums[0]))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)


def aligned(tokenizers: Tokenizers, texts: list[str | None], held: int = 1 << 16) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts) of each text, ``held`` units at a time; a long text adds up over several such turns."""
    out = [Document() for _ in texts]
    units: list[str] = []
    ends: list[tuple[int, int]] = []  # document, and how many units there are up to the end of what it has here

    def turn() -> None:
        at = tokenizers.look_up(units)
        numbers, begins = tokenizers.numbers[at], tokenizers.begins[at]
        n = numbers[:, 3]
        place = np.repeat(begins - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        pairs = tokenizers.pairs[place]
        groups = list(map(tokenizers.groups.__getitem__, at.tolist()))
        stops = np.array([e for _, e in ends])
        link_ends = np.concatenate(([0], np.cumsum(n)))[stops]
        whole = np.add.reduceat(numbers, np.concatenate(([0], stops[:-1])), axis=0)
        # Sorted by document and pair; a stable sort by document keeps the order by pair.
        doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], link_ends))))
        order = np.argsort(pairs, kind="stable")
        order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
        pairs, doc = pairs[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])))) if len(pairs) else np.empty(0, np.int64)
        counts = np.diff(np.concatenate((first, [len(pairs)])))
        split = np.searchsorted(doc[first], np.arange(len(ends) + 1))
        start = 0
        for k, (d, e) in enumerate(ends):
            own = first[split[k] : split[k + 1]]
            out[d].add(whole[k], groups[start:e], pairs[own], counts[split[k] : split[k + 1]])
            start = e
        units.clear()
        ends.clear()

    for d, text in enumerate(texts):
        for block in blocks(text or "", held):
            units += block
            ends.append((d, len(units)))
            if len(units) >= held:
                turn()
    if units:
        turn()
    return [x.result() for x in out]


def blocks(text: str, held: int) -> Iterator[list[str]]:
    """The units of a text in lists of at most ``held``; none of an empty text."""
    if 0 < len(text) <= 8 * held:
        found = _BREAK.split(text)
        yield from (found[i : i + held] for i in range(0, len(found), held))
    elif text:
        at, out = 0, []
        for m in _BREAK.finditer(text):
            out.append(text[at : m.start()])
            at = m.end()
            if len(out) == held:
                yield out
                out = []
        yield [*out, text[at:]]


@cache
def _loaded(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)).cast(kind))


def _found(a: str, b: str, pair: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _loaded(a, b)
        for batch in parts(batches):
            out = aligned(tokenizers, batch.column(2).to_pylist())
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
            columns += [pa.array([x[4] for x in out], pa.string()), _lists([x[5] for x in out], pair), _lists([x[6] for x in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])

    return run


def _hot_sums(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            own = batch.column("pairs")
            flat, n = own.flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.diff(own.offsets.to_numpy())
            doc = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            total, most = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            np.add.at(total, doc[hit], n[hit] * counts[at[hit]])
            np.add.at(most, doc[hit], n[hit] * best[at[hit]])
            rest = ~hit
            kept = np.bincount(doc[rest], minlength=len(lengths))
            offsets = pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32))
            left, times = (pa.ListArray.from_arrays(offsets, pa.array(x[rest])) for x in (flat, n))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total), pa.array(most), left, times], ["row", "hot_sum", "hot_best", "pairs", "counts"])

    return run


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): links of each pair of ids in the whole table, and whether its B id has no pair of more."""
    both = found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").cast("long").alias("n"))
    counts = cut(both.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    b = F.pmod("pair", F.lit(width))
    # One row for each id of B's vocabulary at most.
    most = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("n").alias("most")))
    return cut(counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a: str | None = None, b: str | None = None, hot: int = HOT) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one row for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    a, b = a or public_tokenizers.path(A_NAME), b or public_tokenizers.path(B_NAME)
    width = len(_loaded(a, b).b_length)
    small = len(_loaded(a, b).a_length) * width < 1 << 31
    schema = _FOUND.format(id=docs.schema[doc_id].dataType.simpleString(), pair="int" if small else "long")
    # Written once: the tokenizers' work is not repeated, and the keys of rows are settled.
    found = cut(rows.mapInArrow(_found(a, b, pa.int32() if small else pa.int64()), schema), "aligned")
    counts = pair_counts(found, width)
    least = heaviest(counts, hot)
    # At most ``hot`` rows, as counted.
    known = counts.where(F.col("n") >= least).orderBy("pair").toPandas()
    summed = found.select("row", "pairs", "counts").mapInArrow(
        _hot_sums(known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int64)),
        f"row long, hot_sum long, hot_best long, pairs array<{'int' if small else 'long'}>, counts array<long>",
    )
    summed = cut(summed, "hot_sums")
    rest = summed.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("times"))
    met = rest.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    zero = F.lit(0).cast("long")
    whole = summed.select("row", "hot_sum", "hot_best").join(met, "row", "left")
    whole = whole.select("row", (F.col("hot_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("hot_sum") + F.coalesce("more", zero)).alias("count_sum"))
    return found.drop("pairs", "counts").join(whole, "row")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
