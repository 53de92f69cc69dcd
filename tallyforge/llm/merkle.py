"""A Merkle manifest of a table: one root for all rows, and a proof for each.

A row's leaf is the SHA-256 of its fields. Leaves of a source, in the order of
their ids, are the lowest level of that source's tree; every ``ARITY``
consecutive nodes of a level become one node of the next, until one is left, its
subroot. Subroots, in the order of sources, are the lowest level of the tree that
ends in the root.

The tree is built as a monoid of sparse forests. A fragment holds the nodes that
still wait for siblings, by (tree, level, index), and merging two fragments is
the union of their nodes, in which every run of siblings that has become whole
turns into its parent. How many siblings a run has is known beforehand from the
number of leaves, so runs complete in any order and the merge is associative.
Rows are range-partitioned by (source, id), so a fragment is left with at most a
few runs for each level at both its ends. Fragments that stand beside each
other are merged by eights until one is left: a tree reduction in which each
round is a written table, so a lost executor repeats a part of one round. No
fragment passes the driver; it sees how many parts, sources and levels there
are, and the root. What a run consisted of is written when it completes, and
proofs are put together from those tables, from the root down.

Defined results: a null source comes first and is a tree of its own; null ids
come first in their source, and rows that share an id stand in the order of their
leaves, so rows with equal fields are interchangeable; a null id counts as crc32
of nothing; a null field is ``-`` in the leaf, unlike an empty one; one lone leaf
is its own subroot, and root if no other source exists, with the hash of nothing
as its proof; very long texts are hashed whole in the JVM and travel no further;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

ARITY, FAN, DIGEST = 16, 8, 64
#: The tree over all subroots; trees of sources are numbered from 0.
TOP = -1
_NODES = "part long, tree long, level int, index long, leaves long, digest string, kids string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: F.Column) -> F.Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: F.Column) -> F.Column:
    return F.sha2(F.concat(*map(_field, values)), 256)


def height(leaves: int) -> int:
    """Levels above the leaves."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // ARITY), h + 1
    return h


class Forest:
    """Nodes that wait for siblings. ``leaves`` of a node is the number of leaves of its whole tree, which settles the length of each run."""

    def __init__(self, trees: int):
        self.trees, self.runs, self.done = trees, {}, []

    def add(self, part: int, tree: int, level: int, index: int, leaves: int, digest: str) -> None:
        while True:
            width = -(-leaves // ARITY**level)
            if width == 1:
                if tree == TOP:
                    self.runs[tree, level, 0] = (part, leaves, {0: digest})
                    return
                tree, level, index, leaves = TOP, 0, tree, self.trees
                continue
            run = index // ARITY
            part, _, kids = self.runs.setdefault((tree, level, run), (part, leaves, {}))
            kids[index] = digest
            if len(kids) < min(ARITY, width - run * ARITY):
                return
            del self.runs[tree, level, run]
            joined = "".join(kids[i] for i in sorted(kids))
            digest = hashlib.sha256(joined.encode()).hexdigest()
            level, index = level + 1, run
            self.done.append((part, tree, level, index, leaves, digest, joined))

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Completed runs so far, named by the node they make; at the end also the nodes that still wait, whose kids are null."""
        rows, self.done = self.done, []
        if last:
            rows += [(part, tree, level, i, leaves, d, None) for (tree, level, _), (part, leaves, kids) in self.runs.items() for i, d in kids.items()]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "tree", "level", "index", "leaves", "digest", "kids"])


def _merge(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                forest.add(*row)
            yield from forest.batches()
        yield from forest.batches(last=True)

    return run


def numbered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """rows(source, doc_id, leaf, ...) with part, tree, index in the tree and leaves of the tree; the number of parts and of trees."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Writing settles which part a row is in, and its place there.
    rows = cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "leaves")
    # A part holds few sources or few rows of each; a source has at most one row here for each part.
    spans = cut(rows.groupBy("part", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "spans")
    whole, sofar = W.partitionBy("source"), W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumns({"leaves": F.sum("n").over(whole), "before": F.coalesce(F.sum("n").over(sofar), F.lit(0))})
    begins = (F.col("before") == 0).cast("long")
    heads = spans.groupBy("part").agg(F.sum(begins).alias("begun"))
    # One row a part.
    heads = heads.select("part", F.coalesce(F.sum("begun").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    tree = F.col("earlier") + F.sum(begins).over(W.partitionBy("part").orderBy("first").rowsBetween(W.unboundedPreceding, 0)) - 1
    spans = cut(spans.join(heads, "part").select("part", "source", "first", "before", "leaves", tree.alias("tree")), "spans")
    parts, trees = spans.agg(F.max("part"), F.max("tree")).first()
    s = spans.select(F.col("part").alias("_part"), F.col("source").alias("_source"), "first", "before", "leaves", "tree")
    rows = rows.join(s, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    index = F.col("before") + F.col("at") - F.col("first")
    return rows.withColumn("index", index).drop("_part", "_source", "first", "before"), (parts or 0) + 1, 0 if trees is None else trees + 1


def build(rows: DataFrame, parts: int, trees: int) -> tuple[DataFrame, str | None]:
    """Runs of all trees as (tree, level, index, leaves, kids), named by the node they make, and the root."""
    names = ["part", "tree", "level", "index", "leaves", "digest"]
    nodes = rows.select("part", "tree", F.lit(0).alias("level"), "index", "leaves", F.col("leaf").alias("digest"))
    found = cut(nodes.mapInArrow(_merge(trees), _NODES), "forest")
    runs, waiting = found.where("kids IS NOT NULL"), found.where("kids IS NULL")
    while True:
        parts = -(-parts // FAN)
        merged = waiting.select(F.floor(F.col("part") / FAN).alias("part"), *names[1:]).repartition(parts, "part")
        found = cut(merged.mapInArrow(_merge(trees), _NODES), "forest")
        runs, waiting = runs.union(found.where("kids IS NOT NULL")), found.where("kids IS NULL")
        if parts <= 1:
            break
    root = waiting.select("digest").first()
    return runs.select("tree", "level", "index", "leaves", "kids"), root and root.digest


def _siblings(kids: F.Column, at: F.Column) -> F.Column:
    """(left, right): what stands beside the node at this place of its run."""
    return F.struct(F.substring(kids, F.lit(1), DIGEST * at).alias("left"), F.substring(kids, DIGEST * at + DIGEST + 1, F.lit(DIGEST * ARITY)).alias("right"))


def _height(leaves: F.Column, most: int) -> F.Column:
    """height() of a tree, for up to ``most`` levels."""
    out = F.lit(0)
    for k in range(most):
        out = out + (leaves > ARITY**k).cast("int")
    return out


def paths(runs: DataFrame, trees: int, most: int) -> DataFrame:
    """(tree, index, subroot, path) of each run of leaves: the siblings of its node and of those above, from below to the root.

    Level by level from the root down; each join brings a run together with the
    at most ``ARITY`` runs that its nodes are made of.
    """
    high = height(trees)
    top = runs.where(F.col("tree") == TOP).select("level", "index", "kids")
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = top.where(F.col("level") == high).select("level", "index", "kids", none.alias("path"))
    for level in range(high - 1, 0, -1):
        up = above.select(F.col("index").alias("_up"), F.col("kids").alias("_kids"), F.col("path").alias("_path"))
        path = F.concat(F.array(_siblings(F.col("_kids"), F.pmod("index", F.lit(ARITY)))), "_path")
        above = top.where(F.col("level") == level).join(up, F.floor(F.col("index") / ARITY) == F.col("_up")).select("level", "index", "kids", path.alias("path"))
    of_trees = above.select("index", "kids", "path") if high else None
    own = runs.where(F.col("tree") != TOP).withColumn("high", _height(F.col("leaves"), most))
    first = own.where("level = high").select("tree", "level", "index", "kids")
    if of_trees is None:
        level = first.withColumn("path", none)
    else:
        up = of_trees.select(F.col("index").alias("_up"), F.col("kids").alias("_kids"), F.col("path").alias("_path"))
        path = F.concat(F.array(_siblings(F.col("_kids"), F.pmod("tree", F.lit(ARITY)))), "_path")
        level = first.join(up, F.floor(F.col("tree") / ARITY) == F.col("_up")).select("tree", "level", "index", "kids", path.alias("path"))
    level = level.withColumn("subroot", F.sha2("kids", 256))
    out = None
    for k in range(most, 0, -1):
        # level: runs that make nodes of level k, with the path of that node.
        down = level.where(F.col("level") == k)
        if k == 1:
            out = down
            break
        up = down.select(F.col("tree").alias("_tree"), F.col("index").alias("_up"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), "subroot")
        path = F.concat(F.array(_siblings(F.col("_kids"), F.pmod("index", F.lit(ARITY)))), "_path")
        lower = own.where((F.col("level") == k - 1) & (F.col("high") > k - 1)).join(up, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("index") / ARITY) == F.col("_up")))
        level = level.where(F.col("level") < k).union(lower.select("tree", "level", "index", "kids", path.alias("path"), "subroot"))
    if out is None:
        out = level
    of_leaves = out.select("tree", "index", "kids", "path", "subroot")
    if of_trees is None:
        return of_leaves
    # A lone leaf is a subroot itself: its run is one of the top tree.
    return of_leaves.union(of_trees.select(F.lit(TOP).cast("long").alias("tree"), "index", "kids", "path", F.lit(None).cast("string").alias("subroot")))


def manifest(docs: DataFrame, tampered: F.Column | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), source: str = "source", doc_id: str = "doc_id", altered: dict[str, F.Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, changed): path as siblings from below, changed the leaf with ``altered`` fields where ``tampered``."""
    plain, other = leaf(*(F.col(f) for f in fields)), leaf(*((altered or {}).get(f, F.col(f)) for f in fields))
    changed = plain if tampered is None else F.when(tampered, other).otherwise(plain)
    # Written before it is sorted, as sampling for ranges would otherwise hash every text once more.
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), plain.alias("leaf"), changed.alias("changed")), "hashed")
    rows, parts, trees = numbered(rows)
    rows = cut(rows, "numbered")
    most = height(rows.agg(F.max("leaves")).first()[0] or 0)
    runs, root = build(rows, parts, trees)
    up = paths(runs, trees, most).select(F.col("tree").alias("_tree"), F.col("index").alias("_run"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), F.col("subroot").alias("_subroot"))
    lone = F.col("leaves") == 1
    keyed = rows.withColumns({"_at": F.when(lone, F.lit(TOP)).otherwise(F.col("tree")), "_in": F.when(lone, F.col("tree")).otherwise(F.col("index"))})
    met = keyed.join(up, (F.col("_at") == F.col("_tree")) & (F.floor(F.col("_in") / ARITY) == F.col("_run")), "left")
    path = F.when(F.col("_kids").isNull(), F.array().cast("array<struct<left:string,right:string>>")).otherwise(F.concat(F.array(_siblings(F.col("_kids"), F.pmod("_in", F.lit(ARITY)))), "_path"))
    return met.select("doc_id", "source", "leaf", F.coalesce("_subroot", "leaf").alias("subroot"), F.lit(root).cast("string").alias("root"), path.alias("path"), "changed")


def folded(start: F.Column, path: F.Column) -> F.Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    out = manifest(table(spark, sf_dir, "documents"), crc % 5 == 0, altered={"text": F.translate("text", UPPER, LOWER)})
    out = out.withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEVELS = 8
_LEAF = "sha256(concat({}))".format(", ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{t}")))


def _sql() -> str:
    """The same by one query a level: at most 8 levels of each kind of tree, which 4 billion leaves fill."""
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '') IF c <> '']), lambda a, b: list_reduce(list_prepend(xor(a, b), [x::UBIGINT FOR x IN range(8)]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        f"h AS (SELECT doc_id, source, {_LEAF.format(t='text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {_LEAF.format(t=low)} ELSE {_LEAF.format(t='text')} END AS changed FROM documents)",
        "d AS (SELECT doc_id, leaf, changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h)",
        "a0 AS (SELECT tree, i, leaf AS digest FROM d)",
    ]
    group = "SELECT {tree}i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest FROM (SELECT *, count(*) OVER ({over}) AS n FROM {t}{k}) GROUP BY {tree}i // 16"
    for k in range(_LEVELS):
        parts.append(f"a{k + 1} AS ({group.format(tree='tree, ', over='PARTITION BY tree', t='a', k=k)})")
    parts.append(f"b0 AS (SELECT tree AS i, digest FROM a{_LEVELS})")
    for k in range(_LEVELS):
        parts.append(f"b{k + 1} AS ({group.format(tree='', over='', t='b', k=k)})")
    # Siblings of each node; none where a level has one node.
    for t, key in (("a", "PARTITION BY tree, i // 16"), ("b", "PARTITION BY i // 16")):
        for k in range(_LEVELS):
            tree = "tree, " if t == "a" else ""
            around = "coalesce(string_agg(digest, '') OVER ({key} ORDER BY i ROWS BETWEEN {frame}), '')"
            parts.append(f"s{t}{k} AS (SELECT {tree}i, {around.format(key=key, frame='UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {around.format(key=key, frame='1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {t}{k})")
    parts.append("p0 AS (SELECT doc_id, leaf, changed, tree, i, '' AS proof, changed AS fold, leaf AS walk FROM d)")
    step = 0
    for t in "ab":
        for k in range(_LEVELS):
            at = f"p.i // {16**k}" if t == "a" else f"p.tree // {16**k}"
            on = f"s.i = {at}" + (" AND s.tree = p.tree" if t == "a" else "")
            # A run of one is hashed, a level of one is not.
            count = f"(SELECT tree, count(*) AS n FROM a{k} GROUP BY tree)" if t == "a" else f"(SELECT count(*) AS n FROM b{k})"
            new = "CASE WHEN c.n = 1 THEN {0} ELSE sha256(concat(l, {0}, r)) END"
            walk = new.format("walk") if t == "a" else "walk"
            join = "c.tree = p.tree" if t == "a" else "true"
            parts.append(f"p{step + 1} AS (SELECT doc_id, leaf, changed, p.tree, p.i, concat(proof, l, r) AS proof, {new.format('fold')} AS fold, {walk} AS walk FROM p{step} p JOIN s{t}{k} s ON {on} JOIN {count} c ON {join})")
            step += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, walk AS subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified FROM p{step}, b{_LEVELS}"


SQL = _sql()
