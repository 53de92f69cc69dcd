"""A corpus prepared in five stages, each of which reads what the one before has written.

Toxic documents go, lines that many documents share go, one document of each
group of near copies stays, sources are mixed to their weights, and what is left
is packed into sequences. ``run`` returns the last stage's rows.

Defined results: a null or empty text is scored, kept and packed like any other
(as one closing id), and all such texts are one group of near copies. Rows are
told apart by keys that are written with them, so ids may be null or repeated;
only line dedup counts documents, and takes rows that share an id, or have none,
for one. A document that the mix takes several times is several rows from there
on. Columns beyond those of documents are kept up to packing, whatever their
names; packing returns pieces and their places. Empty tables give an empty table.
Very long texts go through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import line_dedup, mixing, near_copies, packing, toxicity
from tallyforge.llm.common import cut, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_copies.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The classifier, the near copies and the packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
