from tallyforge.llm import line_dedup


def test_null_and_repeated_ids_lose_their_own_lines_only(spark):
    rows = [(i, f"shared\nown {i}") for i in range(10)]
    rows += [(None, "own a\nshared"), (None, "shared\nown b"), (20, "shared\nmine\nmore"), (20, "mine\nshared\nmore")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((repr(r.own.doc_id), r.n_dropped, bytes(r.kept).decode()) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([(repr(i), 1, f"own {i}") for i in range(10)] + [("None", 1, "own a"), ("None", 1, "own b"), ("20", 1, "mine\nmore"), ("20", 1, "mine\nmore")])
