"""Rounds of components are the driver's work on small tables: none may be spent on what is settled."""

import random

from tallyforge.llm import common


def roots_of(links):
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root if find(n) != n}


def test_settled_stars_need_no_round(spark, monkeypatch):
    written, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name: written.append(name) or cut(df, name))
    rng = random.Random(4)
    tree = [(i, rng.randrange(max(0, i - 3), i)) for i in range(1, 40)]
    for links, rounds in (([], 0), ([(1, 2), (2, 1), (5, -3), (7, 7)], 0), ([(9, k) for k in (10, 11, 12)], 0), ([(1, 3), (2, 3)], 1), ([(k, k + 1) for k in range(60)], None), (tree, None), ([(50, k) for k in range(50)], None)):
        written.clear()
        found = {r.node: r.root for r in common.links_to_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert found == roots_of(links)
        assert rounds is None or len(written) == 1 + rounds
