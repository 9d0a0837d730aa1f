"""Trees against plain Python: paths, what is inherited, chains, cycles and ids on several rows."""

import random

import pytest

from hostgrain.operators import nested as N
from hostgrain.operators import skew


def walk(rows):
    """Sorted (tree, id, path, depth, root, flag above) of rows (tree, id, up, name, flag), by walks down from the roots."""
    out = []
    for tree in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tree]
        ids = {r[1] for r in own}
        tops = [r for r in own if r[2] == r[1] or r[2] not in ids]
        level = [(r, r[3], 0, r[1], False, (r[1],)) for r in tops]
        reached = set()
        while level:
            down = []
            for r, path, depth, root, above, seen in level:
                out.append((tree, r[1], path, depth, root, above))
                reached.add(r[1])
                if seen.count(r[1]) == 1:
                    down += [(c, f"{path}\\{c[3]}", depth + 1, root, above or r[4], (*seen, c[1])) for c in own if c[2] == r[1] and c[2] != c[1]]
            level = down
        out += [(tree, r[1], r[3], None, None, None) for r in own if r[2] != r[1] and r[2] in ids and r[2] not in reached]
    return sorted(out, key=repr)


def fold(spark, rows):
    df = spark.createDataFrame(rows, "tree int, id int, up int, name string, flag boolean")
    got = N.tree_paths(df, ["tree"], "id", "up", "name", inherit=("flag",)).select("tree", "id", "path", "depth", "root", "flag_above")
    return sorted(map(tuple, got.collect()), key=repr)


def forest(seed, trees=4, n=40, cycles=False):
    r = random.Random(seed)
    rows = []
    for t in range(trees):
        for i in range(n):
            up = r.randrange(n) if cycles else (r.randrange(-2, i) if i else -1)
            rows.append((t, i, up, f"n{i}", r.random() < 0.2))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [forest(1), forest(2, cycles=True), forest(3, trees=1, n=1), [(1, i, i - 1, "x", i == 3) for i in range(70)], [*forest(4), (2, 7, 3, "again", True), (2, 7, 7, "self", False)]])
def test_forests(spark, rows):
    assert fold(spark, rows) == walk(rows)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    from hostgrain.operators import store

    written, cut = [], store.cut
    monkeypatch.setattr(store, "cut", lambda df: (written.append(1), cut(df))[1])
    n = 5000
    df = spark.range(n).selectExpr("id", "id - 1 AS up", "'x' AS name", "id = 10 AS flag")
    got = {r.id: r for r in N.tree_paths(df, [], "id", "up", "name", inherit=("flag",)).selectExpr("id", "depth", "root", "length(path) AS size", "flag_above").collect()}
    assert all((r.depth, r.root, r.size, r.flag_above) == (i, 0, 2 * i + 1, i > 10) for i, r in got.items()) and len(got) == n
    assert len(written) <= 14


def test_most_nodes_below_one(spark, monkeypatch):
    """A parent of most nodes is joined where these lie; no task gets them all."""
    monkeypatch.setattr(skew, "LIGHT", 50)
    monkeypatch.setattr(skew, "HEAVY_SHARE", 20)
    rows = [(0, i, 0 if i % 3 else i - 1, f"n{i}", i == 0) for i in range(600)]
    assert fold(spark, rows) == walk(rows)


def test_nulls_in_trees(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 1, "b", None), (3, 2, None, True), (None, 9, "n", True), (4, None, "d", False)], "id int, up int, name string, flag boolean")
    got = {r.id: (r.path, r.depth, r.flag_above) for r in N.tree_paths(df, [], "id", "up", "name", inherit=("flag",)).collect()}
    assert got == {1: (None, 0, False), 2: ("b", 1, False), 3: ("b", 2, False), None: ("n", 0, False), 4: ("d", 0, False)}
