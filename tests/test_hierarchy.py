"""Labels against closures worked out by hand: forests, further parents, cycles, chains, hubs and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from codelode.operators import hierarchy as L


def closure(edges, seeds):
    out = {}
    for seed in seeds:
        seen, front = set(), {seed}
        while front:
            front = {c for p, c in edges if p in front} - seen
            seen |= front
        out[seed] = seen
    return out


def shapes():
    """Forests in one graph, and what isn't a forest in another."""
    r = random.Random(3)
    tree = [(r.randrange(i), i) for i in range(1, 60)] + [(100, 101)]
    chain = [(200 + i, 201 + i) for i in range(40)]
    hub = [(300, 300 + i) for i in range(1, 80)] + [(305, 400), (400, 401)]
    yield "forests", tree + chain + hub
    two = [(r.randrange(i), i) for i in range(1, 30)] + [(r.randrange(i), i) for i in range(10, 30)]
    cycles = [(101, 102), (102, 103), (103, 101), (103, 104), (104, 105), (107, 107), (107, 108), (108, 109), (120, 121), (121, 122), (109, 101)]
    yield "any", two + cycles + [(200 + r.randrange(25), 200 + r.randrange(25)) for _ in range(40)]


@pytest.mark.parametrize("name,edges", list(shapes()), ids=[n for n, _ in shapes()])
def test_any_graph_gets_its_closure(spark, name, edges, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "p long, c long")
    labels, loose = L.interval_labels(df, "p", "c")
    assert (loose.count() == 0) == (name == "forests")
    nodes = sorted({n for e in edges for n in e})
    seeds = spark.createDataFrame([(n, n) for n in [*nodes, 9999]], "root long, id long")
    for down in (True, False):
        found = {n: set() for n in nodes}
        rows = L.related(labels, loose, seeds, down, "root").collect()
        for root, i in rows:
            found[root].add(i)
        assert found == closure(edges if down else [(c, p) for p, c in edges], nodes)
        assert len(rows) == sum(map(len, found.values()))


def test_empty(spark):
    labels, loose = L.interval_labels(spark.createDataFrame([], "p long, c long"), "p", "c")
    assert labels.count() == loose.count() == 0
    assert L.related(labels, loose, spark.createDataFrame([(1,)], "id long"), True).count() == 0


def test_rounds_go_by_loose_ends(spark, monkeypatch):
    """Where seeds are more than the loose edges' ends, rounds are of these: results aren't written round by round for every seed."""
    edges = [(i // 2, i) for i in range(1, 200)] + [(i // 2 + 1, i) for i in range(5, 200, 40)] + [(150, 3), (7, 7)]
    labels, loose = L.interval_labels(spark.createDataFrame(edges, "parent long, child long"), "parent", "child")
    above, total = closure([(c, p) for p, c in edges], range(200)), {}
    seeds = spark.range(200).select(F.col("id").alias("root"), "id")
    write = L.written

    def counting(df, what="step", counted=None):
        out = write(df, what, counted)
        total[what] = total.get(what, 0) + out[1]
        return out

    monkeypatch.setattr(L, "written", counting)
    for down in (False, True):
        total.clear()
        rows = {tuple(r) for r in L.related(labels, loose, seeds, down, "root").select("root", "id").collect()}
        assert rows == {(i, x) if not down else (x, i) for i, found in above.items() for x in found}
        ends = loose.select("child" if down else "parent").distinct().count()
        assert ends < 200 and total["related"] < len(rows)
