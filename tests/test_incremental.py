"""A graph kept up to date as sources arrive equals the one built at once."""

import random
import shutil

import pytest

from codelode.operators import build as B
from codelode.operators import incremental as N
from codelode.plans.storage import exists, new_path, written
from codelode.schema import FACTS, GRAPH
from codelode.sources import facts as A
from codelode.streaming import streams

SOURCES = ("framework", "app1", "app2")


def random_facts(seed):
    """Facts of three sources that name each other's and missing classes, methods and fields."""
    r = random.Random(seed)
    cls = [f"Lc{i};" for i in range(14)]
    out = {k: [] for k in FACTS}
    for s in SOURCES:
        own = r.sample(cls, 7)
        any_ = lambda: r.choice(cls)  # noqa: B023, E731
        mine = lambda: r.choice(own) if r.random() < 0.85 else r.choice(cls)  # noqa: B023, E731
        m, a = lambda: f"m{r.randrange(3)}", lambda: r.choice(["", "I"])
        out["classes"] += [(c, 2, s) for c in own]
        out["supers"] += [(mine(), any_(), s) for _ in range(9)]
        out["interfaces"] += [(mine(), any_(), s) for _ in range(5)]
        out["class_fields"] += sorted({(mine(), f"f{r.randrange(2)}", "I", 2, s) for _ in range(8)})
        out["methods"] += [(mine(), m(), a(), r.choice("VI"), r.choice([2, 4]), s) for _ in range(14)]
        out["calls"] += [(mine(), m(), a(), any_(), m(), a(), s) for _ in range(40)]
        out["method_field_access"] += [(any_(), f"f{r.randrange(2)}", "I", mine(), m(), a(), r.randrange(2), s) for _ in range(30)]
        out["strings"] += [(f"s{i}", s) for i in range(r.randrange(4))]
        out["method_strings"] += [(f"s{r.randrange(4)}", m(), a(), mine(), s) for _ in range(15)]
    return out


def frames(spark, facts, only=SOURCES):
    return {k: spark.createDataFrame([x for x in rows if x[-1] in only], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS[k]) + ", source string") for k, rows in facts.items()}


def rows(g):
    return {k: sorted(map(tuple, g[k].select(*GRAPH[k].names).collect()), key=repr) for k in GRAPH}


def same(found, want):
    for k in GRAPH:
        assert found[k] == want[k], k


def test_framework_last(spark):
    order = ("app2", "app1", "framework")
    facts, path = random_facts(2), new_path(spark, "graph")
    for n, s in enumerate(order):
        assert N.load_sources(spark, path, frames(spark, facts, (s,)), n)
        if n == 1:
            assert not N.load_sources(spark, path, frames(spark, facts, (s,)), n)  # the batch comes again
            same(rows(N.open_graph(spark, path)), rows(B.build_graph(spark, frames(spark, facts, order[:2]))))
    same(rows(N.open_graph(spark, path)), rows(B.build_graph(spark, frames(spark, facts))))


def test_failed_batch_changes_nothing(spark, monkeypatch):
    facts, path = random_facts(9), new_path(spark, "graph")
    N.load_sources(spark, path, frames(spark, facts, ("app1",)), 0)
    before = rows(N.open_graph(spark, path))
    monkeypatch.setattr(N._Batch, "publish", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        N.load_sources(spark, path, frames(spark, facts, ("framework", "app2")), 1)
    same(rows(N.open_graph(spark, path)), before)
    monkeypatch.undo()
    N.load_sources(spark, path, frames(spark, facts, ("framework", "app2")), 1)
    same(rows(N.open_graph(spark, path)), rows(B.build_graph(spark, frames(spark, facts))))


def test_nothing(spark):
    path = new_path(spark, "graph")
    assert not N.load_sources(spark, path, frames(spark, random_facts(0), ()), 0)
    g = N.open_graph(spark, path)
    assert [r.name for r in g["sources"].collect()] == ["framework"] and g["calls"].count() == 0


def test_some_tables_alone(spark):
    """A graph of some tables has their rows, in whatever order sources arrive, needs no other facts and keeps none; it stays one of these tables."""
    facts, path = random_facts(2), new_path(spark, "graph")
    tables = ("sources", "classes", "methods", "calls")
    want = B.build_graph(spark, frames(spark, facts, SOURCES[:2]), tables=tables)
    of = lambda s: {k: df for k, df in frames(spark, facts, (s,)).items() if k in ("classes", "supers", "interfaces", "methods", "calls")}
    for n, s in enumerate(("app1", "framework")):
        assert N.load_sources(spark, path, of(s), n, tables)
    g = N.open_graph(spark, path)
    assert set(g) == set(tables)
    assert all(sorted(g[k].collect()) == sorted(want[k].collect()) for k in tables)
    assert not any(exists(spark, f"{path}/{k}") for k in ("named_supers", "named_access", "named_fields", "texts", "met_access"))
    with pytest.raises(ValueError, match="other tables"):
        N.load_sources(spark, path, frames(spark, facts, ("app2",)), 2)


def test_a_batch_reads_its_facts_once_and_moves_few(spark, tmp_path, monkeypatch):
    """Facts aren't read again once they are written, and edges that were there before are looked for by what can have moved them, not by all
    that a batch brings for its own source."""
    seen = []

    def removing(df, what="step", counted=None):
        out = written(df, what, counted)
        if what in FACTS and (tmp_path / what).exists():
            shutil.rmtree(tmp_path / what)
        seen.append((what, out[1]))
        return out

    monkeypatch.setattr(N, "written", removing)
    path, schema = new_path(spark, "graph"), lambda k: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS[k]) + ", source string"
    cls = [f"Lc{i};" for i in range(30)]
    tables = ("sources", "classes", "methods", "calls")

    def load(source, n):
        facts = {"classes": [(c, 2, source) for c in cls], "supers": [], "interfaces": [], "methods": [(c, "m", "", "V", 2, source) for c in cls]}
        facts["calls"] = [(c, "m", "", "Lgone;", "m", "", source) for c in cls] + [(c, "m", "", d, "m", "", source) for c, d in zip(cls, cls[1:])]
        for k, r in facts.items():
            spark.createDataFrame(r, schema(k)).write.parquet(str(tmp_path / k))
        assert N.load_sources(spark, path, {k: spark.read.schema(schema(k)).parquet(str(tmp_path / k)) for k in facts}, n, tables)

    load("app1", 0)
    seen.clear()
    load("app2", 1)
    assert dict(seen)["changed"] == 1  # the method of the missing class, at most: app2's own methods can't be those that app1 means
    g = N.open_graph(spark, path)
    assert g["calls"].count() == 2 * (30 + 29) and g["classes"].count() == 61 and g["methods"].count() == 61


def test_files_of_a_source_that_is_there_are_not_read(spark, tmp_path):
    """A stream that is told of a source again needs none of its files, and of a graph of some tables only those that they are made of."""
    facts, tables = random_facts(2), ("sources", "classes")
    folder, out, done = (f"{tmp_path}/{x}" for x in ("facts", "graph", "done"))
    for s in ("app1", "framework"):
        for k, df in frames(spark, facts, (s,)).items():
            if k in ("classes", "supers", "interfaces", "calls"):
                A.write_fact_csv(df, f"{folder}/{s}", k)

    def arrive(*names):
        spark.createDataFrame([(x,) for x in names], "value string").coalesce(1).write.mode("append").text(f"{folder}/{streams.ARRIVED}")
        streams.keep_graph_stream(spark, folder, out, done, tables=tables).awaitTermination()

    arrive("app1")
    shutil.rmtree(f"{folder}/app1")
    arrive("framework", "app1")
    want = B.build_graph(spark, frames(spark, facts, ("app1", "framework")), tables=tables)
    assert sorted(N.open_graph(spark, out)["classes"].collect()) == sorted(want["classes"].collect())


def test_a_graph_of_all_facts_keeps_all(spark):
    """Graphs that list no edges of a kind, as no source had any, are whole ones; none can be of all facts without some edges."""
    everything, few = N._kept(GRAPH), N._kept(("sources", "classes"))
    live = lambda tables: spark.createDataFrame([(k, 1, 0) for k in tables], "table string, source long, batch long")
    assert N._tables_of(live(everything - {"met_calls", "met_method_strings"})) == everything == N._kept([k for k in GRAPH if k != "calls"])
    assert N._tables_of(live(few)) == few == {"loaded", "real_classes", "foreign", "added_classes"}
