"""What a build reads several times is made once, and a round writes no more than it must."""

import shutil

from codelode.operators import build as B
from codelode.operators import references as R
from codelode.plans import ingest_queries as Q
from codelode.plans.storage import written
from codelode.schema import GRAPH
from test_incremental import frames, random_facts, rows


def test_facts_are_read_once(spark, tmp_path):
    """The graph's tables don't go back to where the facts came from."""
    facts = frames(spark, random_facts(4))
    want = rows(B.build_graph(spark, facts))
    for k, df in facts.items():
        df.write.parquet(f"{tmp_path}/{k}")
    g = B.build_graph(spark, {k: spark.read.schema(df.schema).parquet(f"{tmp_path}/{k}") for k, df in facts.items()})
    shutil.rmtree(tmp_path)
    found = rows(g)
    assert all(found[k] == want[k] for k in GRAPH)


def test_rounds_write_open_rows_alone(spark, monkeypatch):
    """Of 1,000 references to plain text and one chain of 40, the rounds after the first write the chain's rows alone."""
    seen = []

    def counting(df, what="step", counted=None):
        out = written(df, what, counted)
        seen.append((what, out[0].count()))
        return out

    monkeypatch.setattr(R, "written", counting)
    entries = [("p", "string", f"a{i}", f"@string/b{i}") for i in range(1000)] + [("p", "string", f"b{i}", "text") for i in range(1000)]
    entries += [("p", "string", f"c{i}", f"@string/c{i + 1}") for i in range(40)] + [("p", "string", "c40", "end")]
    found = {r.key: r.text for r in R.close_resources(spark.createDataFrame(entries, "package string, kind string, name string, value string")).collect()}
    assert found["string/c0"] == "end" and found["string/a7"] == "text" and len(found) == 2041
    rounds = [n for what, n in seen if what == "references"]
    assert len(rounds) > 5 and all(n <= 40 for n in rounds[3:])


def test_tasks_name_files_themselves(spark, monkeypatch):
    """Nothing is renamed by the driver, however many files there are, and folders are named as Spark names them."""
    def renamed(*_):
        raise AssertionError("a file for each row must not be a call of the driver for each")

    monkeypatch.setattr(Q, "rename", renamed)
    keys = ["plain", "middle east", "%system%app%S1.apk", 'a=b:c"d#e', "[x]^{y\\", "größe"]
    df = spark.createDataFrame([(k, f"line of {i}\nend") for i, k in enumerate(keys)], "k string, text string")
    path = Q._files(df, "one.txt")
    found = {r.k: r.value for r in spark.read.text(path, wholetext=True).select("k", "value").collect()}
    assert found == {k: f"line of {i}\nend\n" for i, k in enumerate(keys)}


def test_a_build_makes_the_tables_asked_for(spark, monkeypatch):
    """Parents alone are asked for: they are those of the whole graph, and calls are written as the names and sources that classes need."""
    facts = frames(spark, random_facts(4))
    want, seen = rows(B.build_graph(spark, facts)), {}

    def noting(df, what="step", counted=None):
        seen[what] = df.columns
        return written(df, what, counted)

    monkeypatch.setattr(B, "written", noting)
    g = B.build_graph(spark, facts, tables=("sources", "supers"))
    assert list(g) == ["sources", "supers"]
    assert set(map(tuple, g["supers"].collect())) == set(want["supers"]) and set(map(tuple, g["sources"].collect())) == set(want["sources"])
    assert seen["calls"] == ["callee_class", "source"] and seen["method_strings"] == ["source"] and "methods" in seen and seen["methods"] == ["source"]
