import pytest
from pyspark.sql import functions as F

from codelode.operators import build as B
from codelode.operators import lookups as C
from codelode.operators import traversal as D
from codelode.plans.storage import stored, written
from codelode.schema import GRAPH, INVENTORY


def make(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in GRAPH.items()}


@pytest.fixture(scope="module")
def g(spark):
    """Cyclic calls, cyclic inheritance, one name in two sources."""
    return make(
        spark,
        sources=[(1, "framework"), (2, "b"), (3, "c"), (4, "d")],
        classes=[(20, "LA;", 2, 1), (21, "LA;", 2, 2), (48, "LK;", 2, 1), (49, "LL;", 2, 2), (107, "LM;", 1026, 3), (108, "LI;", 32770, 1), (109, "LN;", 2, 2)],
        methods=[(101, 20, "t", "", "V", 2, 1), (194, 49, "x", "I", "V", 2, 3), (235, 48, "y", "", "V", 2, 1), (239, 107, "z", "", "V", 2, 3), (240, 107, "z", "", "I", 2, 3)],
        supers=[(20, 48, 1), (21, 49, 2), (21, 49, 2), (49, 109, 2), (109, 49, 2), (21, 107, 3)],
        interfaces=[(108, 20, 1), (108, 107, 3)],
        calls=[(194, 101, 3), (235, 101, 1), (239, 235, 3), (239, 235, 1), (101, 101, 1)],
        strings=[(1, "50%_off\\now", 1), (2, "a,b\n\"q\"", 2), (3, "Hello", 2)],
        method_strings=[(1, 101), (2, 194), (3, 194)],
        class_fields=[(7, 20, "f", "I", 2), (8, 21, "f", "J", 2)],
        method_field_access=[(7, 101, 0), (7, 101, 1), (7, 194, 1), (8, 101, 5)],
    )


def ids(df):
    return sorted(tuple(r.path) for r in df.collect())


def test_callers(g):
    got = ids(D.find_callers(g, cls="LA;", name="t", depth=3, simple=True))
    assert got == [(194, 101), (235, 101), (239, 235, 101)]
    assert ids(D.find_callers(g, cls="LA;", name="t", depth=3, simple=True, call_source="c")) == [(194, 101), (239, 235, 101)]
    walks = ids(D.find_callers(g, name="t", depth=2))
    assert walks == [(101, 101), (101, 101, 101), (194, 101), (194, 101, 101), (235, 101), (235, 101, 101), (239, 235, 101)]
    with pytest.raises(D.TooManyPaths):
        D.find_callers(g, name="t", depth=3, max_paths=4)
    assert D.find_callers(g, name="none").count() == 0


def test_outgoing_and_paths(g):
    rows = D.find_outgoing(g, name="z", signature="", depth=2, into_source="framework")
    assert ids(rows) == [(239, 235), (239, 235, 101)]
    shown = D.assemble_paths(g, rows).select(D.display_path(F.col("methods"), show_source=True).alias("p")).orderBy("p").collect()
    assert [r.p for r in shown] == ["M.z() @c > K.y() @framework", "M.z() @c > K.y() @framework > A.t() @framework"]


def names(df):
    return sorted((r.source, r.name) for r in df.collect())


def test_closures_end_on_cycles(g):
    assert names(D.find_children(g, "LA;")) == [("b", "LL;"), ("b", "LN;"), ("c", "LM;"), ("framework", "LK;")]
    assert names(D.find_children(g, "LA;", parent_source="b", child_source="c")) == [("c", "LM;")]
    assert names(D.find_children(g, "LA;", parent_source="d")) == []
    assert names(D.find_parents(g, "LN;", "b")) == [("b", "LA;"), ("b", "LL;"), ("b", "LN;")]
    assert names(D.find_implementers(g, "LI;")) == [("c", "LM;"), ("framework", "LA;"), ("framework", "LK;")]
    assert names(D.find_implementers(g, "LI;", impl_source="framework")) == [("framework", "LA;"), ("framework", "LK;")]
    found = D.with_source_fallback(lambda s: D.find_children(g, "LL;", parent_source=s))
    assert names(found) == [("b", "LL;"), ("b", "LN;")]
    with pytest.raises(D.NotFound):
        D.with_source_fallback(lambda s: D.find_children(g, "LL;", parent_source=s), fallback=False)


def test_lookups(g):
    one = lambda df, c: sorted(r[c] for r in df.collect())
    assert one(C.get_methods(g, name="z"), "id") == [239, 240]
    assert one(C.get_methods(g, cls="LL;", name="x", signature="I", source="c"), "id") == [194]
    assert one(C.get_method_ids(g, name="x", source="b"), "id") == []
    for bad in ({}, {"cls": "LA;", "signature": ""}, {"signature": ""}):
        with pytest.raises(ValueError):
            C.get_methods(g, **bad)
    with pytest.raises(ValueError):
        C.get_fields(g, "LA;", ty="I")
    assert one(C.get_fields(g, "LA;", "f", "I"), "id") == [7]
    assert one(C.classes_with_method(g, "z"), "class") == ["LM;", "LM;"]
    assert C.classes_with_method(g, "z", no_abstract=True).count() == 0
    assert one(C.find_strings(g, "50%_off\\now"), "string") == ["50%_off\\now"]
    assert one(C.find_strings(g, "hel%"), "string") == ["Hello"]
    assert one(C.find_strings(g, "hello"), "string") == []
    assert one(C.methods_for_string(g, "%e%", like=True), "id") == [194]
    assert C.strings_by_method(g, name="x").first().strings == ["Hello", "a,b\n\"q\""]
    assert one(C.methods_by_field(g, "LA;", "f", source="framework"), "action") == [0, 1, 1]
    assert one(C.methods_by_field(g, "LA;", "f", source="framework", only_read=True), "id") == [101]
    with pytest.raises(ValueError):
        C.methods_by_field(g, "LA;", only_read=True, only_write=True)
    assert one(C.method_field_refs(g, 101), "action") == [0, 1]
    assert one(C.find_class(g, "A"), "source") == ["b", "framework"]
    assert one(C.find_class(g, "Lk"), "name") == ["LK;"]


def test_files_and_sources(spark, g):
    files = spark.createDataFrame([("/p/%a/smali/x/C.smali", "%a"), ("/p/framework/x/C.smali", "framework"), ("/p/%a/pkg/Q.smali", "%a"), ("/p/%a/AndroidManifest.xml", "%a")], "path string, source string")
    assert [r.path for r in C.files_for_class(files, "x.C").collect()] == ["/p/framework/x/C.smali", "/p/%a/smali/x/C.smali"]
    assert [r.path for r in C.files_for_class(files, "Q", fallback_package="pkg").collect()] == ["/p/%a/pkg/Q.smali"]
    assert C.manifest_files(files, "%a").count() == 1
    inv = {"apks": spark.createDataFrame([(1, "app.x", "X.apk", False, False, "/system/app/X.apk")], INVENTORY["apks"])}
    texts = spark.createDataFrame([("framework",), ("%z",), ("X.apk",), ("app.x",), ("what",)], "text string")
    assert {r.text: r.source for r in C.resolve_source(inv, texts).collect()} == {"framework": "framework", "%z": "%z", "X.apk": "%system%app%X.apk", "app.x": "%system%app%X.apk", "what": "what"}


def test_components(spark, g):
    inv = {k: spark.createDataFrame([], s) for k, s in INVENTORY.items()}
    inv["apks"] = spark.createDataFrame([(1, "android", "f.apk", False, True, "/f.apk"), (2, "app", "c", False, False, "c")], INVENTORY["apks"])
    inv["activities"] = spark.createDataFrame([(5, "K", None, True, True, "", 1), (6, "L", "perm", True, True, "", 2)], INVENTORY["activities"])
    g = dict(g)
    g["sources"] = g["sources"].withColumn("name", F.when(F.col("id") == 3, "c").otherwise(F.col("name")))
    rows = D.component_calls(g, inv, name="t", depth=1)
    assert sorted((r["class"], tuple(r.path)) for r in rows.collect()) == [("LK;", (235, 101)), ("LL;", (194, 101))]
    assert D.component_calls(g, inv, name="t", depth=1, no_permissions=True).count() == 1
    assert D.paths_by_package(rows).count() == 2
    assert D.component_calls(g, inv, name="t", depth=3, one_path=True).count() == 2
    assert [r["class"] for r in D.intent_reading_activities(g, inv, getter="t", signature="", no_permissions=True).collect()] == ["LK;"]
    assert D.uri_parse_components(g, inv).count() == 0


@pytest.fixture(scope="module")
def facts(spark):
    f = lambda kind, rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'flags' else 'int' if n == 'action' else 'string'}" for n in names.split()) + ", source string")
    fw, a = "framework", "%a"
    return {
        "classes": f("classes", [("LX;", 3, fw), ("LY;", 2, fw), ("LX;", 2, a), ("LZ;", 2, a)], "class flags"),
        "supers": f("supers", [("LZ;", "LX;", a), ("LZ;", "LMissing;", a), ("LY;", "LX;", fw), ("LGone;", "LX;", a)], "child parent"),
        "interfaces": f("interfaces", [("LZ;", "LMissing;", a), ("LZ;", "LIface;", a)], "class interface"),
        "class_fields": f("class_fields", [("LX;", "f", "I", 2, fw), ("LX;", "f", "I", 2, a)], "class name ty flags"),
        "methods": f("methods", [("LX;", "m", "", "V", 2, a), ("LX;", "m", "", "I", 2, a), ("LZ;", "n", "", "V", 2, a), ("LY;", "k", "", "V", 2, fw)], "class name args ret flags"),
        "calls": f("calls", [("LZ;", "n", "", "LX;", "m", "", a), ("LZ;", "n", "", "LY;", "new", "I", a), ("LZ;", "n", "", "LZ;", "n", "", a), ("LZ;", "n", "", "LNo;", "q", "", a)], "caller_class caller_name caller_args callee_class callee_name callee_args"),
        "method_field_access": f("access", [("LX;", "f", "I", "LZ;", "n", "", 1, a)], "field_class field_name field_ty method_class method_name method_args action"),
        "strings": f("strings", [("s", a), ("s", a)], "string"),
        "method_strings": f("ms", [("s", "n", "", "LZ;", a)], "string method args class"),
    }


def test_build(spark, facts):
    g = {k: df.cache() for k, df in B.build_graph(spark, facts).items()}
    spec = {(r.name, r.source): (r.id, r.access_flags) for r in C.class_specs(g).collect()}
    assert spec["LMissing;", "framework"][1] == 2 and spec["LIface;", "framework"][1] == 32770 and spec["LNo;", "framework"][1] == 2
    assert spec["LX;", "framework"][1] == 2  # unknown bits are masked
    by_id = {v[0]: k for k, v in spec.items()}
    assert sorted((by_id[r.parent], by_id[r.child]) for r in g["supers"].collect()) == [(("LMissing;", "framework"), ("LZ;", "%a")), (("LX;", "%a"), ("LZ;", "%a")), (("LX;", "framework"), ("LY;", "framework"))]
    m = {r.id: (r["class"], r.name, r.ret, r.source) for r in C.method_specs(g).collect()}
    assert ("LY;", "new", "V", "%a") in m.values() and ("LNo;", "q", "V", "%a") in m.values()
    calls = sorted((m[r.caller][:2], m[r.callee][:3]) for r in g["calls"].collect())
    assert calls == [(("LZ;", "n"), ("LNo;", "q", "V")), (("LZ;", "n"), ("LX;", "m", "I")), (("LZ;", "n"), ("LX;", "m", "V")), (("LZ;", "n"), ("LY;", "new", "V"))]
    field = C.field_specs(g).where("source = '%a'").first().id
    assert [tuple(r) for r in g["method_field_access"].select("field", "action").collect()] == [(field, 1)]
    assert g["strings"].count() == 1 and g["method_strings"].count() == 1
    left = B.remove_source(g, "%a")
    assert left["sources"].count() == 1 and left["calls"].count() == 0 and left["supers"].count() == 1
    assert all(df.count() == (1 if k == "sources" else 0) for k, df in B.wipe(g).items())
    denied = B.build_graph(spark, facts, spark.createDataFrame([("%a",)], "pattern string"))
    assert denied["classes"].where("name = 'LZ;'").count() == 0
    assert B.id_collisions(g["classes"], "name", "source").count() == 0


def test_shortest_paths_through_a_hub(spark):
    """A thousand million walks lead through five layers of 63 methods; each method has its shortest one all the same."""
    width, depth = 63, 5
    ids = spark.range(width * depth)
    calls = ids.select((F.col("id") + width).alias("caller"), F.explode(F.sequence(F.col("id") - F.col("id") % width, F.col("id") - F.col("id") % width + width - 1)).alias("callee"))
    calls = calls.unionByName(spark.createDataFrame([(width * 5, 3), (7, 7), (2, 9)], "caller long, callee long"))
    calls = stored({"calls": calls.unionByName(calls)}, "calls")["calls"]
    seeds = ids.where(F.col("id") < width).select("id")
    found = {r.id: (list(r.path), r.length) for r in D.shortest_paths(seeds, calls, "callee", "caller", depth).collect()}
    assert found[width * 5] == ([width * 5, 3], 1) and found[7] == ([7, 7], 1) and found[2] == ([2, 9], 1)
    assert found[width * 5 + 1] == ([width * 5 + 1, width * 4, width * 3, width * 2, width, 0], 5) and len(found) == width * 5 + 2
    counts = list(D.walk_counts(seeds, calls, "callee", "caller", depth))
    assert counts[-1] > 62**5
    with pytest.raises(D.TooManyPaths):
        D.expand(seeds, calls, "callee", "caller", depth, max_paths=10**8)


def test_shortest_paths_of_nothing(spark):
    calls = spark.createDataFrame([(1, 2)], "caller long, callee long")
    assert D.shortest_paths(calls.limit(0).select(F.col("caller").alias("id")), calls, "callee", "caller", 3).count() == 0
    assert list(D.walk_counts(calls.select(F.col("caller").alias("id")), calls, "callee", "caller", 3)) == []


def test_field_access_broadcasts_no_table_of_names(spark, facts):
    """Files of names look small to Spark's size check, yet a hash table of them in every task would grow with the input."""
    g = B.build_graph(spark, facts)
    f = {k: B.stage_named(df, g["sources"]) for k, df in facts.items()}
    access = written(f["method_field_access"].unionByName(f["method_field_access"].withColumn("field_class", F.lit("LNone;"))), "access")[0]
    fields, methods, classes = (written(g[k], k)[0] for k in ("class_fields", "methods", "classes"))
    rows = B.resolve_field_access(access, fields, methods, classes)
    found = rows.collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, g["method_field_access"].collect())) and len(found) == 1
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
