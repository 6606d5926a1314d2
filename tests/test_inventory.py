from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codelode.operators import diff as G
from codelode.operators import inventory as I
from codelode.operators import inventory_build as E
from codelode.operators import review as H
from codelode.operators.traversal import NotFound
from codelode.schema import INVENTORY
from codelode.sources import device as S
from codelode.sources.listing import list_tree
from codelode.sources import facts as A
from codelode.streaming import streams

DATA = Path(__file__).parent / "data"


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_property_dump(spark):
    text = "[a.b]: [1]\n[empty]: []\n[multi]: [x\ny]\nnonsense\n[nl]: [\nz]\n[last]: [q]"
    assert tuples(S.read_property_dump(lines(spark, text))) == [("a.b", "1"), ("empty", ""), ("last", "q"), ("multi", "x\ny"), ("nl", "\nz")]


def test_lists(spark):
    got = S.read_service_list(lines(spark, "0\tactivity: [android.app.IActivityManager]", "1\tnone: []", "Found 2 services:", ""))
    assert [tuple(r) for r in got.orderBy("number").collect()] == [(0, "activity", "android.app.IActivityManager"), (1, "none", None)]
    assert tuples(S.read_package_list(lines(spark, "package:/data/app/a=b/base.apk=com.x", "", "junk", "package:=x"))) == [("/data/app/a=b/base.apk",)]
    assert tuples(S.read_pattern_list(lines(spark, "# c", "x", "", " y "))) == [("x",), ("y",)]


def test_files(spark, tmp_path):
    deep = tmp_path / "a/b/c/d/e/f"
    deep.mkdir(parents=True)
    (tmp_path / "a/one.prop").write_text("# no\nk=v=w\nsame=1\nblank\n")
    (tmp_path / "a/two.prop").write_text("same=2\n")
    (deep / "far.prop").write_text("far=1\n")
    (tmp_path / "a/x_service_contexts").write_text("# c\nsvc u:object\n* any\n\nsvc again\nother z\n")
    (tmp_path / "a/b/Framework.APK").write_text("x")
    assert tuples(S.read_property_files(spark, str(tmp_path))) == [("k", "v=w"), ("same", "2")]
    assert tuples(S.read_service_contexts(spark, str(tmp_path))) == [("other",), ("svc",)]
    assert [Path(r.path).name for r in S.package_files(spark, str(tmp_path)).collect()] == ["Framework.APK"]
    assert S.find_files(spark, str(tmp_path), suffix=".prop", max_depth=2).count() == 2
    assert sorted(Path(r.path).name for r in S.find_files(spark, str(tmp_path), kind="dir", min_depth=2, max_depth=3).collect()) == ["b", "c"]
    (tmp_path / "empty/hollow").mkdir(parents=True)
    (tmp_path / "empty/nothing.prop").write_text("")
    assert {Path(r.path).name for r in S.find_files(spark, str(tmp_path / "empty")).collect()} == {"nothing.prop"}
    assert {Path(r.path).name for r in S.find_files(spark, str(tmp_path), kind="dir", prefix="hol").collect()} == {"hollow"}
    (tmp_path / "/".join(["deep", *"x" * 80])).mkdir(parents=True)
    (tmp_path / "/".join(["deep", *"x" * 80, "far.txt"])).write_text("x")
    assert [r.depth for r in S.find_files(spark, str(tmp_path), name="far.txt").collect()] == [82]
    # many rounds of few folders find the same as one
    both = [tuples(list_tree(spark, str(tmp_path), folders=n)) for n in (3, 2000)]
    assert both[0] == both[1] and len(both[0]) == len(list(tmp_path.rglob("*")))
    assert {d for _, d, _ in tuples(list_tree(spark, f"file://{tmp_path}", max_depth=2))} == {1, 2}
    (tmp_path / "probe.csv").write_text('s,m,1,0,7,"x"\ns2,m2,0,1\n')
    assert tuples(S.read_probe_results(spark, str(tmp_path / "probe.csv"))) == [("s", "m", True, False), ("s2", "m2", False, True)]


def test_cached_result_and_snapshots(spark, tmp_path):
    calls = []

    def fn():
        calls.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert S.cached_result(spark, str(tmp_path), "op", {"a": 1}, fn, force).count() == 3
    assert S.cached_result(spark, str(tmp_path), "op", {"a": None}, fn).count() == 3
    assert len(calls) == 3
    E.rebuild_inventory(spark, {"apks": spark.range(2)}, str(tmp_path / "s"))
    with pytest.raises(Exception, match="already exists"):
        E.rebuild_inventory(spark, {"apks": spark.range(2)}, str(tmp_path / "s"))
    assert E.rebuild_inventory(spark, {"apks": spark.range(3)}, str(tmp_path / "s"), force=True)["apks"].count() == 3
    S.write_json(spark.range(1).select(F.array(F.struct("id")).alias("x")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().x[0].id == 0


@pytest.fixture(scope="module")
def manifests(spark):
    return S.read_manifests(spark, str(DATA / "manifests")).cache()


def test_manifests(spark, manifests):
    paths = manifests.select("file", F.lit("/system/priv-app/One/One.apk").alias("device_path"))
    apks = E.build_apks(manifests, paths).cache()
    assert [tuple(r) for r in apks.select("app_name", "name", "is_debuggable", "is_priv").collect()] == [("app.one", "One.apk", True, True)]
    got = lambda df: {r[0]: tuple(r)[1:] for r in df.collect()}
    acts = got(E.build_components(manifests, apks, "activity").select("class_name", "exported", "enabled"))
    assert acts == {"app.one.Main": (True, True), "app.one.Alias": (False, True)}
    assert got(E.build_components(manifests, apks, "receiver").select("class_name", "permission", "exported", "enabled")) == {"app.one.R": ("perm.R", False, False)}
    binders = spark.createDataFrame([("Lapp/one/S;", -1)], "class string, returns_binder int")
    assert got(E.build_services(manifests, apks, binders).select("class_name", "returns_binder")) == {"app.one.S": (-1,)}
    assert got(E.build_providers(manifests, apks).select("name", "read_permission", "write_permission", "grant_uri_permissions")) == {"app.one.P": ("perm.P", "perm.W", True)}
    assert got(E.build_permissions(manifests, apks).select("name", "protection_level")) == {"app.one.P": ("signature",), "app.one.Q": ("normal",)}
    assert got(E.build_uses_permissions(manifests, apks).select("name")) == {"perm.X": ()}
    assert got(E.build_protected_broadcasts(manifests).select("name")) == {"app.one.ACTION": ()}
    filters = S.manifest_filters(manifests, "activity")
    assert tuples(filters.select("action", "category", "scheme")) == [("EDIT", "DEFAULT", "app"), ("VIEW", "DEFAULT", "app")]


def test_disassembly(spark, tmp_path):
    text = A.read_disassembly(spark, str(DATA / "disassembly"), "%app")
    f = A.extract_code_facts(text)
    rows = {k: tuples(df.drop("source")) for k, df in f.items()}
    assert rows["classes"] == [("Lapp/Main;", 2)]
    assert rows["supers"] == [("Lapp/Main;", "Landroid/app/Activity;")]
    assert rows["interfaces"] == [("Lapp/Main;", "Lapp/Callback;")]
    assert rows["class_fields"] == [("Lapp/Main;", "TAG", "Ljava/lang/String;", 2 | 16 | 32), ("Lapp/Main;", "count", "I", 4)]
    assert rows["methods"] == [("Lapp/Main;", "onBind", "Landroid/content/Intent;", "Landroid/os/IBinder;", 2), ("Lapp/Main;", "run", "ILjava/lang/String;", "V", 8)]
    assert rows["calls"] == [("Lapp/Main;", "run", "ILjava/lang/String;", "Lapp/Other;", "help", "")]
    assert sorted(r[-1] for r in rows["method_field_access"]) == [0, 1]
    assert rows["strings"] == [("hello, world",), ('main, \\"tag\\"',)]
    assert rows["method_strings"] == [("hello, world", "run", "ILjava/lang/String;", "Lapp/Main;")]
    ins = A.instructions(text)
    assert tuples(E.returns_binder(ins)) == [("%app", "Lapp/Main;", -1)]
    hashes = {r.name: r.hash for r in E.method_hashes(ins).collect() if r["class"] == "Lapp/Main;"}
    assert len(hashes) == 2 and len(set(hashes.values())) == 2 and not any(h.endswith("=") for h in hashes.values())
    for kind in ("strings", "class_fields"):
        A.write_fact_csv(f[kind].unionByName(f[kind]), str(tmp_path), kind)
    assert tuples(A.read_fact_csv(spark, str(tmp_path), "strings")) == rows["strings"]
    assert A.read_fact_csv(spark, str(tmp_path), "class_fields").count() == 4
    (tmp_path / "supers.csv").write_text("only one\n")
    with pytest.raises(Exception):
        A.read_fact_csv(spark, str(tmp_path), "supers").collect()


def test_references(spark):
    resources = spark.createDataFrame([("p", "bool", "a", "0x7f01", "@bool/b"), ("p", "bool", "b", "0x7f02", "true"), ("p", "x", "c1", None, "@x/c2"), ("p", "x", "c2", None, "@x/c1"), ("p", "array", "l", None, "one"), ("p", "array", "l", None, "two"), ("q", "bool", "a", None, "no")], "package string, kind string, name string, id string, value string")
    values = spark.createDataFrame([("p", v) for v in ("@bool/a", "@0x7f02", "@x/c1", "@array/l", "@android:bool/z", "plain", None)], "package string, value string")
    got = E.resolve_references(values, resources)
    assert sorted((str(r.value), str(r.resolved)) for r in got.collect()) == [("@0x7f02", "true"), ("@android:bool/z", "@android:bool/z"), ("@array/l", "one"), ("@array/l", "two"), ("@bool/a", "true"), ("@x/c1", "@x/c1"), ("None", "None"), ("plain", "plain")]


def test_long_chains_of_references(spark):
    chain = [("p", "string", f"s{i}", None, f"@string/s{i + 1}") for i in range(50)] + [("p", "string", "s50", None, "found"), ("p", "id", "n", "0x" + "7" * 1200, "long")]
    resources = spark.createDataFrame(chain, "package string, kind string, name string, id string, value string")
    values = spark.createDataFrame([("p", "@string/s0"), ("p", "@0x" + "7" * 1200)], "package string, value string")
    assert sorted(r.resolved for r in E.resolve_references(values, resources).collect()) == ["found", "long"]


def test_hashes_tell_literals_apart(spark):
    def of(body):
        text = spark.createDataFrame([("/a", "s", ".class public LA;\n.method public m()V\n" + body + "\n.end method\n")], "path string, source string, text string")
        return E.method_hashes(A.instructions(text)).first().hash

    assert of('const-string v0, "pay v1 :now"') != of('const-string v0, "pay v2 :later"')
    assert of('const-string v0, "a # b"') != of('const-string v0, "a # c"')
    assert of('const-string v0, "a"  # said "b"') == of('    const-string p3, "a"')
    assert of('invoke-virtual {v0, v1}, LA;->b()V') == of('invoke-virtual {v4, v5}, LA;->b()V # note')
    assert of('const-string v0, "say \\"v1\\" # x"') != of('const-string v0, "say \\"v2\\" # x"')
    assert of(':a\ngoto :a\nconst/4 v0, 0x1') != of(':a\ngoto :a\nconst/4 v0, 0x2')


def test_diff_sources_and_snapshots_are_whole_or_absent(spark, tmp_path):
    good, bad = spark.range(3), spark.range(3).withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    base = str(tmp_path / "d")
    with pytest.raises(Exception, match="broken"):
        G.add_diff_source(base, {"apks": good, "services": bad}, "one")
    assert not any(p.name.startswith("diff_source") for p in (tmp_path / "d").rglob("*"))
    G.add_diff_source(base, {"apks": good, "services": good}, "one")  # the failure left nothing behind
    with pytest.raises(FileExistsError):
        G.add_diff_source(base, {"apks": good}, "one")
    assert spark.read.parquet(f"{base}/apks").count() == 3
    S.save_snapshot({"a": good}, str(tmp_path / "s"))
    with pytest.raises(Exception, match="broken"):
        S.save_snapshot({"a": spark.range(9), "b": bad}, str(tmp_path / "s"), force=True)
    assert S.open_snapshot(spark, str(tmp_path / "s"), ["a"])["a"].count() == 3 and len(list(tmp_path.iterdir())) == 2
    S.save_snapshot({"a": spark.range(9)}, str(tmp_path / "s"), force=True)
    assert S.open_snapshot(spark, str(tmp_path / "s"), ["a"])["a"].count() == 9


def test_framework_files(spark):
    files = spark.createDataFrame([(p, b, x) for p, b, x in (
        ("/s/framework/arm/boot-foo.jar", "/s/framework", True), ("/s/framework/foo.dex", "/s/framework", False), ("/s/framework/foo.vdex", "/s/framework", False), ("/p/framework/foo.jar", "/p/framework", False),
        ("/s/framework/framework-res.apk", "/s/framework", False), ("/s/framework/other.apk", "/s/framework", False), ("/s/framework/x.oat", "/s/framework", False),
    )], "path string, base string, failed boolean")
    assert sorted(r.path for r in E.dedupe_framework_files(files).collect()) == ["/p/framework/foo.jar", "/s/framework/foo.dex", "/s/framework/framework-res.apk"]
    assert "/s/framework/foo.vdex" in [r.path for r in E.dedupe_framework_files(files, allow_vdex=True).collect()]
    policies = spark.createDataFrame([("/e/plat.cil",), ("/e/29.0.cil",), ("/e/29.0.compat.cil",), ("/e/x.txt",)], "path string")
    assert tuples(E.select_policy_files(policies)) == [("/e/plat.cil",)]


def test_service_methods(spark):
    services = spark.createDataFrame([(1, "a", "p.IA", 0), (2, "b", "p.IB", 0)], INVENTORY["system_services"])
    constants = spark.createDataFrame([("Lp/IA$Stub;", "TRANSACTION_x", 1), ("Lp/IA$Stub;", "TRANSACTION_y", 2), ("Lp/IB$Stub;", "TRANSACTION_z", 1), ("Lp/IB$Stub;", "DESCRIPTOR", 1)], "class string, name string, value long")
    methods = spark.createDataFrame([("Lp/IA;", "x", "I", "V"), ("Lp/IB;", "z", "", "I")], "class string, name string, args string, ret string")
    got = E.build_service_methods(services, constants, methods)
    assert tuples(got.select("system_service_id", "name", "transaction_id", "signature", "return_type").na.fill("-")) == [(1, "x", 1, "-", "-"), (1, "y", 2, "-", "-"), (2, "z", 1, "", "I")]


@pytest.fixture(scope="module")
def inv(spark):
    inv = {k: spark.createDataFrame([], s) for k, s in INVENTORY.items()}
    inv["providers"] = spark.createDataFrame([(i, f"p{i}", a, None, False, None, None, True, True, 1) for i, a in enumerate(("left.authority", "x:left.authority", "a;left.authority;b", "not.left.authority:z"))], INVENTORY["providers"])
    inv["receivers"] = spark.createDataFrame([(1, "R", "perm.a", True, True, "", 1), (2, "S", None, True, True, "", 1), (3, "T", None, False, True, "", 2)], INVENTORY["receivers"])
    inv["system_services"] = spark.createDataFrame([(1, "a", "IA", 1), (2, "b", None, -1)], INVENTORY["system_services"])
    inv["system_service_methods"] = spark.createDataFrame([(1, 1, 1, "x", "I", "V", "h1"), (2, 1, 2, "y", None, None, None), (3, 2, 1, "z", "", "V", "h3")], INVENTORY["system_service_methods"])
    inv["permissions"] = spark.createDataFrame([(1, "perm.a", "normal|x", 1), (2, "perm.b", "signature", 1)], INVENTORY["permissions"])
    inv["apks"] = spark.createDataFrame([(1, "a", "A.apk", False, False, "/A.apk")], INVENTORY["apks"])
    return inv


def test_authorities_and_not_found(inv):
    assert [r.id for r in I.providers_with_authority(inv, "left.authority").collect()] == [0, 1, 2]
    with pytest.raises(NotFound):
        I.get_by_id(inv, "apks", 9)
    with pytest.raises(NotFound):
        I.service_classes(inv, "none")


def test_diff_with_itself_matches(inv):
    out = G.diff_all(inv, inv, "same")
    assert out["permissions"].where("not exists_in_diff or not protection_level_matches_diff").count() == 0
    assert out["providers"].where("not (exists_in_diff and exported_matches_diff and permission_matches_diff and read_permission_matches_diff)").count() == 0
    assert G.diff_components(inv["receivers"], inv["receivers"]).where("not (exists_in_diff and exported_matches_diff and permission_matches_diff)").count() == 0
    assert tuples(G.diff_service_methods(inv, inv)) == [(1, True, 1), (2, True, 0), (3, True, 1)]


def test_diff_and_review(spark, inv, tmp_path):
    other = dict(inv)
    # a repeated key: the row with the largest id counts
    other["receivers"] = spark.createDataFrame([(7, "R", "perm.a", True, True, "", 1), (9, "R", "perm.z", False, True, "", 1)], INVENTORY["receivers"])
    other["system_services"] = spark.createDataFrame([(5, "a", "IA", 1)], INVENTORY["system_services"])
    other["system_service_methods"] = spark.createDataFrame([(1, 5, 1, "x", "I", "V", "changed")], INVENTORY["system_service_methods"])
    d = G.diff_components(inv["receivers"], other["receivers"])
    assert [tuple(r) for r in d.orderBy("item").collect()] == [(1, True, False, False, "perm.z"), (2, False, False, False, None), (3, False, False, False, None)]
    rows = G.diffed(inv["receivers"], d, "receivers")
    assert [r.id for r in H.review_components(rows).collect()] == [2]
    m = G.diff_service_methods(inv, other)
    assert tuples(m) == [(1, True, -1), (2, False, 0), (3, False, 0)]
    reviewed = H.review_methods(G.diffed(inv["system_service_methods"], m, "system_service_methods"), inv["system_services"])
    assert sorted(r.id for r in H.filter_methods(reviewed).collect()) == [1, 2]
    assert [r.id for r in H.filter_methods(reviewed, modified_only=True).collect()] == [1]
    assert [r.id for r in H.filter_methods(reviewed, service="b", new_only=True, binder_available=False).collect()] == [3]
    assert [r.id for r in H.filter_components(inv["receivers"], normal=I.usable_app_permissions(inv)).collect()] == [1]
    assert sorted(r.id for r in H.filter_components(inv["receivers"], no_permission=True).collect()) == [2, 3]
    assert [r.id for r in H.hide(inv["receivers"], spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2,)], "id long")).collect()] == [2]
    assert [r.id for r in H.text_search(inv["receivers"], F.col("class_name"), "^[RS]$").orderBy("id").collect()] == [1, 2]
    assert H.text_search(inv["receivers"], F.col("class_name"), "(").count() == 0
    (tmp_path / "hidden.json").write_text('{"kind": "receivers", "ids": [1, 1, 2]}\n')
    assert H.read_hidden(spark, str(tmp_path / "hidden.json")).count() == 2
    G.add_diff_source(str(tmp_path / "d"), G.diff_all(inv, other, "o", apks=False), "o")
    assert tuples(G.list_diff_sources(spark, str(tmp_path / "d"), "system_services")) == [("o",)]
    G.remove_diff_source(spark, str(tmp_path / "d"), "o")
    assert not list((tmp_path / "d").rglob("*.parquet"))
    assert G.pending(inv["receivers"], d.where("item = 1")).count() == 2


def test_replace(spark, inv):
    new = {"receivers": inv["receivers"].withColumn("class_name", F.lit("N"))}
    with pytest.raises(ValueError):
        E.replace_apk(inv, new, 1)
    out = E.replace_apk(inv, new, 1, force=True)
    assert tuples(out["receivers"].select("id", "class_name")) == [(1, "N"), (2, "N"), (3, "T")]
    assert out["apks"].count() == 0


def test_log_stream(spark, tmp_path):
    rows = [(1, "E", "a", "boom", 7), (2, "I", "ss", "x", 1), (3, "V", "ss", "needle", 1), (0, "E", "a", "old", 7)]
    spark.createDataFrame(rows, "ts long, level string, tag string, message string, pid long").repartition(3).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("ts long, level string, tag string, message string, pid long").parquet(str(tmp_path / "in"))
    routes = [streams.Route("errors", level="E"), streams.Route("info", level="E", tag="ss", tag_level="I"), streams.Route("needle", message="needle"), streams.Route("p7", pid=7)]
    for _ in range(2):  # a second run finds nothing new
        streams.route_log_stream(log, routes, str(tmp_path / "out"), str(tmp_path / "cp"), since=1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert tuples(got.select("route", "ts")) == [("errors", 1), ("info", 1), ("info", 2), ("needle", 3), ("p7", 1)]


def test_ingest_stream(spark, tmp_path):
    for source, text in (("a", "LA;,2\n"), ("b", "LB;,2\nLC;,4\n")):
        (tmp_path / "in" / source).mkdir(parents=True)
        (tmp_path / "in" / source / "classes.csv").write_text(text)
    run = lambda cp: streams.ingest_sources_stream(spark, str(tmp_path / "in"), "classes", str(tmp_path / "out"), str(tmp_path / cp)).awaitTermination()
    run("cp")
    run("cp-lost")  # even without its checkpoint, the ledger keeps a source from being loaded twice
    (tmp_path / "in/c").mkdir()
    (tmp_path / "in/c/classes.csv").write_text("LD;,2\n")
    run("cp")
    assert tuples(spark.read.parquet(str(tmp_path / "out/classes")).select("class", "source")) == [("LA;", "a"), ("LB;", "b"), ("LC;", "b"), ("LD;", "c")]
    assert streams.read_ledger(spark, str(tmp_path / "out/_ledger")).count() == 3


def test_disassembly_is_cut_at_headers(spark):
    """Context of lines in files with several classes, none, headers that are no headers, and without text."""
    files = [("/a", "s", "junk\n.class public La;\r\n.method a(I)V\n x\n.class Lb;\n y\n.method bad\n z\n\n.method c()I\n w\n"), ("/b", "s", ""), ("/c", "s", ".method m()V\n.class La;\nq"), ("/d", "s", None), ("/e", "s", "no heads\nat all")]
    lines = A.disassembly_lines(spark.createDataFrame(files, "path string, source string, text string"))
    found = {(r.path, r.line): (r.value, r["class"], r.method, r.args, r.ret) for r in lines.collect()}
    want = {}
    for path, _, text in files:
        cls = header = None
        for n, line in enumerate([] if text is None else text.replace("\r\n", "\n").split("\n")):
            if line.strip().startswith(".class"):
                cls = line.split()[-1]
            if line.strip().startswith(".method"):
                header = line.split()[-1] if "(" in line else ""
            name, _, rest = (header or "").partition("(")
            want[path, n] = (line, cls, name if header else header, rest.partition(")")[0] if header else header, rest.partition(")")[2] if header else header)
    assert found == want
    plan = A.tagged_lines(spark.createDataFrame(files, "path string, source string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_literals_with_comments(spark):
    text = '.class La;\n.field public static final s:Ljava/lang/String; = "n # \\"q\\""  # c "d"\n.method m()V\n const-string v0, "x # y"  # note\n const-string/jumbo p1, "a \\"b\\" c" # "z"\n const-string v2, "plain"\n const-string v3, ""#e\n const-string v4, "' + "\\u4e2d" * 3000 + '"\n.end method'
    facts = A.extract_code_facts(spark.createDataFrame([("/c", "s", text)], "path string, source string, text string"))
    assert {r.string[:12] for r in facts["strings"].collect()} == {'n # \\"q\\"', "x # y", 'a \\"b\\" c', "plain", "", "\\u4e2d\\u4e2d"}
    assert facts["method_strings"].count() == 5


def test_cache_is_never_half_written_or_stale(spark, tmp_path):
    base, source = str(tmp_path / "cache"), str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    count = lambda force=False: S.cached_result(spark, base, "op", {}, lambda: spark.read.parquet(source), force, [source]).count()
    assert count() == 3
    with pytest.raises(ZeroDivisionError):
        S.cached_result(spark, base, "op", {}, lambda: 1 / 0, True, [source])
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        S.cached_result(spark, base, "op", {}, lambda: broken, True, [source])
    assert count() == 3 and not list((tmp_path / "cache").rglob("half-*"))
    spark.range(5).write.mode("overwrite").parquet(source)
    assert count() == 5
    for _ in range(3):
        assert count(force=True) == 5
    assert sorted(len([d for d in p.iterdir() if d.is_dir()]) for p in (tmp_path / "cache" / "op").iterdir()) == [1, 2]
    other = lambda: S.cached_result(spark, base, "two", {}, lambda: spark.range(1)) and spark.range(9)  # noqa: E731  another call is done before this one
    assert S.cached_result(spark, base, "two", {}, other).count() == 1
    assert S.files_fingerprint(spark, [str(tmp_path / "none")]) != S.files_fingerprint(spark, [source])
