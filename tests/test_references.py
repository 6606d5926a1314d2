"""References in manifests against a reading of the resources one step at a time."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codelode.operators import inventory_build as E
from codelode.operators import references as R
from codelode.sources import device as S

A = 'xmlns:android="http://schemas.android.com/apk/res/android"'
RESOURCES = "package string, kind string, name string, value string"


def follow(entries, package, key):
    """What an entry stands for: (found, text)."""
    seen = []
    while True:
        value = entries[package, key]
        if value is None or not value.startswith("@") or "/" not in value or value in seen:
            return value
        if not any(p == package and k.split("/")[0] == value[1:].split("/")[0] for p, k in entries):
            return value
        seen.append(value)
        if (package, value[1:]) not in entries:
            return None
        key = value[1:]


def test_close_resources(spark):
    r = random.Random(8)
    rows = []
    for p in ("a", "b"):
        rows += [(p, "string", f"c{i}", f"@string/c{i + 1}" if i < 99 else "end") for i in range(100)]  # a long chain
        rows += [(p, "string", f"r{i}", r.choice([f"@string/r{r.randrange(40)}", f"@bool/r{r.randrange(40)}", "@string/none", "@other/x", "@android:string/x", "@plain", "text", "", None])) for i in range(40)]
        rows += [(p, "bool", f"r{i}", r.choice(["true", "false", "TRUE", f"@bool/r{r.randrange(40)}", f"@string/r{r.randrange(40)}"])) for i in range(40)]
        rows += [(p, "string", f"l{i}", f"@string/l{(i + 1) % 5}") for i in range(5)] + [(p, "string", f"t{i}", f"@string/{'l2' if i == 0 else f't{i - 1}'}") for i in range(9)] + [(p, "string", "self", "@string/self")]
    rows += [("a", "string", "c99", "end2"), ("a", None, "x", "y"), (None, "string", "x", "y"), ("a", "string", None, "y")]
    entries = {(p, f"{k}/{n}"): v for p, k, n, v in reversed(rows) if p and k and n}
    found = {(x.package, x.key): x.text for x in R.close_resources(spark.createDataFrame(rows, RESOURCES)).collect()}
    assert found == {(p, k): follow(entries, p, k) for p, k in entries}


def test_no_resources(spark):
    assert R.close_resources(spark.createDataFrame([], RESOURCES)).count() == 0


@pytest.fixture(scope="module")
def manifests(spark):
    receivers = "".join(f'<receiver android:name=".R{i}" {x}/>' for i, x in enumerate((
        "", 'android:exported="@bool/no"', 'android:exported="@bool/lost"', 'android:exported="True"', 'android:exported="false"', 'android:enabled="@bool/off"', 'android:permission="@string/perm"', 'android:permission="@string/lost"', 'android:exported="@bool/odd"',
    )))
    text = f'<manifest {A} package="p.q"><application android:debuggable="@bool/yes">{receivers}<receiver android:name="@string/cls"/><receiver android:name="x.y/.Z"/></application></manifest>'
    return S.parse_manifests(spark.createDataFrame([("/a/AndroidManifest.xml", text), ("/b/AndroidManifest.xml", text.replace("p.q", "other")), ("/c/AndroidManifest.xml", "<manifest")], "file string, text string"))


PATHS = [("/a/AndroidManifest.xml", "/system/A.apk"), ("/b/AndroidManifest.xml", "/system/B.apk")]
ENTRIES = [("p.q", "bool", "no", "@bool/nope"), ("p.q", "bool", "nope", "false"), ("p.q", "bool", "off", "false"), ("p.q", "bool", "yes", "true"), ("p.q", "bool", "odd", "False"), ("p.q", "string", "perm", "the.PERM"), ("p.q", "string", "cls", ".Named")]


def built(spark, manifests, resources):
    paths = spark.createDataFrame(PATHS, "file string, device_path string")
    apks = E.build_apks(manifests, paths, resources=resources)
    rows = E.build_components(manifests, apks, "receiver", resources).join(apks.select(F.col("id").alias("apk_id"), "app_name", "is_debuggable"), "apk_id")
    return {(r.app_name, r.class_name): (r.exported, r.enabled, r.permission, r.is_debuggable) for r in rows.collect()}


def test_builds_resolve(spark, manifests):
    found = built(spark, manifests, spark.createDataFrame(ENTRIES, RESOURCES))
    own = {k[1]: v for k, v in found.items() if k[0] == "p.q"}
    assert own == {
        "p.q.R0": (False, True, None, True), "p.q.R1": (False, True, None, True), "p.q.R2": (True, True, None, True), "p.q.R3": (True, True, None, True), "p.q.R4": (False, True, None, True), "p.q.R5": (False, False, None, True),
        "p.q.R6": (False, True, "the.PERM", True), "p.q.R7": (False, True, "@string/lost", True), "p.q.R8": (True, True, None, True), "p.q.Named": (False, True, None, True), "x.y.Z": (False, True, None, True),
    }
    other = {k[1]: v for k, v in found.items() if k[0] == "other"}  # another package's resources don't count
    assert other["other.R1"] == other["other.R2"] == (True, True, None, False) and other["other.R5"][1] and other["other.R6"][2] == "@string/perm" and "cls" in other


def test_builds_without_resources(spark, manifests):
    found = built(spark, manifests, None)
    assert found["p.q", "p.q.R1"] == (True, True, None, False) and found["p.q", "p.q.R6"] == (False, True, "@string/perm", False)


def test_whole_build_resolves(spark, manifests):
    empty = lambda schema: spark.createDataFrame([], schema)
    inv = E.build_inventory(manifests, spark.createDataFrame(PATHS, "file string, device_path string"), empty("name string, value string"), empty("number long, name string, iface string"), empty("class string, returns_binder int"), empty("class string, name string, value string"), empty("class string, name string, args string, ret string"), resources=spark.createDataFrame(ENTRIES, RESOURCES))
    assert {r.class_name for r in inv["receivers"].where("permission = 'the.PERM'").collect()} == {"p.q.R6"}


def test_read_resources(spark, tmp_path):
    values = Path(tmp_path) / "app" / "res" / "values"
    values.mkdir(parents=True)
    (values / "strings.xml").write_text('<?xml version="1.0"?><resources>\n<string name="a">@string/b</string><string name="b">B &amp; c</string><string name="e"></string><item name="i">x</item></resources>')
    (values / "bools.xml").write_text('<resources><bool name="yes">true</bool></resources>')
    (values / "public.xml").write_text("<resources/>")
    found = sorted((r.base.endswith("/app"), r.kind, r.name, r.value) for r in S.read_resources(spark, str(tmp_path)).collect())
    assert [f for f in found if f[2] != "e"] == [(True, "bool", "yes", "true"), (True, "string", "a", "@string/b"), (True, "string", "b", "B & c")]
    assert all(f[3] is None for f in found if f[2] == "e")


def test_rounds_leave_out_what_nothing_points_at(spark, monkeypatch):
    """The rounds carry ids alone, and of entries that have ended only those that an open one points at."""
    rows = [("p", "string", f"plain{i}", "x") for i in range(50)]
    rows += [("p", "string", f"c{i}", f"@string/c{i + 1}") for i in range(9)] + [("p", "string", "c9", "end"), ("p", "string", "lost", "@string/none"), ("p", "string", "other", "@dimen/none"), ("p", "string", "self", "@string/self")]
    seen, write = [], R.written

    def noting(df, what="step", counted=None):
        out = write(df, what, counted)
        seen.append((what, df.columns, out[0].count()))
        return out

    monkeypatch.setattr(R, "written", noting)
    found = {x.key: x.text for x in R.close_resources(spark.createDataFrame(rows, RESOURCES)).collect()}
    assert found == {f"string/plain{i}": "x" for i in range(50)} | {f"string/c{i}": "end" for i in range(10)} | {"string/lost": None, "string/other": "@dimen/none", "string/self": "@string/self"}
    assert all("package" not in columns and "text" not in columns for what, columns, _ in seen if what != "resources")
    assert {n for what, _, n in seen if what == "ended"} <= {0, 1, 2}
