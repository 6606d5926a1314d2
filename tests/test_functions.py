import pytest
from pyspark.sql import functions as F

from codelode.functions import expr as X
from codelode.schema import FLAGS


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i").select(column).collect()]




@pytest.mark.parametrize(("make", "cases"), [
    (lambda A: X.to_dotted(A), [("La/b/C;", "a.b.C"), ("a.b.C", "a.b.C"), ("C", "C"), (None, None)]),
    (lambda A: X.to_slashed(A), [("a.b.C", "La/b/C;"), ("La/b/C;", "La/b/C;")]),
    (lambda A: X.class_path(A), [("La/b/C$D;", "a/b/C$D.smali"), ("a.C", "a/C.smali")]),
    (lambda A: X.simple_name(A), [("a.b.C", "C"), ("C", "C")]),
    (lambda A: X.package_of(A), [("a.b.C", "a.b"), ("C", ""), ("La/C;", "a")]),
    (lambda A: X.has_package(A), [("a.C", True), (".C", False), ("C", False)]),
    (lambda A: X.with_package(A, F.lit("x.y")), [("a.b.C", "x.y.C"), ("C", "x.y.C")]),
    (lambda A: X.with_simple_name(A, F.lit("Z")), [("a.b.C", "a.b.Z"), ("C", "Z")]),
    (lambda A: X.from_manifest_name(F.lit("p"), A), [(".C", "p.C"), ("q/.C", "q.C"), ("q/r.C", "r.C"), ("r.C", "r.C")]),
    (lambda A: F.array_join(X.split_signature(A), " "), [("I[JLa/b;[[Lc;Z", "I [J La/b; [[Lc; Z"), ("", ""), ("Q", None)]),
    (lambda A: X.squash(A), [("/a/b.apk", "%a%b.apk"), ("/a%b\\c", "%a\\%b\\\\c")]),
    (lambda A: X.unsquash(X.squash(A)), [(p, p) for p in ("/a/b.apk", "/a%b\\c", "\\%/", "%%\\\\")]),
    (lambda A: X.file_name(A), [("/a/b.c.apk", "b.c.apk")]),
    (lambda A: X.stem(A), [("/a/b.c.apk", "b")]),
    (lambda A: X.extension(A), [("/a/b.c.apk", "apk"), ("/a.b/c", None)]),
    (lambda A: F.array_join(X.authorities(A), ","), [("a:b;c", "a,b,c"), ("a", "a")]),
])
def test_text(spark, make, cases):
    assert values(spark, make(F.col("a")), *((c[0], None) for c in cases)) == [c[1] for c in cases]


def test_tri_state_tables(spark):
    A, B = F.col("a"), F.col("b")
    t, u, f = 1, 0, -1
    rows = [(a, b) for a in (t, u, f) for b in (t, u, f)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r.a, r.b): (r.x, r.o) for r in df.select("a", "b", X.tri_and(A, B).alias("x"), X.tri_or(A, B).alias("o")).collect()}
    for a, b in rows:
        assert got[a, b][0] == (b if a == t else a)
        assert got[a, b][1] == (t if t in (a, b) else f if (a, b) == (f, f) else u)
    odd = spark.createDataFrame([(7,), (None,), (1,), (-1,)], "a int").select(X.tri_from_code(A), X.tri_true_or_unknown(A), X.tri_false_or_unknown(A), X.tri_text(A), X.tri_known(A)).collect()
    assert [tuple(r) for r in odd] == [(0, True, True, "unknown", False), (0, True, True, "unknown", False), (1, True, False, "true", True), (-1, False, True, "false", True)]


def test_flags_and_tags(spark):
    A = F.col("a")
    df = spark.createDataFrame([(FLAGS["PUBLIC"] | FLAGS["ABSTRACT"],)], "a long")
    row = df.select(X.is_public(A), X.is_not_abstract(A), X.has_all(A, 1026), X.flags_difference(A, F.lit(2).cast("long")), X.flags_union(A, F.lit(4).cast("long"))).first()
    assert tuple(row) == (True, False, True, 1024, 1030)
    got = spark.createDataFrame([("ILa/IFoo;", None), ("La/FooListener;", None), ("La/Foo;", None), ("[La/IFoo;", None), ("I", None)], "a string, b string").select(X.is_binder_like(X.split_signature(A)), X.has_class(X.split_signature(A))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (False, True), (False, False), (False, False)]


def test_argument_hash_tells_null_from_empty(spark):
    got = values(spark, X.argument_hash(F.col("a"), F.col("b")), ("x", None), ("x", ""), (None, "x"), ("x\x1f", ""))
    assert len(set(got)) == 4


def test_source_file_parts(spark):
    df = spark.createDataFrame([("/p/framework/smali/a/b/C.smali",), ("/p/%system%app%X.apk/smali_classes2/a/C.smali",)], "a string").select(X.source_file_parts(F.col("a")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in df] == [("framework", "a.b.C", None), ("%system%app%X.apk", "a.C", "/system/app/X.apk")]
