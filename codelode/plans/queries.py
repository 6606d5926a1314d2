"""Registered queries over the derived graph and inventory, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import expr as X
from codelode.operators import build as B
from codelode.operators import diff as G
from codelode.operators import hierarchy as L
from codelode.operators import inventory as I
from codelode.operators import inventory_build as E
from codelode.operators import lookups as C
from codelode.operators import review as H
from codelode.operators import traversal as D
from codelode.plans import derive
from codelode.plans.derive import other_sql, with_views
from codelode.plans.storage import stored
from codelode.streaming.streams import Route, routed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ALL = (*derive.GRAPH, *derive.INVENTORY, "components", *derive.BASE)
CLASS, FIELD_CLASS = "Lp/C3;", "Lp/C3;"


def query(name: str, sql: str | None):
    """Register fn(t) under a name; t: all tables and views."""

    def add(fn: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(derive.tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return fn

    return add


def paths(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"), *more)


# SQL that several oracles share.
SPEC = "SELECT m.id, c.name AS class, m.name, m.args AS signature, m.ret, s.name AS source, m.access_flags FROM methods m JOIN classes c ON c.id = m.class JOIN sources s ON s.id = m.source"
FSPEC = "SELECT f.id, c.name AS class, f.name, f.ty, s.name AS source, f.access_flags FROM class_fields f JOIN classes c ON c.id = f.class JOIN sources s ON s.id = c.source"
CSPEC = "SELECT c.id, c.name, s.name AS source, c.access_flags FROM classes c JOIN sources s ON s.id = c.source"
EDGES = "edges AS (SELECT DISTINCT caller, callee FROM calls)"


def walks(seed: str, depth: int, backward: bool = True) -> str:
    """CTEs edges and w(path list, tip, length)."""
    at, to = ("callee", "caller") if backward else ("caller", "callee")
    grow = (lambda p: f"list_prepend(e.{to}, {p})") if backward else (lambda p: f"list_append({p}, e.{to})")
    return f"{EDGES}, w(path, tip, length) AS (SELECT {grow('[z.id]')}, e.{to}, 1 FROM ({seed}) z JOIN edges e ON e.{at} = z.id UNION ALL SELECT {grow('w.path')}, e.{to}, w.length + 1 FROM w JOIN edges e ON e.{at} = w.tip WHERE w.length < {depth})"


SEED = f"SELECT m.id FROM methods m JOIN classes c ON c.id = m.class WHERE c.name = '{CLASS}'"
PATHS = "SELECT array_to_string(path, '>') AS path, CAST(length AS INT) AS length FROM w"


# Call walks.


@query("callers_d3", f"{walks(SEED, 3)} {PATHS}")
def _(t):
    return paths(D.find_callers(stored(t, "calls"), cls=CLASS, depth=3))


for _depth in (1, 2):
    query(f"callers_d{_depth}", f"{walks(SEED, _depth)} {PATHS}")(lambda t, d=_depth: paths(D.find_callers(stored(t, "calls") if d > 1 else t, cls=CLASS, depth=d)))


@query("callers_by_source", f"{walks(SEED, 3)} {PATHS} JOIN methods m ON m.id = w.path[1] JOIN sources s ON s.id = m.source WHERE s.name = 'asia'")
def _(t):
    return paths(D.find_callers(stored(t, "calls"), cls=CLASS, call_source="asia", depth=3))


@query("callers_simple", f"{walks(SEED, 3)} {PATHS} WHERE len(list_distinct(path)) = len(path)")
def _(t):
    return paths(D.find_callers(stored(t, "calls"), cls=CLASS, depth=3, simple=True))


@query("outgoing_d3", f"{walks(SEED, 3, False)} {PATHS}")
def _(t):
    return paths(D.find_outgoing(stored(t, "calls"), cls=CLASS, depth=3))


@query("outgoing_into_source", f"{walks(SEED, 3, False)} {PATHS} JOIN methods m ON m.id = w.path[-1] JOIN sources s ON s.id = m.source WHERE s.name = 'framework'")
def _(t):
    return paths(D.find_outgoing(stored(t, "calls"), cls=CLASS, into_source="framework", depth=3))


@query("path_ends", f"{walks(SEED, 2)}, x AS ({SPEC}) SELECT array_to_string(path, '>') AS path, CAST(length AS INT) AS length, a.class AS src_class, a.source AS src_source, b.class AS dst_class, b.source AS dst_source, CAST(len(path) AS INT) AS n FROM w JOIN x a ON a.id = w.path[1] JOIN x b ON b.id = w.path[-1]")
def _(t):
    rows = D.assemble_paths(t, D.find_callers(stored(t, "calls"), cls=CLASS, depth=2))
    a, b = X.path_src(F.col("methods")), X.path_dst(F.col("methods"))
    return rows.select(F.array_join("path", ">").alias("path"), "length", a["class"].alias("src_class"), a["source"].alias("src_source"), b["class"].alias("dst_class"), b["source"].alias("dst_source"), X.path_len(F.col("methods")).alias("n"))


@query("path_display", f"{walks(SEED, 2)}, x AS ({SPEC}), h AS (SELECT path, unnest(path) AS id, unnest(range(1, len(path) + 1)) AS i FROM w) SELECT array_to_string(h.path, '>') AS path, string_agg(concat(replace(substr(x.class, 2, length(x.class) - 2), '/', '.'), '.', x.name, '(', x.signature, ')', ' @', x.source), ' > ' ORDER BY i) AS shown FROM h JOIN x ON x.id = h.id WHERE i < len(h.path) GROUP BY h.path")
def _(t):
    rows = D.assemble_paths(t, D.find_callers(stored(t, "calls"), cls=CLASS, depth=2))
    return rows.select(F.array_join("path", ">").alias("path"), D.display_path(F.col("methods"), hide_last=True, show_source=True).alias("shown"))


# Inheritance.


def closure_sql(name: str, seed: str, edges: str, tip: str, step: str) -> str:
    return f"{name}(id) AS (SELECT e.{step} FROM ({seed}) z JOIN {edges} e ON e.{tip} = z.id UNION SELECT e.{step} FROM {name} JOIN {edges} e ON e.{tip} = {name}.id)"


def class_rows(ids: str, where: str = "") -> str:
    return f"SELECT DISTINCT x.source, x.name, x.access_flags FROM ({CSPEC}) x JOIN {ids} z ON z.id = x.id {where}"


@query("parents_of", closure_sql("up", "SELECT c.id FROM classes c JOIN sources s ON s.id = c.source WHERE c.name = 'Lp/C75;' AND s.name = 'framework'", "supers", "child", "parent") + " " + class_rows("up"))
def _(t):
    return D.find_parents(stored(t, "supers"), "Lp/C75;", "framework")


@query("children_of", closure_sql("down", "SELECT id FROM classes WHERE name = 'Lp/C1;'", "supers", "parent", "child") + " " + class_rows("down"))
def _(t):
    return D.find_children(stored(t, "supers"), "Lp/C1;")


@query("children_child_source", closure_sql("down", "SELECT c.id FROM classes c JOIN sources s ON s.id = c.source WHERE c.name = 'Lp/C1;' AND s.name = 'asia'", "supers", "parent", "child") + " " + class_rows("down", "WHERE x.source = 'europe'"))
def _(t):
    return D.find_children(stored(t, "supers"), "Lp/C1;", parent_source="asia", child_source="europe")


IMPL = closure_sql("direct", f"SELECT id FROM classes WHERE name = '{CLASS}'", "interfaces", "interface", "class") + ", " + closure_sql("below", "SELECT id FROM direct", "supers", "parent", "child") + ", both_ AS (SELECT id FROM direct UNION SELECT id FROM below)"


@query("implementers", f"{IMPL} {class_rows('both_')}")
def _(t):
    return D.find_implementers(stored(t, "supers", "interfaces"), CLASS)


@query("implementers_in_source", f"{IMPL} {class_rows('both_', 'WHERE x.source = ' + chr(39) + 'framework' + chr(39))}")
def _(t):
    return D.find_implementers(stored(t, "supers", "interfaces"), CLASS, impl_source="framework")


# The same by labels.


def labelled(t, *names: str) -> dict[str, DataFrame]:
    return L.with_labels({k: t[k] for k in ("sources", "classes", "supers", "interfaces")}, *names)


for _name, _find in {
    "parents_of": lambda t: D.find_parents(labelled(t, "supers"), "Lp/C75;", "framework"),
    "children_of": lambda t: D.find_children(labelled(t, "supers"), "Lp/C1;"),
    "children_child_source": lambda t: D.find_children(labelled(t, "supers"), "Lp/C1;", parent_source="asia", child_source="europe"),
    "implementers": lambda t: D.find_implementers(labelled(t), CLASS),
}.items():
    QUERIES[f"{_name}_labelled"] = lambda spark, sf_dir, find=_find: find(derive.tables(spark, sf_dir))
    ORACLE_SQL[f"{_name}_labelled"] = ORACLE_SQL[_name]

# Classes with two parents, an edge that closes a cycle, one to itself, and every class as a seed of its own.
LOOSE = "e(parent, child) AS (SELECT parent, child FROM supers UNION SELECT interface, class FROM interfaces UNION SELECT 40, 5 UNION SELECT 9, 9)"


def loose_edges(t) -> DataFrame:
    spark = t["supers"].sparkSession
    more = spark.createDataFrame([(40, 5), (9, 9)], "parent long, child long")
    return t["supers"].select("parent", "child").unionByName(t["interfaces"].select(F.col("interface").alias("parent"), F.col("class").alias("child"))).unionByName(more)


@query("labelled_below_each", f"{LOOSE}, r(root, id) AS (SELECT e.parent, e.child FROM e UNION SELECT r.root, e.child FROM r JOIN e ON e.parent = r.id) SELECT root, id FROM r")
def _(t):
    seeds = t["classes"].select(F.col("id").alias("root"), "id").unionByName(t["interfaces"].select(F.col("interface").alias("root"), F.col("interface").alias("id"))).unionByName(t["supers"].select(F.col("parent").alias("root"), F.col("parent").alias("id")))
    return L.related(*L.interval_labels(loose_edges(t), "parent", "child"), seeds, True, "root")


@query("labelled_above_each", f"{LOOSE}, r(root, id) AS (SELECT e.child, e.parent FROM e UNION SELECT r.root, e.parent FROM r JOIN e ON e.child = r.id) SELECT root, id FROM r")
def _(t):
    return L.related(*L.interval_labels(loose_edges(t), "parent", "child"), t["classes"].select(F.col("id").alias("root"), "id"), False, "root")


@query("source_fallback", closure_sql("down", "SELECT id FROM classes WHERE id = 3", "supers", "parent", "child") + " " + class_rows("down"))
def _(t):
    # the class is known outside the framework alone here, so the first try finds nothing
    g = {"sources": t["sources"], "supers": stored(t, "supers")["supers"], "classes": t["classes"].where("id <> 2")}
    return D.with_source_fallback(lambda source: D.find_children(g, "Lp/C1;", parent_source=source))


# Method, field, class and string lookups.

for _name, _args in {
    "name": {"name": "m3"},
    "class": {"cls": CLASS},
    "class_name": {"cls": CLASS, "name": "m3"},
    "name_sig": {"name": "m3", "signature": ""},
    "full": {"cls": CLASS, "name": "m3", "signature": ""},
}.items():
    for _source in (None, "framework"):
        _where = " AND ".join(f"x.{'class' if k == 'cls' else k} = '{v}'" for k, v in (_args | ({"source": _source} if _source else {})).items())
        _sfx = "_in_source" if _source else ""
        query(f"methods_by_{_name}{_sfx}", f"SELECT * FROM ({SPEC}) x WHERE {_where}")(lambda t, a=_args, s=_source: C.get_methods(t, source=s, **a))
        query(f"method_ids_by_{_name}{_sfx}", f"SELECT id FROM ({SPEC}) x WHERE {_where}")(lambda t, a=_args, s=_source: C.get_method_ids(t, source=s, **a))

for _name, _args in {"class": {"cls": FIELD_CLASS}, "name": {"cls": FIELD_CLASS, "name": "f1"}, "full": {"cls": FIELD_CLASS, "name": "f0", "ty": "I", "source": "framework"}}.items():
    _where = " AND ".join(f"x.{'class' if k == 'cls' else k} = '{v}'" for k, v in _args.items())
    query(f"fields_by_{_name}", f"SELECT * FROM ({FSPEC}) x WHERE {_where}")(lambda t, a=_args: C.get_fields(t, **a))
    query(f"field_ids_by_{_name}", f"SELECT id FROM ({FSPEC}) x WHERE {_where}")(lambda t, a=_args: C.get_field_ids(t, **a))

WITH_METHOD = f"SELECT x.name AS class, x.source FROM methods m JOIN ({CSPEC}) x ON x.id = m.class WHERE m.name = 'm3'"


@query("classes_with_method", WITH_METHOD)
def _(t):
    return C.classes_with_method(t, "m3")


@query("classes_with_method_concrete", f"{WITH_METHOD} AND m.args = '' AND (x.access_flags & 33792) = 0 AND x.source = 'framework'")
def _(t):
    return C.classes_with_method(t, "m3", args="", source="framework", no_abstract=True)


@query("classes_with_method_grouped", f"SELECT source, string_agg(class, ',' ORDER BY class) AS classes FROM ({WITH_METHOD}) GROUP BY source")
def _(t):
    return C.by_source(C.classes_with_method(t, "m3")).select("source", F.array_join("classes", ",").alias("classes"))


@query("all_sources", "SELECT DISTINCT name FROM sources")
def _(t):
    return C.all_sources(t)


@query("classes_for", f"SELECT name FROM ({CSPEC}) x WHERE source = 'asia'")
def _(t):
    return C.classes_for(t, "asia")


@query("methods_for", f"SELECT * FROM ({SPEC}) x WHERE source = 'asia'")
def _(t):
    return C.methods_for(t, "asia")


@query("find_class_prefix", f"SELECT name, source FROM ({CSPEC}) x WHERE name ILIKE 'Lp/C1%'")
def _(t):
    return C.find_class(t, "Lp/c1")


@query("find_class_exact", f"SELECT name, source FROM ({CSPEC}) x WHERE name = '{CLASS}'")
def _(t):
    return C.find_class(t, "p.C3")


@query("strings_for_method", "SELECT s.string FROM strings s JOIN method_strings u ON u.string = s.id WHERE u.method = 71")
def _(t):
    return C.strings_for_method(t, 71)


@query("strings_for_source", "SELECT s.string FROM strings s JOIN sources z ON z.id = s.source WHERE z.name = 'framework'")
def _(t):
    return C.strings_for_source(t)


for _name, _pattern, _test in (("like", "%AR%", "ILIKE '%AR%'"), ("exact", "red widget", "= 'red widget'")):
    query(f"find_strings_{_name}", f"SELECT s.string, z.name AS source FROM strings s JOIN sources z ON z.id = s.source WHERE s.string {_test}")(lambda t, p=_pattern: C.find_strings(t, p))
    query(f"methods_for_string_{_name}", f"SELECT x.* FROM ({SPEC}) x WHERE x.id IN (SELECT u.method FROM method_strings u JOIN strings s ON s.id = u.string WHERE s.string {_test}) AND x.source = 'framework'")(lambda t, p=_pattern: C.methods_for_string(t, p, "%" in p, "framework"))


@query("strings_by_method", f"SELECT x.id, x.class, x.name, string_agg(s.string, ',' ORDER BY s.string) AS strings FROM ({SPEC}) x JOIN method_strings u ON u.method = x.id JOIN strings s ON s.id = u.string WHERE x.name = 'm3' GROUP BY x.id, x.class, x.name")
def _(t):
    return C.strings_by_method(t, name="m3").select("id", "class", "name", F.array_join("strings", ",").alias("strings"))


CLASS_SOURCE_SPEC = "SELECT m.id, c.name AS class, m.name, m.args AS signature, m.ret, s.name AS source, m.access_flags FROM methods m JOIN classes c ON c.id = m.class JOIN sources s ON s.id = c.source"


@query("methods_referencing_field", f"SELECT x.*, a.action FROM ({CLASS_SOURCE_SPEC}) x JOIN method_field_access a ON a.method = x.id WHERE a.field = 7")
def _(t):
    return C.methods_referencing_field(t, 7)


for _name, _kw, _test in (("", {}, ""), ("_read", {"only_read": True}, "AND a.action = 0"), ("_write", {"only_write": True}, "AND a.action = 1")):
    query(f"methods_by_field{_name}", f"SELECT x.*, a.field, a.action FROM ({CLASS_SOURCE_SPEC}) x JOIN method_field_access a ON a.method = x.id JOIN ({FSPEC}) f ON f.id = a.field WHERE f.class = '{FIELD_CLASS}' {_test}")(lambda t, kw=_kw: C.methods_by_field(t, FIELD_CLASS, **kw))
    query(f"fields_by_method{_name}", f"SELECT f.*, a.method, a.action FROM ({FSPEC}) f JOIN method_field_access a ON a.field = f.id JOIN ({SPEC}) x ON x.id = a.method WHERE x.name = 'm3' AND x.source = 'framework' {_test}")(lambda t, kw=_kw: C.fields_by_method(t, name="m3", source="framework", **kw))


@query("method_field_refs", f"SELECT f.*, a.action FROM ({FSPEC}) f JOIN method_field_access a ON a.field = f.id WHERE a.method = 71 AND a.action IN (0, 1)")
def _(t):
    return C.method_field_refs(t, 71)


@query("resolve_source", "SELECT n.text, coalesce(a.source, n.text) AS source FROM (SELECT name AS text FROM sources UNION ALL SELECT app_name FROM apks UNION ALL SELECT name FROM apks UNION ALL SELECT replace(device_path, '/', '%') FROM apks) n LEFT JOIN (SELECT app_name AS k, replace(device_path, '/', '%') AS source FROM apks UNION ALL SELECT name, replace(device_path, '/', '%') FROM apks) a ON a.k = n.text")
def _(t):
    names = t["sources"].select(F.col("name").alias("text"))
    for c in ("app_name", "name"):
        names = names.unionByName(t["apks"].select(F.col(c).alias("text")))
    return C.resolve_source(t, names.unionByName(t["apks"].select(X.squash(F.col("device_path")).alias("text"))))


# Components that reach a method. The graph's sources of the derived inventory are names of regions.

COMPONENTS = "comps AS (SELECT concat(x.kind, 's') AS kind, concat('L', replace(x.class_name, '.', '/'), ';') AS class, s.name AS graph_source, a.device_path, x.permission, x.read_permission, x.write_permission, x.exported, x.enabled FROM components x JOIN apks a ON a.id = x.apk_id JOIN sources s ON s.id = CASE WHEN x.apk_id % 2 = 0 THEN 1 ELSE 2 + x.apk_id % 4 END)"
KIND = "CASE kind WHEN 'activitys' THEN 'activities' ELSE kind END"
TARGET = "SELECT id FROM methods WHERE name = 'm3' AND args = ''"


def derived_components(t: dict[str, DataFrame], **flags) -> DataFrame:
    """D.components with the sources that the derived graph has."""
    g = t["sources"].select(F.col("id").alias("__s"), F.col("name").alias("__source"))
    key = F.when(F.col("__apk") % 2 == 0, F.lit(1)).otherwise(2 + F.col("__apk") % 4)
    a = t["apks"].select(F.col("id").alias("__apk"), F.col("device_path").alias("__path")).join(g, key == F.col("__s"))
    rows = D.components(t, **flags)
    return rows.join(a, rows["device_path"] == F.col("__path")).select("kind", "class", F.col("__source").alias("graph_source"), "device_path", "app_name")


for _name, _kw, _test in (("", {}, "TRUE"), ("_no_perms", {"no_permissions": True, "only_exported": True, "only_enabled": True}, "exported AND enabled AND permission IS NULL AND (kind <> 'providers' OR (read_permission IS NULL AND write_permission IS NULL))")):
    query(f"component_calls{_name}", f"{walks(TARGET, 1)}, {COMPONENTS}, x AS ({SPEC}) SELECT {KIND} AS kind, c.class, c.graph_source, c.device_path, array_to_string(w.path, '>') AS path, CAST(w.length AS INT) AS length FROM w JOIN x ON x.id = w.path[1] JOIN comps c ON c.class = x.class AND c.graph_source = x.source WHERE {_test}")(
        lambda t, kw=_kw: D.component_paths(t, derived_components(t, **kw), D.find_callers(t, name="m3", signature="", depth=1)).select("kind", "class", "graph_source", "device_path", F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"))
    )


@query("component_calls_by_package", f"{walks(TARGET, 1)}, {COMPONENTS}, x AS ({SPEC}) SELECT c.device_path, string_agg(array_to_string(w.path, '>'), ',' ORDER BY array_to_string(w.path, '>')) AS paths FROM w JOIN x ON x.id = w.path[1] JOIN comps c ON c.class = x.class AND c.graph_source = x.source GROUP BY c.device_path")
def _(t):
    rows = D.component_paths(t, derived_components(t), D.find_callers(t, name="m3", signature="", depth=1))
    return D.paths_by_package(rows).select("device_path", F.array_join("paths", ",").alias("paths"))


@query("intent_style_activities", f"{walks(TARGET, 1)}, {COMPONENTS}, x AS ({SPEC}) SELECT DISTINCT c.class, c.graph_source, c.device_path FROM w JOIN x ON x.id = w.path[1] JOIN comps c ON c.class = x.class AND c.graph_source = x.source WHERE kind = 'activitys' AND enabled AND exported AND permission IS NULL")
def _(t):
    comps = derived_components(t, only_enabled=True, only_exported=True, no_permissions=True).where("kind = 'activities'")
    return D.component_paths(t, comps, D.find_callers(t, name="m3", signature="", depth=1)).select("class", "graph_source", "device_path").distinct()


# Graph build, from names. Results are shown as names, since ids are ours.

PARENT = "SELECT k.name AS child, p.name AS parent, s.source FROM supers s JOIN classes k ON k.id = s.child JOIN classes p ON p.id = s.parent"
NAMED = f"""nsupers AS MATERIALIZED ({PARENT}),
ninterfaces AS MATERIALIZED (SELECT k.name AS class, i.name AS interface, x.source FROM interfaces x JOIN classes k ON k.id = x.class JOIN classes i ON i.id = x.interface),
ncalls AS MATERIALIZED (SELECT c1.name AS caller_class, m1.name AS caller_name, m1.args AS caller_args, c2.name AS callee_class, m2.name AS callee_name, m2.args AS callee_args, x.source FROM calls x JOIN methods m1 ON m1.id = x.caller JOIN classes c1 ON c1.id = m1.class JOIN methods m2 ON m2.id = x.callee JOIN classes c2 ON c2.id = m2.class),
naccess AS MATERIALIZED (SELECT fc.name AS field_class, f.name AS field_name, f.ty AS field_ty, mc.name AS method_class, m.name AS method_name, m.args AS method_args, a.action, m.source FROM method_field_access a JOIN class_fields f ON f.id = a.field JOIN classes fc ON fc.id = f.class JOIN methods m ON m.id = a.method JOIN classes mc ON mc.id = m.class)"""
#: The class that a name means in a source: its own, else the framework's.
PREF = "pref AS MATERIALIZED (SELECT n.name, z.id AS source, coalesce(o.id, f.id) AS id FROM (SELECT DISTINCT name FROM classes) n CROSS JOIN sources z LEFT JOIN classes o ON o.name = n.name AND o.source = z.id LEFT JOIN classes f ON f.name = n.name AND f.source = 1)"


def known(t: dict[str, DataFrame], rows: DataFrame, **columns: str) -> DataFrame:
    """rows with class ids replaced by name and source: columns maps a result's prefix to the id's column."""
    for prefix, column in columns.items():
        c = t["classes"].select(F.col("id").alias(f"__{prefix}"), F.col("name").alias(f"{prefix}_name"), F.col("source").alias(f"{prefix}_source"))
        rows = rows.join(c, rows[column] == F.col(f"__{prefix}")).drop(f"__{prefix}")
    return rows


@query("register_source", "SELECT name FROM sources UNION SELECT app_name FROM apks")
def _(t):
    return B.register_source(t["sources"], t["apks"].select(F.col("app_name").alias("name"))).select("name")


@query("deny_sources", "SELECT app_name AS name FROM apks WHERE NOT is_debuggable")
def _(t):
    names = t["apks"].select(F.col("app_name").alias("name"))
    return B.deny_sources(names, t["apks"].where("is_debuggable").select(F.col("app_name").alias("pattern")))


@query("build_classes", "SELECT name, min(access_flags & 65534) AS access_flags, source FROM classes GROUP BY name, source")
def _(t):
    return B.load_classes(derive.named_facts(t)["classes"]).select("name", "access_flags", "source")


@query("build_strings", "SELECT DISTINCT string, source FROM strings")
def _(t):
    return B.load_strings(derive.named_facts(t)["strings"]).select("string", "source")


_LACKS = "SELECT DISTINCT n.name FROM ({}) n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.name = n.name AND k.source IN (n.source, 1))"
KEPT = "kept AS (SELECT * FROM classes WHERE id % 3 <> 0)"


def kept(t: dict[str, DataFrame]) -> DataFrame:
    return t["classes"].where("id % 3 <> 0")


@query("build_missing_parents", f"{NAMED}, {KEPT} {_LACKS.format('SELECT parent AS name, source FROM nsupers')}")
def _(t):
    rows = derive.named_facts(t)["supers"]
    return B.add_missing_parents(kept(t), rows).join(kept(t), ["id"], "left_anti").select("name")


@query("build_missing_interfaces", f"{NAMED}, {KEPT} {_LACKS.format('SELECT interface AS name, source FROM ninterfaces')}")
def _(t):
    rows = derive.named_facts(t)["interfaces"]
    return B.add_missing_interfaces(kept(t), rows).join(kept(t), ["id"], "left_anti").select("name")


@query("build_missing_callee_classes", f"{NAMED}, {KEPT} {_LACKS.format('SELECT callee_class AS name, source FROM ncalls')}")
def _(t):
    rows = derive.named_facts(t)["calls"]
    return B.add_missing_callee_classes(kept(t), rows).join(kept(t), ["id"], "left_anti").select("name")


@query("build_supers", f"{NAMED}, {PREF} SELECT DISTINCT n.child AS child_name, n.source AS child_source, n.parent AS parent_name, p.source AS parent_source, n.source FROM nsupers n JOIN classes k ON k.name = n.child AND k.source = n.source JOIN pref r ON r.name = n.parent AND r.source = n.source JOIN classes p ON p.id = r.id")
def _(t):
    rows = known(t, B.resolve_supers(derive.named_facts(t)["supers"], t["classes"]), child="child", parent="parent")
    return rows.select("child_name", "child_source", "parent_name", "parent_source", "source")


@query("build_interfaces", f"{NAMED}, {PREF} SELECT DISTINCT n.class AS class_name, n.source AS class_source, n.interface AS interface_name, p.source AS interface_source, n.source FROM ninterfaces n JOIN classes k ON k.name = n.class AND k.source = n.source JOIN pref r ON r.name = n.interface AND r.source = n.source JOIN classes p ON p.id = r.id")
def _(t):
    rows = known(t, B.resolve_interfaces(derive.named_facts(t)["interfaces"], t["classes"]), **{"class": "class", "interface": "interface"})
    return rows.select("class_name", "class_source", "interface_name", "interface_source", "source")


@query("build_class_fields", "SELECT class, name, ty, access_flags FROM class_fields")
def _(t):
    return B.resolve_class_fields(derive.named_facts(t)["class_fields"], t["classes"]).select("class", "name", "ty", "access_flags")


@query("build_methods", "SELECT DISTINCT class, name, args, ret, access_flags, source FROM methods")
def _(t):
    return B.resolve_methods(derive.named_facts(t)["methods"], t["classes"]).select("class", "name", "args", "ret", "access_flags", "source")


@query("build_missing_callee_methods", f"{NAMED}, {PREF}, km AS (SELECT * FROM methods WHERE id % 3 <> 0) SELECT r.id AS class, n.callee_name AS name, n.callee_args AS args, 'V' AS ret, min(n.source) AS source FROM ncalls n JOIN pref r ON r.name = n.callee_class AND r.source = n.source WHERE r.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM km WHERE km.class = r.id AND km.name = n.callee_name AND km.args = n.callee_args) GROUP BY r.id, n.callee_name, n.callee_args")
def _(t):
    known_methods = t["methods"].where("id % 3 <> 0")
    rows = B.add_missing_callee_methods(known_methods, derive.named_facts(t)["calls"], t["classes"])
    return rows.join(known_methods, ["id"], "left_anti").select("class", "name", "args", "ret", "source")


@query("build_calls", f"{NAMED}, {PREF} SELECT DISTINCT a.id AS caller, b.id AS callee, n.source FROM ncalls n JOIN classes k ON k.name = n.caller_class AND k.source = n.source JOIN methods a ON a.class = k.id AND a.name = n.caller_name AND a.args = n.caller_args JOIN pref r ON r.name = n.callee_class AND r.source = n.source JOIN methods b ON b.class = r.id AND b.name = n.callee_name AND b.args = n.callee_args WHERE a.id <> b.id")
def _(t):
    return B.resolve_calls(derive.named_facts(t)["calls"], t["methods"], t["classes"])


@query("build_field_access", f"{NAMED}, {PREF} SELECT DISTINCT f.id AS field, m.id AS method, n.action FROM naccess n JOIN pref r ON r.name = n.field_class AND r.source = n.source JOIN class_fields f ON f.class = r.id AND f.name = n.field_name AND f.ty = n.field_ty JOIN classes k ON k.name = n.method_class AND k.source = n.source JOIN methods m ON m.class = k.id AND m.name = n.method_name AND m.args = n.method_args")
def _(t):
    access = stored(derive.named_facts(t), "method_field_access")["method_field_access"]
    return B.resolve_field_access(access, t["class_fields"], t["methods"], t["classes"])


@query("build_method_strings", "SELECT DISTINCT u.string, u.method FROM method_strings u")
def _(t):
    return B.resolve_method_strings(derive.named_facts(t)["method_strings"], t["strings"], t["methods"], t["classes"])


@query("already_loaded", "SELECT name AS source, 'methods' AS kind FROM sources WHERE id % 2 = 0")
def _(t):
    wanted = t["sources"].select(F.col("name").alias("source"), F.lit("methods").alias("kind"))
    ledger = t["sources"].where("id % 2 = 1").select(F.col("name").alias("source"), F.lit("methods").alias("kind"))
    return B.already_loaded(wanted, ledger)


GONE = "lc AS (SELECT * FROM classes WHERE source <> 5), lm AS (SELECT m.* FROM methods m JOIN lc ON lc.id = m.class WHERE m.source <> 5)"


@query("remove_source", f"{GONE} SELECT 'classes' AS what, id AS a, source AS b FROM lc UNION ALL SELECT 'methods', id, class FROM lm UNION ALL SELECT 'calls', caller, callee FROM calls WHERE source <> 5 AND caller IN (SELECT id FROM lm) AND callee IN (SELECT id FROM lm) UNION ALL SELECT 'supers', parent, child FROM supers WHERE source <> 5 AND parent IN (SELECT id FROM lc) AND child IN (SELECT id FROM lc)")
def _(t):
    source = "middle east"
    g = B.remove_source({k: t[k] for k in derive.GRAPH}, source)
    part = lambda what, a, b: g[what].select(F.lit(what).alias("what"), F.col(a).alias("a"), F.col(b).alias("b"))
    return part("classes", "id", "source").unionByName(part("methods", "id", "class")).unionByName(part("calls", "caller", "callee")).unionByName(part("supers", "parent", "child"))


@query("assign_ids", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS collisions FROM (SELECT DISTINCT name, source FROM classes)")
def _(t):
    rows = B.assign_ids(t["classes"].select("name", "source").distinct(), "name", "source")
    n, bad = rows.agg(F.count_distinct("id").alias("n")), B.id_collisions(rows, "name", "source").agg(F.count("*").alias("collisions"))
    return n.crossJoin(bad)


# Inventory build.


@query("component_defaults", "SELECT id, CASE WHEN id % 3 = 0 THEN exported WHEN id % 3 = 1 THEN id % 5 > 0 ELSE TRUE END AS exported, CASE WHEN id % 4 = 0 THEN enabled ELSE TRUE END AS enabled FROM components")
def _(t):
    exported = F.when(F.col("id") % 3 == 0, F.col("exported").cast("string")).when(F.col("id") % 3 == 2, "@bool/unknown")
    enabled = F.when(F.col("id") % 4 == 0, F.col("enabled").cast("string")).when(F.col("id") % 4 == 1, "FALSE").when(F.col("id") % 4 == 2, " false")
    exported, enabled = E.component_defaults(F.col("id") % 5, exported, enabled)
    return t["components"].select("id", exported.alias("exported"), enabled.alias("enabled"))


@query("permissions_dedup", "SELECT name, source_apk_id, min(CASE WHEN id % 5 = 0 THEN 'normal' ELSE protection_level END) AS protection_level FROM permissions GROUP BY name, source_apk_id")
def _(t):
    p = t["permissions"].withColumn("protection_level", F.when(F.col("id") % 5 != 0, F.col("protection_level")))
    return E.permissions_from(p.unionByName(p)).select("name", "source_apk_id", "protection_level")


@query("uses_permissions_dedup", "SELECT DISTINCT name, apk_id FROM apk_permissions")
def _(t):
    return E.uses_from(t["apk_permissions"].unionByName(t["apk_permissions"])).select("name", "apk_id")


@query("normal_permissions", "SELECT * FROM permissions WHERE protection_level ILIKE '%normal%'")
def _(t):
    return I.normal_permissions(t)


@query("usable_permissions", "SELECT DISTINCT name FROM permissions WHERE protection_level ILIKE '%normal%'")
def _(t):
    return I.usable_app_permissions(t)


@query("properties_dedup", "SELECT name, min(value) AS value FROM device_properties GROUP BY name")
def _(t):
    p = t["device_properties"].select("name", "value")
    return E.build_properties(p.unionByName(p)).select("name", "value")


@query("system_services_first", "SELECT n_name AS name, arg_min(concat('p.', o.o_orderstatus), o_orderkey) AS iface FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders o ON o_custkey = c_custkey GROUP BY n_name")
def _(t):
    rows = t["nation"].join(t["customer"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["orders"], F.col("o_custkey") == F.col("c_custkey"))
    return E.build_system_services(rows.select(F.col("o_orderkey").alias("number"), F.col("n_name").alias("name"), F.concat(F.lit("p."), "o_orderstatus").alias("iface"))).select("name", "iface")


@query("privileged_paths", "SELECT device_path AS path FROM apks WHERE device_path LIKE '/%/priv-app/%'")
def _(t):
    return E.privileged_paths(t["apks"].select(F.col("device_path").alias("path")))


_KINDS = "CASE l_linenumber % 4 WHEN 0 THEN 'jar' WHEN 1 THEN 'vdex' WHEN 2 THEN 'dex' ELSE 'apex' END"
_FILES = f"SELECT DISTINCT concat('/system/framework/', CASE WHEN l_linenumber % 2 = 0 THEN 'boot-' ELSE '' END, 'f', CAST(l_partkey AS STRING), '.', {_KINDS}) AS path, '/system/framework' AS base, concat('f', CAST(l_partkey AS STRING)) AS key, {_KINDS} AS kind, l_linenumber = 7 AS failed FROM lineitem"


@query("framework_file_dedup", f"f AS ({_FILES}) SELECT path, base, key, kind FROM (SELECT *, row_number() OVER (PARTITION BY base, key ORDER BY CASE kind WHEN 'jar' THEN 1 WHEN 'dex' THEN 3 ELSE 4 END, path) AS n FROM f WHERE kind <> 'vdex' AND NOT failed) WHERE n = 1")
def _(t):
    return E.dedupe_framework_files(t.sql(_FILES).drop("key", "kind"))


_POLICY = "SELECT concat('/system/etc/', CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), '.0.cil') WHEN 1 THEN concat(CAST(p_size AS STRING), '.0.compat.cil') WHEN 2 THEN concat('plat', CAST(p_partkey AS STRING), '.cil') ELSE 'plat.txt' END) AS path FROM part"


@query("policy_files", f"SELECT path FROM ({_POLICY}) WHERE path LIKE '%.cil' AND path NOT LIKE '%.compat.cil' AND NOT regexp_matches(path, '[0-9]+\\.[0-9]\\.cil')")
def _(t):
    return E.select_policy_files(t.sql(_POLICY))


@query("binder_availability", "SELECT id, name, iface, CAST(CASE WHEN id % 2 = 0 AND iface IS NOT NULL THEN 1 ELSE can_get_binder END AS INT) AS can_get_binder FROM system_services")
def _(t):
    return E.update_binder_availability(t["system_services"], t["system_services"].where("id % 2 = 0").select("name", "iface"))


@query("service_methods_replaced", "SELECT * FROM system_service_methods WHERE system_service_id <> 3 UNION ALL SELECT id + 1000000, system_service_id, transaction_id, name, signature, return_type, method_hash FROM system_service_methods WHERE system_service_id = 3")
def _(t):
    return E.replace_service(t, 3, t["system_service_methods"].withColumn("id", F.col("id") + 1_000_000))["system_service_methods"]


@query("apk_replaced", "SELECT id, class_name, apk_id, CASE WHEN apk_id = 3 THEN NOT exported ELSE exported END AS exported FROM receivers")
def _(t):
    inv = {k: t[k] for k in derive.INVENTORY}
    new = {"apks": t["apks"], "receivers": t["receivers"].withColumn("exported", ~F.col("exported"))}
    return E.replace_apk(inv, new, 3, force=True)["receivers"].select("id", "class_name", "apk_id", "exported")


@query("service_impls_built", f"{closure_sql('below0', 'SELECT id FROM classes WHERE name = ' + chr(39) + 'Lp/C1;' + chr(39), 'supers', 'parent', 'child')} SELECT DISTINCT s.name AS source, concat('p.', substr(c.name, 4, length(c.name) - 4)) AS class_name FROM below0 b JOIN classes c ON c.id = b.id JOIN sources s ON s.id = c.source WHERE (c.access_flags & 1024) = 0")
def _(t):
    g = {k: t[k] for k in ("sources", "supers")}
    # the class of part 2 and 3 stands for the stub of one service
    g["classes"] = t["classes"].withColumn("name", F.when(F.col("name") == "Lp/C1;", "Lp/I1$Stub;").otherwise(F.col("name")))
    services = t["system_services"].where("iface = 'p.I1'")
    return E.build_service_impls(stored(g, "supers"), services).select("source", "class_name")


@query("service_impls_labelled", "i(iface, id) AS (SELECT s.iface, c.id FROM (SELECT DISTINCT iface FROM system_services WHERE iface IS NOT NULL) s JOIN classes c ON c.name = concat('Lp/C', substr(s.iface, 4), ';')), r(root, id) AS (SELECT i.iface, e.child FROM i JOIN supers e ON e.parent = i.id UNION SELECT r.root, e.child FROM r JOIN supers e ON e.parent = r.id) SELECT DISTINCT y.name AS service, s.name AS source, CASE WHEN c.id IN (SELECT id FROM i) THEN concat('p.I', substr(c.name, 5, length(c.name) - 5), '$Stub') ELSE concat('p.', substr(c.name, 4, length(c.name) - 4)) END AS class_name FROM r JOIN system_services y ON y.iface = r.root JOIN classes c ON c.id = r.id JOIN sources s ON s.id = c.source WHERE (c.access_flags & 1024) = 0")
def _(t):
    # class n stands for the stub of interface n; every service at once
    services = t["system_services"]
    stubs = services.where("iface is not null").select(F.concat(F.lit("Lp/C"), F.substring("iface", 4, 20), F.lit(";")).alias("name"), X.to_slashed(F.concat("iface", F.lit("$Stub"))).alias("stub")).distinct()
    classes = t["classes"].join(stubs, "name", "left").withColumn("name", F.coalesce("stub", "name")).drop("stub")
    g = L.with_labels({"sources": t["sources"], "supers": t["supers"], "classes": classes}, "supers")
    rows = E.build_service_impls(g, services).join(services.select(F.col("id").alias("system_service_id"), F.col("name").alias("service")), "system_service_id")
    return rows.select("service", "source", "class_name")


# Inventory lookups.

for _table in ("apks", "receivers", "services", "activities", "providers", "permissions", "system_services", "system_service_methods", "protected_broadcasts", "device_properties", "fuzz_results"):
    query(f"all_{_table}", f"SELECT * FROM {_table}")(lambda t, n=_table: I.get_all(t, n))


@query("apk_by_id", "SELECT * FROM apks WHERE id = 7")
def _(t):
    return I.get_by_id(t, "apks", 7)


@query("property_by_name", "SELECT * FROM device_properties WHERE name = 'ro.asia.7'")
def _(t):
    return I.property_by_name(t, "ro.asia.7")


@query("props_like", "SELECT * FROM device_properties WHERE name ILIKE 'RO.A%'")
def _(t):
    return I.properties_like(t, "RO.A%")


for _column, _value in (("app_name", "app.s3"), ("name", "S3.apk"), ("device_path", "/system/app/S3.apk")):
    query(f"apk_by_{_column}", f"SELECT * FROM apks WHERE {_column} = '{_value}'")(lambda t, c=_column, v=_value: I.apk_by(t, c, v))


@query("debuggable", "SELECT * FROM apks WHERE is_debuggable")
def _(t):
    return I.debuggable_apks(t)


@query("permission_by_name", "SELECT * FROM permissions WHERE name = 'perm.N3'")
def _(t):
    return I.permission_by_name(t, "perm.N3")


@query("permissions_by_apk", "SELECT * FROM permissions WHERE source_apk_id = 3")
def _(t):
    return I.permissions_by_apk(t, 3)


@query("permission_like", "SELECT p.id, p.name, p.protection_level, p.source_apk_id, a.app_name AS source_app FROM permissions p JOIN apks a ON a.id = p.source_apk_id WHERE p.name ILIKE 'PERM.n1%'")
def _(t):
    return I.permissions_like(t, "PERM.n1%")


@query("service_by_name", "SELECT * FROM system_services WHERE name = 'svc.nation_4'")
def _(t):
    return I.service_by_name(t, "svc.nation_4")


@query("services_like", "SELECT * FROM system_services WHERE name ILIKE 'SVC.%A%'")
def _(t):
    return I.services_like(t, "SVC.%A%")


@query("impls_of", "SELECT * FROM system_service_impls WHERE system_service_id = 4")
def _(t):
    return I.impls_of(t, 4)


@query("impls_by_service", "SELECT s.name, string_agg(concat(i.source, ':', i.class_name), ',' ORDER BY i.source, i.class_name) AS impls FROM system_service_impls i JOIN system_services s ON s.id = i.system_service_id GROUP BY s.name")
def _(t):
    shown = F.array_join(F.transform("impls", lambda x: F.concat(x["source"], F.lit(":"), x["class_name"])), ",")
    return I.impls_by_service(t).select("name", shown.alias("impls"))


@query("service_methods_sorted", "SELECT id, system_service_id, transaction_id, name, coalesce(signature, '?') AS signature, coalesce(return_type, '?') AS return_type FROM system_service_methods ORDER BY system_service_id, transaction_id, id")
def _(t):
    return I.service_methods(t)


for _table, _apk in (("receivers", 4), ("services", 5), ("activities", 6), ("providers", 3)):
    query(f"{_table}_by_apk", f"SELECT * FROM {_table} WHERE apk_id = {_apk}")(lambda t, n=_table, a=_apk: I.components_by_apk(t, n, a))


@query("authority", "SELECT id, name, authorities FROM providers WHERE list_contains(string_split_regex(authorities, '[:;]'), 'auth12')")
def _(t):
    return I.providers_with_authority(t, "auth12").select("id", "name", "authorities")


@query("apk_permissions_of", "SELECT name FROM apk_permissions WHERE apk_id = 3")
def _(t):
    return I.apk_permissions(t, 3)


@query("apks_with_permissions", "SELECT a.id, a.app_name, coalesce(string_agg(p.name, ',' ORDER BY p.name), '') AS permissions FROM apks a LEFT JOIN apk_permissions p ON p.apk_id = a.id GROUP BY a.id, a.app_name")
def _(t):
    return I.apks_with_permissions(t).select("id", "app_name", F.array_join("permissions", ",").alias("permissions"))


@query("broadcasts_like", "SELECT * FROM protected_broadcasts WHERE name ILIKE '%BRAND#1%'")
def _(t):
    return I.protected_broadcasts_like(t, "BRAND#1")


@query("probe_security", "SELECT * FROM fuzz_results WHERE security_exception_thrown")
def _(t):
    return I.probe_results(t, True)


@query("probe_unprotected", "SELECT DISTINCT service_name, method_name FROM fuzz_results WHERE NOT security_exception_thrown")
def _(t):
    return I.unprotected_endpoints(t)


@query("privileged_apks", "SELECT app_name, name, device_path FROM apks WHERE is_priv")
def _(t):
    return I.list_apks(t, only_privileged=True)


@query("accessible_services", "SELECT * FROM system_services WHERE can_get_binder = 1 OR (can_get_binder = 0 AND iface IS NOT NULL)")
def _(t):
    return I.list_services(t, only_accessible=True)


@query("services_without_impls", "SELECT * FROM system_services s WHERE NOT EXISTS (SELECT 1 FROM system_service_impls i WHERE i.system_service_id = s.id)")
def _(t):
    return I.list_services(t, with_impls=False)


@query("services_with_methods", "SELECT s.id, string_agg(concat(CAST(m.transaction_id AS STRING), ':', m.name), ',' ORDER BY m.transaction_id, m.name, m.signature NULLS FIRST, m.return_type NULLS FIRST) AS methods FROM system_services s JOIN system_service_impls i ON i.system_service_id = s.id AND i.id = (SELECT min(j.id) FROM system_service_impls j WHERE j.system_service_id = s.id) LEFT JOIN system_service_methods m ON m.system_service_id = s.id GROUP BY s.id")
def _(t):
    rows = I.list_services(t, with_impls=True, methods=True)
    return rows.select("id", F.array_join(F.transform("methods", lambda m: F.concat(m["transaction_id"].cast("string"), F.lit(":"), m["name"])), ",").alias("methods"))


@query("public_components", "SELECT id, class_name FROM receivers WHERE exported AND enabled")
def _(t):
    return I.list_components(t["receivers"], public=True, enabled=True).select("id", "class_name")


@query("returns_binder_filter", "SELECT id, class_name, returns_binder FROM services WHERE returns_binder <> -1")
def _(t):
    return I.list_components(t["services"], returns_binder=True).select("id", "class_name", "returns_binder")


_RECORD = "SELECT x.id, replace(a.device_path, '/', '%') AS source, 'p' AS package, x.{n} AS class, x.exported, x.enabled, x.permission FROM {t} x JOIN apks a ON a.id = x.apk_id"


@query("component_records", _RECORD.format(t="receivers", n="class_name"))
def _(t):
    return I.component_records(t, "receivers")


@query("provider_records", f"SELECT r.*, array_to_string(string_split_regex(p.authorities, '[:;]'), ',') AS authorities, p.read_permission, p.write_permission FROM ({_RECORD.format(t='providers', n='name')}) r JOIN providers p ON p.id = r.id")
def _(t):
    return I.component_records(t, "providers").withColumn("authorities", F.array_join("authorities", ","))


@query("service_classes", "SELECT 'impl' AS role, concat('L', replace(i.class_name, '.', '/'), ';') AS class FROM system_service_impls i JOIN system_services s ON s.id = i.system_service_id WHERE s.name = 'svc.nation_4' UNION ALL SELECT r.role, concat('L', replace(s.iface, '.', '/'), r.e, ';') FROM system_services s CROSS JOIN (VALUES ('interface', ''), ('stub', '$Stub'), ('proxy', '$Stub$Proxy')) r(role, e) WHERE s.name = 'svc.nation_4'")
def _(t):
    return I.service_classes(t, "svc.nation_4")


@query("table_update", "SELECT id, name, CASE WHEN id % 3 = 0 THEN 'changed' ELSE value END AS value FROM device_properties WHERE id % 5 <> 0")
def _(t):
    p = t["device_properties"]
    rows = I.update(p, p.where("id % 3 = 0").withColumn("value", F.lit("changed")))
    return I.delete_by(rows, "id", p.where("id % 5 = 0").select("id"))


# Snapshot diffs.

OTHER = {
    "apks": "id app_name name is_debuggable is_priv device_path",
    "receivers": "id class_name permission exported enabled apk_id",
    "providers": "id name authorities permission read_permission write_permission exported enabled apk_id",
    "permissions": "id name protection_level source_apk_id",
    "system_services": "id name iface can_get_binder",
    "protected_broadcasts": "id name",
}


def other_cte(table: str) -> str:
    key = "class_name" if table in ("receivers", "services", "activities") else "name"
    columns = OTHER.get(table, OTHER["receivers"])
    return f"o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY id DESC) AS n FROM ({other_sql(table, columns)})) WHERE n = 1)"


def both(t: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    inv = {k: t[k] for k in derive.INVENTORY}
    other = {k: derive.other_snapshot(df) for k, df in inv.items() if k != "apk_permissions"}
    # methods belong to services by id, and the other snapshot has numbered its services anew
    m = other["system_service_methods"]
    other["system_service_methods"] = m.withColumn("system_service_id", F.col("system_service_id") + 1_000_000)
    return inv, other


@query("diff_apks", f"{other_cte('apks')} SELECT a.id AS item, o.id IS NOT NULL AS exists_in_diff FROM apks a LEFT JOIN o ON o.name = a.name")
def _(t):
    inv, other = both(t)
    return G.diff_apks(inv["apks"], other["apks"])


DIFF_COMPONENTS = "SELECT a.id AS item, o.id IS NOT NULL AS exists_in_diff, coalesce(o.id IS NOT NULL AND a.exported IS NOT DISTINCT FROM o.exported, FALSE) AS exported_matches_diff, coalesce(o.id IS NOT NULL AND a.permission IS NOT DISTINCT FROM o.permission, FALSE) AS permission_matches_diff, o.permission AS diff_permission FROM {t} a LEFT JOIN o ON o.class_name = a.class_name"
for _table in ("receivers", "services", "activities"):
    query(f"diff_{_table}", f"{other_cte(_table)} {DIFF_COMPONENTS.format(t=_table)}")(lambda t, n=_table: (lambda p: G.diff_components(p[0][n], p[1][n]))(both(t)))

_SAME = "coalesce(o.id IS NOT NULL AND a.{c} IS NOT DISTINCT FROM o.{c}, FALSE) AS {c}_matches_diff"


@query("diff_providers", f"{other_cte('providers')} SELECT a.id AS item, o.id IS NOT NULL AS exists_in_diff, {_SAME.format(c='exported')}, {_SAME.format(c='permission')}, o.permission AS diff_permission, {_SAME.format(c='read_permission')}, o.read_permission AS diff_read_permission, {_SAME.format(c='write_permission')}, o.write_permission AS diff_write_permission FROM providers a LEFT JOIN o ON o.name = a.name")
def _(t):
    inv, other = both(t)
    return G.diff_providers(inv["providers"], other["providers"])


@query("diff_permissions", f"{other_cte('permissions')} SELECT a.id AS permission, o.id IS NOT NULL AS exists_in_diff, {_SAME.format(c='protection_level')}, o.protection_level AS diff_protection_level FROM permissions a LEFT JOIN o ON o.name = a.name")
def _(t):
    inv, other = both(t)
    return G.diff_permissions(inv["permissions"], other["permissions"])


@query("diff_system_services", f"{other_cte('system_services')} SELECT a.id AS item, o.id IS NOT NULL AS exists_in_diff FROM system_services a LEFT JOIN o ON o.name = a.name")
def _(t):
    inv, other = both(t)
    return G.diff_services(inv["system_services"], other["system_services"])


MKEY = "concat_ws('|', m.name, coalesce(m.signature, ''), coalesce(m.return_type, ''))"
_OTHER_METHODS = other_sql("system_service_methods", "id system_service_id transaction_id name signature return_type method_hash")
METHOD_DIFF = f"theirs AS (SELECT s.name AS service, {MKEY} AS k, arg_max(coalesce(m.method_hash, chr(1)), m.id) AS h FROM ({_OTHER_METHODS}) m JOIN (SELECT * FROM system_services WHERE id % 7 <> 0) s ON s.id = m.system_service_id GROUP BY 1, 2), mdiff AS (SELECT m.id AS method, x.k IS NOT NULL AS exists_in_diff, CAST(CASE WHEN x.k IS NULL OR m.method_hash IS NULL OR x.h = chr(1) THEN 0 WHEN m.method_hash = x.h THEN 1 ELSE -1 END AS INT) AS hash_matches_diff FROM system_service_methods m JOIN system_services s ON s.id = m.system_service_id LEFT JOIN theirs x ON x.service = s.name AND x.k = {MKEY})"


@query("diff_service_methods", f"{METHOD_DIFF} SELECT * FROM mdiff")
def _(t):
    return G.diff_service_methods(*both(t))


@query("diff_pending", "SELECT id FROM apks WHERE id % 2 = 1")
def _(t):
    done = G.diff_apks(t["apks"].where("id % 2 = 0"), t["apks"])
    return G.pending(t["apks"], done).select("id")


@query("unprotected_broadcasts", f"SELECT DISTINCT name FROM protected_broadcasts WHERE id % 7 <> 0 AND id % 3 = 0")
def _(t):
    inv, other = both(t)
    return G.unprotected_broadcasts({"protected_broadcasts": inv["protected_broadcasts"].where("id % 3 <> 0")}, other)


ALL_DIFF = " UNION ALL ".join(
    f"SELECT '{_t}' AS what, a.id AS item, EXISTS (SELECT 1 FROM ({other_sql(_t, OTHER.get(_t, OTHER['receivers']))}) o WHERE o.{_k} = a.{_k}) AS exists_in_diff FROM {_t} a" for _t, _k in (("apks", "name"), ("receivers", "class_name"), ("activities", "class_name"), ("services", "class_name"), ("providers", "name"), ("permissions", "name"), ("system_services", "name"))
)


@query("diff_all", f"SELECT * FROM ({ALL_DIFF})")
def _(t):
    out = G.diff_all(*both(t), source="other")
    # components named services and system services are told apart by the table's name
    inv, other = both(t)
    out["services"] = G.diff_components(inv["services"], other["services"])
    rows = None
    for what in ("apks", "receivers", "activities", "services", "providers", "permissions", "system_services"):
        part = out[what].select(F.lit(what).alias("what"), F.col("permission" if what == "permissions" else "item").alias("item"), "exists_in_diff")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def component_diff(t: dict[str, DataFrame], table: str) -> DataFrame:
    inv, other = both(t)
    return G.diffed(inv[table], G.diff_components(inv[table], other[table]).withColumn("diff_source", F.lit("other")), table, "other")


@query("diffed_for_apk", f"{other_cte('receivers')}, d AS ({DIFF_COMPONENTS.format(t='receivers')}) SELECT r.id, r.class_name, d.exists_in_diff FROM receivers r JOIN d ON d.item = r.id WHERE r.apk_id = 4")
def _(t):
    inv, other = both(t)
    return G.diffed(inv["receivers"], G.diff_components(inv["receivers"], other["receivers"]), apk_id=4).select("id", "class_name", "exists_in_diff")


@query("only_new_components", f"{other_cte('activities')} SELECT a.id, a.class_name FROM activities a LEFT JOIN o ON o.class_name = a.class_name WHERE o.id IS NULL")
def _(t):
    return G.only_new(component_diff(t, "activities")).select("id", "class_name")


# Review.


@query("review_components", f"{other_cte('receivers')} SELECT a.id, a.class_name FROM receivers a LEFT JOIN o ON o.class_name = a.class_name WHERE o.id IS NULL AND a.id % 5 <> 0 AND a.exported")
def _(t):
    # the derived components that the other snapshot lacks are all disabled
    return H.review_components(component_diff(t, "receivers").withColumn("enabled", F.col("id") % 5 != 0)).select("id", "class_name")


def method_review(t: dict[str, DataFrame]) -> DataFrame:
    inv, other = both(t)
    rows = G.diffed(inv["system_service_methods"], G.diff_service_methods(inv, other), "system_service_methods")
    return H.review_methods(rows, inv["system_services"])


_REVIEWED = f"{METHOD_DIFF}, reviewed AS (SELECT m.*, d.exists_in_diff, d.hash_matches_diff, s.name AS service, s.can_get_binder FROM system_service_methods m JOIN mdiff d ON d.method = m.id JOIN system_services s ON s.id = m.system_service_id WHERE NOT d.exists_in_diff OR d.hash_matches_diff = -1)"


@query("review_methods", f"{_REVIEWED} SELECT id, service, exists_in_diff, hash_matches_diff FROM reviewed")
def _(t):
    return method_review(t).select("id", "service", "exists_in_diff", "hash_matches_diff")


@query("review_filters", f"{_REVIEWED} SELECT id, service FROM reviewed WHERE exists_in_diff AND hash_matches_diff <> 1 AND can_get_binder = 1")
def _(t):
    return H.filter_methods(method_review(t), modified_only=True).select("id", "service")


@query("review_normal_permission", "SELECT id, class_name FROM receivers WHERE permission IN (SELECT name FROM permissions WHERE protection_level ILIKE '%normal%')")
def _(t):
    return H.filter_components(t["receivers"], normal=I.usable_app_permissions(t)).select("id", "class_name")


@query("review_no_permission", "SELECT id, name FROM providers WHERE coalesce(permission, read_permission, write_permission) IS NULL")
def _(t):
    return H.filter_components(t["providers"], no_permission=True).select("id", "name")


@query("hidden", "SELECT id, class_name FROM receivers WHERE id % 3 <> 0 AND apk_id % 5 <> 0")
def _(t):
    return H.hide(t["receivers"], t["receivers"].where("id % 3 = 0"), t["apks"].where("id % 5 = 0")).select("id", "class_name")


@query("text_search", "SELECT id, class_name FROM receivers WHERE regexp_matches(class_name, 'C1.*7$') OR contains(class_name, 'C1.*7$')")
def _(t):
    return H.text_search(t["receivers"], F.col("class_name"), "C1.*7$").select("id", "class_name")


@query("signature_tags", "SELECT id, CASE WHEN signature = 'Lp/ICallback;Z' THEN 'binder' WHEN signature = 'ILjava/lang/String;' THEN 'class' END AS tag FROM system_service_methods")
def _(t):
    return t["system_service_methods"].select("id", H.signature_tag(F.col("signature"), F.col("return_type")).alias("tag"))


@query("unprotected_tag", "SELECT id, coalesce(permission, read_permission, write_permission) IS NULL AS unprotected FROM providers")
def _(t):
    return t["providers"].select("id", H.is_unprotected(t["providers"]).alias("unprotected"))


@query("present_packages", "SELECT DISTINCT id, name FROM apks WHERE id IN (SELECT apk_id FROM receivers)")
def _(t):
    return H.present(t["apks"], t["receivers"], "apk_id")


# Expressions.


def expression(name: str, table: str, column: Callable[[], Column], sql: str, key: str = "id") -> None:
    """column is made when the query runs: there may be no session yet."""
    query(f"expr_{name}", f"SELECT {key}, {sql} AS v FROM {table}")(lambda t: t[table].select(key, column().alias("v")))


_DOTTED = "replace(substr(name, 2, length(name) - 2), '/', '.')"
expression("to_dotted", "classes", lambda: X.to_dotted(F.col("name")), _DOTTED)
expression("to_slashed", "classes", lambda: X.to_slashed(X.to_dotted(F.col("name"))), "name")
expression("class_path", "classes", lambda: X.class_path(F.col("name")), "concat(substr(name, 2, length(name) - 2), '.smali')")
expression("simple_name", "classes", lambda: X.simple_name(F.col("name")), f"split_part({_DOTTED}, '.', 2)")
expression("package_of", "classes", lambda: X.package_of(F.col("name")), "'p'")
expression("with_package", "classes", lambda: X.with_package(F.col("name"), F.lit("q.r")), f"concat('q.r.', split_part({_DOTTED}, '.', 2))")
expression("with_simple_name", "classes", lambda: X.with_simple_name(F.col("name"), F.lit("Z")), "'p.Z'")
expression("from_manifest_name", "apks", lambda: X.from_manifest_name(F.col("app_name"), F.when(F.col("id") % 2 == 0, ".Main").otherwise("q/.Main")), "CASE WHEN id % 2 = 0 THEN concat(app_name, '.Main') ELSE 'q.Main' END")
expression("split_signature", "methods", lambda: F.array_join(X.split_signature(F.col("args")), "|"), "CASE args WHEN 'Ljava/lang/String;I' THEN 'Ljava/lang/String;|I' ELSE args END")
expression("method_display", "methods", lambda: X.method_display(F.lit("C"), F.col("name"), F.col("args"), F.col("ret")), "concat('C->', name, '(', args, ')', ret)")
expression("method_key", "system_service_methods", lambda: X.method_key(F.col("name"), F.col("signature"), F.col("return_type")), "concat_ws('|', name, coalesce(signature, ''), coalesce(return_type, ''))")
expression("argument_hash", "system_service_methods", lambda: X.argument_hash(F.col("name"), F.col("signature")), "sha256(concat('=', name, chr(31), CASE WHEN signature IS NULL THEN chr(0) ELSE concat('=', signature) END))")
expression("squash", "apks", lambda: X.squash(F.col("device_path")), "replace(device_path, '/', '%')")
expression("unsquash", "apks", lambda: X.unsquash(X.squash(F.concat("device_path", F.lit("\\a%b")))), "concat(device_path, '\\a%b')")
expression("file_name", "apks", lambda: X.file_name(F.col("device_path")), "name")
expression("stem", "apks", lambda: X.stem(F.col("device_path")), "replace(name, '.apk', '')")
expression("extension", "apks", lambda: X.extension(F.col("device_path")), "'apk'")
expression("has_all", "classes", lambda: X.has_all(F.col("access_flags"), 32770), "(access_flags & 32770) = 32770")
expression("has_any", "classes", lambda: X.has_any(F.col("access_flags"), 33792), "(access_flags & 33792) <> 0")
expression("is_not_abstract", "classes", lambda: X.is_not_abstract(F.col("access_flags")), "(access_flags & 1024) = 0")
expression("flags_difference", "classes", lambda: X.flags_difference(F.col("access_flags"), F.lit(2).cast("long")), "access_flags & ~2")
expression("flags_symmetric", "classes", lambda: X.flags_symmetric_difference(F.col("access_flags"), F.lit(1026).cast("long")), "xor(access_flags, 1026)")
expression("tri_and", "services", lambda: X.tri_and(F.col("returns_binder"), F.col("id") % 4 - 1), "CAST(CASE WHEN returns_binder = 1 THEN CASE WHEN id % 4 - 1 IN (-1, 1) THEN id % 4 - 1 ELSE 0 END ELSE returns_binder END AS INT)")
expression("tri_or", "services", lambda: X.tri_or(F.col("returns_binder"), F.col("id") % 4 - 1), "CAST(CASE WHEN returns_binder = 1 OR id % 4 - 1 = 1 THEN 1 WHEN returns_binder = -1 AND id % 4 - 1 = -1 THEN -1 ELSE 0 END AS INT)")
expression("tri_text", "services", lambda: X.tri_text(F.col("returns_binder")), "CASE returns_binder WHEN 1 THEN 'true' WHEN -1 THEN 'false' ELSE 'unknown' END")
expression("tri_from_bool", "apks", lambda: X.tri_from_bool(F.col("is_debuggable")), "CAST(CASE WHEN is_debuggable THEN 1 ELSE -1 END AS INT)")
expression("authorities", "providers", lambda: F.array_join(X.authorities(F.col("authorities")), ","), "replace(authorities, ':', ',')")
expression("permission_any", "providers", lambda: X.permission_for_mode("any", F.col("permission"), F.col("read_permission"), F.col("write_permission")), "coalesce(permission, read_permission, write_permission)")
expression("source_file_parts", "apks", lambda: F.concat_ws(",", *(X.source_file_parts(F.concat(F.lit("/proj/"), X.squash(F.col("device_path")), F.lit("/smali/a/b/C.smali")))[c] for c in ("source", "class_name", "package_file"))), "concat(replace(device_path, '/', '%'), ',a.b.C,', device_path)")

_REFERENCES = "SELECT concat('pkg', CAST(p_partkey % 10 AS STRING)) AS package, 'string' AS kind, concat('n', CAST(p_partkey AS STRING)) AS name, CAST(NULL AS STRING) AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('@string/n', CAST(p_partkey + 10 AS STRING)) END AS value FROM part"


@query("expr_resolve_reference", f"r AS ({_REFERENCES}), walk(package, start, value, n) AS (SELECT package, concat('@string/', name), concat('@string/', name), 0 FROM r UNION ALL SELECT w.package, w.start, r.value, n + 1 FROM walk w JOIN r ON r.package = w.package AND concat('@string/', r.name) = w.value WHERE n < 10) SELECT w.package, w.start AS value, CASE WHEN arg_max(w.value, n) LIKE '@%' THEN w.start ELSE arg_max(w.value, n) END AS resolved FROM walk w GROUP BY w.package, w.start")
def _(t):
    resources = t.sql(_REFERENCES)
    values = resources.select("package", F.concat(F.lit("@string/"), "name").alias("value"))
    return E.resolve_references(values, resources)


# Streams, over the events as a batch: the stream itself is tested on its own.

_LEVEL = "CASE event_type WHEN 'error' THEN 'E' WHEN 'click' THEN 'I' ELSE 'V' END"


@query("log_routes", f"SELECT event_id, route FROM (SELECT event_id, 'errors' AS route FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'info_of_u3' FROM events WHERE event_type = 'error' OR (user_id % 20 = 3 AND event_type IN ('error', 'click')) UNION ALL SELECT event_id, 'sevens' FROM events WHERE regexp_matches(props, '7') UNION ALL SELECT event_id, 'process' FROM events WHERE user_id % 50 = 7)")
def _(t):
    log = t["events"].select("event_id", "ts", F.expr(_LEVEL).alias("level"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("tag"), F.col("props").alias("message"), (F.col("user_id") % 50).alias("pid"))
    routes = [Route("errors", level="E"), Route("info_of_u3", level="E", tag="u3", tag_level="I"), Route("sevens", message="7"), Route("process", pid=7)]
    return routed(log, routes).select("event_id", "route")
