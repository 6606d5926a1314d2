"""Graph build: named facts become id-resolved tables, for all sources in one pass after the framework's.

A name means the class of that name in its own source, else the framework's. Facts carry the id of their source in column `source`.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.plans.storage import together, written
from codelode.schema import ALL_FLAGS, FRAMEWORK, GRAPH, INTERFACE, PUBLIC

FRAMEWORK_ID = 1


def stable_id(*key: Column) -> Column:
    """An id that depends on the natural key alone, the same in every run."""
    return F.xxhash64(*key)


def assign_ids(df: DataFrame, *key: str) -> DataFrame:
    return df.withColumn("id", stable_id(*(F.col(k) for k in key)))


def id_collisions(df: DataFrame, *key: str) -> DataFrame:
    """Ids that stand for several natural keys; empty in any table that is fit for use."""
    return df.select("id", *key).distinct().groupBy("id").count().where("count > 1")


def empty_graph(spark: SparkSession) -> dict[str, DataFrame]:
    g = {k: spark.createDataFrame([], s) for k, s in GRAPH.items()}
    return g | {"sources": spark.createDataFrame([(FRAMEWORK_ID, FRAMEWORK)], GRAPH["sources"])}


def register_source(sources: DataFrame, names: DataFrame) -> DataFrame:
    """sources with those of names(name) that aren't there yet; the framework's id is fixed, the others come from the name."""
    new = names.select("name").where("name is not null").distinct().join(sources, "name", "left_anti")
    ids = F.when(F.col("name") == FRAMEWORK, F.lit(FRAMEWORK_ID).cast("long")).otherwise(stable_id(F.col("name")))
    return sources.unionByName(new.select(ids.alias("id"), "name"))


def deny_sources(names: DataFrame, deny: DataFrame, allow: bool = False) -> DataFrame:
    """names(name) without those in deny(pattern), or, with allow, those in it alone."""
    return names.join(deny, names["name"] == deny["pattern"], "left_semi" if allow else "left_anti")


def stage_named(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts whose source is named, with its id instead."""
    ids = sources.select(F.col("id").alias("__id"), F.col("name").alias("source"))
    return facts.join(ids, "source").drop("source").withColumnRenamed("__id", "source")


def load_classes(named: DataFrame) -> DataFrame:
    rows = named.select(F.col("class").alias("name"), F.col("flags").bitwiseAND(F.lit(ALL_FLAGS)).alias("access_flags"), "source")
    rows = rows.groupBy("name", "source").agg(F.min("access_flags").alias("access_flags"))
    return assign_ids(rows, "name", "source").select(*GRAPH["classes"].names)


def load_strings(named: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """One row for each (source, string), those in `strings` kept."""
    rows = named.select("string", "source").dropDuplicates(["source", "string"])
    if strings is not None:
        rows = rows.join(strings, ["source", "string"], "left_anti")
    rows = assign_ids(rows, "source", "string").select("id", "string", "source")
    return rows if strings is None else strings.unionByName(rows)


def unknown_classes(names: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct names(name, source) that neither the source nor the framework has."""
    own = classes.select("name", "source")
    framework = classes.where(F.col("source") == FRAMEWORK_ID).select("name")
    names = names.distinct()  # before the joins: a name is there once a fact
    return names.join(own, ["name", "source"], "left_anti").join(framework, "name", "left_anti").select("name").where("name is not null").distinct()


def _added(classes: DataFrame, names: DataFrame, flags: int) -> DataFrame:
    new = unknown_classes(names, classes).select("name", F.lit(flags).cast("long").alias("access_flags"), F.lit(FRAMEWORK_ID).cast("long").alias("source"))
    return classes.unionByName(assign_ids(new, "name", "source").select(*GRAPH["classes"].names))


def add_missing_parents(classes: DataFrame, supers: DataFrame) -> DataFrame:
    return _added(classes, supers.select(F.col("parent").alias("name"), "source"), PUBLIC)


def add_missing_interfaces(classes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """After add_missing_parents: a name missing in both ways keeps the flags of a parent."""
    return _added(classes, interfaces.select(F.col("interface").alias("name"), "source"), PUBLIC | INTERFACE)


def add_missing_callee_classes(classes: DataFrame, calls: DataFrame) -> DataFrame:
    return _added(classes, calls.select(F.col("callee_class").alias("name"), "source"), PUBLIC)


def _merged(table: DataFrame) -> DataFrame:
    """table for a merge join. Files of names are many times smaller than a hash table of them, so where Spark's size check looks at files it
    broadcasts tables that grow with the input, and each task holds all of them."""
    return table.hint("merge")


def with_own_class(rows: DataFrame, classes: DataFrame, name: str, out: str) -> DataFrame:
    """rows whose class `name` is in their own source, with its id."""
    own = classes.select(F.col("name").alias(name), "source", F.col("id").alias(out))
    return rows.join(_merged(own), [name, "source"])


def with_preferred_class(rows: DataFrame, classes: DataFrame, name: str, out: str) -> DataFrame:
    """rows with the id of the class that `name` means; those without one are dropped."""
    own = classes.select(F.col("name").alias(name), "source", F.col("id").alias("__own"))
    framework = classes.where(F.col("source") == FRAMEWORK_ID).select(F.col("name").alias(name), F.col("id").alias("__framework"))
    found = rows.join(_merged(own), [name, "source"], "left").join(_merged(framework), name, "left").withColumn(out, F.coalesce("__own", "__framework"))
    return found.where(F.col(out).isNotNull()).drop("__own", "__framework")


def resolve_supers(supers: DataFrame, classes: DataFrame) -> DataFrame:
    rows = with_preferred_class(with_own_class(supers, classes, "child", "child_id"), classes, "parent", "parent_id")
    return rows.select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child"), "source").distinct()


def resolve_interfaces(interfaces: DataFrame, classes: DataFrame) -> DataFrame:
    rows = with_preferred_class(with_own_class(interfaces, classes, "class", "class_id"), classes, "interface", "interface_id")
    return rows.select(F.col("interface_id").alias("interface"), F.col("class_id").alias("class"), "source").distinct()


def resolve_class_fields(fields: DataFrame, classes: DataFrame) -> DataFrame:
    rows = with_own_class(fields, classes, "class", "class_id").select(F.col("class_id").alias("class"), "name", "ty", F.col("flags").alias("access_flags"))
    return assign_ids(rows, "class", "name", "ty").select(*GRAPH["class_fields"].names)


def resolve_methods(methods: DataFrame, classes: DataFrame) -> DataFrame:
    rows = with_own_class(methods, classes, "class", "class_id").select(F.col("class_id").alias("class"), "name", "args", "ret", F.col("flags").alias("access_flags"), "source").distinct()
    return assign_ids(rows, "class", "name", "args", "ret", "access_flags", "source").select(*GRAPH["methods"].names)


def add_missing_callee_methods(methods: DataFrame, calls: DataFrame, classes: DataFrame) -> DataFrame:
    """Methods that are called but not known, with return type V; of several sources that call one, the smallest id owns it."""
    rows = with_preferred_class(calls.select("callee_class", "callee_name", "callee_args", "source").distinct(), classes, "callee_class", "class")
    rows = rows.select("class", F.col("callee_name").alias("name"), F.col("callee_args").alias("args"), "source")
    new = rows.join(methods.select("class", "name", "args"), ["class", "name", "args"], "left_anti").groupBy("class", "name", "args").agg(F.min("source").alias("source"))
    new = new.select("class", "name", "args", F.lit("V").alias("ret"), F.lit(PUBLIC).cast("long").alias("access_flags"), "source")
    return methods.unionByName(assign_ids(new, "class", "name", "args", "ret", "access_flags", "source").select(*GRAPH["methods"].names))


def resolve_calls(calls: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (caller, callee, source) without self calls; overloads that differ in their return type alone fan out."""
    rows = with_preferred_class(with_own_class(calls.distinct(), classes, "caller_class", "a_class"), classes, "callee_class", "b_class")
    a = methods.select(F.col("class").alias("a_class"), F.col("name").alias("caller_name"), F.col("args").alias("caller_args"), F.col("id").alias("caller"))
    b = methods.select(F.col("class").alias("b_class"), F.col("name").alias("callee_name"), F.col("args").alias("callee_args"), F.col("id").alias("callee"))
    rows = rows.join(a, ["a_class", "caller_name", "caller_args"]).join(b, ["b_class", "callee_name", "callee_args"])
    return rows.where("caller <> callee").select("caller", "callee", "source").distinct()


def resolve_field_access(access: DataFrame, fields: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (field, method, action). access is gone through twice, so it should be a file: its distinct field names are resolved by
    themselves, and its rows meet each table once, on whole names, instead of going through every join for a class."""
    f = fields.select(F.col("class").alias("f_class"), F.col("name").alias("field_name"), F.col("ty").alias("field_ty"), F.col("id").alias("field"))
    named = with_preferred_class(access.select("field_class", "field_name", "field_ty", "source").distinct(), classes, "field_class", "f_class")
    named = named.join(_merged(f), ["f_class", "field_name", "field_ty"]).drop("f_class")
    c = classes.select(F.col("id").alias("m_class"), F.col("name").alias("method_class"), "source")
    m = methods.select(F.col("class").alias("m_class"), F.col("name").alias("method_name"), F.col("args").alias("method_args"), F.col("id").alias("method")).join(_merged(c), "m_class").drop("m_class")
    rows = access.join(_merged(named), ["field_class", "field_name", "field_ty", "source"]).select("field", "method_class", "method_name", "method_args", "source", "action")
    return rows.join(_merged(m), ["method_class", "method_name", "method_args", "source"]).select("field", "method", "action").dropDuplicates()


def resolve_method_strings(uses: DataFrame, strings: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    rows = with_own_class(uses, classes, "class", "m_class")
    m = methods.select(F.col("class").alias("m_class"), F.col("name").alias("method"), "args", F.col("id").alias("method_id"))
    s = strings.select("string", "source", F.col("id").alias("string_id"))
    rows = rows.join(m, ["m_class", "method", "args"]).join(s, ["string", "source"])
    return rows.select(F.col("string_id").alias("string"), F.col("method_id").alias("method")).distinct()


#: What a table is made of besides its own facts and the classes: the other tables, and the facts of other kinds.
NEEDED = {
    "calls": ("methods",),
    "method_field_access": ("class_fields", "methods"),
    "method_strings": ("strings", "methods"),
    "methods": ("calls",),
}


def kinds_used(tables: Iterable[str]) -> tuple[set[str], set[str]]:
    """The kinds of facts that tables are made of whole, and those of which the classes need names alone."""
    whole, waiting = set(), list(tables)
    while waiting:
        k = waiting.pop()
        if k not in whole and k not in ("sources", "classes"):
            whole.add(k)
            waiting += NEEDED.get(k, ())
    classes = any(k not in ("sources", "strings") for k in tables)
    return whole | ({"classes"} if classes else set()), {"supers", "interfaces", "calls"} - whole if classes else set()


#: The names that missing classes come from.
NAMES = {"supers": "parent", "interfaces": "interface", "calls": "callee_class"}


def build_graph(spark: SparkSession, facts: dict[str, DataFrame], deny: DataFrame | None = None, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The graph from named facts with a source name column, all of it or the `tables` asked for. Missing classes of all kinds are added to the
    framework before anything is resolved.

    Facts are written once, as they are read for the sources, for what is missing, and for their own table. Of facts that no table asked for
    is made of, only the distinct sources (and the names that classes may be missing by) are."""
    tables = list(GRAPH) if tables is None else list(tables)
    whole, names_of = kinds_used(tables)
    columns = {k: df.columns if k in whole else [NAMES[k], "source"] if k in names_of else ["source"] for k, df in facts.items()}
    facts = {k: df if k in whole else df.select(*columns[k]).distinct() for k, df in facts.items()}
    facts = {k: rows for k, (rows, _, _) in together(spark, {k: partial(written, df, k) for k, df in facts.items()}).items()}
    names = reduce(DataFrame.unionByName, (df.select(F.col("source").alias("name")).distinct() for df in facts.values())).distinct()
    if deny is not None:
        names = deny_sources(names, deny)
    out = {"sources": written(register_source(empty_graph(spark)["sources"], names), "sources")[0]}
    f = {k: stage_named(df, out["sources"]) for k, df in facts.items()}
    if "classes" in whole:
        classes = load_classes(f["classes"])
        classes = add_missing_parents(classes, f["supers"])
        classes = add_missing_interfaces(classes, f["interfaces"])
        out["classes"] = classes = written(add_missing_callee_classes(classes, f["calls"]), "classes")[0]
    if "methods" in whole:
        out["methods"] = methods = written(add_missing_callee_methods(resolve_methods(f["methods"], classes), f["calls"], classes), "methods")[0]
    made = {
        "supers": lambda: resolve_supers(f["supers"], classes),
        "interfaces": lambda: resolve_interfaces(f["interfaces"], classes),
        "calls": lambda: resolve_calls(f["calls"], methods, classes),
        "class_fields": lambda: resolve_class_fields(f["class_fields"], classes),
        "strings": lambda: load_strings(f["strings"]),
        "method_field_access": lambda: resolve_field_access(f["method_field_access"], out["class_fields"], methods, classes),
        "method_strings": lambda: resolve_method_strings(f["method_strings"], out["strings"], methods, classes),
    }
    wanted = {*tables, *(x for k in tables for x in NEEDED.get(k, ()))}
    for k, make in made.items():
        if k in wanted and k in whole:
            out[k] = make()
    return {k: out[k] for k in GRAPH if k in tables}


def already_loaded(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """wanted(source, kind) without what the ledger has recorded."""
    return wanted.join(ledger, ["source", "kind"], "left_anti")


def remove_source(g: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """The graph without a source and all that hangs on it: its classes, their methods and fields, and every row that names one of these."""
    gone = g["sources"].where(F.col("name") == name).select(F.col("id").alias("source"))
    out = {"sources": g["sources"].where(F.col("name") != name)}
    by_source = {k: g[k].join(gone, "source", "left_anti") for k in ("classes", "methods", "supers", "interfaces", "calls", "strings")}
    left = by_source["classes"].select(F.col("id").alias("__c"))
    known = lambda df, column, ids: df.join(ids, df[column] == ids[ids.columns[0]], "left_semi")
    methods = known(by_source["methods"], "class", left)
    method_ids = methods.select(F.col("id").alias("__m"))
    fields = known(g["class_fields"], "class", left)
    out |= {"classes": by_source["classes"], "methods": methods, "class_fields": fields, "strings": by_source["strings"]}
    out["supers"] = known(known(by_source["supers"], "parent", left), "child", left)
    out["interfaces"] = known(known(by_source["interfaces"], "interface", left), "class", left)
    out["calls"] = known(known(by_source["calls"], "caller", method_ids), "callee", method_ids)
    out["method_field_access"] = known(known(g["method_field_access"], "method", method_ids), "field", fields.select(F.col("id").alias("__f")))
    out["method_strings"] = known(known(g["method_strings"], "method", method_ids), "string", by_source["strings"].select(F.col("id").alias("__s")))
    return out


def wipe(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables, empty (the framework source of a graph stays)."""
    out = {k: df.limit(0) for k, df in tables.items()}
    if "sources" in out:
        out["sources"] = tables["sources"].where(F.col("name") == FRAMEWORK)
    return out
