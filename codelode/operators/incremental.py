"""A graph that is kept up to date as sources arrive, in any order, without building it anew.

A name means a class of its own source, else the framework's, so what one source brings can only change what others have resolved to the
framework: classes and methods that were added for want of a real one give way, and edges to them move. Ids are hashes of natural keys,
so a class that was missing has the id of the real one; methods are met by a key of class, name and arguments, under which there may be
one that was added, or one or more real ones.

Tables are partitioned by source and by the batch that wrote them. A batch writes partitions of its own beside those in use, and then, in
one rename, the list of those that count from now on: a batch that fails has changed nothing, one that comes again finds itself done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.build import FRAMEWORK_ID, NAMES, kinds_used, load_classes, register_source, stable_id, stage_named
from codelode.plans.storage import delete, exists, rename, together, written
from codelode.schema import GRAPH, INTERFACE, PUBLIC

#: What is kept besides the graph's own tables: facts with class ids and keys in place of names, of every source that has arrived.
_FACTS = {
    "loaded": "id long, name string",
    "real_classes": "id long, name string, access_flags long",
    "foreign": "name string, as_parent boolean, as_interface boolean",
    "named_supers": "parent long, child long",
    "named_interfaces": "interface long, class long",
    "named_fields": "id long, class long, name string, ty string, access_flags long",
    "named_methods": "id long, class long, name string, args string, ret string, access_flags long, key long",
    "named_calls": "caller_key long, callee_key long, class long, name string, args string",
    "named_access": "field long, method_key long, action int",
    "named_method_strings": "string long, method_key long",
    "texts": "id long, string string",
}
#: Tables that batches change: what was added for want of real ones (all of the framework's partition), and resolved edges with the keys they met by.
_RESOLVED = {
    "added_classes": "id long, name string, access_flags long",
    "added_methods": "id long, class long, name string, args string, owner long, key long",
    "met_calls": "caller long, callee long, caller_key long, callee_key long",
    "met_access": "field long, method long, action int, method_key long",
    "met_method_strings": "string long, method long, method_key long",
}
_TABLES = _FACTS | _RESOLVED
#: The kept table that each of the graph's tables is there by, and those that a kind of facts brings.
_MAIN = {
    "sources": "loaded", "classes": "real_classes", "methods": "named_methods", "supers": "named_supers", "interfaces": "named_interfaces", "calls": "met_calls", "class_fields": "named_fields",
    "method_field_access": "met_access", "strings": "texts", "method_strings": "met_method_strings",
}
_BROUGHT = {
    "classes": ("real_classes", "foreign", "added_classes"), "methods": ("named_methods", "added_methods"), "supers": ("named_supers",), "interfaces": ("named_interfaces",), "calls": ("named_calls",),
    "class_fields": ("named_fields",), "method_field_access": ("named_access",), "strings": ("texts",), "method_strings": ("named_method_strings",),
}


def _kept(tables: Iterable[str]) -> set[str]:
    """What is kept for tables of the graph: all, where all facts are."""
    whole, _ = kinds_used(tables)
    kept = {"loaded", *(x for k in whole for x in _BROUGHT[k]), *(_MAIN[k] for k in tables)}
    return set(_TABLES) if kept >= set(_FACTS) else kept


def _tables_of(live: DataFrame) -> set[str]:
    """The tables that a graph keeps. One of all facts keeps all: edges of a kind that no source has may not be listed."""
    found = {r[0] for r in live.select("table").distinct().collect()}
    return set(_TABLES) if found >= set(_FACTS) else found


def _key(of: Column, name: str, args: str) -> Column:
    return stable_id(of, F.col(name), F.col(args))


def _live(spark: SparkSession, path: str) -> DataFrame | None:
    """(table, source, batch) of the partitions that count."""
    if not exists(spark, f"{path}/_live"):
        return None
    rows = spark.read.schema("table string, source long, batch long").parquet(f"{path}/_live")
    return rows.groupBy("table", "source").agg(F.max("batch").alias("batch"))


def _table(spark: SparkSession, path: str, name: str, live: DataFrame | None) -> DataFrame:
    if live is None or not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], f"{_TABLES[name]}, source long")
    rows = spark.read.schema(f"{_TABLES[name]}, source long, batch long").parquet(f"{path}/{name}")
    return rows.join(live.where(F.col("table") == name).select("source", "batch"), ["source", "batch"], "left_semi").drop("batch")


class _Batch:
    """What a batch reads (as it was before) and writes."""

    def __init__(self, spark: SparkSession, path: str, batch: int) -> None:
        self.spark, self.path, self.batch = spark, path, batch
        self.live = _live(spark, path)
        if self.live is not None:
            self.live, _, _ = written(self.live, "live")
        self.changed: list[DataFrame] = []
        self.only_framework = spark.range(FRAMEWORK_ID, FRAMEWORK_ID + 1).select(F.col("id").alias("source"))

    def before(self, name: str) -> DataFrame:
        return _table(self.spark, self.path, name, self.live)

    def put(self, name: str, rows: DataFrame, sources: DataFrame) -> DataFrame:
        """Write the partitions of sources(source) of a table; the rows as they are from now on, of these sources alone."""
        rows = rows.withColumn("batch", F.lit(self.batch).cast("long"))
        out = f"{self.path}/{name}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch").parquet(out)
        self.changed.append(sources.select(F.lit(name).alias("table"), "source").distinct())
        if not exists(self.spark, out):
            return self.spark.createDataFrame([], f"{_TABLES[name]}, source long")
        return self.spark.read.schema(f"{_TABLES[name]}, source long, batch long").parquet(out).where(F.col("batch") == self.batch).drop("batch")

    def publish(self) -> None:
        half = f"{self.path}/_half-{self.batch}"
        reduce(DataFrame.unionByName, self.changed).withColumn("batch", F.lit(self.batch).cast("long")).coalesce(1).write.mode("overwrite").parquet(half)
        if not exists(self.spark, f"{self.path}/_live"):
            self.spark.createDataFrame([], "table string, source long, batch long").write.parquet(f"{self.path}/_live")
        for f in self.spark.read.parquet(half).inputFiles():
            rename(self.spark, f, f"{self.path}/_live/batch-{self.batch}.parquet")
        delete(self.spark, half)


    def check(self, tables: set[str]) -> None:
        """A graph keeps the same tables from its first batch on."""
        found = tables if self.live is None else _tables_of(self.live)
        if found != tables:
            raise ValueError(f"{self.path} is a graph of other tables: {', '.join(sorted(found ^ tables))}")


def _own(rows: DataFrame, real: DataFrame, name: str) -> DataFrame:
    """rows with __own: whether the row's source has the class."""
    return rows.join(real.select(F.col("name").alias(name), "source", F.lit(True).alias("__own")), [name, "source"], "left").where(F.col(name).isNotNull())


def _meaning(name: str) -> Column:
    """The class id that a name means, after _own()."""
    return stable_id(F.col(name), F.when(F.col("__own"), F.col("source")).otherwise(F.lit(FRAMEWORK_ID).cast("long")))


def _in_own(rows: DataFrame, real: DataFrame, name: str) -> DataFrame:
    """rows of classes that their source has, with the class id; of the framework's, all: a class may be added to it later."""
    return _own(rows, real, name).where(F.coalesce(F.col("__own"), F.lit(False)) | (F.col("source") == FRAMEWORK_ID)).drop("__own").withColumn("__id", stable_id(F.col(name), F.col("source")))


def _foreign(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    """Names that their source has no class of; each is looked for once, not once a fact."""
    names = [f[k].select(F.col(c).alias("name"), "source", F.lit(k == "supers").alias("as_parent"), F.lit(k == "interfaces").alias("as_interface")) for k, c in NAMES.items()]
    names = reduce(DataFrame.unionByName, names).where("name is not null").groupBy("name", "source").agg(F.max("as_parent").alias("as_parent"), F.max("as_interface").alias("as_interface"))
    return names.join(real.select("name", "source"), ["name", "source"], "left_anti")


def _named_supers(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    rows = _own(f["supers"], real, "parent").withColumn("__parent", _meaning("parent")).drop("__own")
    return _in_own(rows, real, "child").select(F.col("__parent").alias("parent"), F.col("__id").alias("child"), "source").distinct()


def _named_interfaces(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    rows = _own(f["interfaces"], real, "interface").withColumn("__interface", _meaning("interface")).drop("__own")
    return _in_own(rows, real, "class").select(F.col("__interface").alias("interface"), F.col("__id").alias("class"), "source").distinct()


def _named_fields(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    rows = _in_own(f["class_fields"], real, "class").select(F.col("__id").alias("class"), "name", "ty", F.col("flags").alias("access_flags"), "source")
    return rows.withColumn("id", stable_id(F.col("class"), F.col("name"), F.col("ty")))


def _named_methods(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    rows = _in_own(f["methods"], real, "class").distinct()  # by the class's name, as the join has dealt them
    rows = rows.select(F.col("__id").alias("class"), "name", "args", "ret", F.col("flags").alias("access_flags"), "source")
    return rows.withColumn("id", stable_id(*(F.col(c) for c in ("class", "name", "args", "ret", "access_flags", "source")))).withColumn("key", _key(F.col("class"), "name", "args"))


def _named_calls(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    """Callers go to the join as keys. Repeated calls stay: what they meet is made distinct."""
    rows = f["calls"].select(_key(stable_id(F.col("caller_class"), F.col("source")), "caller_name", "caller_args").alias("caller_key"), "callee_class", F.col("callee_name").alias("name"), F.col("callee_args").alias("args"), "source")
    rows = _own(rows, real, "callee_class").withColumn("class", _meaning("callee_class"))
    return rows.select("caller_key", _key(F.col("class"), "name", "args").alias("callee_key"), "class", "name", "args", "source")


def _named_access(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    rows = _own(f["method_field_access"], real, "field_class").withColumn("__field", _meaning("field_class")).drop("__own")
    return _in_own(rows, real, "method_class").select(stable_id(F.col("__field"), F.col("field_name"), F.col("field_ty")).alias("field"), _key(F.col("__id"), "method_name", "method_args").alias("method_key"), "action", "source").distinct()


def _texts(f: dict[str, DataFrame]) -> DataFrame:
    return f["strings"].select("string", "source").distinct().withColumn("id", stable_id(F.col("source"), F.col("string")))


def _named_method_strings(f: dict[str, DataFrame], real: DataFrame) -> DataFrame:
    uses = _in_own(f["method_strings"], real, "class").join(_texts(f).select("string", "source", F.col("id").alias("__string")), ["string", "source"])
    return uses.select(F.col("__string").alias("string"), _key(F.col("__id"), "method", "args").alias("method_key"), "source").distinct()


def _keyed(f: dict[str, DataFrame], real: DataFrame | None, whole: set[str]) -> dict[str, DataFrame]:
    """A batch's facts of some kinds with ids and keys, by table."""
    made = {
        "classes": ("foreign", _foreign), "supers": ("named_supers", _named_supers), "interfaces": ("named_interfaces", _named_interfaces), "class_fields": ("named_fields", _named_fields), "methods": ("named_methods", _named_methods),
        "calls": ("named_calls", _named_calls), "method_field_access": ("named_access", _named_access), "method_strings": ("named_method_strings", _named_method_strings), "strings": ("texts", lambda f, _: _texts(f)),
    }
    return {name: make(f, real) for k, (name, make) in made.items() if k in whole}


def _touching(rows: DataFrame, changed: dict[str, DataFrame]) -> DataFrame:
    """rows of which one of the columns is in changed[column](value)."""
    for column, values in changed.items():
        rows = rows.join(values.select(F.col("value").alias(column), F.lit(True).alias(f"__{column}")), column, "left")
    marks = [F.col(f"__{c}").isNotNull() for c in changed]
    return rows.where(reduce(lambda a, b: a | b, marks)).drop(*(f"__{c}" for c in changed))


def _remet(b: _Batch, table: str, facts: str, new: DataFrame, changed: dict[str, DataFrame], meet: Callable[[DataFrame], DataFrame], own: DataFrame) -> None:
    """Bring a table of resolved edges up to date: facts of new sources and facts that touch what has changed are met anew, in the
    partitions of their sources alone; the other edges of those partitions are kept. own: the new sources."""
    again = _touching(b.before(facts).select(*new.columns), changed)
    again, moved, _ = written(again, "moved")
    sources = written(again.select("source").distinct(), "sources")[0] if moved else again.select("source").limit(0)
    kept = b.before(table).join(sources, "source", "left_semi")
    for column, values in changed.items():
        kept = kept.join(values.select(F.col("value").alias(column)), column, "left_anti")
    rows = meet(again.unionByName(new)).distinct()
    b.put(table, kept.select(*rows.columns).unionByName(rows), sources.unionByName(own))


def _add_classes(b: _Batch, real: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bring added_classes up to date: names that the batch looks for or brings are looked at anew. The ids (class) of the framework's
    classes, and of those that it has only now."""
    framework = F.col("source") == FRAMEWORK_ID
    lit_framework = F.lit(FRAMEWORK_ID).cast("long")
    had_classes = b.before("real_classes").where(framework).select("name").unionByName(b.before("added_classes").select("name"))
    has_classes = b.before("real_classes").unionByName(real).where(framework).select("name")
    touched = foreign.select("name").unionByName(real.where(framework).select("name")).distinct()
    wanted = b.before("foreign").unionByName(foreign).join(touched, "name", "left_semi").join(has_classes, "name", "left_anti").groupBy("name").agg(F.max("as_parent").alias("p"), F.max("as_interface").alias("i"))
    flags = F.when(F.col("p") | ~F.col("i"), PUBLIC).otherwise(PUBLIC | INTERFACE).cast("long")
    wanted = wanted.select(stable_id(F.col("name"), lit_framework).alias("id"), "name", flags.alias("access_flags"), lit_framework.alias("source"))
    added = b.put("added_classes", b.before("added_classes").join(touched, "name", "left_anti").unionByName(wanted), b.only_framework)
    has_classes = has_classes.unionByName(added.select("name")).distinct()
    ids = lambda names: names.select(stable_id(F.col("name"), lit_framework).alias("class"))
    return ids(has_classes), ids(has_classes.join(had_classes, "name", "left_anti"))


def load_sources(spark: SparkSession, path: str, facts: dict[str, DataFrame], batch: int, tables: Iterable[str] | None = None) -> bool:
    """Add the sources of named facts to the graph at path, each whole; whether there was one that it hadn't got.

    Sources that have arrived before are left out, so a batch that comes again changes nothing. batch: a number that grows from call to
    call (a stream's own is one). tables: those of the graph that are kept, the same in each call; only facts that they are made of are
    kept, and `facts` need not have other kinds, by which sources are registered if they are given. Facts are written once, as all that is
    made of them reads them. The work grows with what the batch brings and what it moves, apart from looking for that by key."""
    kept = _kept(GRAPH if tables is None else list(tables))
    tables = [k for k in GRAPH if _MAIN[k] in kept]
    whole, names_of = kinds_used(tables)
    b = _Batch(spark, path, batch)
    b.check(kept)
    loaded = b.before("loaded")
    there = loaded.select(F.col("name").alias("source"))
    facts = {k: df.join(there, "source", "left_anti") for k, df in facts.items()}
    facts = {k: df if k in whole else df.select(*([NAMES[k], "source"] if k in names_of else ["source"])).distinct() for k, df in facts.items()}
    facts = {k: rows for k, (rows, _, _) in together(spark, {k: partial(written, df, k) for k, df in facts.items()}).items()}
    names = reduce(DataFrame.unionByName, (df.select(F.col("source").alias("name")).distinct() for df in facts.values())).distinct()
    new, n, _ = written(register_source(loaded.select("id", "name"), names).join(loaded.select("id"), "id", "left_anti"), "new")
    if not n:
        return False
    b.put("loaded", new.withColumn("source", F.col("id")), new.select(F.col("id").alias("source")))
    f = {k: stage_named(df, new) for k, df in facts.items() if k in whole or k in names_of}
    own = new.select(F.col("id").alias("source"))
    real = b.put("real_classes", load_classes(f["classes"]), own) if "classes" in whole else None
    now = together(spark, {k: partial(b.put, k, df, own) for k, df in _keyed(f, real, whole).items()}) if whole else {}
    if real is not None:
        valid, came = _add_classes(b, real, now["foreign"])
    if "methods" in whole:
        _add_edges(b, now, real, valid, came, own, tables)
    b.publish()
    return True


def _add_edges(b: _Batch, now: dict[str, DataFrame], real: DataFrame, valid: DataFrame, came: DataFrame, own: DataFrame, tables: list[str]) -> None:
    """Bring added_methods and the tables of resolved edges up to date."""
    both = lambda k: b.before(k).unionByName(now[k])
    framework = F.col("source") == FRAMEWORK_ID
    lit_framework = F.lit(FRAMEWORK_ID).cast("long")
    # what the framework's facts say of classes that it has only now
    came, valid = (written(df, k)[0] for k, df in (("came", came), ("valid", valid)))

    def existing(k: str) -> DataFrame:
        rows = both(k)
        return rows.where(~framework).unionByName(rows.where(framework).join(valid, "class", "left_semi"))

    #: Of what the batch brings, that which sources before it can have named: a class of their own came with them, so the framework's alone.
    brought = lambda k: both(k).where(framework).join(came, "class", "left_semi").unionByName(now[k].where(framework).join(valid, "class", "left_semi"))

    # methods that are called and missing: those that were, and those that the batch calls, but for what is there now. A method that was met
    # stays met, so calls before the batch add none, and the smallest source of theirs is the owner that is kept.
    methods = existing("named_methods")
    old = b.before("added_methods")
    called = now["named_calls"].groupBy("callee_key", "class", "name", "args").agg(F.min("source").alias("owner")).withColumnRenamed("callee_key", "key")
    called = called.unionByName(old.select(*called.columns)).join(methods.select("key"), "key", "left_anti").groupBy("key", "class", "name", "args").agg(F.min("owner").alias("owner"))
    ids = stable_id(F.col("class"), F.col("name"), F.col("args"), F.lit("V"), F.lit(PUBLIC).cast("long"), F.col("owner"))
    added_methods = b.put("added_methods", called.select(ids.alias("id"), "class", "name", "args", "owner", "key", lit_framework.alias("source")), b.only_framework)
    pair = lambda df: df.select("key", "id", "class")
    other = pair(old).unionByName(pair(added_methods)).groupBy("key", "id", "class").count().where("count = 1")
    other = other.join(real.where(~framework).select(F.col("id").alias("class")), "class", "left_anti")
    changed = written(brought("named_methods").select("key").unionByName(other.select("key")).distinct().select(F.col("key").alias("value")), "changed")[0]

    # edges
    under = written(methods.select("key", "id").unionByName(added_methods.select("key", "id")), "methods")[0]

    def met_calls(rows: DataFrame) -> DataFrame:
        a, c = (under.select(F.col("key").alias(f"{x}_key"), F.col("id").alias(x)) for x in ("caller", "callee"))
        return rows.join(a, "caller_key").join(c, "callee_key").where("caller <> callee").select("caller", "callee", "caller_key", "callee_key", "source")

    m = under.select(F.col("key").alias("method_key"), F.col("id").alias("method"))

    def met_access(rows: DataFrame) -> DataFrame:
        fields = existing("named_fields").select(F.col("id").alias("field"))
        return rows.join(m, "method_key").join(fields, "field", "left_semi").select("field", "method", "action", "method_key", "source")

    met = {"named_calls": ("caller_key", "callee_key", "source"), "named_access": ("field", "method_key", "action", "source"), "named_method_strings": ("string", "method_key", "source")}
    edges = {
        "calls": ("met_calls", "named_calls", lambda: {"caller_key": changed, "callee_key": changed}, met_calls),
        "method_field_access": ("met_access", "named_access", lambda: {"method_key": changed, "field": brought("named_fields").select(F.col("id").alias("value")).distinct()}, met_access),
        "method_strings": ("met_method_strings", "named_method_strings", lambda: {"method_key": changed}, lambda rows: rows.join(m, "method_key").select("string", "method", "method_key", "source")),
    }
    jobs = {k: partial(_remet, b, table, of, now[of].select(*met[of]), moved(), meet, own) for k, (table, of, moved, meet) in edges.items() if k in tables}
    if jobs:
        together(b.spark, jobs)


def open_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The graph's tables as they are after the last whole batch, of those that it keeps."""
    live = _live(spark, path)
    there = set(_TABLES) if live is None else _tables_of(live)
    t = {k: _table(spark, path, k, live) for k in _TABLES}
    framework = F.col("source") == FRAMEWORK_ID
    classes = t["real_classes"].unionByName(t["added_classes"])
    has = classes.where(framework).select(F.col("id").alias("__class"))

    def whole(k: str, column: str) -> DataFrame:
        """Rows of classes that are there: only the framework's facts can name others."""
        rows = t[k]
        return rows.where(~framework).unionByName(rows.where(framework).join(has, rows[column] == has["__class"], "left_semi"))

    methods = whole("named_methods", "class").drop("key").unionByName(t["added_methods"].select("id", "class", "name", "args", F.lit("V").alias("ret"), F.lit(PUBLIC).cast("long").alias("access_flags"), F.col("owner").alias("source")))
    sources = t["loaded"].select("id", "name").unionByName(spark.createDataFrame([(FRAMEWORK_ID, "framework")], GRAPH["sources"])).distinct()
    out = {
        "sources": sources, "classes": classes, "methods": methods, "supers": whole("named_supers", "child"), "interfaces": whole("named_interfaces", "class"), "calls": t["met_calls"], "class_fields": whole("named_fields", "class"),
        "method_field_access": t["met_access"], "strings": t["texts"], "method_strings": t["met_method_strings"],
    }
    return {k: df.select(*GRAPH[k].names) for k, df in out.items() if _MAIN[k] in there}


def loaded_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the sources that the graph at path has got."""
    return _table(spark, path, "loaded", _live(spark, path)).select("name")
