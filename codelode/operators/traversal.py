"""Graph traversals: bounded call walks, inheritance closures, and components that reach a method.

Each level is one equi-join of the frontier's ids with the edges; a level is written to the shared folder as Parquet and read back with
its schema, so no plan grows, no level is written twice, and names are joined once at the end. Edges are read at every level: give
tables that are files, not plans that derive them (plans.storage.stored writes them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.expr import squash, to_dotted, to_slashed
from codelode.operators.hierarchy import LABELLED, related
from codelode.operators.lookups import Graph, class_specs, get_method_ids, method_specs
from codelode.plans.storage import written
from codelode.schema import FRAMEWORK


class TooManyPaths(RuntimeError):
    """A walk has found more paths than max_paths; nothing is cut short silently."""


def walk_counts(seeds: DataFrame, edges: DataFrame, tip: str, step: str, depth: int) -> Iterator[int]:
    """How many walks of 1 to n edges there are from seeds(id), for n = 1, 2, ... depth: counts summed along edges, a number a node, whatever
    the number of walks. Repeated edges count once."""
    edges = edges.select(F.col(tip).alias("__tip"), F.col(step).alias("id"))
    front = seeds.select("id").distinct().withColumn("n", F.lit(1).cast("decimal(38,0)"))
    total = 0
    for _ in range(depth):
        rows = front.withColumnRenamed("id", "__tip").join(edges, "__tip").distinct()
        front, found, _ = written(rows.groupBy("id").agg(F.sum("n").cast("decimal(38,0)").alias("n")), "counts")
        if not found:
            return
        total += int(front.agg(F.sum("n")).first()[0])
        yield total


def shortest_paths(seeds: DataFrame, edges: DataFrame, tip: str, step: str, depth: int, backward: bool = True) -> DataFrame:
    """(id, path, length): of each node that walks of 1 to depth edges from seeds(id) lead to, the shortest one, of equals the one whose
    ids are the smallest, from the node on.

    Level by level: a node is taken when it is first met, and of the nodes that lead to it the smallest is its next, as that one has its
    own best walk already. So each node is there once, and walks are never listed."""
    spark, schema = seeds.sparkSession, "id long, path array<bigint>, length int"
    edges = edges.select(F.col(tip).alias("__tip"), F.col(step).alias("id"))
    front, files = seeds.select(F.col("id").cast("long").alias("id"), F.array(F.col("id").cast("long")).alias("path")).distinct(), []
    for level in range(1, depth + 1):
        new = front.withColumnRenamed("id", "__tip").join(edges, "__tip").groupBy("id").agg(F.min(F.struct("__tip", "path")).alias("next"))
        if files:
            new = new.join(spark.read.schema(schema).parquet(*files), "id", "left_anti")
        path = F.array_prepend("next.path", F.col("id")) if backward else F.array_append("next.path", F.col("id"))
        front, found, file = written(new.select(F.col("id").cast("long").alias("id"), path.alias("path"), F.lit(level).alias("length")), "shortest")
        if not found:
            break
        files.append(file)
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def expand(seeds: DataFrame, edges: DataFrame, tip: str, step: str, depth: int, max_paths: int | None = None, simple: bool = False, backward: bool = True) -> DataFrame:
    """(path array<long>, length): all walks of 1 to depth edges from seeds(id), along edges from column `tip` to column `step`.

    A walk may come back to where it was (simple=True leaves such ones out); every prefix is a result too. Backward walks are listed
    from the far end to the seed. Repeated edges are combined among a level's results, not in the edge table, which a small frontier
    then joins without a shuffle of its own. With max_paths, walks are counted before any is listed (simple ones as they are listed).
    """
    if max_paths is not None and not simple:
        for level, total in enumerate(walk_counts(seeds, edges, tip, step, depth), 1):
            if total > max_paths:
                raise TooManyPaths(f"more than {max_paths} paths within {level} steps")
    edges = edges.select(F.col(tip).alias("__tip"), F.col(step).alias("__step"))
    front = seeds.select(F.array("id").alias("path"), F.col("id").alias("__at")).distinct()
    levels, total = [], 0
    for level in range(1, depth + 1):
        rows = front.join(edges, F.col("__at") == F.col("__tip"))
        if simple:
            rows = rows.where(~F.array_contains("path", F.col("__step")))
        path = F.array_prepend("path", F.col("__step")) if backward else F.array_append("path", F.col("__step"))
        front = rows.select(path.alias("path"), F.col("__step").alias("__at")).distinct()
        if level < depth or (simple and max_paths is not None):
            front, found, _ = written(front, "walks")
            total += found
            if simple and max_paths is not None and total > max_paths:
                raise TooManyPaths(f"more than {max_paths} paths within {level} steps")
        levels.append(front.select("path", F.lit(level).alias("length")))
    return reduce(DataFrame.unionByName, levels) if levels else front.select("path", F.lit(0).alias("length")).limit(0)


def assemble_paths(g: Graph, paths: DataFrame) -> DataFrame:
    """Paths of ids with a column `methods`: the path as an array of method structs in order. Walks are told apart by their own ids."""
    spec = method_specs(g).select(F.col("id").alias("__id"), F.struct("id", "class", "name", "signature", "ret", "source", "access_flags").alias("spec"))
    rows = paths.select("path", "length", F.posexplode("path").alias("idx", "__id")).join(spec, "__id")
    return rows.groupBy("path", "length").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "spec"))), lambda x: x["spec"]).alias("methods"))


def _with_end(g: Graph, paths: DataFrame, end: int, source: str | None) -> DataFrame:
    """Paths whose method at one end is in a source."""
    if source is None:
        return paths
    s = g["sources"].where(F.col("name") == source).select(F.col("id").alias("source"))
    m = g["methods"].join(s, "source", "left_semi").select(F.col("id").alias("__end"))
    return paths.join(m, F.element_at("path", end) == F.col("__end"), "left_semi")


def callers_of(g: Graph, ids: DataFrame, call_source: str | None = None, depth: int = 3, max_paths: int | None = None, simple: bool = False) -> DataFrame:
    paths = expand(ids, g["calls"], "callee", "caller", depth, max_paths, simple, backward=True)
    return _with_end(g, paths, 1, call_source)


def find_callers(g: Graph, name: str | None = None, cls: str | None = None, signature: str | None = None, source: str | None = None, call_source: str | None = None, depth: int = 3, max_paths: int | None = None, simple: bool = False) -> DataFrame:
    """(path, length): walks that end in the methods found, outermost caller first; call_source: that of the outermost method."""
    return callers_of(g, get_method_ids(g, name, cls, signature, source), call_source, depth, max_paths, simple)


def find_outgoing(g: Graph, name: str | None = None, cls: str | None = None, signature: str | None = None, source: str | None = None, into_source: str | None = None, depth: int = 3, max_paths: int | None = None, simple: bool = False) -> DataFrame:
    """(path, length): walks that start at the methods found; into_source: that of the last method."""
    paths = expand(get_method_ids(g, name, cls, signature, source), g["calls"], "caller", "callee", depth, max_paths, simple, backward=False)
    return _with_end(g, paths, -1, into_source)


def reached(seeds: DataFrame, edges: DataFrame, tip: str, step: str, *keys: str) -> DataFrame:
    """(*keys, id): all that can be reached from seeds(*keys, id) in one or more edges, for each combination of keys.

    A level takes the ids of the level before it over one edge and leaves out those that any level has, so each is expanded once and
    cycles end. Levels are files of their own: what has been reached is read at each level, never written again."""
    spark, columns = seeds.sparkSession, [*keys, "id"]
    edges = edges.select(F.col(tip).alias("__tip"), F.col(step).alias("id"))
    front, paths = seeds.select(*columns).distinct(), []
    while True:
        new = front.withColumnRenamed("id", "__tip").join(edges, "__tip").select(*columns).distinct()
        if paths:
            new = new.join(spark.read.schema(front.schema).parquet(*paths), columns, "left_anti")
        front, found, path = written(new, "reached")
        if not found:
            return spark.read.schema(front.schema).parquet(*paths) if paths else front
        paths.append(path)


def inherited(g: Graph, seeds: DataFrame, table: str, down: bool, *keys: str) -> DataFrame:
    """(*keys, id): all that is below or above seeds(*keys, id) along `supers` or `interfaces`: by the graph's labels, if it has any
    (hierarchy.with_labels), else level by level."""
    if f"{table}_labels" in g:
        return related(g[f"{table}_labels"], g[f"{table}_loose"], seeds, down, *keys)
    ends = LABELLED[table]
    return reached(seeds, g[table], *(ends if down else ends[::-1]), *keys)


def _classes(g: Graph, name: str, source: str | None) -> DataFrame:
    c = class_specs(g).where(F.col("name") == name)
    return (c if source is None else c.where(F.col("source") == source)).select("id")


def _class_rows(g: Graph, ids: DataFrame, source: str | None = None) -> DataFrame:
    c = class_specs(g).join(ids, "id", "left_semi")
    return (c if source is None else c.where(F.col("source") == source)).select("source", "name", "access_flags").distinct()


def find_parents(g: Graph, cls: str, source: str) -> DataFrame:
    """All proper ancestors of one class."""
    return _class_rows(g, inherited(g, _classes(g, cls, source), "supers", down=False))


def find_children(g: Graph, cls: str, parent_source: str | None = None, child_source: str | None = None) -> DataFrame:
    """All proper descendants of every class of that name, or of that in parent_source; those in child_source alone, if given."""
    return _class_rows(g, inherited(g, _classes(g, cls, parent_source), "supers", down=True), child_source)


def find_implementers(g: Graph, iface: str, iface_source: str | None = None, impl_source: str | None = None) -> DataFrame:
    """Classes and interfaces below an interface, and all classes below those."""
    direct = inherited(g, _classes(g, iface, iface_source), "interfaces", down=True)
    below = inherited(g, direct, "supers", down=True)
    return _class_rows(g, direct.unionByName(below).distinct(), impl_source)


class NotFound(LookupError):
    """A search that must find something found nothing."""


def with_source_fallback(op, source: str | None = None, fallback: bool = True) -> DataFrame:
    """op(source): with none given, the framework; if that gives nothing, all sources (op(None)), unless fallback is off; nothing at all is an error."""
    found = op(FRAMEWORK if source is None else source)
    if not found.isEmpty():
        return found
    if source is None and fallback:
        found = op(None)
        if not found.isEmpty():
            return found
    raise NotFound("no class found")


COMPONENT_TABLES = {"receivers": "class_name", "services": "class_name", "activities": "class_name", "providers": "name"}


def components(inv: dict[str, DataFrame], only_exported: bool = False, only_enabled: bool = False, no_permissions: bool = False) -> DataFrame:
    """(kind, class, graph_source, device_path): the four component tables together. The framework package's source is `framework`."""
    a = inv["apks"].select(F.col("id").alias("apk_id"), F.when(F.col("app_name") == "android", FRAMEWORK).otherwise(squash(F.col("device_path"))).alias("graph_source"), "device_path", "app_name")
    parts = []
    for table, name in COMPONENT_TABLES.items():
        t = inv[table]
        free = F.col("permission").isNull()
        if table == "providers":
            free = free & F.col("read_permission").isNull() & F.col("write_permission").isNull()
        for wanted, test in ((only_exported, F.col("exported")), (only_enabled, F.col("enabled")), (no_permissions, free)):
            t = t.where(test) if wanted else t
        parts.append(t.select(F.lit(table).alias("kind"), to_slashed(F.col(name)).alias("class"), "apk_id"))
    return reduce(DataFrame.unionByName, parts).join(a, "apk_id").select("kind", "class", "graph_source", "device_path", "app_name")


def component_paths(g: Graph, comps: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths whose outermost method is in a component's class, in that package's source."""
    m = method_specs(g).select(F.col("id").alias("__first"), F.col("class").alias("class"), F.col("source").alias("graph_source"))
    rows = paths.withColumn("__first", F.element_at("path", 1)).join(m, "__first").drop("__first")
    return rows.join(comps, ["class", "graph_source"])


def component_calls(g: Graph, inv: dict[str, DataFrame], name: str | None = None, cls: str | None = None, signature: str | None = None, method_source: str | None = None, component_apk: str | None = None, depth: int = 3, only_exported: bool = False, only_enabled: bool = False, no_permissions: bool = False, one_path: bool = False) -> DataFrame:
    """(kind, class, graph_source, device_path, app_name, path, length): components from which a method can be reached.

    method_source restricts the method called, component_apk (a device path) the components. one_path keeps, of each class and source,
    the shortest path, of equals the one with the smallest ids.
    """
    comps = components(inv, only_exported, only_enabled, no_permissions)
    if component_apk is not None:
        comps = comps.where(F.col("device_path") == component_apk)
    if not one_path:
        rows = component_paths(g, comps, find_callers(g, name, cls, signature, method_source, depth=depth))
    else:
        paths = shortest_paths(get_method_ids(g, name, cls, signature, method_source), g["calls"], "callee", "caller", depth)
        rows = component_paths(g, comps, paths.select("path", "length"))
        keys = ["kind", "class", "graph_source", "device_path", "app_name"]
        best = F.min(F.struct("length", "path")).alias("best")
        rows = rows.groupBy(*keys).agg(best).select(*keys, "best.path", "best.length")
    return rows


def paths_by_package(rows: DataFrame) -> DataFrame:
    return rows.groupBy("device_path").agg(F.array_sort(F.collect_list(F.array_join("path", ">"))).alias("paths"))


def uri_parse_components(g: Graph, inv: dict[str, DataFrame], **flags) -> DataFrame:
    """Components that parse an intent from a URI themselves."""
    return component_calls(g, inv, name="parseUri", cls="Landroid/content/Intent;", signature="Ljava/lang/String;I", depth=1, **flags)


def intent_reading_activities(g: Graph, inv: dict[str, DataFrame], strict: bool = False, no_permissions: bool = False, getter: str = "getIntent", signature: str = "", owner: str = "Landroid/app/Activity;") -> DataFrame:
    """Enabled and exported activities that call the no-argument getIntent themselves (strict: the one of android.app.Activity alone).
    An activity whose package isn't known is looked for in the framework. no_permissions: those that require none."""
    calls = find_callers(g, name=getter, cls=owner if strict else None, signature=signature, depth=1)
    acts = inv["activities"].where("enabled and exported")
    if no_permissions:
        acts = acts.where(F.col("permission").isNull())
    a = inv["apks"].select(F.col("id").alias("apk_id"), F.when(F.col("app_name") == "android", FRAMEWORK).otherwise(squash(F.col("device_path"))).alias("__source"), "device_path", "app_name")
    comps = acts.join(a, "apk_id", "left").select(F.lit("activities").alias("kind"), to_slashed(F.col("class_name")).alias("class"), F.coalesce("__source", F.lit(FRAMEWORK)).alias("graph_source"), "device_path", "app_name")
    return component_paths(g, comps, calls).select("class", "graph_source", "device_path", "app_name").distinct()


def display_path(methods: Column, hide_last: bool = False, show_source: bool = False) -> Column:
    """class.name(args) of each hop; without the last hop where the caller has named it anyway."""
    shown = F.slice(methods, F.lit(1), F.greatest(F.size(methods) - 1, F.lit(0))) if hide_last else methods
    hop = lambda m: F.concat(to_dotted(m["class"]), F.lit("."), m["name"], F.lit("("), m["signature"], F.lit(")"), *([F.lit(" @"), m["source"]] if show_source else []))
    return F.array_join(F.transform(shown, hop), " > ")
