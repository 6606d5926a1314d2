"""Graph lookups: projections, filters and equi-joins over a code graph g, a dict of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.expr import class_path, file_name, ilike_pattern, squash, to_dotted, to_slashed
from codelode.schema import ABSTRACT, FRAMEWORK, INTERFACE, READ, WRITE

Graph = dict[str, DataFrame]


def method_specs(g: Graph) -> DataFrame:
    """(id, class, name, signature, ret, source, access_flags) of every method; source is the method's own."""
    c = g["classes"].select(F.col("id").alias("__c"), F.col("name").alias("__class"))
    s = g["sources"].select(F.col("id").alias("__s"), F.col("name").alias("__source"))
    m = g["methods"]
    rows = m.join(c, m["class"] == F.col("__c")).join(s, m["source"] == F.col("__s"))
    return rows.select("id", F.col("__class").alias("class"), "name", F.col("args").alias("signature"), "ret", F.col("__source").alias("source"), "access_flags")


def field_specs(g: Graph) -> DataFrame:
    """(id, class, name, ty, source, access_flags) of every field; source is the class's."""
    c = class_specs(g).select(F.col("id").alias("__c"), F.col("name").alias("__class"), F.col("source").alias("__source"))
    f = g["class_fields"]
    return f.join(c, f["class"] == F.col("__c")).select("id", F.col("__class").alias("class"), "name", "ty", F.col("__source").alias("source"), "access_flags")


def class_specs(g: Graph) -> DataFrame:
    """(id, name, source, access_flags) of every class."""
    s = g["sources"].select(F.col("id").alias("__s"), F.col("name").alias("__source"))
    return g["classes"].join(s, g["classes"]["source"] == F.col("__s")).select("id", "name", F.col("__source").alias("source"), "access_flags")


def _method_shape(name: str | None, cls: str | None, signature: str | None) -> None:
    if not name and (signature is not None or not cls):
        raise ValueError("a method search needs a name, or a class alone")


def get_method_ids(g: Graph, name: str | None = None, cls: str | None = None, signature: str | None = None, source: str | None = None) -> DataFrame:
    """(id) of methods by name; class; name and signature; class and name; or all three. Tables that no argument needs aren't joined."""
    _method_shape(name, cls, signature)
    rows = g["methods"]
    if name is not None:
        rows = rows.where(F.col("name") == name)
    if signature is not None:
        rows = rows.where(F.col("args") == signature)
    if cls is not None:
        c = g["classes"].where(F.col("name") == cls).select(F.col("id").alias("class"))
        rows = rows.join(c, "class", "left_semi")
    if source is not None:
        s = g["sources"].where(F.col("name") == source).select(F.col("id").alias("source"))
        rows = rows.join(s, "source", "left_semi")
    return rows.select("id")


def get_methods(g: Graph, name: str | None = None, cls: str | None = None, signature: str | None = None, source: str | None = None) -> DataFrame:
    _method_shape(name, cls, signature)
    rows = method_specs(g)
    for column, value in (("name", name), ("class", cls), ("signature", signature), ("source", source)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def _field_shape(cls: str | None, name: str | None, ty: str | None) -> None:
    if not cls or (ty is not None and not name):
        raise ValueError("a field search needs a class, and a name if there is a type")


def get_fields(g: Graph, cls: str, name: str | None = None, ty: str | None = None, source: str | None = None) -> DataFrame:
    """Fields by class; class and name; or class, name and type."""
    _field_shape(cls, name, ty)
    rows = field_specs(g)
    for column, value in (("class", cls), ("name", name), ("ty", ty), ("source", source)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def get_field_ids(g: Graph, cls: str, name: str | None = None, ty: str | None = None, source: str | None = None) -> DataFrame:
    return get_fields(g, cls, name, ty, source).select("id")


def classes_with_method(g: Graph, name: str, args: str | None = None, source: str | None = None, no_abstract: bool = False) -> DataFrame:
    """(class, source) of each method found, repeated as often; source is the class's."""
    m = g["methods"].where(F.col("name") == name)
    if args is not None:
        m = m.where(F.col("args") == args)
    c = class_specs(g)
    if source is not None:
        c = c.where(F.col("source") == source)
    if no_abstract:
        c = c.where(F.col("access_flags").bitwiseAND(F.lit(ABSTRACT | INTERFACE)) == 0)
    c = c.select(F.col("id").alias("__c"), F.col("name").alias("__class"), F.col("source").alias("__source"))
    return m.join(c, m["class"] == F.col("__c")).select(F.col("__class").alias("class"), F.col("__source").alias("source"))


def by_source(classes: DataFrame) -> DataFrame:
    """(source, classes): the classes of each source as a sorted list."""
    return classes.groupBy("source").agg(F.array_sort(F.collect_list("class")).alias("classes"))


def all_sources(g: Graph) -> DataFrame:
    return g["sources"].select("name").distinct()


def classes_for(g: Graph, source: str) -> DataFrame:
    return class_specs(g).where(F.col("source") == source).select("name")


def methods_for(g: Graph, source: str) -> DataFrame:
    return method_specs(g).where(F.col("source") == source)


def find_class(g: Graph, pattern: str) -> DataFrame:
    """(name, source): the class of that dotted or whole name; L... without the end is a prefix, in which LIKE's signs are live."""
    rows = class_specs(g).select("name", "source")
    if pattern.startswith("L") and not pattern.endswith(";") and "." not in pattern:
        return rows.where(F.col("name").ilike(ilike_pattern(pattern) + "%"))
    return rows.where(F.col("name") == to_slashed(F.lit(pattern)))


def _string_match(column: Column, pattern: str, like: bool) -> Column:
    return column.ilike(ilike_pattern(pattern)) if like else column == pattern


def _strings(g: Graph, source: str | None = None) -> DataFrame:
    s = g["sources"] if source is None else g["sources"].where(F.col("name") == source)
    s = s.select(F.col("id").alias("source"), F.col("name").alias("__source"))
    return g["strings"].join(s, "source").select("id", "string", F.col("__source").alias("source"))


def strings_for_method(g: Graph, method_id: int) -> DataFrame:
    used = g["method_strings"].where(F.col("method") == method_id).select(F.col("string").alias("id"))
    return g["strings"].join(used, "id", "left_semi").select("string")


def strings_for_source(g: Graph, source: str = FRAMEWORK) -> DataFrame:
    return _strings(g, source).select("string")


def find_strings(g: Graph, pattern: str, source: str | None = None) -> DataFrame:
    """(string, source): LIKE if the pattern holds a %, else equal."""
    return _strings(g, source).where(_string_match(F.col("string"), pattern, "%" in pattern)).select("string", "source")


def methods_for_string(g: Graph, pattern: str, like: bool = False, source: str | None = None) -> DataFrame:
    """Methods that use a matching constant, once each. A pattern with LIKE matches as such."""
    s = g["strings"].where(_string_match(F.col("string"), pattern, like)).select(F.col("id").alias("string"))
    ids = g["method_strings"].join(s, "string", "left_semi").select(F.col("method").alias("id"))
    rows = method_specs(g).join(ids, "id", "left_semi")
    return rows if source is None else rows.where(F.col("source") == source)


def strings_by_method(g: Graph, name: str | None = None, signature: str | None = None, cls: str | None = None, source: str | None = None) -> DataFrame:
    """Methods found, each with the sorted list of its constants; those without any are left out."""
    m = get_methods(g, name, cls, signature, source)
    used = g["method_strings"].select(F.col("method").alias("id"), F.col("string").alias("__s")).join(g["strings"].select(F.col("id").alias("__s"), "string"), "__s")
    return m.join(used, "id").groupBy(*m.columns).agg(F.array_sort(F.collect_list("string")).alias("strings"))


def _spec_with_class_source(g: Graph) -> DataFrame:
    """Methods with their class's source instead of their own."""
    c = class_specs(g).select(F.col("id").alias("__c"), F.col("name").alias("__class"), F.col("source").alias("__source"))
    m = g["methods"]
    return m.join(c, m["class"] == F.col("__c")).select(m["id"], F.col("__class").alias("class"), m["name"], F.col("args").alias("signature"), "ret", F.col("__source").alias("source"), "access_flags")


def _access(g: Graph, action: int | None) -> DataFrame:
    return g["method_field_access"] if action is None else g["method_field_access"].where(F.col("action") == action)


def methods_referencing_field(g: Graph, field_id: int, action: int | None = None) -> DataFrame:
    """Methods that read or write a field, a row for each way; source is the class's."""
    used = _access(g, action).where(F.col("field") == field_id).select(F.col("method").alias("id"), "action")
    return _spec_with_class_source(g).join(used, "id")


def _one_action(only_read: bool, only_write: bool) -> int | None:
    if only_read and only_write:
        raise ValueError("only_read and only_write exclude each other")
    return READ if only_read else WRITE if only_write else None


def methods_by_field(g: Graph, cls: str, name: str | None = None, source: str | None = None, only_read: bool = False, only_write: bool = False) -> DataFrame:
    """Methods that use any field found, a row for each field and way."""
    fields = get_field_ids(g, cls, name, None, source).select(F.col("id").alias("field"))
    used = _access(g, _one_action(only_read, only_write)).join(fields, "field", "left_semi").select(F.col("method").alias("id"), "field", "action")
    return _spec_with_class_source(g).join(used, "id")


def method_field_refs(g: Graph, method_id: int) -> DataFrame:
    """Fields that a method uses, with action; unknown codes are left out."""
    used = g["method_field_access"].where((F.col("method") == method_id) & F.col("action").isin(READ, WRITE)).select(F.col("field").alias("id"), "action")
    return field_specs(g).join(used, "id")


def fields_by_method(g: Graph, cls: str | None = None, name: str | None = None, signature: str | None = None, source: str | None = None, only_read: bool = False, only_write: bool = False) -> DataFrame:
    """Fields that any method found uses, a row for each method and way."""
    methods = get_method_ids(g, name, cls, signature, source).select(F.col("id").alias("method"))
    used = _access(g, _one_action(only_read, only_write)).join(methods, "method", "left_semi").select(F.col("field").alias("id"), "method", "action")
    return field_specs(g).join(used, "id")


def resolve_source(inv: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """names(text) with the graph source each may mean: the framework and squashed paths as they are, x.apk by file name, else by package
    name; a text that matches nothing passes through. All candidates are returned."""
    a = inv["apks"].select(F.col("app_name").alias("__app"), F.col("name").alias("__file"), squash(F.col("device_path")).alias("__source"))
    as_is = (F.col("text") == FRAMEWORK) | F.col("text").startswith("%")
    by_file = names.where(~as_is & F.lower("text").endswith(".apk")).join(a, F.col("text") == F.col("__file"), "left").select("text", "__source")
    by_app = names.where(~as_is & ~F.lower("text").endswith(".apk")).join(a, F.col("text") == F.col("__app"), "left").select("text", "__source")
    found = by_file.unionByName(by_app).unionByName(names.where(as_is).select("text", F.col("text").alias("__source")))
    return found.select("text", F.coalesce("__source", "text").alias("source")).distinct()


def files_for_class(files: DataFrame, cls: str, source: str | None = None, fallback_package: str | None = None) -> DataFrame:
    """(path, rank) of the files(path, source) that hold a class: the framework's first, then packages'. A name in no package is also
    looked for in fallback_package, after all others. With a source, its files alone."""
    wanted = [(to_dotted(F.lit(cls)), 0)]
    if fallback_package and "." not in cls.strip(".") and "/" not in cls:
        wanted.append((F.lit(f"{fallback_package}.{cls.lstrip('.')}"), 2))
    rows = files if source is None else files.where(F.col("source") == source)
    hit = F.coalesce(*(F.when(F.col("path").endswith(F.concat(F.lit("/"), class_path(c))), F.lit(r)) for c, r in wanted))
    rank = hit + F.when(F.col("source") == FRAMEWORK, 0).otherwise(1)
    return rows.select("path", "source", rank.alias("rank")).where("rank is not null").orderBy("rank", "path")


def manifest_files(files: DataFrame, source: str | None = None) -> DataFrame:
    rows = files if source is None else files.where(F.col("source") == source)
    return rows.where(file_name(F.col("path")) == "AndroidManifest.xml")


