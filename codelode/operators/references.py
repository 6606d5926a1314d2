"""References in manifests: a package's resource table closed once, and looked up by every build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.plans.storage import written
from codelode.sources.device import attribute, manifest_attributes

_IS_REFERENCE = "^@[^/]*/"


def _id(package: Column | str, key: Column | str) -> Column:
    """What stands for an entry in the rounds, which shuffle nothing else: 16 bytes instead of its names."""
    package = F.col(package) if isinstance(package, str) else package
    return F.unhex(F.md5(F.concat(F.length(package).cast("string"), F.lit(":"), package, key if isinstance(key, Column) else F.col(key))))


def _doubled(rows: DataFrame, plain: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(id, end) of rows(id, to, end, open) that come to an end, where every open row's pointer is replaced by its target's, until none is
    open or every chain without a cycle must have ended: the rounds grow with the logarithm of the longest chain. A round writes the rows
    that were open alone. Then the rows (id, to) that are open still, and how many.

    An entry that no open row points at is pointed at in no later round either, as pointers move to targets of targets. So entries that
    have ended are looked through for such in the first two rounds, in which most references end, and left out of what follows."""
    rows, left, _ = written(rows, "references", F.col("open"))
    done = rows.where("not open").select("id", "end")
    ended = plain.select("id", F.col("id").alias("end")).unionByName(done)
    steps, most = 1, left
    while left and steps <= most:
        open_ = rows.where("open")
        if steps <= 2:
            ended, _, _ = written(ended.join(open_.select(F.col("to").alias("id")), "id", "left_semi"), "ended")
        nodes = open_.select(F.col("id").alias("to"), F.col("to").alias("__to"), F.lit(None).cast("binary").alias("__end"), F.lit(True).alias("__open"))
        nodes = nodes.unionByName(ended.select(F.col("id").alias("to"), F.lit(None).cast("binary").alias("__to"), F.col("end").alias("__end"), F.lit(False).alias("__open")))
        moved = open_.join(nodes, "to").select("id", F.col("__to").alias("to"), F.col("__end").alias("end"), F.col("__open").alias("open"))
        rows, left, _ = written(moved, "references", F.col("open"))
        new = rows.where("not open").select("id", "end")
        done, ended = done.unionByName(new), ended.unionByName(new)
        steps *= 2
    return done, rows.where("open").select("id", "to"), left


def close_resources(resources: DataFrame) -> DataFrame:
    """(package, key, text) of every entry of resources(package, kind, name, value); key: kind/name, text as _closed() gives it."""
    plain, refers, found = _closed(resources)
    return plain.select("package", "key", F.col("value").alias("text")).unionByName(refers.select("package", "key", "id").join(found, "id").select("package", "key", "text"))


def _closed(resources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entries (package, key, value, id) of resources(package, kind, name, value) that are texts, those that are references, and (id,
    text) of these: what each stands for in the end.

    A value @kind/name stands for that entry of its package. Text is null where the last entry is missing or has no text; the reference
    itself stays as text where the package has no entry of its kind at all (@android:... too), where it has no slash, and where a chain
    comes back to it. Of repeated entries the smallest value counts."""
    key = F.concat_ws("/", "kind", "name")
    entries = resources.where("package is not null and kind is not null and name is not null").groupBy("package", key.alias("key")).agg(F.min("value").alias("value"))
    entries, _, _ = written(entries.withColumn("id", _id("package", "key")), "resources")
    refers = F.coalesce(F.col("value").rlike(_IS_REFERENCE), F.lit(False))
    plain = entries.where(~refers)
    links = entries.where(refers).select("id", _id("package", F.expr("substring(value, 2)")).alias("to"))
    there = entries.select(F.col("id").alias("to"), F.lit(True).alias("__found"))
    first, _, _ = written(links.join(there, "to", "left").select("id", "to", F.col("__found").isNotNull().alias("open")), "references")
    # the text of a chain that ends at a missing entry: the reference itself, or none where the package has others of its kind
    kinds = entries.select("package", F.substring_index("key", "/", 1).alias("__kind"), F.lit(True).alias("__has")).distinct()
    named = entries.where(refers).select("id", "package", "value", F.substring_index(F.expr("substring(value, 2)"), "/", 1).alias("__kind"))
    last = named.join(first.where("not open").select("id"), "id").join(kinds, ["package", "__kind"], "left")
    texts = plain.select(F.col("id").alias("end"), F.col("value").alias("text")).unionByName(last.select(F.col("id").alias("end"), F.when(F.col("__has").isNull(), F.col("value")).alias("text")))
    done, still, left = _doubled(first.select("id", "to", F.when(~F.col("open"), F.col("id")).alias("end"), "open"), plain)
    if left:  # after so many steps every open pointer has come to lie on a cycle, and together they lie on all of it
        cycles = still.select("to").distinct().withColumn("__cycle", F.lit(True))
        again = still.select("id").join(first.select("id", "to"), "id").join(cycles, "to", "left")
        again = again.select("id", "to", F.when(F.col("__cycle"), F.col("id")).alias("end"), F.col("__cycle").isNull().alias("open"))
        done = done.unionByName(_doubled(again, plain)[0])
        texts = texts.unionByName(entries.where(refers).join(again.where("not open").select("id"), "id").select(F.col("id").alias("end"), F.col("value").alias("text")))
    return plain, entries.where(refers), done.join(texts, "end").select("id", "text")


def _texts() -> Column:
    """Every attribute of a manifest that may be a reference."""
    app = F.col("application")

    def of(entries: Column, names: tuple[str, ...]) -> Column:
        return F.coalesce(F.flatten(F.transform(entries, lambda x: F.array(*(attribute(x, n) for n in names)))), F.array().cast("array<string>"))

    lists = [of(F.col(f"`{tag}`") if tag in ("permission", "uses-permission", "protected-broadcast") else app[tag], names) for tag, names in manifest_attributes().items()]
    split = F.coalesce(F.flatten(F.transform(app["provider"], lambda x: F.split(F.coalesce(attribute(x, "authorities"), F.lit("")), ";"))), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(F.col("_package"), attribute(app, "debuggable")), split, *lists), lambda x: x.rlike(_IS_REFERENCE)))


def with_references(manifests: DataFrame, resources: DataFrame) -> DataFrame:
    """manifests with refs, a map from each reference that a manifest holds to the text it stands for; those that can't be resolved aren't in it.

    resources(package, kind, name, value) are closed once for all manifests. A manifest's map is no larger than the manifest."""
    plain, _, found = _closed(resources)
    closed = plain.select("id", F.col("value").alias("text")).unionByName(found).where("text is not null")
    used = manifests.where("_package is not null").select("file", "_package", F.explode(_texts()).alias("__ref")).distinct()
    maps = used.withColumn("id", _id("_package", F.expr("substring(__ref, 2)"))).join(closed, "id").groupBy("file", "_package").agg(F.map_from_entries(F.collect_set(F.struct("__ref", "text"))).alias("refs"))
    return manifests.join(maps, ["file", "_package"], "left")


def text_of(value: Column, refs: Column | None) -> Column:
    """An attribute's text, a reference resolved; one that can't be stays as it is."""
    return value if refs is None else F.coalesce(F.try_element_at(refs, value), value)


def bool_of(value: Column, refs: Column | None, absent: Column | bool, unresolved: bool) -> Column:
    """An attribute's truth: exactly true or false as it stands or resolved; `absent` where there is none, `unresolved` for anything else."""
    text, absent = text_of(value, refs), absent if isinstance(absent, Column) else F.lit(absent)
    return F.when(value.isNull(), absent).when(text == "true", True).when(text == "false", False).otherwise(F.lit(unresolved))

