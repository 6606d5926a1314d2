"""Readers of a device's text files: manifests, properties, service and package lists, probe results, file listings; JSON results and their cache."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.expr import file_path
from codelode.plans.storage import delete, exists, file_system, rename
from codelode.sources.listing import list_tree

_A = "_android:"
# Kinds of resource files whose entries are plain values.
RESOURCE_KINDS = ("string", "bool", "integer", "color", "dimen", "id")


def _attributes(*names: str) -> str:
    return ", ".join(f"`{_A}{n}`: string" for n in names)


_DATA = ("scheme", "host", "port", "path", "pathPattern", "pathPrefix", "pathSuffix", "pathAdvancedPattern", "mimeType")
_FILTER = f"`intent-filter`: array<struct<action: array<struct<{_attributes('name')}>>, category: array<struct<{_attributes('name')}>>, data: array<struct<{_attributes(*_DATA)}>>>>"
_COMPONENT = f"array<struct<{_attributes('name', 'permission', 'exported', 'enabled')}, {_FILTER}>>"
_PROVIDER = f"array<struct<{_attributes('name', 'authorities', 'permission', 'readPermission', 'writePermission', 'grantUriPermissions', 'exported', 'enabled')}, {_FILTER}>>"
MANIFEST_SCHEMA = (
    f"_package string, permission array<struct<{_attributes('name', 'protectionLevel')}>>, `uses-permission` array<struct<{_attributes('name')}>>, `protected-broadcast` array<struct<{_attributes('name')}>>, "
    f"application struct<{_attributes('debuggable', 'allowBackup', 'permission')}, receiver: {_COMPONENT}, service: {_COMPONENT}, activity: {_COMPONENT}, `activity-alias`: {_COMPONENT}, provider: {_PROVIDER}>, _corrupt_record string"
)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each package manifest, with its file; a manifest that can't be read has only _corrupt_record."""
    rows = spark.read.format("xml").option("rowTag", "manifest").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").schema(MANIFEST_SCHEMA).load(path)
    return rows.withColumn("file", file_path(F.input_file_name()))


def parse_manifests(text: DataFrame) -> DataFrame:
    """The same of text(file, text), a manifest in each row."""
    parsed = F.from_xml("text", MANIFEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return text.select(parsed.alias("m"), "file").select("m.*", "file")


def attribute(struct: Column, name: str) -> Column:
    return struct.getField(_A + name)


def manifest_attributes() -> dict[str, tuple[str, ...]]:
    """The attributes that a manifest's elements are read with, by tag; a provider's authorities aside."""
    component = ("name", "permission", "exported", "enabled")
    tags = {tag: component for tag in ("receiver", "service", "activity", "activity-alias")}
    tags["provider"] = (*component, "readPermission", "writePermission", "grantUriPermissions")
    return tags | {"permission": ("name", "protectionLevel"), "uses-permission": ("name",), "protected-broadcast": ("name",)}


def read_resources(spark: SparkSession, path: str, kinds: tuple[str, ...] = RESOURCE_KINDS) -> DataFrame:
    """(base, kind, name, value) of the entries in <base>/res/values/<kind>s.xml below path; value is null where an entry holds no plain text.

    Entries of another tag than the file's kind aren't values of it; files that can't be read have none."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*s.xml").text(path, wholetext=True)
    text = text.withColumn("file", file_path(F.input_file_name())).where(F.col("file").rlike("/res/values/[^/]+s\\.xml$"))
    text = text.select(F.regexp_extract("file", "^(.*)/res/values/", 1).alias("base"), F.regexp_extract("file", "/([^/]+)s\\.xml$", 1).alias("kind"), "value")
    parts = []
    for kind in kinds:
        entries = F.from_xml("value", f"`{kind}` array<struct<_name: string, _VALUE: string>>", {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
        parts.append(text.where(F.col("kind") == kind).select("base", "kind", F.explode(entries[kind]).alias("x")).select("base", "kind", F.col("x._name").alias("name"), F.nullif(F.col("x._VALUE"), F.lit("")).alias("value")))
    return reduce(DataFrame.unionByName, parts).where("name is not null")


def _refs(manifests: DataFrame) -> list[str]:
    """The map of references, where manifests have one: it goes with every row that is made of them."""
    return ["refs"] if "refs" in manifests.columns else []


def manifest_packages(manifests: DataFrame) -> DataFrame:
    app = F.col("application")
    return manifests.where("_package is not null").select("file", F.col("_package").alias("package"), attribute(app, "debuggable").alias("debuggable"), attribute(app, "allowBackup").alias("allow_backup"), *_refs(manifests))


def manifest_named(manifests: DataFrame, tag: str) -> DataFrame:
    """(file, package, name[, protection_level]) of permission, uses-permission or protected-broadcast entries."""
    rows = manifests.where("_package is not null").select("file", F.col("_package").alias("package"), F.explode(F.col(f"`{tag}`")).alias("x"), *_refs(manifests))
    out = rows.select("file", "package", *_refs(rows), attribute(F.col("x"), "name").alias("name"), *([attribute(F.col("x"), "protectionLevel").alias("protection_level")] if tag == "permission" else []))
    return out


def manifest_components(manifests: DataFrame, kind: str) -> DataFrame:
    """(file, package, x): one row for each component of a kind; activities with their aliases."""
    app = F.col("application")
    lists = F.concat(F.coalesce(app["activity"], F.array()), F.coalesce(app["activity-alias"], F.array())) if kind == "activity" else app[kind]
    return manifests.where("_package is not null").select("file", F.col("_package").alias("package"), F.explode(lists).alias("x"), *_refs(manifests))


def manifest_filters(manifests: DataFrame, kind: str) -> DataFrame:
    """(file, package, component, filter, action, category, and the nine data fields): the product of each intent filter's entries; absent ones are null."""
    rows = manifest_components(manifests, kind).select("file", "package", attribute(F.col("x"), "name").alias("component"), F.posexplode(F.col("x").getField("intent-filter")).alias("filter", "f"))
    rows = rows.select("file", "package", "component", "filter", F.explode_outer(F.col("f.action")).alias("a"), F.col("f.category").alias("cs"), F.col("f.data").alias("ds"))
    rows = rows.select("file", "package", "component", "filter", "a", F.explode_outer("cs").alias("c"), "ds").select("file", "package", "component", "filter", "a", "c", F.explode_outer("ds").alias("d"))
    return rows.select("file", "package", "component", "filter", attribute(F.col("a"), "name").alias("action"), attribute(F.col("c"), "name").alias("category"), *(attribute(F.col("d"), n).alias(n) for n in _DATA))


def read_property_dump(text: DataFrame) -> DataFrame:
    """(name, value) of `[name]: [value]` records in whole texts (column value); a value may span lines, other lines are dropped."""
    pattern = F.lit("(?s)\\[([^\\]\\n]*)\\]: \\[(.*?)\\](?=\\r?\\n|$)")
    pairs = F.arrays_zip(F.regexp_extract_all("value", pattern, 1).alias("name"), F.regexp_extract_all("value", pattern, 2).alias("value"))
    return text.select(F.explode(pairs).alias("p")).select("p.name", "p.value")


def read_property_files(spark: SparkSession, path: str, max_depth: int = 5) -> DataFrame:
    """(name, value) of key=value lines of *.prop files at most max_depth folders down; of several the last by file and line wins."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.prop").text(path, wholetext=True).select(file_path(F.input_file_name()).alias("file"), "value")
    base = F.lit(path.rstrip("/").split("://")[-1])
    below = F.regexp_replace(F.regexp_replace("file", "^[a-z0-9]+:/+", "/"), F.concat(F.lit("^.*\\Q"), base, F.lit("\\E/")), "")
    lines = files.where(F.size(F.split(below, "/")) <= max_depth).select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.where(~F.trim("text").startswith("#") & F.col("text").contains("="))
    pair = F.split("text", "=", 2)
    rows = lines.select("file", "line", F.trim(pair[0]).alias("name"), F.trim(pair[1]).alias("value"))
    return rows.groupBy("name").agg(F.max_by("value", F.struct("file", "line")).alias("value"))


def read_service_list(text: DataFrame) -> DataFrame:
    """(number, name, iface) of `N<tab>name: [iface]` lines (column value); an empty interface is null, other lines are dropped."""
    pattern = "^\\s*(\\d+)\\s+([^:]+):\\s*\\[(.*)\\]\\s*$"
    rows = text.where(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select(part(1).cast("long").alias("number"), F.trim(part(2)).alias("name"), F.nullif(part(3), F.lit("")).alias("iface"))


def read_service_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(name): distinct first words of *_service_contexts files, without blank lines, comments and the wildcard."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_service_contexts").text(path)
    name = F.split(F.trim("value"), "\\s+")[0]
    return lines.select(name.alias("name")).where("name <> '' and name <> '*' and not startswith(name, '#')").distinct()


def read_package_list(text: DataFrame) -> DataFrame:
    """(path) between the first colon and the last equals sign of each line (column value); lines without are dropped."""
    return text.select(F.regexp_extract("value", "^[^:]*:(.*)=", 1).alias("path")).where("path <> ''")


def read_probe_results(spark: SparkSession, path: str) -> DataFrame:
    """(service_name, method_name, exception_thrown, security_exception_thrown) of a headerless CSV; further columns are ignored."""
    lines = spark.read.text(path)
    row = F.from_csv("value", F.lit("s string, m string, e string, x string"), {"mode": "PERMISSIVE", "quote": '"', "escape": '"'})
    return lines.where("trim(value) <> ''").select(row.alias("r")).select(F.col("r.s").alias("service_name"), F.col("r.m").alias("method_name"), F.coalesce(F.trim("r.e") == "1", F.lit(False)).alias("exception_thrown"), F.coalesce(F.trim("r.x") == "1", F.lit(False)).alias("security_exception_thrown"))


def find_files(spark: SparkSession, base: str, kind: str = "file", min_depth: int = 1, max_depth: int | None = None, suffix: str | None = None, prefix: str | None = None, name: str | None = None, ignore_case: bool = False) -> DataFrame:
    """(path, depth) of files (or folders) below base, by depth and name; empty ones too, and at any depth unless max_depth is given. Contents are not read."""
    rows = list_tree(spark, base, max_depth).where(F.col("folder") == (kind == "dir")).select("path", "depth").where(F.col("depth") >= min_depth)
    last = F.substring_index("path", "/", -1)
    fold = F.lower if ignore_case else (lambda c: c)
    text = lambda t: F.lit(t.lower() if ignore_case else t)
    for wanted, test in ((suffix, lambda t: fold(last).endswith(text(t))), (prefix, lambda t: fold(last).startswith(text(t))), (name, lambda t: fold(last) == text(t))):
        if wanted is not None:
            rows = rows.where(test(wanted))
    return rows


def framework_dirs(spark: SparkSession, base: str) -> DataFrame:
    return find_files(spark, base, kind="dir", name="framework")


def package_files(spark: SparkSession, base: str) -> DataFrame:
    return find_files(spark, base, suffix=".apk", ignore_case=True)


def read_pattern_list(text: DataFrame) -> DataFrame:
    """(pattern): the lines (column value) that are neither blank nor comments."""
    return text.select(F.trim("value").alias("pattern")).where("pattern <> '' and not startswith(pattern, '#')")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines, nested columns nested."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def files_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A text that changes when a file below paths comes, goes, or gets another size or time. Spark lists the files; none is read."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return json.dumps(sorted(paths))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select("path", "length", "modificationTime")
    seen = files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.bit_xor(F.xxhash64("modificationTime", "path", "length"))).first()
    return json.dumps([sorted(paths), *seen], default=str)


def _published(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the results that are there whole."""
    fs, p = file_system(spark, f"{folder}/[0-9]*")
    return sorted(int(f.getPath().getName()) for f in fs.globStatus(p) or ())


def cached_result(spark: SparkSession, base: str, op: str, args: dict, fn: Callable[[], DataFrame], force: bool = False, inputs: list[str] | None = None) -> DataFrame:
    """fn's result, kept as Parquet under the operator's name and a hash of all its arguments and of what the files below `inputs` are like
    (their names, sizes and times), so changed input gives a new result; force computes it anew.

    A result is written beside the others and gets its number by one rename when it is whole, so a call that fails leaves what was there,
    and of two that compute the same, the later finds the earlier's (with force, the later counts). The one before a forced result stays
    for those that read it; older ones go."""
    key = hashlib.sha256(json.dumps([args, files_fingerprint(spark, inputs) if inputs else None], sort_keys=True, default=str).encode()).hexdigest()
    folder = f"{base}/{op}/{key}"
    there = _published(spark, folder)
    if force or not there:
        half = f"{folder}/half-{uuid.uuid4().hex}"
        try:
            fn().write.parquet(half)
            now = _published(spark, folder)
            if force or not now:
                number = now[-1] + 1 if now else 0
                rename(spark, half, f"{folder}/{number}")
                delete(spark, f"{folder}/{number}/{half.rsplit('/', 1)[1]}")  # where another took the number at the same moment
        finally:
            delete(spark, half)
        there = _published(spark, folder)
        for old in there[:-2]:
            delete(spark, f"{folder}/{old}")
    return spark.read.parquet(f"{folder}/{there[-1]}")


def open_snapshot(spark: SparkSession, path: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def save_snapshot(tables: dict[str, DataFrame], path: str, force: bool = False) -> None:
    """Write all tables as one snapshot, or none: they are written beside it and get its name when all are there. One that is there is an
    error, or, with force, replaced."""
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, path) and not force:
        raise FileExistsError(f"{path} already exists")
    unfinished = f"{path.rstrip('/')}.unfinished-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{unfinished}/{name}")
        delete(spark, path)
        rename(spark, unfinished, path)
    except BaseException:
        delete(spark, unfinished)
        raise


def baseline_path(base: str, api_level: int) -> str:
    """Where the emulator's snapshot of an API level is kept."""
    return f"{base.rstrip('/')}/emulator-{api_level}"
