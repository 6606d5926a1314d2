"""Inventory build: manifests, lists and code facts become inventory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.expr import extension, file_name, from_manifest_name, is_not_abstract, to_dotted, to_slashed
from codelode.operators.build import stable_id
from codelode.operators.diff import StoredDiffs
from codelode.operators.references import bool_of, text_of, with_references
from codelode.operators.traversal import inherited
from codelode.plans.storage import written
from codelode.schema import FALSE, INVENTORY, TRUE, UNKNOWN
from codelode.sources.device import attribute, manifest_components, manifest_named, manifest_packages, open_snapshot, save_snapshot

PRIVILEGED = "^/(?:[^/]+/)+priv-app/.*"
# The order in which kinds of framework files are tried, and the service transaction constants' prefix.
FILE_KINDS = ("jar", "vdex", "dex", "apex")
TRANSACTION = "TRANSACTION_"


def _refs(rows: DataFrame) -> Column | None:
    return F.col("refs") if "refs" in rows.columns else None


def _resolved(manifests: DataFrame, resources: DataFrame | None) -> DataFrame:
    """manifests with their references, where resources(package, kind, name, value) are given and manifests haven't got them yet."""
    return manifests if resources is None or "refs" in manifests.columns else with_references(manifests, resources)


def privileged_paths(paths: DataFrame) -> DataFrame:
    """paths(path) of privileged apps."""
    return paths.where(F.col("path").rlike(PRIVILEGED))


def build_apks(manifests: DataFrame, paths: DataFrame, installed: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """One row for each readable manifest; one whose debuggable can't be resolved isn't. paths(file, device_path) says where a manifest's package is; installed(path) is the list of
    packages, by which privilege is told; without it, or for a package that isn't listed, by a priv-app folder in the path."""
    rows = manifest_packages(_resolved(manifests, resources)).join(paths, "file")
    app_name, debuggable = text_of(F.col("package"), _refs(rows)), bool_of(F.col("debuggable"), _refs(rows), False, False)
    fallback = F.col("device_path").contains("/priv-app/")
    if installed is None:
        rows = rows.withColumn("is_priv", fallback)
    else:
        listed = installed.select(F.col("path").alias("device_path"), F.col("path").rlike(PRIVILEGED).alias("__priv")).distinct()
        rows = rows.join(listed, "device_path", "left").withColumn("is_priv", F.coalesce("__priv", fallback))
    name = file_name(F.col("device_path"))
    rows = rows.select(app_name.alias("app_name"), name.alias("name"), debuggable.alias("is_debuggable"), "is_priv", "device_path", "file")
    return _least(rows, "app_name", "name").withColumn("id", stable_id(F.col("app_name"), F.col("name")))


def _least(rows: DataFrame, *key: str) -> DataFrame:
    """Of the rows of a key the smallest, by its other columns in order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__least")).select(*(F.col(c) if c in key else F.col(f"__least.{c}").alias(c) for c in rows.columns))


def component_defaults(filters: Column, exported: Column, enabled: Column, refs: Column | None = None) -> tuple[Column, Column]:
    """Whether a component is exported and enabled by its attributes' text: where there is none, exported if it has an intent filter (filters:
    their number), and enabled. A reference counts as what it stands for; text that comes to neither true nor false, exactly, is true."""
    return bool_of(exported, refs, filters > 0, True), bool_of(enabled, refs, True, True)


def _components(manifests: DataFrame, apks: DataFrame, kind: str, resources: DataFrame | None) -> DataFrame:
    rows = manifest_components(_resolved(manifests, resources), kind).join(apks.select("file", F.col("id").alias("apk_id"), "app_name"), "file")
    x, refs = F.col("x"), _refs(rows)
    filters = F.coalesce(F.size(x.getField("intent-filter")), F.lit(0))
    exported, enabled = component_defaults(filters, attribute(x, "exported"), attribute(x, "enabled"), refs)
    package = text_of(F.col("package"), refs)
    name = text_of(attribute(x, "name"), refs)
    text = lambda c: text_of(attribute(x, c), refs)
    more = []
    if kind == "provider":
        parts = F.transform(F.split(attribute(x, "authorities"), ";"), lambda a: text_of(a, refs))
        more = [F.coalesce(F.array_join(parts, ";"), F.lit("")).alias("authorities"), bool_of(attribute(x, "grantUriPermissions"), refs, False, False).alias("grant_uri_permissions"), F.coalesce(text("readPermission"), text("permission")).alias("read_permission"), F.coalesce(text("writePermission"), text("permission")).alias("write_permission")]
    return rows.select("apk_id", from_manifest_name(package, name).alias("class_name"), text("permission").alias("permission"), exported.alias("exported"), enabled.alias("enabled"), F.when(F.instr(name, "/") > 0, F.substring_index(name, "/", 1)).otherwise(package).alias("pkg"), *more)


def build_components(manifests: DataFrame, apks: DataFrame, kind: str, resources: DataFrame | None = None) -> DataFrame:
    """Receivers, services or activities (with their aliases), of one kind; references count as what resources(package, kind, name, value)
    say they stand for, here and in the other builds. Of several of one name and package the smallest row stays."""
    rows = _least(_components(manifests, apks, kind, resources), "class_name", "apk_id")
    return rows.withColumn("id", stable_id(F.lit(kind), F.col("class_name"), F.col("apk_id"))).select(*INVENTORY["receivers"].names)


def build_services(manifests: DataFrame, apks: DataFrame, binders: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """binders(class, returns_binder) as returns_binder() gives them; unknown for others."""
    rows = build_components(manifests, apks, "service", resources)
    b = binders.groupBy(to_dotted(F.col("class")).alias("class_name")).agg(F.max("returns_binder").alias("returns_binder"))
    return rows.join(b, "class_name", "left").withColumn("returns_binder", F.coalesce("returns_binder", F.lit(UNKNOWN))).select(*INVENTORY["services"].names)


def build_providers(manifests: DataFrame, apks: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """Read and write permissions default to the generic one; grantUriPermissions is an attribute, false by default and where it can't be resolved."""
    rows = _least(_components(manifests, apks, "provider", resources), "class_name", "apk_id")
    return rows.withColumn("id", stable_id(F.lit("provider"), F.col("class_name"), F.col("apk_id"))).withColumnRenamed("class_name", "name").select(*INVENTORY["providers"].names)


def permissions_from(rows: DataFrame) -> DataFrame:
    """Declared permissions(name, protection_level, source_apk_id): normal by default; of several of one name and package one stays."""
    rows = rows.where("name is not null").select("name", F.coalesce(F.nullif("protection_level", F.lit("")), F.lit("normal")).alias("protection_level"), "source_apk_id")
    rows = rows.groupBy("name", "source_apk_id").agg(F.min("protection_level").alias("protection_level"))
    return rows.withColumn("id", stable_id(F.col("name"), F.col("source_apk_id"))).select(*INVENTORY["permissions"].names)


def _named(manifests: DataFrame, tag: str, resources: DataFrame | None) -> DataFrame:
    rows = manifest_named(_resolved(manifests, resources), tag)
    return rows.withColumns({c: text_of(F.col(c), _refs(rows)) for c in ("name", "protection_level") if c in rows.columns})


def build_permissions(manifests: DataFrame, apks: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    return permissions_from(_named(manifests, "permission", resources).join(apks.select("file", F.col("id").alias("source_apk_id")), "file"))


def uses_from(rows: DataFrame) -> DataFrame:
    """Requested permissions(name, apk_id), blank ones out, once each."""
    rows = rows.where("trim(name) <> ''").select("name", "apk_id").dropDuplicates()
    return rows.withColumn("id", stable_id(F.col("name"), F.col("apk_id"))).select(*INVENTORY["apk_permissions"].names)


def build_uses_permissions(manifests: DataFrame, apks: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    return uses_from(_named(manifests, "uses-permission", resources).join(apks.select("file", F.col("id").alias("apk_id")), "file"))


def build_protected_broadcasts(manifests: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    rows = _named(manifests, "protected-broadcast", resources).where("name is not null").select("name").distinct()
    return rows.select(stable_id(F.col("name")).alias("id"), "name")


def build_properties(pairs: DataFrame) -> DataFrame:
    """pairs(name, value), once for each name (the smallest value of several)."""
    rows = pairs.groupBy("name").agg(F.min("value").alias("value"))
    return rows.select(stable_id(F.col("name")).alias("id"), "name", "value")


def build_system_services(listed: DataFrame) -> DataFrame:
    """listed(number, name, iface): the first of a name wins; whether it gives a binder isn't known yet."""
    rows = listed.groupBy("name").agg(F.min_by(F.struct("iface"), "number").alias("first"))
    return rows.select(stable_id(F.col("name")).alias("id"), "name", F.col("first.iface").alias("iface"), F.lit(UNKNOWN).alias("can_get_binder"))


def returns_binder(instructions: DataFrame) -> DataFrame:
    """(source, class, returns_binder) of classes with onBind(Intent): false if it has two instructions and the first loads a number, else true.
    Classes without the method aren't listed: unknown."""
    rows = instructions.where("method = 'onBind' and args = 'Landroid/content/Intent;'")
    literal = F.col("opcode").rlike("^const(/|-wide|$)") & F.col("operands").rlike("^-?(0x[0-9a-fA-F]+|\\d+)$")
    rows = rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.min_by(literal, "line").alias("literal"))
    return rows.select("source", "class", F.when((F.col("n") == 2) & F.col("literal"), FALSE).otherwise(TRUE).alias("returns_binder"))


def build_service_methods(services: DataFrame, constants: DataFrame, methods: DataFrame) -> DataFrame:
    """Methods of services: constants(class, name, value) named TRANSACTION_* of <iface>$Stub, with signature and return type from
    methods(class, name, args, ret) of the interface if every one is found there, else none has them."""
    s = services.where("iface is not null").select(F.col("id").alias("system_service_id"), to_slashed(F.col("iface")).alias("iface"), to_slashed(F.concat(F.col("iface"), F.lit("$Stub"))).alias("class"))
    c = constants.where(F.col("name").startswith(TRANSACTION)).select("class", F.expr(f"substring(name, {len(TRANSACTION) + 1})").alias("name"), F.col("value").cast("long").alias("transaction_id"))
    m = methods.select(F.col("class").alias("iface"), "name", F.col("args").alias("signature"), F.col("ret").alias("return_type")).groupBy("iface", "name").agg(F.min(F.struct("signature", "return_type")).alias("m"))
    rows = s.join(c, "class").join(m, ["iface", "name"], "left")
    whole = rows.groupBy("system_service_id").agg((F.count("m") == F.count("*")).alias("whole"))
    rows = rows.join(whole, "system_service_id")
    signature, ret = F.when(F.col("whole"), F.col("m.signature")), F.when(F.col("whole"), F.col("m.return_type"))
    rows = rows.select("system_service_id", "transaction_id", "name", signature.alias("signature"), ret.alias("return_type"))
    return rows.select(stable_id(F.col("system_service_id"), F.col("transaction_id"), F.col("name")).alias("id"), "system_service_id", "transaction_id", "name", "signature", "return_type", F.lit(None).cast("string").alias("method_hash"))


def descendants_of_each(g: dict[str, DataFrame], seeds: DataFrame) -> DataFrame:
    """(root, id): every proper descendant of every seed class seeds(id), for all seeds at once; ends on cycles."""
    return inherited(g, seeds.select(F.col("id").alias("root"), "id").distinct(), "supers", True, "root")


def build_service_impls(g: dict[str, DataFrame], services: DataFrame) -> DataFrame:
    """Classes that aren't abstract below <iface>$Stub, in any source."""
    names = services.where("iface is not null").select(F.col("id").alias("system_service_id"), to_slashed(F.concat(F.col("iface"), F.lit("$Stub"))).alias("name"))
    stubs = g["classes"].join(names, "name").select("id", "system_service_id")
    below = descendants_of_each(g, stubs).withColumnRenamed("id", "class_id")
    sources = g["sources"].select(F.col("id").alias("__s"), F.col("name").alias("__source"))
    classes = g["classes"].where(is_not_abstract(F.col("access_flags"))).select(F.col("id").alias("class_id"), F.col("name").alias("class"), F.col("source").alias("__s")).join(sources, "__s")
    rows = below.join(stubs, below["root"] == stubs["id"]).join(classes, "class_id").select("system_service_id", F.col("__source").alias("source"), to_dotted(F.col("class")).alias("class_name")).distinct()
    return rows.withColumn("id", stable_id(F.col("system_service_id"), F.col("source"), F.col("class_name"))).select(*INVENTORY["system_service_impls"].names)


def method_hashes(instructions: DataFrame) -> DataFrame:
    """(source, class, name, signature, hash): SHA-256 over arguments, return type, and operations with their operands in order, labels and
    registers left out; base64 without padding. Hashes compare only with hashes made here."""
    ops = F.array_sort(F.collect_list(F.struct("line", F.concat_ws(" ", "opcode", "operands").alias("op"))))
    rows = instructions.groupBy("source", "class", "method", "args", "ret").agg(F.array_join(F.transform(ops, lambda x: x["op"]), "\n").alias("code"))
    digest = F.unhex(F.sha2(F.concat_ws("\n", "args", "ret", "code"), 256))
    return rows.select("source", "class", F.col("method").alias("name"), F.col("args").alias("signature"), F.rtrim(F.base64(digest), F.lit("=")).alias("hash"))


def with_method_hashes(methods: DataFrame, impls: DataFrame, hashes: DataFrame) -> DataFrame:
    """Service methods with the hash of the first implementation's (the smallest by id) method of that name and signature."""
    first = impls.groupBy("system_service_id").agg(F.min_by(F.struct("source", "class_name"), "id").alias("i")).select("system_service_id", F.col("i.source").alias("source"), to_slashed(F.col("i.class_name")).alias("class"))
    h = hashes.join(first, ["source", "class"]).groupBy("system_service_id", "name", "signature").agg(F.min("hash").alias("__hash"))
    rows = methods.drop("method_hash").join(h, ["system_service_id", "name", "signature"], "left")
    return rows.withColumn("method_hash", F.col("__hash")).select(*INVENTORY["system_service_methods"].names)


def update_binder_availability(services: DataFrame, listed: DataFrame) -> DataFrame:
    """Services that the list(name, iface) shows with an interface give a binder."""
    seen = listed.where("coalesce(iface, '') <> ''").select("name", F.lit(True).alias("__seen")).distinct()
    code = F.when(F.col("__seen"), TRUE).otherwise(F.col("can_get_binder"))
    return services.join(seen, "name", "left").select("id", "name", "iface", code.cast("int").alias("can_get_binder"))


def replace_service(inv: dict[str, DataFrame], service_id: int, methods: DataFrame, impls: DataFrame | None = None, diffs: StoredDiffs | None = None) -> dict[str, DataFrame]:
    """inv with one service's methods (and implementations, if given) replaced, and its stored diffs, if given, made anew."""
    keep = F.col("system_service_id") != service_id
    own = F.col("system_service_id") == service_id
    out = dict(inv)
    out["system_service_methods"] = inv["system_service_methods"].where(keep).unionByName(methods.where(own))
    if impls is not None:
        out["system_service_impls"] = inv["system_service_impls"].where(keep).unionByName(impls.where(own))
    if diffs is not None:
        diffs.refresh(out, service=service_id)
    return out


_BY_APK = {"receivers": "apk_id", "services": "apk_id", "activities": "apk_id", "providers": "apk_id", "permissions": "source_apk_id", "apk_permissions": "apk_id"}


def replace_apk(inv: dict[str, DataFrame], rows: dict[str, DataFrame], apk_id: int, force: bool = False, diffs: StoredDiffs | None = None) -> dict[str, DataFrame]:
    """inv with one package's rows added; with force, those it has are replaced. Without, a known package is an error. The package's stored
    diffs, if given, are made anew."""
    if not force and not inv["apks"].where(F.col("id") == apk_id).isEmpty():
        raise ValueError(f"package {apk_id} is known; force replaces it")
    out = dict(inv)
    for table, column in {"apks": "id", **_BY_APK}.items():
        own = F.col(column) == apk_id
        kept = inv[table].where(~own)
        out[table] = kept.unionByName(rows[table].where(own).select(*kept.columns)) if table in rows else kept
    if diffs is not None:
        diffs.refresh(out, package=apk_id)
    return out


def build_inventory(manifests: DataFrame, paths: DataFrame, properties: DataFrame, listed: DataFrame, binders: DataFrame, constants: DataFrame, methods: DataFrame, g: dict[str, DataFrame] | None = None, hashes: DataFrame | None = None, installed: DataFrame | None = None, resources: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of one device's inventory. With resources(package, kind, name, value), the manifests are looked through for references once."""
    if resources is not None:
        manifests, _, _ = written(with_references(manifests, resources), "manifests")
    apks = build_apks(manifests, paths, installed)
    services = build_system_services(listed)
    inv = {
        "apks": apks.select(*INVENTORY["apks"].names),
        "receivers": build_components(manifests, apks, "receiver"),
        "activities": build_components(manifests, apks, "activity"),
        "services": build_services(manifests, apks, binders),
        "providers": build_providers(manifests, apks),
        "permissions": build_permissions(manifests, apks),
        "apk_permissions": build_uses_permissions(manifests, apks),
        "protected_broadcasts": build_protected_broadcasts(manifests),
        "device_properties": build_properties(properties),
        "system_services": services,
        "system_service_methods": build_service_methods(services, constants, methods),
    }
    if g is not None:
        inv["system_service_impls"] = build_service_impls(g, services)
        if hashes is not None:
            inv["system_service_methods"] = with_method_hashes(inv["system_service_methods"], inv["system_service_impls"], hashes)
    return inv


def rebuild_inventory(spark: SparkSession, inv: dict[str, DataFrame], path: str, force: bool = False) -> dict[str, DataFrame]:
    """Write an inventory as a snapshot: one that is there is an error, or, with force, replaced."""
    save_snapshot(inv, path, force)
    return open_snapshot(spark, path, list(inv))


def dedupe_framework_files(files: DataFrame, allow_vdex: bool = False) -> DataFrame:
    """files(path, base, failed) without repeats of a framework file: those found under one base folder with one name, the prefix boot- and
    the extension aside, are one; of them the first kind of FILE_KINDS that hasn't failed stays. Packages are told apart and stay if their
    name holds `framework`."""
    key = F.regexp_replace(F.regexp_replace(file_name(F.col("path")), "^boot-", ""), "\\.[^.]*$", "")
    kind = F.lower(extension(F.col("path")))
    rank = F.array_position(F.array(*(F.lit(k) for k in FILE_KINDS)), kind)
    rows = files.select("path", "failed", "base", key.alias("key"), kind.alias("kind"), rank.alias("rank"))
    apks = rows.where((F.col("kind") == "apk") & F.col("key").contains("framework")).select("path", "base", "key", "kind")
    rest = rows.where((F.col("rank") > 0) & ~F.coalesce("failed", F.lit(False)))
    if not allow_vdex:
        rest = rest.where("kind <> 'vdex'")
    best = rest.groupBy("base", "key").agg(F.min_by(F.struct("path", "kind"), F.struct("rank", "path")).alias("b"))
    return best.select("b.path", "base", "key", "b.kind").unionByName(apks)


def select_policy_files(files: DataFrame) -> DataFrame:
    """files(path) of policy sources: *.cil, without compatibility ones and those named by version numbers."""
    path = F.trim("path")
    return files.where(path.endswith(".cil") & ~path.endswith(".compat.cil") & ~path.rlike("[0-9]+\\.[0-9]\\.cil"))


def resolve_references(values: DataFrame, resources: DataFrame) -> DataFrame:
    """values(package, value) with `resolved`: @kind/name and @0x... are looked up in the package's resources(package, kind, name, id, value),
    again and again until nothing is left to look up; on a cycle, an unknown name or another package's, the text as it was. Arrays give a
    row each. A round follows every open reference by one step and ends, as no reference is followed twice on its way."""
    r = resources.select(F.col("package").alias("__p"), F.col("kind").alias("__k"), F.col("name").alias("__n"), F.lower("id").alias("__id"), F.col("value").alias("__v"))
    columns = ["package", "value", "resolved"]
    is_reference = F.coalesce(F.col("resolved").rlike("^@[^@]"), F.lit(False))
    rows = values.select("package", "value", F.col("value").alias("resolved"))
    done, left = rows.where(~is_reference), 1
    rows = rows.where(is_reference).withColumn("__seen", F.array().cast("array<string>"))
    while left:
        by_name = (F.col("package") == F.col("__p")) & (F.regexp_extract("resolved", "^@([^/]+)/", 1) == F.col("__k")) & (F.regexp_extract("resolved", "/(.+)$", 1) == F.col("__n"))
        by_id = (F.col("package") == F.col("__p")) & (F.lower(F.expr("substring(resolved, 2)")) == F.col("__id"))
        coded = F.col("resolved").rlike("^@0x")
        found = rows.where(~coded).join(r, by_name, "left").unionByName(rows.where(coded).join(r, by_id, "left"))
        lost = F.col("__v").isNull() | F.array_contains("__seen", F.col("__v"))
        found = found.select("package", "value", F.when(lost, F.col("value")).otherwise(F.col("__v")).alias("resolved"), F.array_append("__seen", F.col("resolved")).alias("__seen"), lost.alias("__lost"))
        open_ = is_reference & ~F.col("__lost")
        found, left, _ = written(found, "references", open_)
        done = done.unionByName(found.where(~open_).select(*columns))
        rows = found.where(open_).drop("__lost")
    return done.select(*columns)
