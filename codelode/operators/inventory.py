"""Inventory lookups over a device inventory inv, a dict of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.expr import authorities, from_manifest_name, ilike_pattern, package_of, squash, to_slashed, tri_from_code, tri_true_or_unknown
from codelode.operators.traversal import NotFound
from codelode.schema import FRAMEWORK, TRUE, UNKNOWN

Inventory = dict[str, DataFrame]


def one(df: DataFrame) -> DataFrame:
    """df, which must have a row."""
    if df.isEmpty():
        raise NotFound("no such row")
    return df


def get_all(inv: Inventory, table: str) -> DataFrame:
    return inv[table]


def get_by_id(inv: Inventory, table: str, id_: int) -> DataFrame:
    return one(inv[table].where(F.col("id") == id_))


def _like(column: str, pattern: str) -> Column:
    return F.col(column).ilike(ilike_pattern(pattern))


def property_by_name(inv: Inventory, name: str) -> DataFrame:
    return inv["device_properties"].where(F.col("name") == name)


def properties_like(inv: Inventory, pattern: str) -> DataFrame:
    return inv["device_properties"].where(_like("name", pattern))


def apk_by(inv: Inventory, column: str, value: str) -> DataFrame:
    """column: app_name, name (the file's) or device_path."""
    return inv["apks"].where(F.col(column) == value)


def debuggable_apks(inv: Inventory) -> DataFrame:
    return inv["apks"].where("is_debuggable")


def _permissions(inv: Inventory) -> DataFrame:
    a = inv["apks"].select(F.col("id").alias("source_apk_id"), F.col("app_name").alias("source_app"))
    return inv["permissions"].join(a, "source_apk_id").select("id", "name", "protection_level", "source_apk_id", "source_app")


def permission_by_name(inv: Inventory, name: str) -> DataFrame:
    return inv["permissions"].where(F.col("name") == name)


def permissions_by_apk(inv: Inventory, apk_id: int) -> DataFrame:
    return inv["permissions"].where(F.col("source_apk_id") == apk_id)


def permissions_like(inv: Inventory, pattern: str) -> DataFrame:
    return _permissions(inv).where(_like("name", pattern))


def normal_permissions(inv: Inventory) -> DataFrame:
    return inv["permissions"].where(_like("protection_level", "%normal%"))


def usable_app_permissions(inv: Inventory) -> DataFrame:
    return normal_permissions(inv).select("name").distinct()


def service_by_name(inv: Inventory, name: str) -> DataFrame:
    return inv["system_services"].where(F.col("name") == name)


def services_like(inv: Inventory, pattern: str) -> DataFrame:
    return inv["system_services"].where(_like("name", pattern))


def impls_of(inv: Inventory, service_id: int) -> DataFrame:
    return inv["system_service_impls"].where(F.col("system_service_id") == service_id)


def impls_by_service(inv: Inventory) -> DataFrame:
    """(name, impls): every service that has any, with the sorted list of source and class."""
    s = inv["system_services"].select(F.col("id").alias("system_service_id"), "name")
    rows = inv["system_service_impls"].join(s, "system_service_id")
    return rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("source", "class_name"))).alias("impls"))


def service_methods(inv: Inventory, service_id: int | None = None) -> DataFrame:
    """Methods by service in the order of their transactions; an unknown signature or return type shows as ?."""
    rows = inv["system_service_methods"] if service_id is None else inv["system_service_methods"].where(F.col("system_service_id") == service_id)
    rows = rows.select("id", "system_service_id", "transaction_id", "name", F.coalesce("signature", F.lit("?")).alias("signature"), F.coalesce("return_type", F.lit("?")).alias("return_type"))
    return rows.orderBy("system_service_id", "transaction_id", "id")


def components_by_apk(inv: Inventory, table: str, apk_id: int) -> DataFrame:
    return inv[table].where(F.col("apk_id") == apk_id)


def providers_with_authority(inv: Inventory, authority: str) -> DataFrame:
    """Providers that have the authority as one of their list; the one with the smallest id comes first."""
    return inv["providers"].where(F.array_contains(authorities(F.col("authorities")), authority)).orderBy("id")


def apk_permissions(inv: Inventory, apk_id: int) -> DataFrame:
    return inv["apk_permissions"].where(F.col("apk_id") == apk_id).select("name")


def apks_with_permissions(inv: Inventory) -> DataFrame:
    """apks with the sorted list of the permissions they request, which may be empty."""
    lists = inv["apk_permissions"].groupBy("apk_id").agg(F.array_sort(F.collect_list("name")).alias("permissions")).withColumnRenamed("apk_id", "id")
    return inv["apks"].join(lists, "id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))


def protected_broadcasts_like(inv: Inventory, text: str) -> DataFrame:
    return inv["protected_broadcasts"].where(_like("name", f"%{text}%"))


def probe_results(inv: Inventory, security: bool) -> DataFrame:
    return inv["fuzz_results"].where(F.col("security_exception_thrown") == security)


def unprotected_endpoints(inv: Inventory) -> DataFrame:
    return probe_results(inv, False).select("service_name", "method_name").distinct()


def list_apks(inv: Inventory, only_privileged: bool = False) -> DataFrame:
    rows = inv["apks"].where("is_priv") if only_privileged else inv["apks"]
    return rows.select("app_name", "name", "device_path")


def list_services(inv: Inventory, only_accessible: bool = False, with_impls: bool | None = None, methods: bool = False) -> DataFrame:
    """Services: accessible ones (a binder known to be refused is out, an unknown one needs an interface), with or without implementations,
    and with their methods as a list in the order of transactions."""
    rows = inv["system_services"]
    if only_accessible:
        code = tri_from_code(F.col("can_get_binder"))
        rows = rows.where((code == TRUE) | ((code == UNKNOWN) & F.col("iface").isNotNull()))
    if with_impls is not None:
        i = inv["system_service_impls"].select(F.col("system_service_id").alias("id")).distinct()
        rows = rows.join(i, "id", "left_semi" if with_impls else "left_anti")
    if methods:
        m = inv["system_service_methods"].groupBy(F.col("system_service_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("transaction_id", "name", "signature", "return_type"))).alias("methods"))
        rows = rows.join(m, "id", "left")
    return rows


def list_components(rows: DataFrame, public: bool = False, enabled: bool = False, new: bool = False, returns_binder: bool = False) -> DataFrame:
    """Independent filters; `new` needs a diff's exists_in_diff, returns_binder keeps services that may give one."""
    for wanted, test in ((public, F.col("exported") if public else None), (enabled, F.col("enabled") if enabled else None), (new, ~F.col("exists_in_diff") if new else None), (returns_binder, tri_true_or_unknown(F.col("returns_binder")) if returns_binder else None)):
        rows = rows.where(test) if wanted else rows
    return rows


def component_records(inv: Inventory, table: str) -> DataFrame:
    """(id, source, package, class, exported, enabled, permission[, authorities, read_permission, write_permission]) of components.

    source is the framework for the package `android`, else the squashed path; the package is the class's own, else the app's name, with
    which a class name that starts with a dot is completed."""
    name = "name" if table == "providers" else "class_name"
    a = inv["apks"].select(F.col("id").alias("apk_id"), "app_name", "device_path")
    rows = inv[table].join(a, "apk_id")
    cls = from_manifest_name(F.col("app_name"), F.col(name))
    package = F.when(package_of(F.col(name)) != "", package_of(F.col(name))).otherwise(F.col("app_name"))
    source = F.when(F.col("app_name") == "android", FRAMEWORK).otherwise(squash(F.col("device_path")))
    more = [authorities(F.col("authorities")).alias("authorities"), F.col("read_permission"), F.col("write_permission")] if table == "providers" else []
    return rows.select("id", source.alias("source"), package.alias("package"), cls.alias("class"), "exported", "enabled", "permission", *more)


def service_classes(inv: Inventory, name: str) -> DataFrame:
    """(role, class) of a service: implementations, interface, its Stub and the Stub's Proxy, as class files spell them."""
    s = one(service_by_name(inv, name))
    impl = inv["system_service_impls"].join(s.select(F.col("id").alias("system_service_id")), "system_service_id", "left_semi").select(F.lit("impl").alias("role"), to_slashed(F.col("class_name")).alias("class"))
    iface = s.where("iface is not null").select(F.explode(F.array(*(F.struct(F.lit(r).alias("role"), to_slashed(F.concat(F.col("iface"), F.lit(e))).alias("class")) for r, e in (("interface", ""), ("stub", "$Stub"), ("proxy", "$Stub$Proxy"))))).alias("x")).select("x.role", "x.class")
    return impl.unionByName(iface)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def update(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those with their id."""
    return table.join(rows, "id", "left_semi").select("id").join(rows, "id").select(*table.columns).unionByName(table.join(rows, "id", "left_anti").select(*table.columns))


def delete_by(table: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """table without rows whose column is in the first column of values."""
    v = values.select(F.col(values.columns[0]).alias("__v"))
    return table.join(v, table[column] == F.col("__v"), "left_anti")
