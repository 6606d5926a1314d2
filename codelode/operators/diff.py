"""Snapshot diffs: this inventory against another, keyed by name. Of repeated keys on the other side the row with the largest id counts."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.expr import method_key, tri_from_bool
from codelode.plans.storage import delete, exists, file_system, together, written
from codelode.schema import UNKNOWN

EMULATOR = "emulator"
TABLES = ("system_services", "system_service_methods", "apks", "receivers", "activities", "services", "providers", "permissions")


def _latest(other: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the one with the largest id."""
    return other.groupBy(*keys).agg(F.max_by(F.struct(*other.columns), "id").alias("o"))


def _against(items: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """items with the other side's row as struct `o`, null where there is none."""
    o = _latest(other, [key]).withColumnRenamed(key, "__key")
    return items.join(o, items[key] == F.col("__key"), "left").drop("__key")


def _exists() -> Column:
    return F.col("o").isNotNull()


def diff_apks(items: DataFrame, other: DataFrame) -> DataFrame:
    return _against(items, other, "name").select(F.col("id").alias("item"), _exists().alias("exists_in_diff"))


def same_permissions(modes: list[tuple[Column, Column]]) -> Column:
    """Neither side requires any, or each mode's is the same."""
    return reduce(lambda a, b: a & b, (a.eqNullSafe(b) for a, b in modes))


def diff_components(items: DataFrame, other: DataFrame) -> DataFrame:
    """Receivers, services or activities; all false where the other side has none."""
    rows = _against(items, other, "class_name")
    no = F.lit(False)
    return rows.select(
        F.col("id").alias("item"), _exists().alias("exists_in_diff"), F.when(_exists(), F.col("exported").eqNullSafe(F.col("o.exported"))).otherwise(no).alias("exported_matches_diff"),
        F.when(_exists(), same_permissions([(F.col("permission"), F.col("o.permission"))])).otherwise(no).alias("permission_matches_diff"), F.col("o.permission").alias("diff_permission"),
    )


def diff_providers(items: DataFrame, other: DataFrame) -> DataFrame:
    rows = _against(items, other, "name")
    out = [F.col("id").alias("item"), _exists().alias("exists_in_diff"), F.when(_exists(), F.col("exported").eqNullSafe(F.col("o.exported"))).otherwise(F.lit(False)).alias("exported_matches_diff")]
    for mode in ("", "read_", "write_"):
        column = f"{mode}permission"
        out += [F.when(_exists(), F.col(column).eqNullSafe(F.col(f"o.{column}"))).otherwise(F.lit(False)).alias(f"{column}_matches_diff"), F.col(f"o.{column}").alias(f"diff_{column}")]
    return rows.select(*out)


def diff_services(items: DataFrame, other: DataFrame) -> DataFrame:
    return _against(items, other, "name").select(F.col("id").alias("item"), _exists().alias("exists_in_diff"))


def diff_service_methods(inv: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """Methods matched within the service of the same name by name, signature and return type; hashes compare with hashes, unknown if
    either is missing. Methods of a service that the other side hasn't got aren't there either."""
    def keyed(side: dict[str, DataFrame]) -> DataFrame:
        s = side["system_services"].select(F.col("id").alias("system_service_id"), F.col("name").alias("__service"))
        return side["system_service_methods"].join(s, "system_service_id").withColumn("__key", method_key(F.col("name"), F.col("signature"), F.col("return_type")))

    theirs = keyed(other).groupBy("__service", "__key").agg(F.max_by(F.struct("method_hash"), "id").alias("o"))
    rows = keyed(inv).join(theirs, ["__service", "__key"], "left")
    same = F.when(_exists(), tri_from_bool(F.col("method_hash") == F.col("o.method_hash"))).otherwise(UNKNOWN)
    return rows.select(F.col("id").alias("method"), _exists().alias("exists_in_diff"), same.cast("int").alias("hash_matches_diff"))


def diff_permissions(items: DataFrame, other: DataFrame) -> DataFrame:
    rows = _against(items, other, "name")
    same = F.when(_exists(), F.col("protection_level").eqNullSafe(F.col("o.protection_level"))).otherwise(F.lit(False))
    return rows.select(F.col("id").alias("permission"), _exists().alias("exists_in_diff"), same.alias("protection_level_matches_diff"), F.col("o.protection_level").alias("diff_protection_level"))


def pending(items: DataFrame, done: DataFrame, key: str = "item") -> DataFrame:
    """Items that have no diff row yet."""
    return items.join(done, items["id"] == done[key], "left_anti")


def unprotected_broadcasts(inv: dict[str, DataFrame], other: dict[str, DataFrame]) -> DataFrame:
    """Broadcasts protected there and not here."""
    return other["protected_broadcasts"].select("name").distinct().join(inv["protected_broadcasts"], "name", "left_anti")


def diff_all(inv: dict[str, DataFrame], other: dict[str, DataFrame], source: str, services: bool = True, apks: bool = True) -> dict[str, DataFrame]:
    """Every table's diff, with the name of the diff source; independent jobs."""
    out: dict[str, DataFrame] = {}
    if services:
        out |= {"system_services": diff_services(inv["system_services"], other["system_services"]), "system_service_methods": diff_service_methods(inv, other)}
    if apks:
        out |= {"apks": diff_apks(inv["apks"], other["apks"]), "providers": diff_providers(inv["providers"], other["providers"]), "permissions": diff_permissions(inv["permissions"], other["permissions"])}
        out |= {t: diff_components(inv[t], other[t]) for t in ("receivers", "activities", "services")}
        out["unprotected_broadcasts"] = unprotected_broadcasts(inv, other)
    return {k: df.withColumn("diff_source", F.lit(source)) for k, df in out.items()}


def add_diff_source(base: str, diffs: dict[str, DataFrame], name: str) -> None:
    """Write a source's diffs, a folder for each table and source, within it one for each of at most OWNER_FOLDERS groups of owners. If one fails, all that this call has written is taken away again, half
    written or whole; a source that is there is an error and stays."""
    begun = []

    def write(table: str) -> None:
        df, path = diffs[table], f"{base}/{table}/diff_source={name}"
        if exists(df.sparkSession, path):
            raise FileExistsError(f"{path} already exists")
        begun.append((df.sparkSession, path))
        rows = df.drop("diff_source")
        (rows.hint("rebalance", "owner").write.partitionBy("owner") if "owner" in rows.columns else rows.write).parquet(path)

    try:
        if diffs:
            together(next(iter(diffs.values())).sparkSession, {table: partial(write, table) for table in diffs})
    except BaseException:
        for spark, path in begun:
            delete(spark, path)
        raise


def remove_diff_source(spark: SparkSession, base: str, name: str, tables: tuple[str, ...] = (*TABLES, "unprotected_broadcasts")) -> None:
    for table in tables:
        delete(spark, f"{base}/{table}/diff_source={name}")


def list_diff_sources(spark: SparkSession, base: str, table: str = "apks") -> DataFrame:
    return spark.read.parquet(f"{base}/{table}").select("diff_source").distinct()


def resolve_diff_source(name: str | None = None) -> str:
    """The argument, else the environment's default, else the emulator."""
    return name or os.environ.get("CODELODE_DIFF_SOURCE") or EMULATOR


_KEYS = {"system_service_methods": "method", "permissions": "permission"}
#: The column of a table that says whose a row is: a package's or a service's.
PACKAGE_OWNERS = {"apks": "id", "receivers": "apk_id", "activities": "apk_id", "services": "apk_id", "providers": "apk_id", "permissions": "source_apk_id"}
SERVICE_OWNERS = {"system_services": "id", "system_service_methods": "system_service_id"}
#: Folders that the owners of a table share, so that the number of files doesn't grow with that of owners; up to so many owners with
#: ids in sequence have a folder each.
OWNER_FOLDERS = 32


def owner_folder(owner: Column) -> Column:
    return F.pmod(owner, F.lit(OWNER_FOLDERS).cast("long")).cast("int")


def owned(diffs: dict[str, DataFrame], inv: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Diffs of inv's tables with owned_by, the package's or service's id, and owner, the number of the folder that it shares; tables that
    nobody owns stay as they are."""
    out = dict(diffs)
    for table, column in (PACKAGE_OWNERS | SERVICE_OWNERS).items():
        if table in diffs:
            item = _KEYS.get(table, "item")
            owner = F.col(column).cast("long")
            out[table] = diffs[table].join(inv[table].select(F.col("id").alias(item), owner.alias("owned_by"), owner_folder(owner).alias("owner")), item)
    return out


def recorded_sources(spark: SparkSession, base: str) -> list[str]:
    """Names of the diff sources that have been written at base, by the names of their folders."""
    fs, p = file_system(spark, f"{base}/*/diff_source=*")
    return sorted({f.getPath().getName().partition("=")[2] for f in fs.globStatus(p) or ()})


@dataclass(frozen=True)
class StoredDiffs:
    """Diffs written by store_diffs() at base; others(name) opens the inventory that a source was compared with."""

    base: str
    others: Callable[[str], dict[str, DataFrame]]

    def store(self, inv: dict[str, DataFrame], name: str) -> None:
        """Add a source: every table's diff, in folders of owners; all or nothing."""
        add_diff_source(self.base, owned(diff_all(inv, self.others(name), name), inv), name)

    def refresh(self, inv: dict[str, DataFrame], package: int | None = None, service: int | None = None) -> None:
        """Make one package's or service's diffs anew against every source that is recorded; inv is the inventory as it is now.

        Only that owner's folders are written, with the rows of the owners that share them as they were, each replaced when its rows are
        there, or deleted if there are none; a refresh that failed half way is put right by another. A package's refresh leaves services
        alone, and a service's packages."""
        owners, owner = (PACKAGE_OWNERS, package) if service is None else (SERVICE_OWNERS, service)
        own = inv | {t: inv[t].where(F.col(c) == owner) for t, c in owners.items()}
        spark = inv["apks"].sparkSession
        for name in recorded_sources(spark, self.base):
            diffs = owned(diff_all(own, self.others(name), name, services=service is not None, apks=service is None), own)
            together(spark, {table: partial(self._replace, table, name, owner, diffs[table]) for table in owners})

    def _replace(self, table: str, name: str, owner: int, now: DataFrame) -> None:
        """One owner's rows of a table and source replaced, in the folder that it shares with others."""
        spark, folder = now.sparkSession, owner % OWNER_FOLDERS
        shared = f"{self.base}/{table}/diff_source={name}/owner={folder}"
        if exists(spark, shared):
            theirs = spark.read.schema(now.drop("diff_source", "owner").schema).parquet(shared).where(F.col("owned_by") != owner)
            now = now.unionByName(theirs.withColumns({"diff_source": F.lit(name), "owner": F.lit(folder)}))
        rows, n, path = written(now, "refreshed")
        if n:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("diff_source", "owner").parquet(f"{self.base}/{table}")
        else:
            delete(spark, shared)
        delete(spark, path)


def diffed(items: DataFrame, diffs: DataFrame, table: str = "", source: str | None = None, apk_id: int | None = None, service_id: int | None = None) -> DataFrame:
    """Items with their diff row, of one diff source, of one package or service."""
    d = diffs if source is None else diffs.where(F.col("diff_source") == source)
    d = d.withColumnRenamed(_KEYS.get(table, "item"), "__item")
    rows = items.join(d, items["id"] == F.col("__item")).drop("__item")
    if apk_id is not None:
        rows = rows.where(F.col("source_apk_id" if table == "permissions" else "apk_id") == apk_id)
    return rows if service_id is None else rows.where(F.col("system_service_id") == service_id)


def only_new(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("exists_in_diff"))
