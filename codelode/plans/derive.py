"""The driver's tables read as a code graph and a device inventory. The SQL is the same for Spark and for the oracle."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "sources": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CASE WHEN r_regionkey = 0 THEN 'framework' ELSE lower(r_name) END AS name FROM region",
    "classes": "SELECT p_partkey AS id, concat('Lp/C', CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING), ';') AS name, CAST(CASE WHEN p_size <= 5 THEN 32770 WHEN p_size <= 10 THEN 1026 ELSE 2 END AS BIGINT) AS access_flags, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 + CAST(floor(p_partkey / 2.0) AS BIGINT) % 4 END AS BIGINT) AS source FROM part",
    "methods": "SELECT DISTINCT l.l_partkey * 10 + l.l_linenumber AS id, l.l_partkey AS class, concat('m', CAST(l.l_linenumber AS STRING)) AS name, CASE l.l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'I' ELSE 'Ljava/lang/String;I' END AS args, 'V' AS ret, CAST(2 AS BIGINT) AS access_flags, c.source AS source FROM lineitem l JOIN classes c ON c.id = l.l_partkey",
    "calls": "SELECT DISTINCT a.l_partkey * 10 + a.l_linenumber AS caller, b.l_partkey * 10 + b.l_linenumber AS callee, c.source AS source FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber % 7 + 1 JOIN classes c ON c.id = a.l_partkey WHERE a.l_partkey * 10 + a.l_linenumber <> b.l_partkey * 10 + b.l_linenumber",
    "supers": "SELECT CAST(floor(id / 2.0) AS BIGINT) AS parent, id AS child, source FROM classes WHERE id > 0",
    "interfaces": "SELECT CAST(p.p_size AS BIGINT) AS interface, p.p_partkey AS class, c.source AS source FROM part p JOIN classes c ON c.id = p.p_partkey WHERE p.p_partkey > 50 AND p.p_partkey % 5 = 0",
    "strings": "SELECT min(p.p_partkey) AS id, p.p_name AS string, c.source AS source FROM part p JOIN classes c ON c.id = p.p_partkey GROUP BY p.p_name, c.source",
    "method_strings": "SELECT DISTINCT s.id AS string, m.id AS method FROM methods m JOIN part p ON p.p_partkey = m.class JOIN strings s ON s.string = p.p_name AND s.source = m.source",
    "class_fields": "SELECT c.id * 2 + k.k AS id, c.id AS class, concat('f', CAST(k.k AS STRING)) AS name, CASE WHEN k.k = 0 THEN 'I' ELSE 'Ljava/lang/String;' END AS ty, CAST(2 AS BIGINT) AS access_flags FROM classes c CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k",
    "method_field_access": "SELECT DISTINCT l_suppkey * 2 + l_linenumber % 2 AS field, l_partkey * 10 + l_linenumber AS method, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS action FROM lineitem",
    "apks": "SELECT s_suppkey AS id, concat('app.s', CAST(s_suppkey AS STRING)) AS app_name, concat('S', CAST(s_suppkey AS STRING), '.apk') AS name, s_acctbal < 0 AS is_debuggable, s_nationkey % 4 = 0 AS is_priv, concat('/system/', CASE WHEN s_nationkey % 4 = 0 THEN 'priv-app' ELSE 'app' END, '/S', CAST(s_suppkey AS STRING), '.apk') AS device_path FROM supplier",
    "components": "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'receiver' WHEN 1 THEN 'service' WHEN 2 THEN 'activity' ELSE 'provider' END AS kind, concat('p.C', CAST(CAST(floor(c_custkey / 4.0) AS BIGINT) AS STRING)) AS class_name, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE concat('perm.N', CAST(c_nationkey AS STRING)) END AS permission, CASE WHEN c_custkey % 5 = 0 THEN concat('perm.N', CAST((c_nationkey + 1) % 25 AS STRING)) END AS read_permission, CASE WHEN c_custkey % 6 = 0 THEN concat('perm.N', CAST((c_nationkey + 2) % 25 AS STRING)) END AS write_permission, concat('auth', CAST(c_custkey AS STRING), ':auth', CAST(c_custkey + 1 AS STRING)) AS authorities, c_acctbal > 0 AS exported, c_custkey % 7 <> 0 AS enabled, CAST(c_custkey % 3 - 1 AS INT) AS returns_binder, c_custkey % (SELECT count(*) FROM supplier) AS apk_id FROM customer",
    "permissions": "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('perm.N', CAST(n_nationkey AS STRING)) AS name, CASE n_regionkey WHEN 0 THEN 'normal' WHEN 1 THEN 'normal|instant' WHEN 2 THEN 'signature' ELSE 'dangerous' END AS protection_level, n_nationkey % (SELECT count(*) FROM supplier) AS source_apk_id FROM nation",
    "apk_permissions": "SELECT DISTINCT concat('perm.N', CAST(l_partkey % 25 AS STRING)) AS name, l_suppkey AS apk_id FROM lineitem WHERE l_suppkey % 10 <> 9",
    "system_services": "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('svc.', lower(n_name)) AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE concat('p.I', CAST(n_nationkey AS STRING)) END AS iface, CAST(n_nationkey % 3 - 1 AS INT) AS can_get_binder FROM nation",
    "system_service_impls": "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS system_service_id, CASE WHEN s_suppkey % 2 = 0 THEN 'framework' ELSE concat('%system%app%S', CAST(s_suppkey AS STRING), '.apk') END AS source, concat('p.C', CAST(s_suppkey AS STRING)) AS class_name FROM supplier WHERE s_nationkey % 2 = 0",
    "system_service_methods": "SELECT p_partkey AS id, p_partkey % 25 AS system_service_id, CAST(floor(p_partkey / 25.0) AS BIGINT) + 1 AS transaction_id, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'ILjava/lang/String;' WHEN p_size % 3 = 1 THEN 'Lp/ICallback;Z' ELSE '' END AS signature, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'V' END AS return_type, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS method_hash FROM part",
    "device_properties": "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('ro.', lower(r_name), '.', CAST(n_nationkey AS STRING)) AS name, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey",
    "protected_broadcasts": "SELECT min(p_partkey) AS id, concat('action.', p_type, '.', p_brand) AS name FROM part GROUP BY p_type, p_brand",
    "fuzz_results": "SELECT event_id AS id, event_type AS service_name, concat('m', CAST(user_id % 20 AS STRING)) AS method_name, event_type = 'error' OR value < 10 AS exception_thrown, event_type = 'error' AS security_exception_thrown FROM events",
}
_SPLIT = {"receivers": "receiver", "activities": "activity", "services": "service", "providers": "provider"}
_COMPONENT = "id, class_name, permission, exported, enabled, apk_id"
for _table, _kind in _SPLIT.items():
    _columns = "id, class_name AS name, authorities, permission, read_permission, write_permission, exported, enabled, apk_id" if _table == "providers" else _COMPONENT + (", returns_binder" if _table == "services" else "")
    VIEWS[_table] = f"SELECT {_columns} FROM components WHERE kind = '{_kind}'"

GRAPH = ("sources", "classes", "methods", "calls", "supers", "interfaces", "strings", "method_strings", "class_fields", "method_field_access")
INVENTORY = ("apks", "receivers", "activities", "services", "providers", "permissions", "apk_permissions", "system_services", "system_service_impls", "system_service_methods", "device_properties", "protected_broadcasts", "fuzz_results")

#: Columns of the other snapshot that differ in every eleventh row it has.
_FLIPPED = ("exported", "enabled", "is_debuggable", "is_priv")
_CHANGED = ("permission", "read_permission", "write_permission", "protection_level", "method_hash")


def with_views(body: str) -> str:
    """Oracle SQL: all views before a query, which may add its own (a list that goes on) or start with SELECT."""
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body


def other_sql(table: str, columns: str) -> str:
    """The other snapshot of a view as SQL; columns: those that it has."""
    def one(c: str) -> str:
        if c == "id":
            return "id + 1000000 AS id"
        if c in _FLIPPED:
            return f"CASE WHEN id % 11 = 0 THEN NOT {c} ELSE {c} END AS {c}"
        return f"CASE WHEN id % 11 = 0 THEN concat({c}, '.x') ELSE {c} END AS {c}" if c in _CHANGED else c

    # concat skips nulls in one engine and not in the other, so a null stays null by its own test
    text = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL {one(c)[4:]}" if c in _CHANGED else one(c) for c in columns.split())
    return f"SELECT {text} FROM {table} WHERE id % 7 <> 0"


def other_snapshot(df: DataFrame) -> DataFrame:
    odd = F.col("id") % 11 == 0

    def one(c: str) -> Column:
        if c == "id":
            return (F.col("id") + 1_000_000).alias("id")
        if c in _FLIPPED:
            return F.when(odd, ~F.col(c)).otherwise(F.col(c)).alias(c)
        return F.when(odd, F.concat(c, F.lit(".x"))).otherwise(F.col(c)).alias(c) if c in _CHANGED else F.col(c)

    return df.where("id % 7 <> 0").select(*map(one, df.columns))


_USED = re.compile(r"\b(FROM|JOIN)\s+([a-z]\w*)")


class Tables(Mapping):
    """All base tables and views by name; each is read or derived when it is first used, and leaves no view in the session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in BASE else self.sql(VIEWS[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """A query over these tables, each named after FROM or JOIN."""
        used = {n for _, n in _USED.findall(text)}
        return self.spark.sql(_USED.sub(r"\1 {\2}", text), **{n: self[n] for n in used})

    def __iter__(self) -> Iterator[str]:
        return iter((*BASE, *VIEWS))

    def __len__(self) -> int:
        return len(BASE) + len(VIEWS)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = tables(spark, sf_dir)
    return {k: t[k] for k in GRAPH}


def inventory(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = tables(spark, sf_dir)
    return {k: t[k] for k in INVENTORY}


def named_facts(g: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph's tables joined back to names, with the source's id: what a build starts from."""
    c = g["classes"].select(F.col("id").alias("__c"), F.col("name").alias("__name"), F.col("source").alias("__source"))
    m = g["methods"].select(F.col("id").alias("__m"), F.col("class").alias("__c"), F.col("name").alias("__method"), F.col("args").alias("__args")).join(c, "__c")

    def class_of(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(c.select(F.col("__c").alias(column), F.col("__name").alias(name)), column)

    def method_of(df: DataFrame, column: str, prefix: str) -> DataFrame:
        return df.join(m.select(F.col("__m").alias(column), F.col("__name").alias(f"{prefix}_class"), F.col("__method").alias(f"{prefix}_name"), F.col("__args").alias(f"{prefix}_args"), F.col("__source").alias(f"{prefix}_source")), column)

    fields = class_of(g["class_fields"], "class", "field_class").select(F.col("id").alias("field"), "field_class", F.col("name").alias("field_name"), F.col("ty").alias("field_ty"))
    own_fields = g["class_fields"].join(c.select(F.col("__c").alias("class"), "__name", "__source"), "class")
    access = method_of(g["method_field_access"], "method", "method").join(fields, "field")
    strings = g["strings"].select(F.col("id").alias("string"), F.col("string").alias("__text"))
    return {
        "classes": g["classes"].select(F.col("name").alias("class"), F.col("access_flags").alias("flags"), "source"),
        "supers": class_of(class_of(g["supers"], "parent", "__p"), "child", "__k").select(F.col("__k").alias("child"), F.col("__p").alias("parent"), "source"),
        "interfaces": class_of(class_of(g["interfaces"], "interface", "__i"), "class", "__k").select(F.col("__k").alias("class"), F.col("__i").alias("interface"), "source"),
        "class_fields": own_fields.select(F.col("__name").alias("class"), "name", "ty", F.col("access_flags").alias("flags"), F.col("__source").alias("source")),
        "methods": class_of(g["methods"], "class", "__k").select(F.col("__k").alias("class"), "name", "args", "ret", F.col("access_flags").alias("flags"), "source"),
        "calls": method_of(method_of(g["calls"], "caller", "caller"), "callee", "callee").select("caller_class", "caller_name", "caller_args", "callee_class", "callee_name", "callee_args", "source"),
        "method_field_access": access.select("field_class", "field_name", "field_ty", "method_class", "method_name", "method_args", "action", F.col("method_source").alias("source")),
        "strings": g["strings"].select("string", "source"),
        "method_strings": method_of(g["method_strings"].join(strings, "string"), "method", "method").select(F.col("__text").alias("string"), F.col("method_name").alias("method"), F.col("method_args").alias("args"), F.col("method_class").alias("class"), F.col("method_source").alias("source")),
    }
