"""Review views over a diff: predicates on rows that diff.diffed gives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.expr import any_of, has_class, is_binder_like, requires_no_permission, split_signature, tri_from_code
from codelode.schema import FALSE, TRUE


def review_components(rows: DataFrame) -> DataFrame:
    """New, enabled and exported."""
    return rows.where(~F.col("exists_in_diff") & F.col("enabled") & F.col("exported"))


def review_methods(rows: DataFrame, services: DataFrame) -> DataFrame:
    """Not in the diff, or surely changed; with the service's name and whether it gives a binder."""
    s = services.select(F.col("id").alias("system_service_id"), F.col("name").alias("service"), "can_get_binder")
    return rows.where(~F.col("exists_in_diff") | (tri_from_code(F.col("hash_matches_diff")) == FALSE)).join(s, "system_service_id")


def filter_methods(rows: DataFrame, service: str | None = None, new_only: bool = False, modified_only: bool = False, binder_available: bool = True) -> DataFrame:
    if service is not None:
        rows = rows.where(F.col("service") == service)
    if new_only:
        rows = rows.where(~F.col("exists_in_diff"))
    if modified_only:
        rows = rows.where(F.col("exists_in_diff") & (tri_from_code(F.col("hash_matches_diff")) != TRUE))
    return rows.where(tri_from_code(F.col("can_get_binder")) == TRUE) if binder_available else rows


def _modes(rows: DataFrame) -> list[str]:
    return [m for m in ("permission", "read_permission", "write_permission") if m in rows.columns]


def filter_components(rows: DataFrame, apk_id: int | None = None, no_permission: bool = False, normal: DataFrame | None = None) -> DataFrame:
    """normal(name): components of which some mode requires one of these permissions."""
    if apk_id is not None:
        rows = rows.where(F.col("apk_id") == apk_id)
    if no_permission:
        rows = rows.where(is_unprotected(rows))
    if normal is not None:
        names = normal.select(F.col("name").alias("__normal")).distinct()
        held = rows.select("id", F.explode(F.array(*_modes(rows))).alias("__normal")).join(names, "__normal", "left_semi").select("id")
        rows = rows.join(held, "id", "left_semi")
    return rows


def hide(rows: DataFrame, items: DataFrame | None = None, owners: DataFrame | None = None, owner: str = "apk_id") -> DataFrame:
    """rows without hidden items(id) and those of hidden packages or services owners(id)."""
    if items is not None:
        rows = rows.join(items.select("id"), "id", "left_anti")
    if owners is not None:
        rows = rows.join(owners.select(F.col("id").alias(owner)), owner, "left_anti")
    return rows


def read_hidden(spark, path: str) -> DataFrame:
    """(kind, id) of a saved state: JSON records {kind, ids}, one for each of the seven hidden sets."""
    return spark.read.schema("kind string, ids array<long>").json(path).select("kind", F.explode("ids").alias("id")).distinct()


def text_search(rows: DataFrame, display: Column, text: str) -> DataFrame:
    """Rows whose display text matches the expression or holds the text; one that isn't a valid expression is only looked for as text."""
    found = display.contains(text)
    try:
        re.compile(text)
    except re.error:
        return rows.where(found)
    return rows.where(found | display.rlike(text))


def signature_tag(signature: Column, ret: Column) -> Column:
    """binder where arguments or return type look like a binder's, class where the arguments hold a class, else null; ? stands for unknown."""
    def types(c: Column) -> Column:
        return F.coalesce(split_signature(F.when(F.coalesce(c, F.lit("?")) != "?", c)), F.array().cast("array<string>"))

    return F.when(any_of(is_binder_like(types(signature)), is_binder_like(types(ret))), "binder").when(has_class(types(signature)), "class")


def is_unprotected(rows: DataFrame) -> Column:
    return requires_no_permission(*(F.col(m) for m in _modes(rows)))


def present(owners: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """Packages or services that some row belongs to, for a pick list."""
    return owners.join(rows.select(F.col(owner).alias("id")), "id", "left_semi").select("id", "name").distinct()
