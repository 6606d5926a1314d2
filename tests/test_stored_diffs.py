"""Stored diffs after a replacement equal a full diff, and nobody else's files are touched."""

from pathlib import Path

from pyspark.sql import functions as F

from codelode.operators import diff as G
from codelode.operators import inventory_build as E
from codelode.plans.derive import tables
from codelode.plans.queries import both


def files(base):
    return {str(p.relative_to(base)): p.stat().st_mtime_ns for p in Path(base).rglob("*.parquet")}


def stored(spark, base, table):
    rows = spark.read.parquet(f"{base}/{table}")
    return sorted((tuple(r) for r in rows.select(*sorted(rows.columns)).collect()), key=repr)


def whole(inv, others, table):
    out = []
    for name, other in others.items():
        rows = G.owned(G.diff_all(inv, other, name), inv)[table]
        out += [tuple(r) for r in rows.select(*sorted(rows.columns)).collect()]
    return sorted(out, key=repr)


def test_refresh(spark, tmp_path):
    inv, other = both(tables(spark, "/root/testdata/sf0.001"))
    inv, others = dict(inv), {"emulator": other, "itself": dict(inv)}
    base = str(tmp_path / "diffs")
    diffs = G.StoredDiffs(base, others.__getitem__)
    for name in others:
        diffs.store(inv, name)
    assert G.recorded_sources(spark, base) == ["emulator", "itself"] and G.recorded_sources(spark, str(tmp_path / "none")) == []
    was = files(base)
    new = {"apks": inv["apks"], "receivers": inv["receivers"].withColumn("permission", F.lit("new"))}
    now = E.replace_apk(inv, new, 3, force=True, diffs=diffs)
    for table in ("apks", "receivers", "activities", "providers", "permissions"):
        assert stored(spark, base, table) == whole(now, others, table), table
    left = files(base)
    gone = {p for p in was if p not in left}
    assert gone and all("/owner=3/" in p and not p.startswith("system_") for p in gone)
    assert all("/owner=3/" in p for p in left if p not in was) and all(was[p] == t for p, t in left.items() if p in was)
    assert not any(p.startswith("activities/") and "/owner=3/" in p for p in left)

    service = inv["system_service_methods"].first().system_service_id
    now = E.replace_service(now, service, inv["system_service_methods"].where(F.col("system_service_id") == service).limit(1), diffs=diffs)
    assert stored(spark, base, "system_service_methods") == whole(now, others, "system_service_methods")
    after = files(base)
    assert all(f"/owner={service}/" in p and p.startswith("system_") for p in {*left, *after} if left.get(p) != after.get(p))


def test_owners_share_folders(spark, tmp_path, monkeypatch):
    """The number of files doesn't grow with that of owners, and a refresh leaves those alone that share the owner's folders."""
    monkeypatch.setattr(G, "OWNER_FOLDERS", 3)
    inv, other = both(tables(spark, "/root/testdata/sf0.001"))
    others = {"emulator": other, "itself": dict(inv)}
    base = str(tmp_path / "diffs")
    diffs = G.StoredDiffs(base, others.__getitem__)
    for name in others:
        diffs.store(inv, name)
    folders = [p for p in Path(base).rglob("owner=*")]
    assert len({p.name for p in folders}) == 3 and inv["apks"].count() > 3
    now = E.replace_apk(dict(inv), {"apks": inv["apks"], "receivers": inv["receivers"].withColumn("permission", F.lit("new"))}, 4, force=True, diffs=diffs)
    for table in ("apks", "receivers", "activities", "services", "providers", "permissions"):
        assert stored(spark, base, table) == whole(now, others, table), table


def test_negative_owner(spark, tmp_path):
    """Ids are hashes in a built inventory: a negative one is stored and replaced as any other."""
    inv, other = both(tables(spark, "/root/testdata/sf0.001"))
    inv = dict(inv) | {"apks": inv["apks"].withColumn("id", -F.col("id") - 100)}
    inv |= {t: inv[t].withColumn("apk_id", -F.col("apk_id") - 100) for t in ("receivers", "activities", "services", "providers")}
    others = {"emulator": other}
    diffs = G.StoredDiffs(str(tmp_path / "diffs"), others.__getitem__)
    diffs.store(inv, "emulator")
    now = E.replace_apk(inv, {"apks": inv["apks"], "receivers": inv["receivers"].withColumn("permission", F.lit("new"))}, -103, force=True, diffs=diffs)
    for table in ("apks", "receivers", "activities"):
        assert stored(spark, diffs.base, table) == whole(now, others, table), table
