"""Interval labels of a hierarchy, kept with its graph: all that is below or above a class is then one range join, not a join a level.

Every node keeps its smallest parent; those edges make a forest. Each tree is walked round, down an edge, through all below it and up
again, and every step of the walk is given the number of downward steps from it to the walk's end, by pointer doubling (rounds by the
logarithm of the largest tree). What is below a node has numbers between those of the steps down to it and up from it.

Edges to further parents, and all edges of trees that hang from a cycle, are loose: they are followed one round at a time, with all that
is below their ends in a join, so that any graph gets what a closure gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.plans.storage import written

#: Numbers in a block: joins meet by tree and block, so a tree that holds most classes is dealt to many tasks.
BLOCK = 4096

#: The tables of a graph that get labels: the edges' upper and lower column.
LABELLED = {"supers": ("parent", "child"), "interfaces": ("interface", "class")}


def _with_next_sibling(kept: DataFrame) -> DataFrame:
    """kept(parent, child) with `sibling`, the next larger child of the same parent. Rows are sorted in ranges of both columns, so the
    children of one parent may fill many tasks; one row a range meets in a task, to find what follows its last row."""
    ordered, _, _ = written(kept.repartitionByRange("parent", "child").select("parent", "child", F.spark_partition_id().alias("range")), "siblings")
    ends = ordered.groupBy("range").agg(F.min(F.struct("parent", "child")).alias("start"))
    after = ends.select("range", F.lead("start").over(Window.orderBy("range")).alias("after"))
    following = F.lead(F.struct("parent", "child")).over(Window.partitionBy("range").orderBy("parent", "child"))
    rows = ordered.withColumn("following", following).join(after, "range").withColumn("following", F.coalesce("following", "after"))
    return rows.select("parent", "child", F.when(F.col("following.parent") == F.col("parent"), F.col("following.child")).alias("sibling"))


def _steps(kept: DataFrame) -> DataFrame:
    """(node, up, to_node, to_up, n, tree): the walks' steps, each with the one that follows; the last one of a tree knows its root."""
    rows, _, _ = written(_with_next_sibling(kept), "siblings")
    first = rows.groupBy("parent").agg(F.min("child").alias("to_node")).withColumnRenamed("parent", "child")
    none = F.lit(None).cast("long")
    step = lambda up, to, to_up, tree=none: (F.col("child").alias("node"), F.lit(up).alias("up"), to.alias("to_node"), to_up.alias("to_up"), F.lit(0 if up else 1).cast("long").alias("n"), tree.alias("tree"))
    down = rows.join(first, "child", "left").select(*step(False, F.coalesce("to_node", "child"), F.col("to_node").isNull()))
    along = rows.where("sibling is not null").select(*step(True, F.col("sibling"), F.lit(False)))
    # one last child a parent, so that no parent is hot here
    upper = rows.select(F.col("child").alias("parent"), F.lit(True).alias("inner"))
    last = rows.where("sibling is null").join(upper, "parent", "left")
    back = last.select(*step(True, F.when(F.col("inner"), F.col("parent")), F.when(F.col("inner"), F.lit(True)), F.when(F.col("inner").isNull(), F.col("parent"))))
    return down.unionByName(along).unionByName(back)


def interval_labels(edges: DataFrame, parent: str, child: str) -> tuple[DataFrame, DataFrame]:
    """labels(id, tree, first, last, block) of all nodes of the forest, and its loose edges(parent, child).

    A node x is below y if they share a tree and y.last < x.first < y.first. Rows with a null end and repeats count for nothing; no edges
    give two empty tables."""
    pairs = edges.select(F.col(parent).cast("long").alias("parent"), F.col(child).cast("long").alias("child")).dropna().distinct()
    pairs, _, _ = written(pairs, "edges")
    kept = pairs.where("parent <> child").groupBy("child").agg(F.min("parent").alias("parent")).select("parent", "child")
    kept, _, _ = written(kept, "forest")
    open_ = F.col("to_node").isNotNull()
    steps, left, _ = written(_steps(kept), "steps", open_)
    while left:
        ahead = steps.select(F.col("node").alias("to_node"), F.col("up").alias("to_up"), F.col("to_node").alias("next_node"), F.col("to_up").alias("next_up"), F.col("n").alias("more"), F.col("tree").alias("next_tree"))
        moved = steps.where(open_).join(ahead, ["to_node", "to_up"])
        moved = moved.select("node", "up", F.col("next_node").alias("to_node"), F.col("next_up").alias("to_up"), (F.col("n") + F.col("more")).alias("n"), F.col("next_tree").alias("tree"))
        before = left
        steps, left, _ = written(moved.unionByName(steps.where(~open_)), "steps", open_)
        if left == before:  # every walk that ends gets nearer to its end: these go round a cycle
            break
    ended = steps.where(~open_)
    nodes = ended.groupBy(F.col("node").alias("id")).agg(F.max("tree").alias("tree"), F.max(F.when(~F.col("up"), F.col("n"))).alias("first"), F.max(F.when(F.col("up"), F.col("n"))).alias("last"))
    roots = ended.where(F.col("up")).groupBy("tree").agg((F.count("*") + 1).alias("first")).select(F.col("tree").alias("id"), "tree", "first", F.lit(0).cast("long").alias("last"))
    labels = nodes.unionByName(roots).withColumn("block", F.expr(f"first div {BLOCK}"))
    labels, _, _ = written(labels.repartitionByRange("tree", "first").sortWithinPartitions("tree", "first"), "labels")
    forest = kept.join(labels.select(F.col("id").alias("child")), "child", "left_semi")
    loose, _, _ = written(pairs.join(forest, ["parent", "child"], "left_anti"), "loose")
    return labels, loose


def with_labels(g: dict[str, DataFrame], *tables: str) -> dict[str, DataFrame]:
    """The graph with the labels and loose edges of its inheritance (`supers` and `interfaces`, or one of them), which D3 to D5 and E15 then use."""
    out = dict(g)
    for table in tables or LABELLED:
        out[f"{table}_labels"], out[f"{table}_loose"] = interval_labels(g[table], *LABELLED[table])
    return out


def _blocks(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BLOCK).cast("long"), F.floor(high / BLOCK).cast("long"))).alias("block")


def _within(labels: DataFrame, seeds: DataFrame, keys: list[str], down: bool) -> DataFrame:
    """All that is below (above) the seeds in the forest. The wider side of a pair, the upper node, is there once a block that it spans."""
    marked = seeds.join(labels, "id").select(*keys, "tree", "first", "last", "block")
    spans = F.col("first") - F.col("last") > 1
    x = marked.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("tree").alias("__tree"), F.col("first").alias("__first"), F.col("last").alias("__last"), F.col("block").alias("__block"))
    if down:
        x = x.where(F.col("__first") - F.col("__last") > 1).select("*", _blocks(F.col("__last") + 1, F.col("__first") - 1)).drop("__block").withColumnRenamed("block", "__block")
        inside = (F.col("first") > F.col("__last")) & (F.col("first") < F.col("__first"))
    else:
        labels = labels.where(spans).select("id", "tree", "first", "last", _blocks(F.col("last") + 1, F.col("first") - 1))
        inside = (F.col("last") < F.col("__first")) & (F.col("first") > F.col("__first"))
    rows = x.join(labels, (F.col("__tree") == F.col("tree")) & (F.col("__block") == F.col("block")) & inside)
    return rows.select(*(F.col(f"__{k}").alias(k) for k in keys), "id").distinct()


def related(labels: DataFrame, loose: DataFrame, seeds: DataFrame, down: bool, *keys: str) -> DataFrame:
    """(*keys, id): all that is below (down) or above the seeds(*keys, id), for each combination of keys, as `reached` gives it: seeds
    themselves only where a cycle leads back to them. One join where no edge is loose, else one a round of loose edges: of the seeds, or,
    where these are more, of the loose edges' ends, as what lies beyond an end is the same for all seeds."""
    seeds = seeds.select(*(F.col(k) for k in keys), F.col("id").cast("long").alias("id")).distinct()
    if loose.isEmpty():
        return _within(labels, seeds, list(keys), down)
    tip, end = ("parent", "child") if down else ("child", "parent")
    hops = loose.select(F.col(tip).alias("__tip"), F.col(end).alias("id"))
    ends, many, _ = written(hops.select(F.col("id").alias("__end"), "id").distinct(), "ends")
    if seeds.count() <= many:
        return _followed(labels, hops, seeds, down, *keys)
    beyond = _followed(labels, hops, ends, down, "__end").unionByName(ends)
    inside, _, _ = written(_within(labels, seeds, list(keys), down), "related")
    first = seeds.unionByName(inside).withColumnRenamed("id", "__tip").join(hops, "__tip").select(*keys, F.col("id").alias("__end")).distinct()
    return inside.unionByName(first.join(beyond, "__end").select(*keys, "id")).distinct()


def _followed(labels: DataFrame, hops: DataFrame, seeds: DataFrame, down: bool, *keys: str) -> DataFrame:
    """related() by rounds: loose edges hops(__tip, id) from all that is reached, and all that is below or above their ends."""
    columns, spark = [*keys, "id"], seeds.sparkSession
    front, files = seeds, []

    def fresh(rows: DataFrame, what: str) -> tuple[DataFrame, int]:
        if files:
            rows = rows.join(spark.read.schema(seeds.schema).parquet(*files), columns, "left_anti")
        rows, found, path = written(rows, what)
        files.append(path)
        return rows, found

    found = 1
    while found:
        new, _ = fresh(_within(labels, front, list(keys), down), "related")
        tips = front.unionByName(new).withColumnRenamed("id", "__tip")
        front, found = fresh(tips.join(hops, "__tip").select(*columns).distinct(), "related")
    return spark.read.schema(seeds.schema).parquet(*files)
