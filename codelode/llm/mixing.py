"""Operator 3: mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm import topics
from codelode.llm.common import WORD, materialize

#: What stands for every category that has no target, and for null.
OTHER = "(other)"
ROUNDS, TOLERANCE = 200, 1e-10
#: For each margin the wanted share of every category; None: as the square root of the share it has, within what the others leave.
Targets = Mapping[str, Mapping[str, float | None]]


def token_count(text: Column) -> Column:
    """Words of the text, which stand for its tokens where no other count is given; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights w >= 0 such that w * tokens, an array with one axis for each margin, has the target shares along every axis: the factors of
    one axis after another are scaled to its target until none changes. A category without tokens gives its share to the others."""
    weight = np.ones_like(tokens, float)
    total = tokens.sum()
    if not total:
        return weight
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(targets):
            now = (weight * tokens).sum(axis=tuple(i for i in range(tokens.ndim) if i != axis))
            there = now > 0
            want = np.where(there, target, 0.0)
            if not want.sum():
                continue
            want = want / want.sum() * total
            factor = np.divide(want, now, out=np.ones_like(now), where=there)
            worst = max(worst, float(np.abs(factor[there] - 1).max()))
            weight = np.where(tokens > 0, weight * factor.reshape([-1 if i == axis else 1 for i in range(tokens.ndim)]), 1.0)
        if worst < tolerance:
            break
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """Inclusion probabilities proportional to the weights, at most 1, that keep `share` of all tokens in expectation (all that can be kept, if that is less)."""
    want, p = share * tokens.sum(), np.zeros_like(weight)
    full = np.zeros(weight.shape, bool)
    free = (weight > 0) & (tokens > 0)
    while free.any():
        rest = want - tokens[full].sum()
        scale = max(0.0, rest) / (weight * tokens)[free].sum()
        over = free & (weight * scale >= 1)
        if not over.any():
            p[free] = weight[free] * scale
            break
        full |= over
        free &= ~over
    p[full] = 1.0
    p[(tokens == 0) & (weight > 0)] = 1.0
    return p


def _prepared(docs: DataFrame, targets: Targets, seed: int, topic: Column | None, tokens: Column | None) -> DataFrame:
    """(row, text, doc_id, __k0, __k1, ..., __n, __draw): the other columns of docs as a struct, so that none can clash with the categories of
    each margin, the number of tokens and the draw."""
    if "topic" in targets and topic is None and "topic" in docs.columns:
        topic = F.col("topic")
    fitted = "topic" in targets and topic is None
    own = {f"margin{i}": F.col(f"`{n}`") for i, n in enumerate(targets) if n != "topic"} | ({} if topic is None else {"given": topic}) | ({} if tokens is None else {"tokens": tokens})
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(row.alias("row"), "text", "doc_id", topics.lang_of(docs).alias("lang"), *(c.alias(n) for n, c in own.items()))
    words, subject = token_count(F.col("text")), F.col("given") if topic is not None else F.lit(None)
    if fitted:
        rows = topics.assigned(rows, topics.fit(rows, len(targets["topic"])))
        words, subject = F.col("__words"), F.col("__topic")
    category = lambda column, target: F.when(column.isin(list(target)), column).otherwise(OTHER) if target else F.lit(OTHER)
    columns = [category(subject if n == "topic" else F.col(f"margin{i}"), target).alias(f"__k{i}") for i, (n, target) in enumerate(targets.items())]
    n = words if tokens is None else F.coalesce("tokens", F.lit(0))
    return rows.select("row", "text", "doc_id", *columns, n.cast("long").alias("__n"), _draw(F.col("doc_id"), F.col("text"), seed).alias("__draw"))


def probabilities(prepared: DataFrame, targets: Targets, share: float) -> DataFrame:
    """A table (__c0, __c1, ..., __weight, __probability) with a row for each combination of categories that prepared(__k0, ..., __n) has.

    The combinations are at most the product of the targets' sizes plus one, which bounds what comes to the driver and what is broadcast;
    the token totals in them are one grouped sum over all documents, combined before the shuffle.
    """
    names = list(targets)
    found = prepared.groupBy(*(f"__k{i}" for i in range(len(names)))).agg(F.sum("__n").alias("__n")).collect()
    kinds = [[*targets[n], OTHER] for n in names]
    place = [{k: i for i, k in enumerate(kind)} for kind in kinds]
    tokens = np.zeros([len(k) for k in kinds])
    for row in found:
        tokens[tuple(place[i][row[i]] for i in range(len(names)))] += row["__n"]
    wanted = []
    for axis, n in enumerate(names):
        now = tokens.sum(axis=tuple(i for i in range(len(names)) if i != axis))
        natural = now[-1] / now.sum() if now.sum() else 0.0
        stated = np.array([np.nan if v is None else v for v in targets[n].values()], float)
        own = np.sqrt(now[:-1] / now.sum()) if now.sum() else np.ones(stated.size)
        free = np.isnan(stated)
        rest = max(0.0, 1 - np.nansum(stated)) * own / own[free].sum() if own[free].sum() else own * 0
        listed = np.where(free, rest, stated)
        wanted.append(np.r_[listed / listed.sum() * (1 - natural) if listed.sum() else listed, natural])
    weight = rake(tokens, wanted)
    chance = calibrate(tokens, weight, share)
    rows = [(*(kinds[i][k] for i, k in enumerate(at)), float(weight[at]), float(chance[at])) for at in (tuple(place[i][row[i]] for i in range(len(names))) for row in found)]
    schema = ", ".join([*(f"__c{i} string" for i in range(len(names))), "__weight double", "__probability double"])
    return prepared.sparkSession.createDataFrame(rows, schema)


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on doc_id (on the text, where that is null) and the seed alone."""
    key = F.coalesce(doc_id.cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 13), 16, 10).cast("double") / float(16**13)


def _weighted(prepared: DataFrame, targets: Targets, share: float) -> DataFrame:
    cells = probabilities(prepared, targets, share)
    return prepared.join(F.broadcast(cells), [F.col(f"__k{i}") == F.col(f"__c{i}") for i in range(len(targets))])


def mix(docs: DataFrame, targets: Targets, share: float, seed: int = 3, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, weight, probability, sampled) of every row of docs(doc_id, text, and a column for each margin).

    targets: for each margin (a column's name, or "topic") the wanted share of tokens by category, or None: the square root of the share
    it has, so that rare ones gain; unlisted categories and null together keep their natural share. Without a topic column, and no `topic` given, topics t0, t1, ... are fitted to the texts, as many as listed.
    tokens: a count of each row's tokens, as token_counts gives it; else its words. share: of all tokens, to be kept in expectation. weight
    is the raked one of the row's combination of categories; sampled is decided by a hash of doc_id, so runs agree and rows with equal
    doc_id and categories go together.

    Defined cases: null and blank texts have no tokens and no topic, and the probability of their combination (1 where it has no tokens at
    all); margins that cannot all be met are met as nearly as the last of ROUNDS rounds gives; texts of any length count whole; an empty
    table gives no rows; other columns are ignored. Texts are gone through once; categories and counts are written to the shared folder.
    """
    prepared = _prepared(docs, targets, seed, topic, tokens)
    prepared = materialize(prepared.select(F.col("doc_id").cast("long").alias("doc_id"), *(f"__k{i}" for i in range(len(targets))), "__n", "__draw"), "mix")
    return _weighted(prepared, targets, share).select("doc_id", F.col("__n").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__probability").alias("probability"), (F.col("__draw") < F.col("__probability")).alias("sampled"))


def sample(docs: DataFrame, targets: Targets, share: float, seed: int = 3, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """The rows of docs, all columns as they are and of whatever names, that mix() samples; cases as in mix()."""
    kept = _weighted(_prepared(docs, targets, seed, topic, tokens), targets, share).where("__draw < __probability")
    return kept.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
