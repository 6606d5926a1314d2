"""The topic margin of a mix."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codelode.llm import mixing, topics
from codelode.llm.wordhash import word_hashes

TARGETS = {"lang": {"en": 1.0}, "topic": {"law": 0.8, "art": 0.2}}


def test_topic_column_is_raked(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(1, 9)), "en", r.choice(["law", "art", "art", "art"])) for i in range(400)] + [(900, "w w", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, topic string")
    for df, topic in ((docs, None), (docs.withColumnRenamed("topic", "kind"), F.col("kind"))):
        got = {x.doc_id: x for x in mixing.mix(df, TARGETS, 0.3, topic=topic).collect()}
        mass = {t: sum(got[i].weight * got[i].n_tokens for i, _, _, k in rows if k == t) for t in ("law", "art")}
        assert len(got) == len(rows) and abs(mass["law"] / sum(mass.values()) - 0.8) < 1e-6
        kept = mixing.sample(df, TARGETS, 0.3, topic=topic)
        assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.sampled}


def test_topics_are_of_the_words(spark):
    r = random.Random(2)
    fields = {"law": [f"law{i}" for i in range(30)], "art": [f"art{i}" for i in range(30)], "sea": [f"sea{i}" for i in range(30)]}
    kinds = [r.choice(list(fields)) for _ in range(300)]
    rows = [(i, " ".join(r.choices(fields[k], k=40)), "en") for i, k in enumerate(kinds)]
    rows += [(1000, "", "en"), (1001, None, None), (1002, " ", "zz"), (1003, " ".join(r.choices(fields["law"], k=30_000)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = topics.fit(docs, 3)
    got = {x.doc_id: x for x in topics.assigned(docs, model).collect()}
    of = {k: Counter(got[i]["__topic"] for i, x in enumerate(kinds) if x == k).most_common(1)[0] for k in fields}
    assert len({t for t, _ in of.values()}) == 3 and sum(n for _, n in of.values()) >= 290
    assert [got[i]["__topic"] for i in (1000, 1001, 1002)] == [None] * 3 and got[1003]["__topic"] == of["law"][0] and got[1003]["__words"] == 30_000
    mixed = {x.doc_id: x for x in mixing.mix(docs, {"topic": {f"t{i}": v for i, v in enumerate((0.6, None, None))}}, 0.5).collect()}
    mass = Counter()
    for i, x in mixed.items():
        mass[got[i]["__topic"]] += x.weight * x.n_tokens
    tokens = Counter()
    for i, x in got.items():
        tokens[x["__topic"]] += x["__words"]
    assert abs(mass["t0"] / sum(mass.values()) - 0.6) < 1e-6 and abs(mass["t1"] / mass["t2"] - (tokens["t1"] / tokens["t2"]) ** 0.5) < 1e-6
    few = topics.fit(docs, 3, sample=50)
    assert len(few.centres) == 3 and topics.assigned(docs.limit(0), topics.fit(docs.limit(0), 3)).count() == 0


def test_mix_against_raking_by_rows(spark):
    """Weights from their definition: rows' weights scaled by one margin after another, in plain Python, until all margins are met."""
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["en", "en", "de"]), r.choice(["law", "art"]), r.choice(["a", "b", "b"])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, topic string, source string")
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.2, "de": 0.8}, "topic": {"law": 0.9, "art": 0.1}}
    weight, n, column = {i: 1.0 for i, *_ in rows}, {x[0]: len(x[1].split()) for x in rows}, {"lang": 2, "topic": 3, "source": 4}
    total = sum(n.values())
    for _ in range(300):
        for margin, want in targets.items():
            now = Counter()
            for x in rows:
                now[x[column[margin]]] += weight[x[0]] * n[x[0]]
            for x in rows:
                weight[x[0]] *= want[x[column[margin]]] * total / now[x[column[margin]]]
    got = {x.doc_id: x for x in mixing.mix(docs, targets, 0.3).collect()}
    assert all(abs(got[i].weight - w) < 1e-6 * w for i, w in weight.items())
    low, high = 0.0, 1e6
    for _ in range(200):  # the factor at which probabilities, at most 1, keep the share
        mid = (low + high) / 2
        kept = sum(min(1.0, mid * weight[i]) * n[i] for i in n)
        low, high = (mid, high) if kept < 0.3 * total else (low, mid)
    assert all(abs(got[i].probability - min(1.0, low * weight[i])) < 1e-6 for i in n if n[i])
    doubled = mixing.mix(docs, targets, 0.3, tokens=2 * F.length("source")).collect()
    assert {x.n_tokens for x in doubled} == {2}


def test_margins_that_cannot_be_met_end(spark):
    rows = [(i, "w w", "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(40)]  # the margins are one and the same
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, {"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.2, "b": 0.8}}, 0.5).collect()
    assert len(got) == 40 and all(0 <= x.probability <= 1 for x in got)
    assert abs(sum(x.probability for x in got) / 40 - 0.5) < 1e-9


def test_all_documents_count(spark):
    """Means and centres are those of all documents, not of the sample that the first centres come from."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choices([f"{'ab'[i % 2]}{j}" for j in range(20)], k=30)), "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = topics.fit(docs, 2, sample=40)
    x = np.stack([topics.features(word_hashes(t.encode(), lower=True)) for _, t, _ in rows])
    assert np.abs(model.means["en"] - x.mean(axis=0)).max() < 1e-4
    own = model.of(x, ["en"] * len(x))
    for k in range(2):
        assert np.abs(model.centres[k] - (x[own == k] - x.mean(axis=0)).mean(axis=0)).max() < 1e-3
