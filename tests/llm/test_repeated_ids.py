"""Rows that share a doc_id and have different texts."""

import random

from codelode.llm import simhash

WORDS = [f"w{i}" for i in range(400)]


def test_representative_is_a_row_of_its_component(spark):
    r = random.Random(3)
    for flip in (False, True):
        rows = []
        for i in range(20):
            a, b = (" ".join(r.choices(WORDS, k=40)) for _ in range(2))
            two = [(100 * i + 5, a), (100 * i + 5, b)]
            rows += [(100 * i + 3, a), *(two[::-1] if flip else two)]
        kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        # the text near document 3 goes, and the one that is alone in its group stays
        assert sorted((x.doc_id, x.text) for x in kept) == sorted(x for i in range(20) for x in (rows[3 * i], rows[3 * i + (1 if flip else 2)]))
