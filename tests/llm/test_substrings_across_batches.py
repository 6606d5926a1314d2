"""Repeats of a doc_id whose rows fall into different batches."""

from codelode.llm import substring_dedup


def test_repeated_doc_ids_across_batches(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    for ids in ((7, 5), (5, 7)):
        one = [(i, f"{passage} {passage} end{i}") for i in ids]
        for third in (7, 5):
            rows = spark.sparkContext.parallelize([*one, (third, f"x y {passage} z"), (9, "a b")], 2)  # the third in another task than the first two
            got = {x.kept for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            assert got == {"a b", f"{passage} {passage} end5", "end7", "x y z" if third == 7 else f"x y {passage} z"}
