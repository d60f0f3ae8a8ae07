"""keep_one: groups without an identifier, or with a repeated one, are groups of their own."""

from retailforge.llm import common, jaccard
from tests.conftest import spark  # noqa: F811,F401


def words(k):
    return " ".join(f"{chr(97 + k)}{i}" for i in range(40))


def test_unrelated_texts_stay_without_or_under_one_identifier(spark):  # noqa: F811
    common.prepare(spark)
    rows = [(None, words(0)), (None, words(1)), (None, words(2)), (None, words(2) + " more"), (7, words(3)), (7, words(4)), (7, words(4)),
            (None, words(5)), (9, words(5) + " !"), (8, words(5)), (None, "..."), (None, None), (1, words(6))]
    got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    near = [(None, words(2)), (None, words(2) + " more")]
    assert sum(r in near for r in got) == 1
    assert sorted((r for r in got if r not in near), key=str) == sorted(
        [(None, words(0)), (None, words(1)), (7, words(3)), (7, words(4)), (8, words(5)), (None, "..."), (None, None), (1, words(6))], key=str)
