import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, ids string, part int, id int, __part int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, source) rows, with further columns that clash with names in the operators."""

    def build(rows, partitions=3):
        rows = [(d, t, "en", s, None if t is None else len(t), "x", "y", 7, 8, 9) for d, t, s in rows]
        return spark.createDataFrame(rows, SCHEMA).repartition(1).coalesce(1) if partitions == 1 else spark.createDataFrame(rows, SCHEMA)

    return build
