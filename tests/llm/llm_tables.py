import pytest

LONG = "lorem " * 60_000


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) rows, with columns whose names an operator might use itself."""

    def build(rows, partitions=3):
        full = [(i, t, "en", None if t is None else f"src{len(t) % 3}", None, 7, "clash") for i, t in rows]
        schema = "id_ long, text string, lang string, source string, n_chars long, score int, tree string"
        return spark.createDataFrame(full, schema).withColumnRenamed("id_", "doc_id").repartition(partitions)

    return build


EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "Ünïcode Σίγμα 漢字 🎉 end"), (7, LONG), (7, LONG), (8, "a" * 50_000), (None, "no id here at all")]


@pytest.fixture(scope="session")
def edges():
    return EDGES
