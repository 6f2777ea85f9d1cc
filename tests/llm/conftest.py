import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes lists of rows as the tables of a folder."""

    def write(**rows):
        at = tmp_path_factory.mktemp("tables")
        schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string"}
        for name, values in rows.items():
            spark.createDataFrame(values, schemas[name]).coalesce(2).write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return write


def doc(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text))
