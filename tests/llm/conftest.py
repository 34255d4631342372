import pytest


@pytest.fixture
def documents(spark):
    """A small table of documents from (doc_id, text) pairs, with columns whose names clash with internal ones."""

    def make(rows):
        extra = "key string, root string, row string, id string, n string, same string, bucket string, held_out string, score string, text_kept string"
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 10) for i, t in rows], schema)

    return make
