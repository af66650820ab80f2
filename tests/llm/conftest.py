import uuid

import pytest


@pytest.fixture()
def stored(spark, tmp_path):
    """Rows as a stored table, which the operators read by scan."""

    def put(rows, schema):
        path = f"file://{tmp_path}/{uuid.uuid4().hex}"
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return put


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(stored):
    def put(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return stored([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)

    return put
