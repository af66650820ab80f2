import random
import sys

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline

from . import brute


def test_pipeline_runs_and_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(400):
        own = rng.choices(words, k=60)
        if k % 8 == 0:
            own[5] = rng.choice(["vile", "awful"])
        rows.append((k, " ".join(own), "en", "s", 0))
        labels.append((k, 1, int(k % 8 == 0)))
    item = " ".join(rng.choices(words, k=20))
    passage = " ".join(rng.choices(words, k=60))
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[1][1] + " w1", "en", "s", 0), (1002, "lead " + item, "en", "s", 0)]
    rows += [(1003 + k, f"{passage} {' '.join(rng.choices(words, k=40))}", "en", "s", 0) for k in range(2)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {k for k, _, toxic in labels if not toxic}
    assert clean <= set(found) and not {0, 8, 16, 1000, 1001, 1002} & set(found)
    assert {1003, 1004, None} <= set(found)
    assert found[2]["decoded_sha256"] == brute.hex256(rows[2][1])
    assert found[1003]["decoded_sha256"] == brute.hex256(rows[-3][1].removeprefix(passage + " "))
    assert len(corpus_pipeline.STAGES) == 5 and "corpus_pipeline" in sys.modules
