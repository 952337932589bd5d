"""What a new vector that visits many lists makes of a batch."""

import numpy as np

from lodewell.operators import matching


def test_visits_are_sent_in_pieces(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((1200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit[600:] @ unit[:600].T
    monkeypatch.setattr(matching, "_ROWS", 8)  # batches of 8 rows, pieces of 128 pairs
    found = matching.best_matches(df.where("id >= 600"), df.where("id < 600"), threshold=-1.0, block_rows=20).toPandas().sort_values("id")
    assert found["match"].tolist() == cos.argmax(axis=1).tolist()
    assert max(b.num_rows for b in matching._sliced(df.coalesce(1).toArrow().to_batches())) == 8
