"""The nearest of vectors that sums of codewords tell badly apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.llm import additive

_RNG = np.random.default_rng(5)
_N = 20_000  # more than the codebooks are fitted on
_HEAVY = _RNG.standard_normal((_N, 32)) * _RNG.lognormal(0, 2, (_N, 1))
_TIGHT = _RNG.standard_normal((3, 32))[np.arange(_N) % 3] + 1e-5 * _RNG.standard_normal((_N, 32))
_RARE = np.where(np.arange(_N)[:, None] % 97 == 7, 50, 1) * _RNG.standard_normal((_N, 32))


@pytest.mark.parametrize("x", [_HEAVY, _TIGHT, _RARE, _HEAVY * 1e100], ids=["norms", "tight", "outliers", "large"])
def test_no_neighbour_is_missed(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = additive.nearest(df, F.col("k") % 500 == 0, candidate_rows=7000, query_rows=30).toPandas()
    assert len(found) == 40 * 20
    for q, mine in found.groupby("query_id"):
        exact = np.zeros(len(x))
        for component, value in zip(x.T, x[q], strict=True):
            exact += component * value
        best = [i for i in np.lexsort((np.arange(len(x)), -exact)) if i != q][:20]
        mine = mine.sort_values("rank")
        assert mine["vec_id"].tolist() == best and mine["score"].tolist() == exact[best].tolist()
