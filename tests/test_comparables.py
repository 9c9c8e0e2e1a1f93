"""The comparable search against all pairs of the pools (comparable_pairs)."""

import math
import os

import comparable_pairs as plain
import pytest

from landgrain.operators import comparables
from landgrain.plans.frames import frames

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def _close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("split", ["train", "test"])
def test_search_is_that_over_all_pairs(spark, split, monkeypatch):
    """Every query, whatever its filters, area or part of a task; one row a query leaves the search, and no pair."""
    monkeypatch.setattr(comparables, "QUERIES", 5)
    monkeypatch.setattr(comparables, "PAIRS", 50)
    f = frames(spark, DATA)
    candidates = f.scaled.where("split = 'train' and tong_gia > 0")
    rows = f.scaled.where(f"split = '{split}'").withColumns({"dien_tich_m2": _thinned(11, "dien_tich_m2"), "mat_tien_m": _thinned(7, "mat_tien_m"), "muc_dich_su_dung_dat": _thinned(13, "muc_dich_su_dung_dat"), "pho_canonical_norm": _thinned(5, "pho_canonical_norm")})
    if split == "train":
        candidates = rows.where("tong_gia > 0")
    args = (rows, candidates, f.embedding, f.config, split == "train")
    found = comparables.search(*args)
    assert found.count() == found.select("q_row_id").distinct().count() > 0
    pairs = plain.score(plain.cascade(comparables.pool(*args), f.config), f.config).localCheckpoint()
    for got, want, key in ((comparables.summary(found), plain.summary(pairs), ("row_id",)), (comparables.top(found), plain.top(pairs), ("q_row_id", "comparable_rank"))):
        assert set(got.columns) <= set(want.columns)
        got, want = ({tuple(r[k] for k in key): r for r in x.select(*got.columns).collect()} for x in (got, want))
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert all(_close(r[c], want[k][c]) for c in r.asDict()), k


def _thinned(n, column):
    """The column without the values of every n-th row."""
    from pyspark.sql import functions as F

    return F.when(F.col("row_id") % n != 0, F.col(column))
