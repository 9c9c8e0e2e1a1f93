"""What the comparable search and the queries judged by it leave on disk or shuffle."""

import os
import time

import pytest
from pyspark.sql import functions as F

from landgrain.operators import comparables
from landgrain.plans import frames, queries
from landgrain.plans.frames import JUDGED, Frames
from landgrain.sources.staging import CLEANUP, staged, staged_parts

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_a_staged_table_leaves_no_shuffles(spark):
    before, setting = _shuffles(spark), spark.conf.get(CLEANUP, None)
    out = staged(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"), "shuffled")
    for _ in range(50):  # files go in the background
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP, None) == setting
    assert sum(r["count"] for r in out.collect()) == 10_000


@pytest.fixture(scope="module")
def fresh(spark):
    return Frames(spark, DATA)


@needs_tables
@pytest.mark.parametrize("name", ["compared", "compared_test"])
def test_search_shuffles_rows_for_their_meeting_only(spark, fresh, name):
    """Kinds of queries and cells of candidates are small written tables; rows meet them without a shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = getattr(fresh, name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


@needs_tables
def test_search_places_no_row_of_a_kind_twice(fresh):
    """Queries that differ in nothing but whether they are candidates are kinds of their own; nulls are values."""
    rows = fresh.scaled.where("split = 'train'").withColumns({x: F.when(F.col("row_id") % n != 0, F.col(x)) for x, n in (("muc_dich_su_dung_dat", 3), ("phan_loai_kho", 5), ("tong_gia", 7))})
    found = comparables.search(rows, rows.where("tong_gia > 0"), fresh.embedding, fresh.config)
    assert found.count() == found.select("q_row_id").distinct().count() == rows.count()


@needs_tables
def test_judged_carries_no_vectors(fresh):
    assert set(fresh.judged.columns) >= {*JUDGED, "confidence_score", "predicted", "warning_flags"}
    assert not {"core", "access", "dien_tich_m2"} & set(fresh.judged.columns)


@needs_tables
@pytest.mark.parametrize("name", ["explanations", "focus_row"])
def test_judged_rows_are_not_written(spark, fresh, name, monkeypatch):
    """Each reader joins what it uses: the joined rows are on disk once at most, in the shuffle, and not in a table beside it."""
    written = []
    monkeypatch.setattr(frames, "staged", lambda df, label: written.append(label) or staged(df, label))
    monkeypatch.setattr(queries, "frames", lambda *_: fresh)
    vars(fresh).pop("judged", None)
    assert queries.QUERIES[name](spark, DATA).count() == (1 if name == "focus_row" else fresh.train.count())
    assert "judged" not in written


@pytest.fixture
def rounds(monkeypatch):
    """The smallest tables in four rounds."""
    monkeypatch.setattr(comparables, "QUERIES", 32)
    monkeypatch.setattr(comparables, "ROUNDS", 4)


@needs_tables
def test_a_round_of_the_search_shuffles_a_share_of_the_rows(spark, fresh, rounds, monkeypatch):
    """The rounds' rows together are all rows, no round has most of them, and what they find is what one meeting of all finds."""
    train = fresh.scaled.where("split = 'train'")
    met = comparables.meeting(train, train.where("tong_gia > 0"), fresh.embedding, fresh.config)
    seen = []

    def found(m, *args, of=comparables.found):
        seen.append((m.left.count(), m.right.count()))
        return of(m, *args)

    monkeypatch.setattr(comparables, "found", found)
    got = comparables.measures(met, fresh.config)
    monkeypatch.undo()
    assert len(seen) == 4
    for n, side in zip(zip(*seen), (met.left, met.right)):
        assert sum(n) == side.count() and max(n) < 0.6 * sum(n)
    want = comparables.found(met, fresh.config).drop("best")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@needs_tables
def test_focus_row_of_parts_is_that_of_all(spark, rounds, monkeypatch):
    f, written = Frames(spark, DATA), []
    monkeypatch.setattr(queries, "frames", lambda *_: f)
    monkeypatch.setattr(queries, "staged_parts", lambda parts, label: staged_parts((written.append(p.count()) or p for p in parts), label))
    assert f.meeting.rounds == 4
    got = queries.focus_row(spark, DATA).collect()
    assert written == [1] * 4
    assert got == queries.diagnostics.focus_row(f.judged).select("row_id", F.round("confidence_score", 6).alias("confidence_score")).collect()
    assert sum(p.count() for p in f.judged_parts()) == f.judged.count() == f.train.count()


@needs_tables
def test_what_follows_from_a_row_is_not_written(spark, monkeypatch):
    """Scores and logarithms of a row's own columns compress badly; they are the same when made by the reader."""
    f, written = Frames(spark, DATA), {}
    monkeypatch.setattr(frames, "staged", lambda df, label: written.update({label: df.columns}) or staged(df, label))
    monkeypatch.setattr(comparables, "staged_parts", lambda parts, label: (written.update({label: (parts := list(parts))[0].columns}), staged_parts(parts, label))[1])
    f.summaries
    assert not {"special_asset_score", "special_asset_reasons", "log_tong_gia", "cluster", "core"} & set(written["described"])
    assert not {"band_confidence", "comparable_confidence", "weighted_band_width_ratio", "best"} & set(written["measures"])
    want = f.described(f.keyed)
    columns = sorted(want.columns)
    assert columns == sorted(set(f.scaled.columns) - {"core", "access"})
    assert sorted(map(str, f.scaled.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
