
from __future__ import annotations

import pytest

from frameloom.plans import planted as Q

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(name, spark, duck, small):
    got = Q.QUERIES[name](spark, small).toPandas()
    want = duck.execute(Q.ORACLES[name]).df()
    assert_same(got, want)


def test_fits_return_a_row_per_cell_or_frame(spark, small):
    from frameloom.plans import views

    sessions = views.images(spark, small).select("session").distinct().count()
    frames = views.images(spark, small).count()
    want = {"poly_radial_fit": 64 * sessions, "surface_fit": 64 * sessions, "foreground_mask": 64 * frames, "frame_anomaly": frames}
    assert set(want) == set(Q.QUERIES) - set(Q.ORACLES)
    for name, n in want.items():
        assert Q.QUERIES[name](spark, small).count() == n, name


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_result_does_not_depend_on_partitions(spark, small):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, Q.QUERIES["stack_selection"](spark, small).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


@pytest.mark.parametrize("kept", ["vec_id < 481", "vec_id % 7 <> 3", "vec_id IN (4, 9, 33)", "vec_id < 100 OR vec_id >= 125"])
def test_mosaics_in_part_equal_sql(kept, spark, duck, small, tmp_path):
    """level_normalise where images of a mosaic are missing."""
    duck.execute(f"COPY (SELECT * FROM '{small}/embeddings.parquet' WHERE {kept}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert_same(Q.QUERIES["level_normalise"](spark, str(tmp_path)).toPandas(), own.execute(Q.ORACLES["level_normalise"]).df())
