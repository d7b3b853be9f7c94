"""Every query of the grids, matrices and studies against its SQL. Those without SQL are trees and tree walks, which
test_bodies_and_seams.py holds against plain Python; here they give finite rows, as many as there should be."""

import math

import pytest

from gridspark.plans import grid_queries, io_queries, matrix_queries, study_queries

from oracle import connect, differences

QUERIES, ORACLES = {}, {}
for plans in (study_queries, grid_queries, matrix_queries, io_queries):
    QUERIES |= plans.QUERIES
    ORACLES |= plans.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert differences(frame, con, ORACLES[name]) == ""
    else:
        rows = frame.collect()
        n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
        assert all(math.isfinite(x) for r in rows for x in r if isinstance(x, float))
        if name == "bh_tree":
            assert sum(r.n for r in rows if r.is_leaf) == n and sum(r.n for r in rows if r.depth == 0) == n
        elif name == "rel_error_summary":
            assert len(rows) == 1 and 0 <= rows[0].median <= rows[0].p95 <= rows[0].max and rows[0].median < 0.05
        else:
            assert len(rows) == n
