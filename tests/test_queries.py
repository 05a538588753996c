"""Some of the registered queries against their SQL on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["vec_dot", "quat_mul", "box_intersects", "particle_aabb", "mask_semi_join", "mask_grid", "octree_leaf_stats", "mesh_elements", "laplacian", "dat_many_files", "particle_closest_point", "particle_edits", "particle_obb_bounds", "mesh_hex_faces", "mesh_pixel_edges", "mesh_quad_edges", "field_dot", "gauss_seidel"])
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    df = e.queries()[name](spark, D)
    got = con.sql(e.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    rows = lambda names, data: sorted(str([x[names.index(c)] for c in cols]) for x in data)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(got.columns, got.fetchall())


def test_registry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent).returncode == 0
