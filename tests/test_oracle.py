"""A spread of registered queries against their SQL (all of them: tools/check.py)."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

SF_DIR = f"/root/testdata/sf{os.environ.get('LANDGRID_SF', '0.01')}"
KEYS = ("scan_scene", "best_scene_platform", "asset_pick", "mosaic_tiles", "minmax_normalize",
        "spectral_rules", "change_ref", "ring_zone_touch", "shannon_entropy", "ueii",
        "accuracy_report", "focal_majority", "distance_transform", "extract_at_polygons", "extract_at_degrees",
        "dashboard_extent", "preprocess_scene", "compare_products", "change_models", "connected_components",
        "sieve_small", "patch_windows", "train_test_split", "classify_year", "landscape_metrics",
        "driver_stack")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    cur = con.execute(entry.oracle_sql()[name])
    want = cur.fetchall()
    assert compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], want) == ""
