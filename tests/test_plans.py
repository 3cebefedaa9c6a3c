"""Plan hygiene for every registered query: no all-pairs joins, filters and
projections reach the scans, no Python UDF on the main path."""

import os

import pytest

import __spark_entry__ as E
from platewise.plans.queries import REGISTRY  # noqa: E402

# the optional training-data queries have tests of their own (tests/llm)
QUERIES = {name: fn for name, fn in E.queries().items() if name in REGISTRY}
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")

# the only queries allowed a Python (Arrow-batched) UDF: the POINT blob codec
ARROW_UDF_OK = {"wkb_decode"}


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_all_pairs_join(spark, name):
    plan = physical_plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDF
    if name not in ARROW_UDF_OK:
        assert "ArrowEvalPython" not in plan


def test_search_pushes_filters_and_prunes_columns(spark):
    plan = physical_plan(QUERIES["search_by_dish"](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    lineitem = [s for s in scans if "lineitem" in s and "l_linestatus" in s]
    assert lineitem, scans
    # the menu scan reads 3 of 11 lineitem columns and pushes the verified flag
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in lineitem[0]
    assert "l_extendedprice" not in lineitem[0]


def test_radius_search_pushes_bounding_box(spark, tmp_path):
    """On stored coordinates all four edges of the box reach the scan."""
    from platewise.operators import search
    from platewise.sources import roles

    cat = roles.bind(spark, SF)
    cat.coordinates.write.parquet(f"{tmp_path}/coordinates")
    stored = cat.with_tables(coordinates=spark.read.parquet(f"{tmp_path}/coordinates"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")      # whole lists of filters in the plan's text
    try:
        plan = physical_plan(search.search_by_radius(stored, 51.1, 17.03, 5.0))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "/coordinates" in line)
    pushed = scan[scan.index("PushedFilters"):]
    for edge in ("GreaterThanOrEqual(lat,", "LessThanOrEqual(lat,", "GreaterThanOrEqual(lon,", "LessThanOrEqual(lon,"):
        assert edge in pushed, pushed


def test_library_code_has_no_cross_joins_or_local_checkpoints():
    import pathlib
    root = pathlib.Path(__file__).resolve().parent.parent / "platewise"
    for f in root.rglob("*.py"):
        text = f.read_text()
        for banned in ("crossJoin", "localCheckpoint", "CROSS JOIN"):
            assert banned not in text, (f, banned)
