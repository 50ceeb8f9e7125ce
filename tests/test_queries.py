"""Every registered query against its SQL on the smallest data, and checks of the plans."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, duck
from queries.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

# The optional part has tests of its own.
WITH_SQL = sorted(ORACLES)
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def database():
    connection = duck(SF)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows_as_sql(spark, database, name):
    verdict, _, _ = compare(spark, database, name, SF)
    assert verdict == "ok"


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs_without_sql(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "price" in df.columns


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ROW_LEVEL = [
    "large_combination_prices", "denoise_series", "denoise_long_series", "pct_change", "pct_change_long_series",
    "interpolate_linear", "join_right_semi", "lookup_join", "overlap_resolve", "encode_categorical", "scale_minmax",
    "sample_weights", "stratified_split", "quantile_bins", "kprototypes_assign", "segment_profile", "grand_total_share",
]


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_plan_has_no_python_cross_join_or_global_window(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "EvalPython" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.splitlines()
    for above, below in zip(lines, lines[1:]):
        if "SinglePartition" in above:  # only what is already aggregated goes to one task
            assert re.search(r"Aggregate\(keys?=\[(\]|_run)", below)


def test_filters_and_columns_reach_the_scan(spark):
    from weekloom.operators.filters import before_year
    from weekloom.sources.tables import scan_table

    lines = scan_table(spark, f"{SF}/lineitem.parquet")
    text = plan(before_year(lines, "l_shipdate", 2001).select("l_quantity", "l_shipdate"))
    assert "LessThan(l_shipdate" in text
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>", text)


def test_all_are_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", ["cumulative_share_cut", "group_mean_sum", "grand_total_share"])
def test_a_year_reaches_the_scan(spark, name):
    from queries import views

    text = plan(views.pos(spark, SF, 2000))
    pushed = re.search(r"PushedFilters: \[[^\]]*l_shipdate[^\]]*\]", text)[0]
    assert "GreaterThanOrEqual(l_shipdate,1999-12-27" in pushed and "LessThan(l_shipdate,2001" in pushed
    weeks = views.pos(spark, SF).filter("year(week_end) = 2000")
    assert views.pos(spark, SF, 2000).exceptAll(weeks).isEmpty() and weeks.exceptAll(views.pos(spark, SF, 2000)).isEmpty()
    assert queries()[name](spark, SF).count() > 0


def test_quantiles_gather_no_lists():
    import inspect

    from weekloom.operators import ordered

    assert "collect_list" not in inspect.getsource(ordered)


@pytest.mark.parametrize("partitions", ["1", "50"])
def test_shuffle_partitions_do_not_change_results(spark, database, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("denoise_long_series", "cumulative_share_cut", "encode_categorical", "stratified_split"):
            assert compare(spark, database, name, SF)[0] == "ok"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_segments_flow_clusters_all_measures(spark):
    rows = queries()["segments_flow"](spark, SF).collect()
    assert sorted(r["segment"] for r in rows) == ["First", "Second"]
    for measure in ("qty", "price", "Lower_income", "Higher_income", "Average_Income"):
        assert all(r[f"{measure}_min"] <= r[f"{measure}_mean"] <= r[f"{measure}_max"] for r in rows)
    assert sum(r["key_share"] for r in rows) == pytest.approx(1) and all(r["keys"] > 0 for r in rows)


def test_weekly_segments_hold_every_week(spark):
    weeks = queries()["kprototypes_assign"](spark, SF).count()
    rows = queries()["cluster_segments"](spark, SF).collect()
    assert sum(r["total_count"] for r in rows) == weeks


@pytest.mark.parametrize("missing", ["public_tokenizers", "weekloom.llm", "corpus_pipeline"])
def test_the_entry_stands_without_the_optional_part(missing):
    """The other queries are there if a package of the text operators, their folder or the pipeline is absent."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""import sys
sys.modules[{missing!r}] = None  # importing it raises ImportError
import __spark_entry__ as e
print(len(e.queries()), "pipeline" in e.queries(), any(q.startswith("op") and q[2].isdigit() for q in e.queries()))"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    n, pipeline, texts = run.stdout.split()
    assert int(n) >= 109 and (pipeline, texts) == ("False", "False")
