"""Registered queries against their DuckDB SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from flowledger.plans import registry

SF = "/root/testdata/sf0.01"
#: One query of each kind; the driver compares all of them.
NAMES = [
    "f7_model_key", "f14_snap_power", "v1_validate_physics", "v2_self_heal", "w3_cross_page_merge", "g3_majority_fill", "j1_merge_sources", "j6_prefix_join", "j13_suffix_antijoin", "w5_iqr_outliers", "w7_same_point",
    "g4_quality_gates", "q1_search_pumps", "w12_consecutive_failures", "a3_interpolate", "p2_classify_pages", "p17_brand_from_text", "t5_infer_from_values", "t13_unpivot_qh_matrix", "s8_upsert_by_key", "flagship_clean_models",
    "t19_curve_records", "j11_fill_chain", "t22_direct_records", "x1_extractors", "f16_coded_names", "p14_spans_to_rows", "w3_merged_fields", "m1_incremental_upsert", "j15_verify_models",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: "<null>" if x is None or x is pd.NA or x != x else str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = plain(registry.queries()[name](spark, SF).toPandas()), plain(duck.execute(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=0)
