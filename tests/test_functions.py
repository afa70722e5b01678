"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from flowledger.functions import curves, names, numbers, physics
from flowledger.operators import tables as T


def values(spark, raw, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_broken_numbers(spark):
    cases = {"11,8": 11.8, "11.8": 11.8, "1 .1": 1.1, "0 .37": 0.37, "1 3": 13.0, "1 03": 103.0, "1 .5": 1.5, "1 62": 162.0, "206": 206.0, "0,5": 0.5, "1 0": 10.0, "51 0": 510.0, "31 30": 3130.0, "0.37+2.2": 0.37, "": None, "x": None}
    assert values(spark, list(cases), numbers.parse_broken_number) == pytest.approx(list(cases.values()))


def test_rich_numbers(spark):
    cases = {"1,5": 1.5, "12.5 м³/ч": 12.5, "~ 7": 7.0, "1,234.5": 1234.5, "CDM 5": None, "8-12": 8.0, "3/4": 3.0, "88 104": 88.0, "": None, "1e3": 1000.0}
    assert values(spark, list(cases), numbers.parse_number_rich) == list(cases.values())


def test_ranges_and_slashes(spark):
    assert [tuple(x) for x in values(spark, ["5-80", "32-19", "", "x", "7", "8-12,5 m"], numbers.parse_range)] == [(5, 80), (19, 32), (0, 0), (0, 0), (7, 7), (8, 12.5)]
    assert values(spark, ["0,37 / 0,37", "-- / 2,2", "1.1 / --", "–", "3,0"], numbers.parse_slash_number) == [0.37, 2.2, 1.1, None, 3.0]


def test_keys_and_names(spark):
    assert len(set(values(spark, ["CDM 32-5", "CDM32-5", "cdm 32-5", "CDM-32-5", "СDM 32-5 50 Hz"], names.model_key))) == 1
    cases = {"LVR(S)1 5-1": "LVR(S)15-1", "LVR(S)1 0-1 6": "LVR(S)10-16", "LVR(S)20-1 0": "LVR(S)20-10", "1 -2": "1-2", "MV(S) 1-2": "MV(S) 1-2", "32-1 0-2": "32-10-2", "1 5-1 4": "15-14"}
    assert values(spark, list(cases), names.repair_split_name) == list(cases.values())
    assert values(spark, ["CDM 32-5", "12", "DN 50", "x", None, "Material 3", "FST 32-125/7"], names.is_garbage) == [False, True, True, True, True, True, False]
    assert values(spark, ["LVR10", "LVR2", "abc"], names.natural_sort_key) == [["lvr", "000000000010"], ["lvr", "000000000002"], ["abc"]]


def test_curves(spark):
    rows = spark.createDataFrame([([0.0, 5.0, 3.0, 15.0, 20.0], [9.0, 8.0, 7.0, 6.0, 5.0]), ([0.0, 10.0, 20.0], [9.0, 7.0, 5.0])], "q array<double>, h array<double>")
    got = rows.select(curves.fix_flow(F.col("q")).alias("q"), curves.interpolate(F.col("q"), F.col("h"), F.lit(12.0)).alias("h"), curves.bep_point(F.col("q"), F.col("h")).alias("b")).collect()
    assert got[1]["q"] == [0.0, 10.0, 20.0] and got[1]["h"] == pytest.approx(6.6) and tuple(got[1]["b"]) == (10.0, 7.0)
    assert got[0]["q"] == sorted(got[0]["q"])
    assert rows.select(curves.is_swapped(F.col("h"), F.col("q")).alias("s")).collect()[1]["s"]


def test_power(spark):
    rows = spark.createDataFrame([(10.0, 20.0, 1.0), (0.0, 5.0, 1.0), (5000.0, 400.0, 3.0)], "q double, h double, p double")
    got = rows.select(physics.efficiency(F.col("q"), F.col("h"), F.col("p")).alias("e"), physics.estimate_power(F.col("q"), F.col("h")).alias("x"), physics.nearest_size(F.col("p")).alias("n")).collect()
    assert got[0]["e"] == pytest.approx(998 * 9.81 * 10 / 3600 * 20 / 1000) and got[0]["x"] == 1.1 and got[0]["n"] == 1.1
    assert got[1]["e"] is None and got[1]["x"] == 0.0 and got[2]["x"] == 1000.0


def test_headers(spark):
    got = values(spark, ["Q (м³/ч)", "Модель", "H1", "Мощность P2, кВт", "zzz", None], lambda c: T.header_field(c)["field"])
    assert got == ["q_nom", "model", "h_nom", "power_kw", None, None]


def test_spans_follow_the_first_of_their_row(spark):
    spans = spark.createDataFrame([(1, 0.0, 5.0, "b"), (1, 2.0, 1.0, "a"), (1, 4.0, 1.0, "c"), (2, 9.0, 0.0, "d")], "page int, y double, x double, text string")
    got = sorted((r["page"], r["row_no"], r["col_no"], r["text"]) for r in T.span_rows(spans, ["page"]).collect())
    assert got == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (2, 0, 0, "d")]


def test_extractors_are_picked_step_by_step(spark):
    rows = [(1, 0, "a", 80.0, 4), (1, 1, "b", 90.0, 4), (1, 2, "c", 55.0, 6), (2, 0, "a", 40.0, 3), (2, 1, "b", 45.0, 9)]
    got = T.sequential_pick(spark.createDataFrame(rows, "page int, place int, extractor string, score double, n int"), ["page"]).orderBy("page").collect()
    assert [r["extractor"] for r in got] == ["c", "b"]
