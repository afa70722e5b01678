"""Streams give what their batch twins give."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowledger.operators import merge, recipes
from flowledger.plans.inputs import outcomes
from flowledger.sources import files
from flowledger.sources.staging import shared_dir
from flowledger.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_recipe_states_equal_the_batch(spark):
    rows = outcomes(spark, SF).where("recipe_id % 20 = 0")
    got = sorted(map(tuple, jobs.replayed(rows, parts=3).collect()))
    want = sorted(tuple(r) for r in recipes.evaluate(rows).select("recipe_id", "uses", "successes", "failures", "action").collect())
    assert got == want and got
    assert jobs.replayed(rows.where("false")).count() == 0


def test_catalogues_are_replaced_once_or_twice(spark, tmp_path):
    out = str(tmp_path / "out")
    files.replace_catalogues(spark.createDataFrame([("a", 1), ("b", 2)], "catalog string, x int"), out)
    for _ in range(2):
        files.replace_catalogues(spark.createDataFrame([("a", 9)], "catalog string, x int"), out)
    assert sorted((r["catalog"], r["x"]) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 2)]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("A 1", 1, 5.0), ("B 2", 2, 6.0), ("", 3, 1.0)], "model string, seq int, q double")
    new = spark.createDataFrame([("a1", 4, 7.0), ("A-1", 5, 8.0), ("C 3", 6, 9.0)], "model string, seq int, q double")
    key = F.upper(F.regexp_replace("model", "[ -]", ""))
    once = merge.upsert(old, new, key, [F.col("seq")])
    twice = merge.upsert(once, new, key, [F.col("seq")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("A-1", 5, 8.0), ("B 2", 2, 6.0), ("C 3", 6, 9.0)]


def test_pages_from_text_files(spark, tmp_path):
    (tmp_path / "cat-3.txt").write_text("Q=1")
    (tmp_path / "cat-4.txt").write_text("two\nlines")
    got = sorted(map(tuple, files.read_pages(spark, str(tmp_path), "text").collect()))
    assert got == [("cat", 3, "Q=1"), ("cat", 4, "two\nlines")]
    assert len({r["sha256"] for r in files.fingerprints(spark, str(tmp_path)).collect()}) == 2


def standing(rows):
    return sorted((tuple(r) for r in recipes.evaluate(rows).select("recipe_id", "uses", "successes", "failures", "action").collect()), key=str)


def test_a_replay_has_a_micro_batch_for_each_span(spark, monkeypatch):
    """However many files a span has."""
    monkeypatch.setattr(jobs, "ROWS_OF_A_FILE", 30, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before, rows = set(os.listdir(shared_dir(spark))), outcomes(spark, SF).where("event_id % 2 = 0")
        got = sorted(map(tuple, jobs.replayed(rows, parts=2).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = {x.split("-")[0]: f"{shared_dir(spark)}/{x}" for x in set(os.listdir(shared_dir(spark))) - before if not x.endswith("-state")}
    assert sum(x.endswith(".parquet") for x in os.listdir(f"{made['replay']}/part=0")) > 2
    # the spans, the last event, and what is folded after it
    assert len(os.listdir(made["replayed"])) <= 4
    assert got == standing(rows)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_recipes_of_a_group_keep_apart(spark, tmp_path, zone):
    """Events that come in no order in four micro-batches, recipes without an id and with very long ones, an hour that a clock shows twice."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ids = F.element_at(F.expr("array(null, -7L, 0L, 9007199254740993L, 9007199254740992L)"), (F.col("id") % 5 + 1).cast("int"))
        # 27 October 2024, 00:00 to 02:00 in UTC
        rows = spark.range(240).select(ids.alias("recipe_id"), F.col("id").alias("event_id"), F.timestamp_seconds(1729987200 + F.col("id") * 30).alias("ts"), (F.col("id") * 7 % 11 < 8).alias("success"))
        end = rows.limit(1).select(F.lit(None).cast("long").alias("recipe_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(True).alias("success"))
        for k in range(4):
            rows.where(F.col("event_id") * 13 % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
        end.coalesce(1).write.parquet(f"{tmp_path}/in/4")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        name = f"states_{zone[:3]}"
        jobs.run_to_memory(jobs.recipe_states(stream, "3 hours", groups=2), name, prepare=lambda w: w.option("checkpointLocation", f"{tmp_path}/state"))
        found = spark.table(name)
        last = found.groupBy("recipe_id").agg(F.max_by(F.struct("uses", "successes", "failures", "action"), "uses").alias("s")).select("recipe_id", "s.*")
        assert sorted(map(tuple, last.collect()), key=str) == standing(rows)
        assert sorted(map(tuple, jobs.replayed(rows).collect()), key=str) == standing(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_folding_by_groups_equals_a_loop():
    made, stands, want = np.random.default_rng(5), np.zeros(0, jobs.STAND), {}
    for batch in range(6):
        events = np.zeros(int(made.integers(0, 60)), jobs.EVENT)
        events["recipe_id"], events["us"] = made.integers(-4, 12, len(events)), made.integers(0, 9, len(events)) + 10 * batch
        events["event_id"], events["success"] = made.permutation(len(events)), made.integers(0, 3, len(events)) == 0
        for e in sorted(events.tolist(), key=lambda e: e[1:3]):
            uses, successes, failures = want.get(e[0], (0, 0, 0))
            want[e[0]] = (uses + 1, successes + e[3], 0 if e[3] else failures + 1)
        own, stands = jobs._fold(stands, events)
        assert set(own["recipe_id"].tolist()) == set(events["recipe_id"].tolist())
        assert {r: tuple(s) for r, *s in stands.tolist()} == want and sorted(want) == stands["recipe_id"].tolist()
