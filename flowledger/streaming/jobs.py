"""Structured Streaming: upserts of arriving catalogues, states of recipes, and tasks without repeats."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recipes import action
from ..sources import snapshot
from ..sources.files import replace_catalogues
from ..sources.staging import shared_dir


def upsert_catalogues(arriving: DataFrame, path: str, checkpoint: str, by: str = "catalog"):
    """Each micro-batch replaces the rows of the catalogues in it: of several files of a catalogue in one batch the last, by
    arrival order column 'at', counts. Doing a batch again gives the same."""

    def put(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(by).agg(F.max("at").alias("at"))
        replace_catalogues(batch.join(last, [by, "at"]), path, by)

    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def upsert_snapshot(arriving: DataFrame, path: str, checkpoint: str, by: str = "catalog"):
    """As upsert_catalogues(), into a snapshot: a reader sees each micro-batch wholly or not at all, and a batch that is tried again
    after a failure changes nothing if it was done. Read it by snapshot.read_catalogues()."""

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(by).agg(F.max("at").alias("at"))
        snapshot.replace_catalogues(batch.join(last, [by, "at"]), path, number + 1, by)

    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


#: Where a recipe stands, and an event that is held back; a state has the bytes of an array of each.
STAND = np.dtype([("recipe_id", "i8"), ("uses", "i8"), ("successes", "i8"), ("failures", "i8")])
EVENT = np.dtype([("recipe_id", "i8"), ("us", "i8"), ("event_id", "i8"), ("success", "?")])
STATE = "stands binary, held binary"
FOLDED = "recipe_id long, uses long, successes long, failures long"
RESULT = f"{FOLDED}, action string"
#: Recipes are advanced by groups, as a call for each recipe takes longer than its events.
GROUPS = 512
#: Rows of a replayed table for each file and for each group at most, on average.
ROWS_OF_A_FILE, ROWS_OF_A_GROUP = 1 << 18, 1 << 16


def _fold(stands: np.ndarray, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the recipes of the events stand after them, and where all recipes of the group do; both by recipe_id."""
    events = events[np.lexsort((events["event_id"], events["us"], events["recipe_id"]))]
    ids, begin = np.unique(events["recipe_id"], return_index=True)
    if not len(ids):
        return stands[:0], stands
    n = np.diff(begin, append=len(events))
    won = np.add.reduceat(events["success"].astype("i8"), begin)
    last = np.maximum.reduceat(np.where(events["success"], np.arange(len(events)), -1), begin)
    own, known = np.zeros(len(ids), STAND), np.isin(ids, stands["recipe_id"])
    own[known] = stands[np.searchsorted(stands["recipe_id"], ids[known])]
    own["recipe_id"] = ids
    own["uses"] += n
    own["successes"] += won
    own["failures"] = np.where(won > 0, begin + n - 1 - last, own["failures"] + n)
    every = np.concatenate([stands[~np.isin(stands["recipe_id"], ids)], own])
    return own, every[np.argsort(every["recipe_id"])]


def _advance(key: tuple, batches, state: GroupState):
    """Folds the events of a group of recipes up to the watermark, in order of time, and holds the others back; all at once."""
    stands, held = (np.frombuffer(x, t) for x, t in zip(state.get if state.exists else (b"", b""), (STAND, EVENT)))
    parts = [held]
    for x in () if state.hasTimedOut else batches:
        part = np.empty(len(x), EVENT)
        for column in EVENT.names:
            part[column] = x[column]
        parts.append(part)
    events, upto = np.concatenate(parts), state.getCurrentWatermarkMs()
    ready = events["us"] < upto * 1000
    rest = events[~ready]
    own, stands = _fold(stands, events[ready])
    state.update((stands.tobytes(), rest.tobytes()))
    if len(rest):
        state.setTimeoutTimestamp(max(int(rest["us"].min()) // 1000, upto) + 1)
    if len(own):
        # the recipe without an id has a group of its own
        yield pd.DataFrame({c: own[c] for c in STAND.names} | ({"recipe_id": [None]} if key[0] < 0 else {}))


def recipe_states(outcomes: DataFrame, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """outcomes (recipe_id, event_id, ts, success), a stream whose events come late by less than late: a row for a recipe, each time
    that the watermark has passed some of its events, with its uses, successes, consecutive failures and action up to there.
    Events are folded in order of ts and event_id whatever order they come in: what comes too early is held in the state until
    the watermark passes it. The events after the last watermark stay in the state. Recipes are dealt by a hash to so many
    groups, each with one state; a checkpoint goes on only with the same number."""
    group = F.when(F.col("recipe_id").isNull(), -1).otherwise(F.pmod(F.hash("recipe_id"), F.lit(groups)))
    own = outcomes.withWatermark("ts", late).select(group.alias("group"), F.coalesce("recipe_id", F.lit(0)).alias("recipe_id"), "event_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("success", F.lit(False)).alias("success"))
    folded = own.groupBy("group").applyInPandasWithState(_advance, FOLDED, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return folded.withColumn("action", action(F.col("uses"), F.col("successes"), F.col("failures")))


def replayed(outcomes: DataFrame, parts: int = 4) -> DataFrame:
    """Where each recipe stands after a table of outcomes went through recipe_states() as a stream: a micro-batch has the rows of one
    of parts spans of time in no order, in files that grow in number with the table, and the watermark is two spans behind, so
    that events are held over micro-batches. An event of no recipe (null) far after all others lets the watermark pass the last
    ones."""
    spark = outcomes.sparkSession
    folder, out = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}", f"{shared_dir(spark)}/replayed-{uuid.uuid4().hex}"
    own = outcomes.select(F.col("recipe_id").cast("long").alias("recipe_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "success")
    a, b, rows = own.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("ts")).first()
    if a is None:
        return spark.createDataFrame([], RESULT)
    files, place = -(-rows // (parts * ROWS_OF_A_FILE)), F.hash("event_id")
    for k in range(parts):
        span = own.where(F.expr(f"(unix_micros(ts) - {a}) * {parts} div {b - a + 1}") == k)
        span.repartition(files, place).sortWithinPartitions(place).write.mode("append").parquet(f"{folder}/part={k}")
    end = spark.range(0, 1, 1, 1).select(F.lit(None).cast("long").alias("recipe_id"), F.lit(-1).cast("long").alias("event_id"), (F.timestamp_micros(F.lit(b)) + F.make_dt_interval(F.lit(3650))).alias("ts"), F.lit(True).alias("success"))
    end.write.mode("append").parquet(f"{folder}/part={parts}")
    late = f"{2 * -(-(b - a) // (parts * 1_000_000)) + 2} seconds"
    # a span with fewer files than another shares a micro-batch with the next; as files are read in order, none has events that are too late
    most = max(Counter(os.path.dirname(x) for x in spark.read.schema(own.schema).parquet(folder).inputFiles()).values())
    stream = spark.readStream.schema(own.schema).option("recursiveFileLookup", "true").option("latestFirst", "false").option("maxFilesPerTrigger", most).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    states = recipe_states(stream, late, max(GROUPS, rows // ROWS_OF_A_GROUP))
    query = states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.schema(RESULT).parquet(out).groupBy("recipe_id").agg(F.max_by(F.struct("uses", "successes", "failures", "action"), "uses").alias("s"))
    return last.select("recipe_id", "s.*")


def fresh_tasks(tasks: DataFrame, by: list[str], at: str = "ts", keep: str = "30 days") -> DataFrame:
    """Each task once within the time that tasks are kept; works on streams and tables."""
    if tasks.isStreaming:
        return tasks.withWatermark(at, keep).dropDuplicatesWithinWatermark(by)
    return tasks.dropDuplicates(by)


def retained(tasks: DataFrame, at: str, now: str, days: int = 30) -> DataFrame:
    """Tasks that aren't older than so many days."""
    return tasks.where(F.col(at) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def run_to_memory(stream: DataFrame, name: str, mode: str = "update", prepare: Callable | None = None) -> None:
    """Runs a stream over what is there now into an in-memory table, for tests and small looks."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (prepare(writer) if prepare else writer).start()
    query.awaitTermination()
