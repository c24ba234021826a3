"""Streams end where batch does, survive a restart, and keep index order."""

import re
import time

import pytest
from pyspark.sql import functions as F

from flowlens import session
from flowlens.operators.neighbours import EpsNeighbourClassifier
from flowlens.session import work_path
from flowlens.streaming import replay, scoring, sinks, windows


def scored(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("index"), F.pmod(i * 7, F.lit(10)).cast("int").alias("category"),
        F.pmod(i * 3, F.lit(2)).cast("int").alias("a"), F.pmod(i, F.lit(2)).cast("int").alias("b"))


@pytest.mark.parametrize("files", [1, 5])
@pytest.mark.parametrize("per_tick, seek", [(1, 396), (90, None), (90, 300)])
def test_each_tick_has_the_next_flows(spark, files, per_tick, seek):
    """Two ways to read them, whatever the files are."""
    path, first = work_path(spark, "t-replay"), seek or 0
    replay.write_replay(scored(spark), path, files=files)
    want = [list(range(at, min(at + per_tick, 400))) for at in range(first, 400, per_tick)]
    for stream, wrap in ((replay.ticks(spark, per_tick, seek), lambda f: replay.each_tick(path, f)),
                         (replay.replay_stream(spark, path, per_tick, seek), lambda f: f)):
        seen = []
        replay.drain(stream, wrap(lambda batch, epoch: seen.append(sorted(r["index"] for r in batch.collect()))), 400 - first, per_tick)
        assert seen == want


def test_a_tick_reads_the_row_groups_of_its_range(spark):
    path, plans = work_path(spark, "t-replay"), []
    replay.write_replay(scored(spark), path)
    replay.drain(replay.ticks(spark, 3, 7), replay.each_tick(path, lambda b, e: plans.append(b._jdf.queryExecution().toString())), 3, 3)
    assert "GreaterThanOrEqual(index,7), LessThanOrEqual(index,9)" in plans[0]
    stream = replay.replay_stream(spark, path, 3)
    assert "BroadcastHashJoin" in _last_plan(stream) and "SortMergeJoin" not in _last_plan(stream)


def test_a_tick_of_a_stream_reads_the_row_groups_of_its_range(spark):
    """Also on a checkpoint that goes on, where no-data batches come between, and with few stores of state."""
    path, checkpoint, plans, seen = work_path(spark, "t-replay"), work_path(spark, "t-checkpoint"), [], []
    replay.write_replay(scored(spark).withColumn("at", F.timestamp_seconds(F.col("index") * 600)), path)
    ranged = replay.ranged_stream(spark, path, 50, 20)

    def counts(come):
        stream = ranged(come)
        plans.append((come, stream._jdf.queryExecution().analyzed().toString()))
        return windows.windowed_confusion_stream(stream, "at", "category", ["a", "b"])

    for flows in (100, 280):
        replay.drain(counts, lambda b, e: seen.extend((r.window_start, r.predictor, r.category, r.pred, r.n) for r in b.collect()),
                     flows, 50, "update", checkpoint, state_partitions=2)
    assert [come for come, _ in plans] == [0, 0, 50, 0, 100, 150, 200, 250, 300, 350]
    for come, plan in plans:
        plain = re.sub(r"#\d+L?|cast\(|as bigint\)|[() ]", "", plan)
        assert f"index>={20 + come}ANDindex<={119 + come}" in plain, plan
    newest = {}
    for *group, n in seen:
        newest[tuple(group)] = max(n, newest.get(tuple(group), 0))
    assert sum(newest.values()) == 2 * 380
    assert len([n for n in session.names_in(spark, f"{checkpoint}/state/0") if n.isdigit()]) == 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8" and replay.come(spark, work_path(spark, "t-none")) == 0


def _last_plan(stream):
    query = sinks.start(stream, lambda b, e: b.count(), available_now=True)
    query.awaitTermination()
    return query._jsq.explainInternal(False)


def test_odd_ticks(spark):
    for per_tick in (0, replay.MOST_PER_TICK + 1):
        with pytest.raises(ValueError):
            replay.ticks(spark, per_tick)
    path, seen = work_path(spark, "t-replay"), []
    replay.write_replay(scored(spark, 0), path)
    replay.drain(replay.ticks(spark, 5), replay.each_tick(path, lambda b, e: seen.append(b.count())), 5, 5)
    assert seen == [0]


def test_pause_jump_and_resume_lose_nothing(spark):
    path, out = work_path(spark, "t-replay"), work_path(spark, "t-out")
    replay.write_replay(scored(spark), path, files=4)
    player = replay.Replay(spark, path, lambda b, e: sinks.write_epoch(b, out, e), per_tick=60)
    for wait in (100, 300):  # flows that have come when it is paused
        query = player.play()
        until = time.time() + 60
        while time.time() < until:
            if any((p["batchId"] + 1) * 60 >= wait for p in query.recentProgress):
                break
            time.sleep(0.05)
        player.pause()
        assert player.query is None
    got = [r["index"] for r in sinks.read_epochs(spark, out).orderBy("index").collect()]
    assert len(got) >= 300 and got == list(range(len(got)))
    before = player.checkpoint
    player.jump(390)
    assert player.checkpoint != before and player.seek == 390


def test_last_n_across_a_restart(spark):
    path, out, checkpoint = (work_path(spark, f"t-{k}") for k in ("replay", "window", "checkpoint"))
    replay.write_replay(scored(spark, 300), path, files=2)

    def run(flows):
        stream = replay.replay_stream(spark, path, 30)
        replay.drain(stream, windows.keep_last_n(out, 50, "index", "category", ["a", "b"]), flows, 30, checkpoint=checkpoint)
        return sinks.latest_epoch(spark, f"{out}/window")

    assert sorted(r["index"] for r in run(90).collect()) == list(range(40, 90))
    window = run(210)
    assert sorted(r["index"] for r in window.collect()) == list(range(250, 300))
    matrix = windows.window_confusion(window, "category", ["a", "b"])
    assert matrix.groupBy("predictor").agg(F.sum(F.col("normal") + F.col("attack")).alias("n")).where(
        "n = 50").count() == 2


def test_stream_explanations_equal_batch(spark):
    points = spark.range(200).select(
        F.col("id").alias("flow_id"), (F.pmod(F.col("id") * 37, F.lit(100)) / 100).alias("x"),
        (F.pmod(F.col("id") * 61, F.lit(100)) / 100).alias("y"), F.pmod("id", F.lit(3)).cast("int").alias("category"))
    model = EpsNeighbourClassifier().fit(points)
    path, out = work_path(spark, "t-replay"), work_path(spark, "t-out")
    replay.write_replay(points, path, "flow_id", 2)
    replay.drain(replay.replay_stream(spark, path, 100, index="flow_id"), scoring.explain_batches(model, 0.1, out), 200, 100)
    names = ["flow_id", "neighbours", "predicted"]
    streamed = sinks.read_epochs(spark, out).select(names).orderBy("flow_id").collect()
    assert streamed == model.explain(points, 0.1).select(names).orderBy("flow_id").collect()
