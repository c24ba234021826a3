"""Streams, drained: each must end where the batch operator does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators.neighbours import EpsNeighbourClassifier
from flowlens.operators.split import assign_index
from flowlens.plans.learner_queries import SEASONS, seasons
from flowlens.plans.neighbour_queries import _BEST
from flowlens.plans.registry import query, r6, round_sql, rounded
from flowlens.plans.tables import EPS, flow_map, flows, matrix, oracle
from flowlens.reduce import linear
from flowlens.session import work_path
from flowlens.streaming import replay, scoring, sinks, windows

_PER_TICK = 100_000
#: Stores for the state of counts: it has some dozens of rows, or as many for each open window.
_COUNT_STORES = 4
_NUMBER = "replay number"
_PREDICTIONS = ["pred_binary", "pred_attack"]


def _replayed(df: DataFrame, index: str) -> tuple[str, int]:
    """The table numbered from 0 and written as a replay: its path and number of flows."""
    spark, path = df.sparkSession, work_path(df.sparkSession, "replay")
    replay.write_replay(assign_index(df, [index], _NUMBER), path, _NUMBER)
    return path, spark.read.parquet(path).count()


def _drained(df: DataFrame, index: str, write, transform=lambda stream: stream, mode: str = "append",
             state_partitions: int | None = None) -> None:
    """All ticks of the table through ``transform``; large tables in ticks of at most ``_PER_TICK`` flows, small ones in a few."""
    path, flows = _replayed(df, index)
    per_tick = max(1, min(_PER_TICK, -(-flows // 3)))
    stream = replay.ranged_stream(df.sparkSession, path, per_tick, index=_NUMBER)
    replay.drain(lambda come: transform(stream(come).drop(_NUMBER)), write, flows, per_tick, mode, state_partitions=state_partitions)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(
        "flow_id", "ts", F.col("gold_category").alias("category"), "pred_binary",
        (F.col("pred_category") != 9).cast("int").alias("pred_attack"))


@query("stream_replay", oracle("SELECT flow_id, gold_category AS category, pred_binary FROM flows", "flows"))
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick reads the row groups of its own flows."""
    path = work_path(spark, "replayed")
    table, count = _replayed(_scored(spark, sf_dir), "flow_id")
    per_tick = max(1, min(_PER_TICK, -(-count // 3)))

    def write(batch: DataFrame, epoch: int) -> None:
        sinks.write_epoch(batch.select("flow_id", "category", "pred_binary"), path, epoch)

    replay.drain(replay.ticks(spark, per_tick, index=_NUMBER), replay.each_tick(table, write, _NUMBER), count, per_tick)
    return sinks.read_epochs(spark, path).drop("epoch")


_LONG_SQL = """
SELECT flow_id, ts, gold_category AS category, predictor, pred FROM flows,
  LATERAL (SELECT unnest(['pred_binary', 'pred_attack']) AS predictor,
    unnest([pred_binary, CAST(pred_category <> 9 AS INT)]) AS pred) p"""
_LAST = "flow_id > (SELECT max(flow_id) FROM flows) - 200"


@query("stream_last_n", oracle(f"""
SELECT flow_id, gold_category AS category, pred_binary, CAST(pred_category <> 9 AS INT) AS pred_attack
FROM flows WHERE {_LAST}""", "flows"))
def stream_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last_n(spark, sf_dir)


def _last_n(spark: SparkSession, sf_dir: str, n: int = 200) -> DataFrame:
    path = work_path(spark, "last-n")
    _drained(_scored(spark, sf_dir), "flow_id", windows.keep_last_n(path, n, "flow_id", "category", _PREDICTIONS))
    return sinks.latest_epoch(spark, f"{path}/window")


def _matrix_sql(condition: str) -> str:
    return f"""
SELECT p.predictor, c.category, count(f.flow_id) FILTER (WHERE f.pred = 0) AS normal,
  count(f.flow_id) FILTER (WHERE f.pred = 1) AS attack
FROM (SELECT unnest(['pred_binary', 'pred_attack']) AS predictor) p
CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS category) c
LEFT JOIN (SELECT * FROM ({_LONG_SQL}) l WHERE {condition}) f ON f.category = c.category AND f.predictor = p.predictor
GROUP BY p.predictor, c.category"""


@query("stream_confusion", oracle(_matrix_sql("true"), "flows"))
def stream_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "confusion")
    _drained(_scored(spark, sf_dir), "flow_id", sinks.write_newest(path),
             lambda stream: windows.confusion_stream(stream, "category", _PREDICTIONS), "complete", _COUNT_STORES)
    return windows.zero_filled(sinks.latest_epoch(spark, path))


@query("stream_confusion_last_n", oracle(_matrix_sql(_LAST), "flows"))
def stream_confusion_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_confusion(_last_n(spark, sf_dir), "category", _PREDICTIONS)


@query("stream_confusion_windowed", oracle(f"""
SELECT date_trunc('hour', ts) AS window_start, predictor, category, pred, count(*) AS n FROM ({_LONG_SQL}) l
GROUP BY ALL""", "flows"))
def stream_confusion_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "confusion-windows")
    _drained(_scored(spark, sf_dir), "flow_id", lambda batch, epoch: sinks.write_epoch(batch, path, epoch),
             lambda stream: windows.windowed_confusion_stream(stream, "ts", "category", _PREDICTIONS), "update", _COUNT_STORES)
    keys = ["window_start", "predictor", "category", "pred"]
    newest = sinks.last_value_per_key(sinks.read_epochs(spark, path), keys, "n")
    return newest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_score")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted reducer and two fitted trees applied to arriving rows."""
    data = matrix(spark, sf_dir)
    train = data.where("split = 'train'")
    scorer = scoring.FlowScorer.fit(linear.PcaReducer(2).fit(train), train)
    path = work_path(spark, "scored-stream")
    _drained(data, "row_id", lambda batch, epoch: sinks.write_epoch(batch, path, epoch), lambda stream: scorer.transform(
        stream).select("row_id", "label", "x", "y", "cats_ae_pred", "original_pred"))
    return sinks.read_epochs(spark, path).drop("epoch")


@query("stream_score_rule", f"""{SEASONS.replace("CAST(least", "month(o_orderdate) AS m, CAST(least")}
SELECT row_id, CAST(category <> 9 AS INT) AS label, {round_sql("m - (SELECT avg(m) FROM seasons WHERE split = 'train')", "x")}, 0.0::DOUBLE AS y,
  CAST(category <> 9 AS INT) AS cats_ae_pred, CAST(category <> 9 AS INT) AS original_pred FROM seasons""")
def stream_score_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving orders whose class follows from the month: the map is the month, and neither tree may err."""
    data = seasons(spark, sf_dir)
    train = data.where("split = 'train'")
    scorer = scoring.FlowScorer.fit(linear.PcaReducer(2).fit(train), train)
    path = work_path(spark, "scored-stream")
    _drained(data, "row_id", lambda batch, epoch: sinks.write_epoch(batch, path, epoch), lambda stream: scorer.transform(
        stream).select("row_id", "label", "x", "y", "cats_ae_pred", "original_pred"))
    return rounded(sinks.read_epochs(spark, path).drop("epoch"), ["x", "y"])


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flow_map(spark, sf_dir)
    train = base.where("split = 'train'").select("x", "y", "category")
    model = EpsNeighbourClassifier().fit(train).store(EPS, work_path(spark, "neighbours"))
    path = work_path(spark, "explained")
    _drained(base.where("split = 'test'").drop("split"), "flow_id", scoring.explain_batches(model, EPS, path, list(range(10))))
    return sinks.read_epochs(spark, path).drop("epoch")


@query("stream_explain", oracle(f"""
SELECT flow_id, category, predicted, neighbours, {round_sql(f'neighbours / {EPS}::DOUBLE', 'density')} FROM ({_BEST}) b""",
                                "flow_map"))
def stream_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_explained(spark, sf_dir), ["density"]).select(
        "flow_id", "category", "predicted", "neighbours", "density")


@query("stream_static_enrich", oracle("""
SELECT q.flow_id, """ + ", ".join(
    round_sql(f"coalesce(count(t.category) FILTER (WHERE t.category = {c})::DOUBLE / nullif(count(t.category), 0), 0)",
              f"p_{c}") for c in range(10)) + f"""
FROM (SELECT * FROM flow_map WHERE split = 'test') q LEFT JOIN (SELECT * FROM flow_map WHERE split = 'train') t
  ON t.x BETWEEN q.x - {EPS * 1.01} AND q.x + {EPS * 1.01}
  AND (t.x - q.x) * (t.x - q.x) + (t.y - q.y) * (t.y - q.y) <= {EPS}::DOUBLE * {EPS}::DOUBLE
GROUP BY q.flow_id""", "flow_map"))
def stream_static_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of arriving flows from the static training points."""
    return _explained(spark, sf_dir).select("flow_id", *[r6(f"p_{c}").alias(f"p_{c}") for c in range(10)])
