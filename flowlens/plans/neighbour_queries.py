"""Joins and neighbourhood queries on the flow map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators import neighbours
from flowlens.plans.registry import query, r6, round_sql, rounded
from flowlens.plans.tables import EPS, flow_map, flows, oracle

_PAIRS = f"""
SELECT q.flow_id, t.category AS label, count(*) AS n
FROM (SELECT * FROM flow_map WHERE split = 'test') q JOIN (SELECT * FROM flow_map WHERE split = 'train') t
  ON t.x BETWEEN q.x - {EPS * 1.01} AND q.x + {EPS * 1.01}
  AND (t.x - q.x) * (t.x - q.x) + (t.y - q.y) * (t.y - q.y) <= {EPS}::DOUBLE * {EPS}::DOUBLE
GROUP BY q.flow_id, t.category"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = flow_map(spark, sf_dir)
    return base.where("split = 'test'").drop("split"), base.where("split = 'train'").select("x", "y", "category")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _parts(spark, sf_dir)
    return neighbours.eps_label_counts(test, train, EPS, label="category")


def _explained(spark: SparkSession, sf_dir: str, labels: list[int] | None = None) -> DataFrame:
    test, train = _parts(spark, sf_dir)
    return neighbours.EpsNeighbourClassifier().fit(train).explain(test, EPS, labels)


@query("eps_range_join", oracle(_PAIRS, "flow_map"))
def eps_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training flows within the radius of every test flow, counted per category."""
    return _counts(spark, sf_dir)


@query("neighbour_histogram", oracle(f"""
SELECT flow_id, label, n, {round_sql('n::DOUBLE / sum(n) OVER (PARTITION BY flow_id)', 'probability')}
FROM ({_PAIRS}) p""", "flow_map"))
def neighbour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.neighbour_histogram(_counts(spark, sf_dir)), ["probability"])


_BEST = f"""
SELECT q.flow_id, q.category, coalesce(p.predicted, -1) AS predicted, coalesce(p.neighbours, 0) AS neighbours
FROM (SELECT * FROM flow_map WHERE split = 'test') q LEFT JOIN (
  SELECT flow_id, CAST(arg_max(label, n * 100 - label) AS INT) AS predicted, CAST(sum(n) AS BIGINT) AS neighbours
  FROM ({_PAIRS}) h GROUP BY flow_id) p ON p.flow_id = q.flow_id"""


@query("visual_predict", oracle(f"SELECT flow_id, category, predicted FROM ({_BEST}) b", "flow_map"))
def visual_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).select("flow_id", "category", "predicted")


@query("neighbour_density", oracle(f"""
SELECT flow_id, neighbours, {round_sql(f'neighbours / {EPS}::DOUBLE', 'density')},
  {round_sql(f'{EPS}::DOUBLE / nullif(neighbours, 0)', 'outlierness')} FROM ({_BEST}) b""", "flow_map"))
def neighbour_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _explained(spark, sf_dir).select("flow_id", "neighbours", "density", "outlierness")
    return rounded(out, ["density", "outlierness"])


@query("explain_flows", oracle(f"""
SELECT b.flow_id, b.category, b.predicted, b.neighbours, {round_sql(f'b.neighbours / {EPS}::DOUBLE', 'density')},
  b.predicted = b.category AS visual_ok, """ + ", ".join(
    round_sql(f"coalesce(h.n{c}::DOUBLE / b.neighbours, 0)", f"p_{c}") for c in range(10)) + f"""
FROM ({_BEST}) b LEFT JOIN (SELECT flow_id, """ + ", ".join(
    f"coalesce(sum(n) FILTER (WHERE label = {c}), 0) AS n{c}" for c in range(10)) + f"""
  FROM ({_PAIRS}) p GROUP BY flow_id) h ON h.flow_id = b.flow_id""", "flow_map"))
def explain_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is every test flow most like? Class probabilities, prediction and density of its neighbourhood."""
    labels = list(range(10))
    out = _explained(spark, sf_dir, labels).withColumn("visual_ok", F.col("predicted") == F.col("category"))
    return rounded(out, ["density", *[f"p_{c}" for c in labels]]).select(
        "flow_id", "category", "predicted", "neighbours", "density", "visual_ok", *[f"p_{c}" for c in labels])


@query("align_by_row", oracle("""
SELECT t.flow_id, t.gold_category AS truth, p.pred_category AS prediction FROM flows t JOIN flows p USING (flow_id)""",
                              "flows"))
def align_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and predictions come as two tables and meet on the row id."""
    truth = flows(spark, sf_dir).select("flow_id", F.col("gold_category").alias("truth"))
    predictions = flows(spark, sf_dir).select("flow_id", F.col("pred_category").alias("prediction"))
    return truth.join(predictions, "flow_id")


@query("lookup_flow", oracle(f"""
SELECT f.flow_id, f.gold_category, f.pred_binary, {round_sql('f.dur', 'x')}, {round_sql('f.sbytes', 'y')}
FROM flows f JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'error') s ON s.event_id = f.flow_id""", "flows"))
def lookup_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of selected flow numbers against the scored rows."""
    selected = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select(
        F.col("event_id").alias("flow_id"))
    return flows(spark, sf_dir).join(selected, "flow_id").select(
        "flow_id", "gold_category", "pred_binary", r6("dur").alias("x"), r6("sbytes").alias("y"))
