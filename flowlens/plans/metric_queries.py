"""Aggregates, classification and clustering metrics, score tables and rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions import vectors
from flowlens.operators import classification as cls, clustering as clu, rolling, scale, scores
from flowlens.operators.encode import distinct_values
from flowlens.plans.registry import query, r6, round_sql, rounded
from flowlens.plans.tables import flows, matrix, oracle, table
from flowlens.session import work_path

_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_minmax", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {round_sql(f'min({c})', 'lo')}, {round_sql(f'max({c})', 'hi')} FROM lineitem"
    for c in _LINE_FEATURES))
def feature_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scale.minmax_stats(table(spark, sf_dir, "lineitem"), _LINE_FEATURES), ["lo", "hi"])


@query("domain_values", oracle("\nUNION ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM flows WHERE {c} IS NOT NULL"
    for c in ("proto", "state", "service", "attack_cat", "gold_category")), "flows"))
def domain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(flows(spark, sf_dir), ["proto", "state", "service", "attack_cat", "gold_category"])


# ---- classification ---------------------------------------------------------------------------

_BINARY = """
SELECT split, count(*) FILTER (WHERE t = 0 AND p = 0) AS tn, count(*) FILTER (WHERE t = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE t = 1 AND p = 0) AS fn, count(*) FILTER (WHERE t = 1 AND p = 1) AS tp
FROM (SELECT split, CAST(label AS INT) AS t, pred_binary AS p FROM flows) x GROUP BY split"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("split", F.col("label").cast("int").alias("t"), F.col("pred_binary").alias("p"))


@query("binary_confusion", oracle(_BINARY, "flows"))
def binary_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cls.binary_confusion(_verdicts(spark, sf_dir), "t", "p", ["split"])


_BINARY_METRICS = f"""
SELECT split, {round_sql('(tp + tn)::DOUBLE / (tp + tn + fp + fn)', 'accuracy')},
  {round_sql('precision', 'precision')}, {round_sql('recall', 'recall')},
  {round_sql('CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END', 'f1')},
  {round_sql('(fp::DOUBLE / nullif(fp + tn, 0) + fn::DOUBLE / nullif(fn + tp, 0)) / 2', 'far')}
FROM (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM ({_BINARY}) b) m"""


@query("binary_metrics", oracle(_BINARY_METRICS, "flows"))
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cls.binary_metrics(_verdicts(spark, sf_dir), "t", "p", ["split"]),
                   ["accuracy", "precision", "recall", "f1", "far"])


@query("category_confusion", oracle("""
SELECT c.category, count(f.flow_id) FILTER (WHERE f.pred_binary = 0) AS normal,
  count(f.flow_id) FILTER (WHERE f.pred_binary = 1) AS attack
FROM (SELECT CAST(unnest(range(10)) AS INT) AS category) c
LEFT JOIN flows f ON f.gold_category = c.category GROUP BY c.category""", "flows"))
def category_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cls.category_confusion(flows(spark, sf_dir), "gold_category", "pred_binary")


_CLASSES = """
SELECT split, class, CAST(row_number() OVER (PARTITION BY split ORDER BY class) - 1 AS INT) AS dense_position, tp, support, predicted,
  coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
  coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0) AS f1
FROM (SELECT split, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(support) AS BIGINT) AS support,
    CAST(sum(predicted) AS BIGINT) AS predicted
  FROM (SELECT split, gold_category AS class, CAST(gold_category = pred_category AS INT) AS tp, 1 AS support, 0 AS predicted
    FROM flows UNION ALL SELECT split, pred_category, 0, 0, 1 FROM flows) u GROUP BY split, class) c"""


@query("per_class_metrics", oracle(f"""
SELECT split, class, dense_position, tp, support, predicted, {round_sql('precision', 'precision')},
  {round_sql('recall', 'recall')}, {round_sql('f1', 'f1')} FROM ({_CLASSES}) m""", "flows"))
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cls.per_class_metrics(flows(spark, sf_dir), "gold_category", "pred_category", ["split"]),
                   ["precision", "recall", "f1"])


@query("averaged_metrics", oracle(f"""
SELECT split, {round_sql('sum(tp)::DOUBLE / sum(support)', 'accuracy')}, {round_sql('avg(f1)', 'f1_macro')},
  {round_sql('2.0::DOUBLE * sum(tp) / (sum(support) + sum(predicted))', 'f1_micro')},
  {round_sql('avg(precision)', 'precision_macro')}, {round_sql('sum(tp)::DOUBLE / sum(predicted)', 'precision_micro')},
  {round_sql('avg(recall)', 'recall_macro')}, {round_sql('sum(tp)::DOUBLE / sum(support)', 'recall_micro')}
FROM ({_CLASSES}) m GROUP BY split""", "flows"))
def averaged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cls.averaged_metrics(flows(spark, sf_dir), "gold_category", "pred_category", ["split"]), cls.AVERAGES)


def _indicator_sql(truth: str, pred: str, source: str) -> str:
    """The battery over 10 indicator cells per row, as DuckDB SQL."""
    return f"""
SELECT split, max(acc) AS accuracy, {round_sql('avg(f1)', 'f1_macro')},
  {round_sql('coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(sup) + sum(prd), 0), 0)', 'f1_micro')},
  {round_sql('avg(pre)', 'precision_macro')}, {round_sql('coalesce(sum(tp)::DOUBLE / nullif(sum(prd), 0), 0)', 'precision_micro')},
  {round_sql('avg(rec)', 'recall_macro')}, {round_sql('coalesce(sum(tp)::DOUBLE / nullif(sum(sup), 0), 0)', 'recall_micro')}
FROM (SELECT split, c, max(acc) AS acc, sum(tp) AS tp, sum(sup) AS sup, sum(prd) AS prd,
    coalesce(sum(tp)::DOUBLE / nullif(sum(prd), 0), 0) AS pre, coalesce(sum(tp)::DOUBLE / nullif(sum(sup), 0), 0) AS rec,
    coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(sup) + sum(prd), 0), 0) AS f1
  FROM (SELECT split, c, CAST({truth} = c AND {pred} = c AS INT) AS tp, CAST({truth} = c AS INT) AS sup,
      CAST({pred} = c AS INT) AS prd,
      round(avg(CAST({truth} = {pred} AS INT)::DOUBLE) OVER (PARTITION BY split), 6) + 0.0::DOUBLE AS acc
    FROM ({source}) s, (SELECT unnest(range(10)) AS c) k) x GROUP BY split, c) m GROUP BY split"""


@query("indicator_metrics", oracle(_indicator_sql("gold_category", "pred_category", "SELECT * FROM flows"), "flows"))
def indicator_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir).select(
        "split", vectors.one_hot_of(F.col("gold_category"), 10).alias("truth"),
        vectors.one_hot_of(F.col("pred_category"), 10).alias("pred"),
    )
    return rounded(cls.indicator_metrics(base, "truth", "pred", 10, ["split"]), cls.AVERAGES)


_SCORES_LIST = "[" + ", ".join(f"features[{i}]" for i in range(1, 11)) + "]"


@query("own_metrics", oracle(_indicator_sql("category", "best", f"""
SELECT split, category, list_position(s, list_max(s)) - 1 AS best
FROM (SELECT split, category, {_SCORES_LIST} AS s FROM matrix) x"""), "matrix"))
def own_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors (here the first ten features) to one-hot predictions to the indicator battery."""
    base = matrix(spark, sf_dir).select(
        "split", vectors.one_hot_of(F.col("category"), 10).alias("truth"),
        vectors.one_hot_of(vectors.argmax(F.slice("features", 1, 10)), 10).alias("pred"),
    )
    return rounded(cls.indicator_metrics(base, "truth", "pred", 10, ["split"]), cls.AVERAGES)


# ---- clustering -------------------------------------------------------------------------------

_CELLS = """
SELECT split, t, p, n, CAST(sum(n) OVER (PARTITION BY split, t) AS BIGINT) AS a,
  CAST(sum(n) OVER (PARTITION BY split, p) AS BIGINT) AS b
FROM (SELECT split, gold_category AS t, pred_category AS p, count(*) AS n FROM flows GROUP BY ALL) g"""

_SUMS = f"""
SELECT s.*, A.pa, B.pb, A.ht, B.hp FROM
 (SELECT split, sum(n)::DOUBLE AS n, sum(n::DOUBLE * (n - 1) / 2) AS s,
    sum(n / tot * ln(n * tot / (a::DOUBLE * b))) AS mi
  FROM (SELECT *, sum(n::DOUBLE) OVER (PARTITION BY split) AS tot FROM ({_CELLS}) c) d GROUP BY split) s
 JOIN (SELECT split, sum(a::DOUBLE * (a - 1) / 2) AS pa, -sum(a / tot * ln(a / tot)) AS ht
   FROM (SELECT *, sum(a::DOUBLE) OVER (PARTITION BY split) AS tot FROM (SELECT DISTINCT split, t, a FROM ({_CELLS}) c) d) e
   GROUP BY split) A USING (split)
 JOIN (SELECT split, sum(b::DOUBLE * (b - 1) / 2) AS pb, -sum(b / tot * ln(b / tot)) AS hp
   FROM (SELECT *, sum(b::DOUBLE) OVER (PARTITION BY split) AS tot FROM (SELECT DISTINCT split, p, b FROM ({_CELLS}) c) d) e
   GROUP BY split) B USING (split)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clu.contingency(flows(spark, sf_dir), "gold_category", "pred_category", ["split"])


@query("contingency", oracle(_CELLS, "flows"))
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query("adjusted_rand", oracle(f"""
SELECT split, {round_sql('(s - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2))', 'value')}
FROM ({_SUMS}) m""", "flows"))
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = clu.agreement_sums(_cells(spark, sf_dir), ["split"])
    return sums.select("split", r6(clu.adjusted_rand(sums)).alias("value"))


@query("adjusted_mutual_info", oracle(f"""
SELECT split, {round_sql('(mi - e) / ((ht + hp) / 2 - e)', 'adjusted_mutual_info')}
FROM ({_SUMS}) m JOIN (
  SELECT split, sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1)
    + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1)
    - lgamma(n - a - b + k + 1))) AS e
  FROM (SELECT ta.split, n::DOUBLE AS n, a::DOUBLE AS a, b::DOUBLE AS b,
      unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1))::DOUBLE AS k
    FROM (SELECT DISTINCT split, t, a FROM ({_CELLS}) c) ta JOIN (SELECT DISTINCT split, p, b FROM ({_CELLS}) c) tb
      USING (split) JOIN (SELECT split, count(*) AS n FROM flows GROUP BY split) tn USING (split)) q
  GROUP BY split) x USING (split)""", "flows"))
def adjusted_mutual_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    sums = clu.with_expected(clu.agreement_sums(cells, ["split"]), cells, ["split"])
    return sums.select("split", r6(clu.adjusted_mutual_info(sums)).alias("adjusted_mutual_info"))


@query("homogeneity_completeness_v", oracle(f"""
SELECT split, {round_sql('mi / ht', 'homogeneity')}, {round_sql('mi / hp', 'completeness')},
  {round_sql('2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp)', 'v_measure')} FROM ({_SUMS}) m""", "flows"))
def homogeneity_completeness_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = clu.agreement_sums(_cells(spark, sf_dir), ["split"])
    h, c = clu.homogeneity(sums), clu.completeness(sums)
    return sums.select("split", r6(h).alias("homogeneity"), r6(c).alias("completeness"),
                       r6(clu.v_measure(h, c)).alias("v_measure"))


@query("fowlkes_mallows", oracle(f"SELECT split, {round_sql('s / sqrt(pa * pb)', 'value')} FROM ({_SUMS}) m", "flows"))
def fowlkes_mallows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = clu.agreement_sums(_cells(spark, sf_dir), ["split"])
    return sums.select("split", r6(clu.fowlkes_mallows(sums)).alias("value"))


@query("silhouette", oracle(f"""
SELECT {round_sql('avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')}
FROM (SELECT i, max(n) AS n, max(a) AS a, min(b) AS b FROM (
  SELECT i, CASE WHEN ci = cj THEN s / nullif(n - 1, 0) END AS a, CASE WHEN ci <> cj THEN s / n END AS b,
    CASE WHEN ci = cj THEN n END AS n
  FROM (SELECT x.row_id AS i, x.category AS ci, y.category AS cj, count(*) AS n,
      sum(list_distance(x.features, y.features)) AS s
    FROM matrix x, matrix y GROUP BY ALL) d) e GROUP BY i) f""", "matrix"))
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clu.silhouette(matrix(spark, sf_dir), "features", "category", "row_id"), ["silhouette"])


@query("calinski_harabasz", oracle(f"""
SELECT {round_sql('(sum(bd) / (max(k) - 1)) / (sum(wd) / (max(n) - max(k)))', 'calinski_harabasz')}
FROM (SELECT dim, count(*) AS k, sum(nc) AS n, sum(nc * (m - gm) * (m - gm)) AS bd, sum(w) AS wd
  FROM (SELECT category, dim, count(*) AS nc, avg(v) AS m, var_pop(v) * count(*) AS w, any_value(gm) AS gm
    FROM (SELECT *, avg(v) OVER (PARTITION BY dim) AS gm
      FROM (SELECT category, unnest(range(64)) AS dim, unnest(features) AS v FROM matrix) u) g
    GROUP BY category, dim) c GROUP BY dim) d""", "matrix"))
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clu.calinski_harabasz(matrix(spark, sf_dir), "features", "category"), ["calinski_harabasz"])


# ---- score tables -----------------------------------------------------------------------------

# three runs and two feature spaces of predictions, made by shifting the threshold of one column
_RUNS_SQL = """
SELECT run, space, split, CAST(label AS INT) AS t, CASE WHEN sbytes > 5 * run + s * 4 THEN 1 ELSE 0 END AS p
FROM flows, (SELECT unnest([1, 2, 3]) AS run) r,
  (SELECT unnest([0, 1]) AS s, unnest(['original', 'reduced']) AS space) q"""

_SCORES_SQL = f"""
SELECT run, 'threshold' AS classifier, 'binary' AS task, space, split, metric, value
FROM (UNPIVOT (
  SELECT run, space, split, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)::DOUBLE AS precision,
    coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)::DOUBLE AS recall,
    coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1,
    ((fp::DOUBLE / nullif(fp + tn, 0) + fn::DOUBLE / nullif(fn + tp, 0)) / 2)::DOUBLE AS far
  FROM (SELECT run, space, split, count(*) FILTER (WHERE t = 0 AND p = 0) AS tn,
      count(*) FILTER (WHERE t = 0 AND p = 1) AS fp, count(*) FILTER (WHERE t = 1 AND p = 0) AS fn,
      count(*) FILTER (WHERE t = 1 AND p = 1) AS tp FROM ({_RUNS_SQL}) r GROUP BY ALL) b)
  ON accuracy, precision, recall, f1, far INTO NAME metric VALUE value) u"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.array(*[F.lit(i) for i in (1, 2, 3)])
    spaces = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(n).alias("space"))
                       for i, n in enumerate(("original", "reduced"))])
    predictions = (
        flows(spark, sf_dir).select("split", "sbytes", F.col("label").cast("int").alias("t"))
        .withColumn("run", F.explode(runs)).select("*", F.inline(spaces))
        .withColumn("p", (F.col("sbytes") > 5 * F.col("run") + F.col("s") * 4).cast("int"))
    )
    return cls.binary_scores(predictions, "t", "p", ["run", "space", "split"]).select(
        "run", F.lit("threshold").alias("classifier"), F.lit("binary").alias("task"), "space", "split", "metric", "value")


@query("run_aggregate", oracle(f"""
SELECT classifier, task, space, split, metric, {round_sql('max(value) - min(value)', 'spread')}
FROM ({_SCORES_SQL}) s GROUP BY ALL""", "flows"))
def run_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = scores.run_aggregate(_scores(spark, sf_dir), lambda v: F.max(v) - F.min(v), "spread")
    return rounded(folded, ["spread"])


@query("run_mean_std", oracle(f"""
SELECT classifier, task, space, split, metric, {round_sql('avg(value)', 'mean')}, {round_sql('stddev_pop(value)', 'std')}
FROM ({_SCORES_SQL}) s GROUP BY classifier, task, space, split, metric""", "flows"))
def run_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores.run_mean_std(_scores(spark, sf_dir)), ["mean", "std"])


_WIDE_SQL = f"""
SELECT classifier, task, metric,
  {round_sql("max(m) FILTER (WHERE space = 'original' AND split = 'test')", 'original')},
  {round_sql("max(m) FILTER (WHERE space = 'original' AND split = 'val')", 'original_val')},
  {round_sql("max(m) FILTER (WHERE space = 'original' AND split = 'train')", 'original_train')},
  {round_sql("max(m) FILTER (WHERE space = 'reduced' AND split = 'test')", 'reduced')},
  {round_sql("max(m) FILTER (WHERE space = 'reduced' AND split = 'val')", 'reduced_val')},
  {round_sql("max(m) FILTER (WHERE space = 'reduced' AND split = 'train')", 'reduced_train')}
FROM (SELECT classifier, task, space, split, metric, avg(value) AS m FROM ({_SCORES_SQL}) s GROUP BY ALL) a
GROUP BY classifier, task, metric"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = scores.run_mean_std(_scores(spark, sf_dir))
    return rounded(scores.score_table_wide(means, "mean"), scores.SCORE_COLUMNS)


@query("score_table_wide", oracle(_WIDE_SQL, "flows"))
def score_table_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


@query("score_report_sink", oracle(f"{_WIDE_SQL} ORDER BY metric", "flows"))
def score_report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as a table and read back."""
    path = work_path(spark, "report")
    scores.sort_metrics(_wide(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


@query("sort_metrics", oracle(f"""
SELECT run, space, split, metric, {round_sql('value', 'value')} FROM ({_SCORES_SQL}) s ORDER BY metric""", "flows"))
def sort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _scores(spark, sf_dir).select("run", "space", "split", "metric", r6("value").alias("value"))
    return scores.sort_metrics(long)


# ---- rolling windows --------------------------------------------------------------------------

@query("last_n_window", oracle(f"""
SELECT flow_id, count(*) OVER w AS n, min(flow_id) OVER w AS first_flow, {round_sql('max(sbytes) OVER w', 'max_sbytes')},
  CAST(sum(pred_binary) OVER w AS BIGINT) AS attacks
FROM flows WINDOW w AS (ORDER BY flow_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""", "flows"))
def last_n_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.last_n(flows(spark, sf_dir), "flow_id", 200, {
        "n": F.count(F.lit(1)), "first_flow": F.min("flow_id"), "max_sbytes": F.max("sbytes"),
        "attacks": F.sum("pred_binary"),
    }), ["max_sbytes"])


@query("rolling_category_confusion", oracle("SELECT flow_id, " + ", ".join(
    f"CAST(sum(CAST(gold_category = {c} AND pred_binary = {v} AS INT)) OVER w AS BIGINT) AS c{c}_{v}"
    for c in range(10) for v in (0, 1)) + """
FROM flows WINDOW w AS (ORDER BY flow_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""", "flows"))
def rolling_category_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_category_confusion(flows(spark, sf_dir), "flow_id", "gold_category", "pred_binary")
