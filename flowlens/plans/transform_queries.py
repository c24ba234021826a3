"""Scans, projections, encodings, splits and scalings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions import cleaning, codes, vectors
from flowlens.operators import encode, scale, split
from flowlens.plans.registry import query, r6, round_sql, rounded
from flowlens.plans.tables import CLEAN_CATEGORY, RATE, capture, flows, matrix, oracle, points, table
from flowlens.schema import ATTACK_CATEGORIES, CAPTURE_COLUMNS, CATEGORY_LABELS, MODEL_COLUMNS, NUMERIC_COLUMNS
from flowlens.session import work_path
from flowlens.sources import capture as files, stores

_QUOTED = {"Stime": '"Stime"', "Ltime": '"Ltime"'}
_NAMES = "[" + ", ".join(f"'{c}'" for c in ATTACK_CATEGORIES) + "]"
_LABELS = "[" + ", ".join(f"'{c}'" for c in CATEGORY_LABELS) + "]"


# ---- scans ------------------------------------------------------------------------------------

@query("scan_capture", oracle(f"SELECT {', '.join(_QUOTED.get(c, c) for c in CAPTURE_COLUMNS)} FROM capture", "capture"))
def scan_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four headerless CSV parts read back as one table."""
    path = work_path(spark, "capture")
    source = capture(spark, sf_dir)
    part = F.pmod(F.col("stcpb"), F.lit(4)).cast("int")
    (source.select(*CAPTURE_COLUMNS, part.alias("part")).write.partitionBy("part")
     .options(header=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    return files.scan_capture(spark, [f"{path}/part={i}" for i in range(4)])


@query("scan_labelled", oracle(f"SELECT {', '.join(MODEL_COLUMNS)} FROM capture", "capture"))
def scan_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with a header, extra columns, another column order and blanks in one name."""
    path = work_path(spark, "labelled")
    source = capture(spark, sf_dir).withColumnRenamed("dinpkt", "   dinpkt")
    files.write_labelled(source.select(*reversed(source.columns)), path)
    return files.scan_labelled(spark, path)


@query("assign_roles", """
SELECT 'named_test' AS file, count(*) FILTER (WHERE event_id % 5 <> 0) AS rows, 'train' AS role FROM events
UNION ALL SELECT 'named_train', count(*) FILTER (WHERE event_id % 5 = 0), 'test' FROM events""")
def assign_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir)
    return files.assign_roles({
        "named_test": base.where("split <> 'test'"), "named_train": base.where("split = 'test'"),
    })


# ---- projections and scalar transforms ----------------------------------------------------------

@query("prune_columns", oracle(f"SELECT {', '.join(MODEL_COLUMNS)} FROM capture", "capture"))
def prune_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.prune_columns(capture(spark, sf_dir))


@query("clean_category", oracle(f"SELECT flow_id, {CLEAN_CATEGORY} AS attack_cat FROM flows", "flows"))
def clean_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_category(flows(spark, sf_dir)).select("flow_id", "attack_cat")


@query("derive_rate", oracle(f"SELECT flow_id, {round_sql(RATE, 'rate')} FROM flows", "flows"))
def derive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", r6(cleaning.rate()).alias("rate"))


@query("blank_to_null_cast", oracle("""
SELECT flow_id, CASE WHEN NOT regexp_matches(ct_ftp_cmd, '\\s') THEN CAST(ct_ftp_cmd AS DOUBLE) END AS ct_ftp_cmd
FROM flows""", "flows"))
def blank_to_null_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", cleaning.blank_to_null().alias("ct_ftp_cmd"))


@query("fill_nulls", oracle("""
SELECT flow_id, coalesce(service, '0') AS service, coalesce(attack_cat, '0') AS attack_cat,
  coalesce(CASE WHEN NOT regexp_matches(ct_ftp_cmd, '\\s') THEN CAST(ct_ftp_cmd AS DOUBLE) END, 0) AS ct_ftp_cmd
FROM flows""", "flows"))
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir).withColumn("ct_ftp_cmd", cleaning.blank_to_null())
    return cleaning.fill_nulls(base.select("flow_id", "service", "attack_cat", "ct_ftp_cmd"))


@query("select_family", oracle("""
SELECT flow_id, 'categorical' AS family, concat_ws('|', proto, state, service, attack_cat, label) AS content FROM flows
UNION ALL
SELECT flow_id, 'numeric', concat_ws('|', spkts, dpkts, label) FROM flows""", "flows"))
def select_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir).select("flow_id", "proto", "state", "service", "spkts", "dpkts", "attack_cat", "label")

    def content(family: str) -> DataFrame:
        part = cleaning.select_family(base, family, keep=("flow_id",))
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in part.columns if c != "flow_id"])
        return part.select("flow_id", F.lit(family).alias("family"), text.alias("content"))

    return content("categorical").unionByName(content("numeric"))


_PROTO, _STATE = ["arp", "tcp", "udp"], ["CON", "FIN", "INT"]


def _indicators_sql(column: str, values: list[str]) -> str:
    return ", ".join(
        f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS {column}_{v}" for v in values
    )


@query("one_hot_encode", oracle(
    f"SELECT flow_id, dur, sbytes, {_indicators_sql('proto', _PROTO)}, {_indicators_sql('state', _STATE)}, "
    f"{_indicators_sql('service', ['click', 'error', 'purchase', 'signup', 'view'])} FROM flows", "flows"))
def one_hot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir)
    model = encode.FlowEncoder(["proto", "state", "service"], ["dur", "sbytes"]).fit(base)
    return model.transform_wide(base, keep=["flow_id"])


@query("align_domain", oracle(
    f"SELECT flow_id, {_indicators_sql('proto', ['tcp', 'udp'])}, {_indicators_sql('state', ['CON', 'FIN'])} "
    "FROM flows", "flows"))
def align_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of a capture without ``arp`` and ``INT`` imposed on all flows."""
    base = flows(spark, sf_dir)
    model = encode.FlowEncoder(["proto", "state"], []).fit(base.where("proto <> 'arp' AND state <> 'INT'"))
    return model.transform_wide(base, keep=["flow_id"])


_BLOCK_SQL = " || ".join(
    [f"CASE WHEN c = '{c}' THEN '1' ELSE '0' END" for c in ATTACK_CATEGORIES]
    + ["CASE WHEN label = '0' THEN '1' ELSE '0' END"]
)


@query("split_feature_label", oracle(f"""
SELECT flow_id, dur AS f0, sbytes AS f1, CASE WHEN proto = 'arp' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f2,
  CASE WHEN proto = 'tcp' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f3,
  CASE WHEN proto = 'udp' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f4,
  {_BLOCK_SQL} AS category_block, CAST(label AS INT) AS label
FROM (SELECT *, coalesce({CLEAN_CATEGORY}, '') AS c FROM flows) x""", "flows"))
def split_feature_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = cleaning.clean_category(flows(spark, sf_dir))
    model = encode.FlowEncoder(["proto", "attack_cat", "label"], ["dur", "sbytes"]).fit(base)
    cut = encode.split_feature_label(base, model, keep=["flow_id"])
    return cut.select(
        "flow_id", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(5)],
        F.array_join(F.col("category_block").cast("array<string>"), "").alias("category_block"), "label",
    )


@query("category_number", oracle(f"""
SELECT flow_id, CAST(CASE WHEN list_position({_NAMES}, c) > 0 THEN list_position({_NAMES}, c) - 1
  WHEN label = '0' THEN 9 ELSE 0 END AS INT) AS category
FROM (SELECT *, {CLEAN_CATEGORY} AS c FROM flows) x""", "flows"))
def category_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = cleaning.clean_category(flows(spark, sf_dir))
    return base.select("flow_id", vectors.argmax(encode.category_block()).alias("category"))


@query("minmax_scale", oracle(f"""
SELECT flow_id, split, {round_sql("(dur - d0) / (d1 - d0)", 'dur')}, {round_sql("(sbytes - s0) / (s1 - s0)", 'sbytes')},
  {round_sql("CAST(spkts - p0 AS DOUBLE) / (p1 - p0)", 'spkts')}
FROM flows, (SELECT min(dur) d0, max(dur) d1, min(sbytes) s0, max(sbytes) s1, min(spkts) p0, max(spkts) p1
  FROM flows) m""", "flows"))
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir)
    scaler = scale.ColumnScaler.fit(base, ["dur", "sbytes", "spkts"])
    return base.select("flow_id", "split", *[r6(scaler.column(c)).alias(c) for c in scaler.bounds])


@query("joint_scale", oracle(f"""
SELECT vec_id, split, {round_sql("(x0 - a) / (b - a)", 'x0')}, {round_sql("(y0 - c) / (d - c)", 'y0')}
FROM points, (SELECT min(x0) a, max(x0) b, min(y0) c, max(y0) d FROM points) m""", "points"))
def joint_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = points(spark, sf_dir)
    test, train = base.where("split = 'test'"), base.where("split = 'train'")
    scaler = scale.ColumnScaler.fit_joint([test, train], ["x0", "y0"])
    both = scaler.transform(test).unionByName(scaler.transform(train))
    return rounded(both, ["x0", "y0"]).select("vec_id", "split", "x0", "y0")


@query("random_split", oracle("""
SELECT flow_id, CASE WHEN (flow_id * 2654435761) % 4294967296 % 100 < 20 THEN 'val' ELSE 'train' END AS part
FROM flows""", "flows"))
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multiplicative hash both engines have; ``split.hash_bucket`` is the library default."""
    bucket = F.expr("(flow_id * 2654435761) % 4294967296 % 100")
    return split.random_split(flows(spark, sf_dir), bucket, 20, "part").select("flow_id", "part")


@query("assign_index", oracle("""
SELECT flow_id, row_number() OVER (ORDER BY sbytes, flow_id) - 1 AS index FROM flows""", "flows"))
def assign_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.assign_index(flows(spark, sf_dir).select("flow_id", "sbytes"), ["sbytes", "flow_id"]).select(
        "flow_id", "index")


@query("positional_slice", oracle("""
SELECT flow_id, 'head' AS slice FROM flows WHERE flow_id < 100
UNION ALL SELECT flow_id, 'row' FROM flows WHERE flow_id = 50
UNION ALL SELECT flow_id, 'tail' FROM flows WHERE flow_id >= 500""", "flows"))
def positional_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.positional_slices(flows(spark, sf_dir), "flow_id", 100, 50, 500).select("flow_id", "slice")


@query("code_columns", oracle("""
SELECT flow_id, pred_binary, CAST(pred_binary AS VARCHAR) AS pred_binary_str, pred_category,
  CAST(pred_category AS VARCHAR) AS pred_category_str FROM flows""", "flows"))
def code_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("pred_binary", "pred_category")})
    return base.select("flow_id", *[c.alias(n) for n, c in codes.code_columns(["pred_binary", "pred_category"]).items()])


@query("decode_category", oracle(f"""
SELECT flow_id, coalesce({_LABELS}[code + 1], 'Unknown') AS name,
  CASE WHEN code < 0 THEN 'Unknown' WHEN code < 9 THEN 'attack_cat_' || {_LABELS}[code + 1] ELSE 'label_0' END AS column_name,
  CASE pred_binary WHEN 0 THEN 'Normal' ELSE 'Attack' END AS verdict
FROM (SELECT *, CASE WHEN flow_id % 7 = 0 THEN -1 ELSE gold_category END AS code FROM flows) x""", "flows"))
def decode_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir).withColumn("code", F.expr("CASE WHEN flow_id % 7 = 0 THEN -1 ELSE gold_category END"))
    return base.select(
        "flow_id", codes.category_name("code").alias("name"), codes.category_column_name("code").alias("column_name"),
        codes.verdict_name("pred_binary").alias("verdict"),
    )


@query("threshold_binary", oracle("""
SELECT flow_id, CAST(round_even(CAST(dur AS DOUBLE) / 50, 0) AS INT) AS pred FROM flows""", "flows"))
def threshold_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select("flow_id", vectors.threshold(F.col("dur") / 50).alias("pred"))


_TEN = "[" + ", ".join(f"features[{i}]" for i in range(1, 11)) + "]"


@query("argmax_onehot", oracle(f"""
SELECT row_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i + 1 = list_position(s, list_max(s))
  THEN 1 ELSE 0 END), '') AS onehot
FROM (SELECT row_id, {_TEN} AS s FROM matrix) x""", "matrix"))
def argmax_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.slice("features", 1, 10)
    onehot = vectors.one_hot_of(vectors.argmax(scores), 10)
    return matrix(spark, sf_dir).select("row_id", F.array_join(onehot.cast("array<string>"), "").alias("onehot"))


@query("filter_group", oracle("""
SELECT flow_id, gold_category, pred_binary FROM flows WHERE gold_category IN (2, 5, 9)""", "flows"))
def filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = ["2", "5", "9"]
    base = flows(spark, sf_dir)
    return base.where(F.col("gold_category").cast("string").isin(visible)).select(
        "flow_id", "gold_category", "pred_binary")


@query("verdict_columns", oracle("""
SELECT flow_id, pred_binary = CAST(gold_category <> 9 AS INT) AS binary_ok, pred_category = gold_category AS visual_ok
FROM flows""", "flows"))
def verdict_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(
        "flow_id", codes.binary_agrees("pred_binary", "gold_category").alias("binary_ok"),
        (F.col("pred_category") == F.col("gold_category")).alias("visual_ok"),
    )


@query("format_fields", oracle("""
SELECT flow_id, printf('%.4f', dur / 8) AS x, printf('%.4f', CAST(flow_id AS DOUBLE) / 16) AS y,
  CASE WHEN pred_category = gold_category THEN '✅ ' ELSE '❌ ' END || 'flow' AS mark FROM flows""", "flows"))
def format_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(
        "flow_id", codes.fixed_decimals(F.col("dur") / 8).alias("x"),
        codes.fixed_decimals(F.col("flow_id").cast("double") / 16).alias("y"),
        codes.marked(F.col("pred_category") == F.col("gold_category"), F.lit("flow")).alias("mark"),
    )


# ---- set operations, sorts, sinks -----------------------------------------------------------------

@query("union_splits", oracle("SELECT split, flow_id, sbytes FROM flows", "flows"))
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = flows(spark, sf_dir)
    parts = {s: base.where(F.col("split") == s).select("flow_id", "sbytes") for s in ("train", "val", "test")}
    return split.union_splits(parts).select("split", "flow_id", "sbytes")


@query("sort_points_by_category", oracle(f"""
SELECT category, vec_id, {round_sql('x0', 'x')}, {round_sql('y0', 'y')} FROM points ORDER BY category""", "points"))
def sort_points_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = points(spark, sf_dir).select("category", "vec_id", r6("x0").alias("x"), r6("y0").alias("y"))
    return stores.sort_points_by_category(base)


@query("scored_flow_sink", oracle(f"""
SELECT row_number() OVER (ORDER BY flow_id) - 1 AS index, pred_binary AS original_pred,
  CAST(pred_category <> 9 AS INT) AS cats_ae_pred, {round_sql('(dur - d0) / (d1 - d0)', 'x_cats_ae')},
  {round_sql('(sbytes - s0) / (s1 - s0)', 'y_cats_ae')}, CAST(label AS DOUBLE) AS label, gold_category AS category,
  CAST(gold_category AS VARCHAR) AS cat_str, CAST(CAST(pred_category <> 9 AS INT) AS VARCHAR) AS cats_ae_pred_str,
  CAST(pred_binary AS VARCHAR) AS original_pred_str
FROM flows, (SELECT min(dur) d0, max(dur) d1, min(sbytes) s0, max(sbytes) s1 FROM flows WHERE split <> 'val') m
WHERE split = 'test'""", "flows"))
def scored_flow_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to Parquet and read back."""
    base = flows(spark, sf_dir).select(
        F.col("flow_id").alias("row_id"), F.col("dur").alias("x"), F.col("sbytes").alias("y"), "label", "split",
        F.col("gold_category").alias("category"), F.col("pred_binary").alias("original_pred"),
        (F.col("pred_category") != 9).cast("int").alias("cats_ae_pred"),
    )
    path = work_path(spark, "scored")
    stores.write_scored_flows(*stores.scored_flows(base.where("split = 'test'"), base.where("split = 'train'")), path)
    return rounded(spark.read.parquet(f"{path}/flows"), ["x_cats_ae", "y_cats_ae"])


@query("lineitem_encoded_scaled", f"""
SELECT {round_sql("(l_quantity - q0) / (q1 - q0)", 'l_quantity')},
  {round_sql("(l_extendedprice - e0) / (e1 - e0)", 'l_extendedprice')},
  {', '.join(f"CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END AS l_returnflag_{v}" for v in 'ANR')},
  {', '.join(f"CASE WHEN l_linestatus = '{v}' THEN 1 ELSE 0 END AS l_linestatus_{v}" for v in 'FO')}
FROM lineitem, (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) e0, max(l_extendedprice) e1
  FROM lineitem) m""")
def lineitem_encoded_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and scale at volume."""
    base = table(spark, sf_dir, "lineitem")
    model = encode.FlowEncoder(["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]).fit(base)
    scaler = scale.ColumnScaler.fit(base, model.numeric)
    return rounded(scaler.transform(model.transform_wide(base)), model.numeric)
