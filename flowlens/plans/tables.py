"""Flow-shaped views over the given tables.

The tables hold no network flows, so every query runs over views derived from ``events``,
``embeddings`` and ``lineitem`` by one SQL text that Spark and DuckDB both understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators.scale import ColumnScaler

EPS = 0.01

FLOWS_SQL = """
SELECT event_id AS flow_id, ts,
  CASE WHEN user_id % 3 = 0 THEN 'tcp' WHEN user_id % 3 = 1 THEN 'udp' ELSE 'arp' END AS proto,
  CASE WHEN event_id % 4 = 0 THEN 'FIN' WHEN event_id % 4 = 1 THEN 'CON' ELSE 'INT' END AS state,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS service,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS dur,
  user_id % 3 AS spkts,
  CAST(floor(value) AS BIGINT) % 4 AS dpkts,
  value AS sbytes,
  CASE WHEN event_id % 6 = 0 THEN ' ' ELSE CAST(event_id % 3 AS STRING) END AS ct_ftp_cmd,
  CASE (user_id + event_id) % 10
    WHEN 0 THEN 'Analysis'
    WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'Backdoors' ELSE 'Backdoor' END
    WHEN 2 THEN 'DoS' WHEN 3 THEN 'Exploits'
    WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN ' Fuzzers' WHEN event_id % 3 = 1 THEN ' Fuzzers ' ELSE 'Fuzzers' END
    WHEN 5 THEN 'Generic'
    WHEN 6 THEN CASE WHEN event_id % 2 = 0 THEN ' Reconnaissance ' ELSE 'Reconnaissance' END
    WHEN 7 THEN CASE WHEN event_id % 2 = 0 THEN ' Shellcode ' ELSE 'Shellcode' END
    WHEN 8 THEN 'Worms' ELSE NULL END AS attack_cat,
  CASE WHEN (user_id + event_id) % 10 = 9 THEN '0' ELSE '1' END AS label,
  CAST((user_id + event_id) % 10 AS INT) AS gold_category,
  CASE WHEN value > 20 THEN 1 ELSE 0 END AS pred_binary,
  CAST((user_id + event_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 10 AS INT) AS pred_category,
  CASE WHEN event_id % 5 = 0 THEN 'test' WHEN event_id % 5 = 1 THEN 'val' ELSE 'train' END AS split
FROM {events}
"""

_FLOWS_WITH_IDS = FLOWS_SQL.replace("AS flow_id, ts,", "AS flow_id, ts, event_id, user_id,")

# all 49 capture columns; the columns the other queries look at match FLOWS_SQL
CAPTURE_SQL = """
SELECT concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS srcip, CAST(1024 + event_id % 60000 AS STRING) AS sport,
  concat('10.0.1.', CAST(event_id % 250 AS STRING)) AS dstip, CAST(event_id % 1024 AS STRING) AS dsport,
  proto, state, dur, sbytes, sbytes * 2 AS dbytes, CAST(event_id % 255 AS DOUBLE) AS sttl,
  CAST(event_id % 31 AS DOUBLE) AS dttl, CAST(event_id % 7 AS DOUBLE) AS sloss, CAST(event_id % 5 AS DOUBLE) AS dloss,
  service, sbytes * 8 AS sload, sbytes * 4 AS dload, CAST(spkts AS DOUBLE) AS spkts, CAST(dpkts AS DOUBLE) AS dpkts,
  CAST(255 AS DOUBLE) AS swin, CAST(255 AS DOUBLE) AS dwin, CAST(event_id * 3 AS DOUBLE) AS stcpb,
  CAST(event_id * 5 AS DOUBLE) AS dtcpb, sbytes + 40 AS smean, sbytes + 20 AS dmean,
  CAST(event_id % 3 AS DOUBLE) AS trans_depth, CAST(event_id % 1500 AS DOUBLE) AS response_body_len,
  dur / 8 AS sjit, dur / 16 AS djit, 1421927414 + event_id AS "Stime", 1421927415 + event_id AS "Ltime",
  dur / 2 AS sinpkt, dur / 4 AS dinpkt, CAST(event_id % 13 AS DOUBLE) / 64 AS tcprtt,
  CAST(event_id % 17 AS DOUBLE) / 64 AS synack, CAST(event_id % 19 AS DOUBLE) / 64 AS ackdat,
  CASE WHEN event_id % 97 = 0 THEN '1' ELSE '0' END AS is_sm_ips_ports, CAST(event_id % 6 AS DOUBLE) AS ct_state_ttl,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(event_id % 4 AS DOUBLE) END AS ct_flw_http_mthd,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN '0' ELSE '1' END AS is_ftp_login, ct_ftp_cmd,
  CAST(event_id % 23 AS DOUBLE) AS ct_srv_src, CAST(event_id % 29 AS DOUBLE) AS ct_srv_dst,
  CAST(event_id % 37 AS DOUBLE) AS ct_dst_ltm, CAST(event_id % 41 AS DOUBLE) AS ct_src_ltm,
  CAST(event_id % 43 AS DOUBLE) AS ct_src_dport_ltm, CAST(event_id % 47 AS DOUBLE) AS ct_dst_sport_ltm,
  CAST(event_id % 53 AS DOUBLE) AS ct_dst_src_ltm, attack_cat, label
FROM {c}
"""

POINTS_SQL = """
SELECT vec_id, label AS category, CASE WHEN label <> 9 THEN 1 ELSE 0 END AS attack,
  CAST({first} AS DOUBLE) AS x0, CAST({second} AS DOUBLE) AS y0,
  CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM {embeddings}
"""

# corrected category as SQL text, for oracle queries
CLEAN_CATEGORY = (
    "CASE WHEN attack_cat = 'Backdoors' THEN 'Backdoor' WHEN attack_cat IN (' Fuzzers', ' Fuzzers ') THEN 'Fuzzers' "
    "WHEN attack_cat = ' Reconnaissance ' THEN 'Reconnaissance' WHEN attack_cat = ' Shellcode ' THEN 'Shellcode' "
    "ELSE attack_cat END"
)
RATE = (
    "CASE WHEN dur = 0 THEN CASE WHEN spkts + dpkts - 1 < 0 THEN CAST('-inf' AS DOUBLE) ELSE 0.0::DOUBLE END "
    "ELSE CAST(spkts + dpkts - 1 AS DOUBLE) / dur END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLOWS_SQL, events=table(spark, sf_dir, "events"))


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 49 capture columns, from one scan of ``events``."""
    text = CAPTURE_SQL.replace('"', "")
    return spark.sql(text, c=spark.sql(_FLOWS_WITH_IDS, events=table(spark, sf_dir, "events")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = POINTS_SQL.replace("{first}", "element_at(embedding, 1)").replace("{second}", "element_at(embedding, 2)")
    return spark.sql(text, embeddings=table(spark, sf_dir, "embeddings"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as feature vectors: row_id, features, category, label (attack or not) and split."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("int").alias("category"), (F.col("label") != 9).cast("int").alias("label"),
        F.expr("CASE WHEN vec_id % 5 = 0 THEN 'test' WHEN vec_id % 5 = 1 THEN 'val' ELSE 'train' END").alias("split"),
    )


def flow_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as points of a 2-D map: duration and bytes, scaled over the whole table."""
    base = flows(spark, sf_dir)
    scaler = ColumnScaler.fit(base, ["dur", "sbytes"])
    return base.select(
        "flow_id", "split", F.col("gold_category").alias("category"), "pred_binary",
        scaler.column("dur").alias("x"), scaler.column("sbytes").alias("y"),
    )


def oracle(body: str, *views: str) -> str:
    """Prefix a DuckDB query with the views it uses."""
    texts = {
        "flows": FLOWS_SQL.replace("{events}", "events"),
        "capture": CAPTURE_SQL.replace("{c}", "(" + _FLOWS_WITH_IDS.replace("{events}", "events") + ") c"),
        "points": POINTS_SQL.replace("{first}", "embedding[1]").replace("{second}", "embedding[2]").replace(
            "{embeddings}", "embeddings"),
        "matrix": """SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features, label AS category,
            CAST(label <> 9 AS INT) AS label, CASE WHEN vec_id % 5 = 0 THEN 'test' WHEN vec_id % 5 = 1 THEN 'val'
            ELSE 'train' END AS split FROM embeddings""",
        "flow_map": """SELECT flow_id, split, gold_category AS category, pred_binary,
            (dur - lo_d) / (hi_d - lo_d) AS x, (sbytes - lo_s) / (hi_s - lo_s) AS y
            FROM flows, (SELECT min(dur) lo_d, max(dur) hi_d, min(sbytes) lo_s, max(sbytes) hi_s FROM flows) m""",
    }
    wanted = ["flows", *views] if "flow_map" in views and "flows" not in views else list(views)
    return "WITH " + ",\n".join(f"{v} AS ({texts[v]})" for v in wanted) + "\n" + body if wanted else body
