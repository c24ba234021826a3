"""Record layout of captures and labelled tables.

The names, their order and the category codes are fixed values of the data format.
"""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The 49 columns of a headerless capture part, in file order.
CAPTURE_COLUMNS = (
    "srcip sport dstip dsport proto state dur sbytes dbytes sttl dttl sloss dloss service sload dload "
    "spkts dpkts swin dwin stcpb dtcpb smean dmean trans_depth response_body_len sjit djit Stime Ltime "
    "sinpkt dinpkt tcprtt synack ackdat is_sm_ips_ports ct_state_ttl ct_flw_http_mthd is_ftp_login "
    "ct_ftp_cmd ct_srv_src ct_srv_dst ct_dst_ltm ct_src_ltm ct_src_dport_ltm ct_dst_sport_ltm "
    "ct_dst_src_ltm attack_cat label"
).split()

# Columns no model reads, and columns that are text.
UNUSED_COLUMNS = "srcip sport dstip dsport Stime Ltime".split()
CATEGORICAL_COLUMNS = "proto state service is_sm_ips_ports is_ftp_login attack_cat label".split()
BLANKABLE_COLUMN = "ct_ftp_cmd"
TIME_COLUMNS = ["Stime", "Ltime"]

MODEL_COLUMNS = [c for c in CAPTURE_COLUMNS if c not in UNUSED_COLUMNS]
NUMERIC_COLUMNS = [c for c in MODEL_COLUMNS if c not in CATEGORICAL_COLUMNS]
TEXT_COLUMNS = ["srcip", "sport", "dstip", "dsport", BLANKABLE_COLUMN, *CATEGORICAL_COLUMNS]

# Category code = position in this list; "Normal" is the code of unattacked flows.
CATEGORIES = "Analysis Backdoor DoS Exploits Fuzzers Generic Reconnaissance Shellcode Worms Normal".split()
NORMAL = CATEGORIES.index("Normal")
ATTACK_CATEGORIES = CATEGORIES[:NORMAL]
CATEGORY_LABELS = [*ATTACK_CATEGORIES, "label_0"]  # names shown next to a flow
VERDICTS = ["Normal", "Attack"]

# Spellings of the category that are corrected, by exact match only.
CATEGORY_FIXES = {
    "Backdoors": "Backdoor",
    " Fuzzers": "Fuzzers",
    " Fuzzers ": "Fuzzers",
    " Reconnaissance ": "Reconnaissance",
    " Shellcode ": "Shellcode",
}

# Columns of the score report after ``metric``.
SCORE_COLUMNS = ["original", "original_val", "original_train", "reduced", "reduced_val", "reduced_train"]


def _column_type(name: str):
    if name in TEXT_COLUMNS:
        return StringType()
    return LongType() if name in TIME_COLUMNS else DoubleType()


CAPTURE_SCHEMA = StructType([StructField(c, _column_type(c)) for c in CAPTURE_COLUMNS])
