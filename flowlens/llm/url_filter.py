"""URL filter: rules decide where one fits, gradient-boosted trees on lexical features decide about all other URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.session import drop_written, written

#: Distinct labelled URLs in the fit: the bound of the fitted sample.
SAMPLE = 20_000
ALLOW, BLOCK = "allow", "block"
_TREES, _DEPTH, _PRIOR = 20, 4, 20.0
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "parameters",
    "query_length", "hyphens", "percent", "fragment", "file_ending", "has_scheme", "suffix_rate", "section_rate",
)


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the beginning of a path, like ``net/es/``; the rule fits the host and its subdomains."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; path: then up to ``?``, ``#`` or the end.
    Both are empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``host``, ``path``, ``rule`` and ``ruling`` of (page_id, url): the longest rule that fits; null if none does."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        rule, ruling = F.when(r.fits(), r.text).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(ruling)
    return out.withColumns({"rule": rule, "ruling": ruling})


def _share(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features, a suffix (last label of the host) and a section (first part of the path) to the rows."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    # distinct characters and how often each occurs: short strings, so a fold over the distinct ones is cheap
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.array_distinct(F.split(url, ""))
    shares = F.transform(chars, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    values = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]+")), "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _share(url, "[0-9]"), "host_digit_ratio": _share(host, "[0-9]"), "entropy": entropy,
        "parameters": F.regexp_count(query, F.lit("[^&;=]+=")), "query_length": F.length(query),
        "hyphens": F.regexp_count(url, F.lit("[-_]")), "percent": F.regexp_count(url, F.lit("%[0-9A-Fa-f]{2}")),
        "fragment": F.contains(url, F.lit("#")), "file_ending": F.regexp_like(path, F.lit(r"\.[A-Za-z0-9]{1,5}$")),
        "has_scheme": F.contains(url, F.lit("://")),
    }
    return rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}).withColumns({
        "suffix": F.regexp_extract(host, r"([^.]*)$", 1), "section": F.regexp_extract(path, "^/([^/]*)", 1),
    })


def _rates(labelled: DataFrame, key: str, mean: float) -> DataFrame:
    """Share of blocked URLs for each value of ``key``, shrunken towards the mean. As many rows as values in the sample."""
    return labelled.groupBy(key).agg(
        ((F.sum("y") + mean * _PRIOR) / (F.count("*") + _PRIOR)).alias(f"{key}_rate")
    )


def classify(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url).

    verdict is that of the longest rule that fits. URLs with a rule are the labelled URLs: the trees learn from at most
    ``SAMPLE`` distinct ones, those that come first by a hash, and judge the URLs without a rule; score is their probability
    of ``block``, null where a rule decided. Suffix statistics are rates of blocked URLs among the sample's suffixes and
    sections; they have at most as many rows as the sample and are broadcast. All features are DataFrame expressions.

    Defined cases: a null url has an empty host and path, no rule, and the features of an empty string; if all labels
    agree, or there are none, the trees are left out and URLs without a rule get that verdict, or ``allow``; rows with the
    same page_id are judged one by one; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    rows = ruled(pages, rules)
    labelled = (
        rows.where("rule IS NOT NULL").select("url", "host", "path", (F.col("ruling") == BLOCK).cast("double").alias("y")).distinct()
        .orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
    )
    sample = written(lexical(labelled), "urls")
    found = sample.groupBy("y").count().collect()
    if len(found) < 2:
        only = BLOCK if found and found[0].y == 1.0 else ALLOW
        drop_written(sample)
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.lit(only)).alias("verdict"),
                           F.when(F.col("rule").isNull(), F.lit(float(only == BLOCK))).alias("score"))
    mean = sum(r.y * r["count"] for r in found) / sum(r["count"] for r in found)
    by_suffix, by_section = (written(_rates(sample, key, mean), "rates") for key in ("suffix", "section"))

    def assembled(table: DataFrame) -> DataFrame:
        with_rates = table.join(F.broadcast(by_suffix), "suffix", "left").join(F.broadcast(by_section), "section", "left")
        return with_rates.fillna(mean, ["suffix_rate", "section_rate"])

    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=_TREES, maxDepth=_DEPTH, stepSize=0.3, seed=7)
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees])
    train = written(assembled(sample).select(*FEATURES, "y").repartition(_parts(spark)), "urls")
    model = steps.fit(train)
    drop_written(train, sample)
    free = model.transform(assembled(lexical(rows.where("rule IS NULL")))).select(
        "page_id", "host", "path", "rule", vector_to_array("probability")[1].alias("score")
    ).withColumn("verdict", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    bound = rows.where("rule IS NOT NULL").select(
        "page_id", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.col("ruling").alias("verdict")
    )
    return bound.unionByName(free).select("page_id", "host", "path", "rule", "verdict", "score")


def _parts(spark: SparkSession) -> int:
    return max(1, min(spark.sparkContext.defaultParallelism, 8))
