"""spark-submit jobs of the flow map: prepare the scored flows, then replay and explain them.

    spark-submit --py-files flowlens.zip flowlens/jobs/flowmap.py prepare CAPTURE TRAIN TEST MODEL_PATH OUTPUT [--radius 0.01]
    ... replay  OUTPUT [--keep 200] [--radius 0.01] [--every "10 milliseconds"]
    ... explain OUTPUT INDEX [--radius 0.01]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions import codes
from flowlens.operators.neighbours import EpsNeighbourClassifier, EpsNeighbourModel
from flowlens.reduce.base import load_models
from flowlens.schema import CATEGORY_LABELS
from flowlens.session import written, get_session, work_path
from flowlens.sources.dataset import FlowDataset
from flowlens.sources.stores import scored_flows
from flowlens.streaming import replay, sinks, windows
from flowlens.streaming.scoring import FlowScorer

PREDICTIONS = ["cats_ae_pred", "original_pred"]
RADIUS = 0.01
GROUPS = {"Categories": "cat_str", "cats_ae_pred": "cats_ae_pred_str", "original_pred": "original_pred_str"}


def prepare(dataset: FlowDataset, reducer, output: str, files: int = 64, radius: float = RADIUS) -> None:
    """Score the test split, scale both maps jointly and write flows (in index order), train points and their index for one
    radius."""
    train, test = dataset.split("train"), dataset.split("test")
    scorer = FlowScorer.fit(reducer, train)
    scored = scorer.transform(test).select("row_id", "x", "y", "label", "category", *PREDICTIONS)
    embedded = reducer.transform(train)
    out = F.col(reducer.output)
    points = embedded.select(F.get(out, F.lit(0)).alias("x"), F.get(out, F.lit(1)).alias("y"), "category")
    # models run once: the joint scale and the final tables both read the written result
    flows, points = scored_flows(written(scored), written(points))
    replay.write_replay(flows, f"{output}/flows", "index", files)
    points.write.mode("overwrite").parquet(f"{output}/train_points")
    EpsNeighbourClassifier("index").fit(points).store(radius, f"{output}/neighbours")


def visible(flows: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Flows of the shown groups of one grouping attribute."""
    return flows.where(F.col(GROUPS[group]).isin(values))


def flow_details(spark: SparkSession, path: str, selected: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Everything about the selected flows (a table of ``index`` values): verdicts, coordinates, neighbourhood. The stored
    index answers for its radius, for others one is built."""
    flows = spark.read.parquet(f"{path}/flows")
    spec = EpsNeighbourClassifier("index")
    model = EpsNeighbourModel.open(spark, f"{path}/neighbours", spec)
    if not model.has(radius):
        model = spec.fit(spark.read.parquet(f"{path}/train_points"))
    chosen = flows.join(selected, "index").withColumns({"x": F.col("x_cats_ae"), "y": F.col("y_cats_ae")})
    labels = list(range(len(CATEGORY_LABELS)))
    out = model.explain(chosen, radius, labels)
    seen = F.col("predicted") != -1
    verdict = {p: codes.marked(codes.binary_agrees(p), codes.verdict_name(p)) for p in PREDICTIONS}
    return out.select(
        "index", codes.category_name("category").alias("category"), *[c.alias(n) for n, c in verdict.items()],
        codes.fixed_decimals("x").alias("x"), codes.fixed_decimals("y").alias("y"),
        F.when(seen, codes.marked(F.col("predicted") == F.col("category"), codes.category_name("predicted")))
        .otherwise("Unknown").alias("visual_pred"),
        "neighbours", "density", "outlierness",
        *[F.col(f"p_{c}").alias(f"p_{CATEGORY_LABELS[c]}") for c in labels],
    )


def replay_job(spark: SparkSession, path: str, keep: int = 200, every: str = "10 milliseconds",
               seek: int | None = None, per_tick: int = 1, output: str | None = None) -> tuple[replay.Replay, str]:
    """A replay of the flows, to be played; every tick refreshes the last-``keep`` window below ``output``."""
    output = output or work_path(spark, "flow-map")
    keep_last = windows.keep_last_n(output, keep, "index", "category", PREDICTIONS)
    return replay.Replay(spark, f"{path}/flows", keep_last, per_tick, every, seek), output


def main(argv: Sequence[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="flowlens.jobs.flowmap", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    tasks = top.add_subparsers(dest="task", required=True)
    p = tasks.add_parser("prepare")
    for name in ("capture", "train", "test", "model_path", "output"):
        p.add_argument(name)
    p.add_argument("--run", type=int, default=0, help="which saved run to use")
    p.add_argument("--radius", type=float, default=RADIUS, help="radius that explanations are prepared for")
    r = tasks.add_parser("replay")
    r.add_argument("path")
    r.add_argument("--keep", type=int, default=200, help="flows to keep")
    r.add_argument("--every", default="10 milliseconds", help="pace of new flows")
    r.add_argument("--per-tick", type=int, default=1, help="flows that come at a time")
    r.add_argument("--seek", type=int, help="start at this flow number")
    e = tasks.add_parser("explain")
    e.add_argument("path")
    e.add_argument("index", type=int, nargs="+")
    e.add_argument("--radius", type=float, default=RADIUS)
    args = top.parse_args(argv)
    spark = get_session(f"flowlens flowmap {args.task}")
    if args.task == "prepare":
        dataset = FlowDataset.load(spark, args.capture, args.train, args.test)
        prepare(dataset, load_models(spark, args.model_path)[args.run], args.output, radius=args.radius)
    elif args.task == "replay":
        player, output = replay_job(spark, args.path, args.keep, args.every, args.seek, args.per_tick)
        print(f"window tables below {output}/window")
        player.play().awaitTermination()
    else:
        selected = spark.createDataFrame([(i,) for i in args.index], "index long")
        flow_details(spark, args.path, selected, args.radius).show(len(args.index), truncate=False, vertical=True)


if __name__ == "__main__":
    main()
