"""The jobs from CSV files to reports."""

import pytest
from pyspark.sql import functions as F

from flowlens.jobs import flowmap, reduce as job
from flowlens.plans.tables import capture
from flowlens.reduce import learners
from flowlens.schema import MODEL_COLUMNS
from flowlens.sources import capture as files, stores
from flowlens.sources.dataset import FlowDataset, category_gaps, plain_frame


@pytest.fixture(scope="module")
def csv_dir(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("csv")
    whole = capture(spark, sf_dir)
    files.write_labelled(whole, str(base / "x_all.csv"))
    files.write_labelled(whole.where("stcpb % 5 <> 0"), str(base / "x_training-set.csv"))
    files.write_labelled(whole.where("stcpb % 5 = 0").withColumnRenamed("dinpkt", "  dinpkt"),
                         str(base / "x_testing-set.csv"))
    return str(base)


@pytest.fixture(scope="module")
def dataset(spark, csv_dir):
    return FlowDataset.load(spark, f"{csv_dir}/*_all.csv", f"{csv_dir}/*training-set.csv", f"{csv_dir}/*testing-set.csv")


def test_dataset(spark, dataset):
    rows = dataset.data.groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("row_id").alias("ids"), F.min(F.size("features")).alias("lo"),
        F.max(F.size("features")).alias("hi")).collect()
    counts = {r.split: r.n for r in rows}
    assert counts["test"] == 200 and counts["train"] + counts["val"] == 800 and 100 < counts["val"] < 220
    assert all(r.n == r.ids and r.lo == r.hi == len(dataset.columns) for r in rows)
    finite = F.forall("features", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    assert dataset.data.where(~finite).count() == 0
    assert dataset.columns[:3] == ["dur", "sbytes", "dbytes"] and "rate" in dataset.columns


def test_split_does_not_depend_on_the_layout(spark, sf_dir):
    whole = capture(spark, sf_dir)
    train, test = whole.where("stcpb % 5 <> 0"), whole.where("stcpb % 5 = 0")
    held = [
        sorted(str(r.features) for r in FlowDataset.prepare(whole, train.repartition(n), test).split("val").collect())
        for n in (1, 4)
    ]
    assert held[0] == held[1] and len(held[0]) > 50


def test_roles(spark, csv_dir):
    frames = {n: files.scan_labelled(spark, f"{csv_dir}/*{n}-set.csv") for n in ("training", "testing")}
    assert {r.file: r.role for r in files.assign_roles(frames).collect()} == {"training": "train", "testing": "test"}


def test_missing_column_is_reported(spark, tmp_path):
    files.write_labelled(spark.range(1), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="lacks"):
        files.scan_labelled(spark, str(tmp_path / "bad"))


def test_plain_frames(spark, csv_dir):
    big = files.scan_labelled(spark, f"{csv_dir}/*_all.csv")
    test = files.scan_labelled(spark, f"{csv_dir}/*testing-set.csv")
    wide = plain_frame(test, big)
    assert wide.columns[-2:] == ["label_0", "label_1"] and "attack_cat_Analysis" in wide.columns
    assert plain_frame(test, onehot=False, family="numeric").columns[-1] == "label"
    assert plain_frame(test, onehot=False).count() == 200
    assert category_gaps(files.prune_columns(capture(spark, "/root/testdata/sf0.001"))).first()[0] >= 0
    assert test.columns == MODEL_COLUMNS


@pytest.mark.parametrize("argv", [
    ["cats_ae", "--reconstruct_loss", "mse"],
])
def test_reduce_job(spark, csv_dir, capsys, tmp_path, argv):
    out = str(tmp_path / "scores")
    job.main(["--number", "1", "--train", '{"epochs": 2}', "--output", out, *argv, csv_dir],
             {"Decision Tree": learners.decision_tree})
    printed = capsys.readouterr().out
    assert "mean over the runs, binary labels" in printed and "accuracy" in printed
    scores = spark.read.parquet(out)
    assert {r.task for r in scores.select("task").distinct().collect()} == {"binary", "category"}
    assert ("own" in {r.classifier for r in scores.collect()}) == (argv[0] == "cats_ae")


def test_command_lines_parse():
    parse = job.parser().parse_args
    assert job.make_reducer(parse(["mds", "data"])).name == "mds"
    assert job.make_reducer(parse(["tsne", "--n_iter", "40", "data"])).steps == 40
    with pytest.raises(SystemExit):
        parse(["mds", "--n_init", "4", "data"])
    net = job.make_reducer(parse(["--train", '{"epochs": 3, "batch_size": 10}', "bin_ae", "--reconstruct_weight",
                                  "0.5", "data"]))
    assert (net.steps, net.batch_size, net.spec.head, net.spec.reconstruct_weight) == (3, 10, "binary", 0.5)
    assert job.make_reducer(parse(["pca", "data"])).name == "pca"
    assert job.make_reducer(parse(["lda", "--categories", "data"])).label == "category"


def test_weights_job_and_flow_map(spark, csv_dir, dataset, capsys, tmp_path):
    model_path = str(tmp_path / "cats_%s")
    args = job.parser().parse_args(["--number", "2", "--train", '{"epochs": 2}', "cats_ae", "--model_path",
                                    model_path % "0.1", csv_dir])
    job.run_experiment(args, dataset.data, {"Decision Tree": learners.decision_tree})
    job.main(["--number", "2", "--output", str(tmp_path / "w"), "weights", "--cats_ae_path", model_path,
              "--cats_ae_weight", "0.1", csv_dir])
    assert "weights 2" in capsys.readouterr().out
    table = spark.read.option("header", True).csv(str(tmp_path / "w" / "dim=0"))
    assert table.columns == ["feature", "cats_ae_0.1_0", "cats_ae_0.1_1"] and table.count() == len(dataset.columns)

    from flowlens.reduce.base import load_models
    out = str(tmp_path / "map")
    flowmap.prepare(dataset, load_models(spark, model_path % "0.1")[0], out, files=3)
    flows = spark.read.parquet(f"{out}/flows")
    assert flows.columns == stores.SCORED_COLUMNS
    assert sorted(r["index"] for r in flows.collect()) == list(range(200))
    player, window = flowmap.replay_job(spark, out, keep=50, per_tick=80)
    from flowlens.streaming import replay, sinks
    replay.drain(replay.ticks(spark, 80), replay.each_tick(player.path, player.each), 200, 80)
    kept = sinks.latest_epoch(spark, f"{window}/window")
    assert sorted(r["index"] for r in kept.collect()) == list(range(150, 200))
    selected = spark.createDataFrame([(0,), (150,)], "index long")
    details = flowmap.flow_details(spark, out, selected, 0.05).collect()
    assert len(details) == 2 and all(r.neighbours >= 0 and len(r.x.split(".")[1]) == 4 for r in details)
    shown = flowmap.visible(flows, "Categories", ["9"])
    assert shown.count() == flows.where("category = 9").count()
