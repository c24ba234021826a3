"""spark-submit job: reduce, compare and report.

    spark-submit --py-files flowlens.zip flowlens/jobs/reduce.py [--size 2] [--number 5] [--train JSON] METHOD [options] DATAPATH

DATAPATH holds three CSV tables with headers: ``*_all.csv``, ``*training-set.csv`` and ``*testing-set.csv``
(or name them with --capture, --train-table, --test-table).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowlens.operators.scores import score_report
from flowlens.reduce import learners, linear, nets, tsne
from flowlens.reduce.base import Reducer
from flowlens.reduce.experiment import Experiment
from flowlens.session import get_session
from flowlens.sources.dataset import FlowDataset
from flowlens.sources.stores import weights_report, write_weights_report

NET_METHODS = {
    "unsup_ae": nets.ae_unsupervised, "sup_cats_ae": nets.net_supervised,
    "bin_ae": nets.ae_binary, "cats_ae": nets.ae_category,
}


def parser() -> argparse.ArgumentParser:
    form = argparse.ArgumentDefaultsHelpFormatter
    top = argparse.ArgumentParser(prog="flowlens.jobs.reduce", formatter_class=form)
    methods = top.add_subparsers(dest="method", required=True)
    top.add_argument("datapath", help="folder of the three tables")
    top.add_argument("--capture", help="capture CSV, relative to DATAPATH", default="*_all.csv")
    top.add_argument("--train-table", help="training CSV", default="*training-set.csv")
    top.add_argument("--test-table", help="test CSV", default="*testing-set.csv")
    top.add_argument("--size", type=int, default=2, help="dimensions to reduce to")
    top.add_argument("--number", type=int, default=5, help="independent runs to average")
    top.add_argument("--train", type=json.loads, default={}, help="training options as JSON, over the defaults")
    top.add_argument("--output", help="also write the score table as Parquet")

    methods.add_parser("pca", formatter_class=form)
    lda = methods.add_parser("lda", formatter_class=form)
    lda.add_argument("--categories", action="store_true", help="use the category label")

    net = argparse.ArgumentParser(add_help=False)
    net.add_argument("--reconstruct_loss", choices=["binary_crossentropy", "mse"], default="binary_crossentropy")
    net.add_argument("--reconstruct_weight", type=float, default=0.1)
    net.add_argument("--enc_regularizer_weight", type=float, default=0.1)
    net.add_argument("--dec_regularizer_weight", type=float, default=0.0)
    net.add_argument("--encoder_regularizer", choices=["l1", "l2"], default="l2")
    net.add_argument("--lr", type=float, default=1e-3)
    net.add_argument("--lr_decay", type=float, default=1e-5)
    net.add_argument("--model_path", help="load models from here if present, else save them")
    for name in NET_METHODS:
        methods.add_parser(name, parents=[net], formatter_class=form)

    mds = methods.add_parser("mds", formatter_class=form)
    _without_effect(mds, "--random_state", "--metric", "--n_init", "--max_iter", "--verbose", "--eps", "--n_jobs", "--dissimilarity")

    tsne_ = methods.add_parser("tsne", formatter_class=form)
    tsne_.add_argument("--perplexity", type=float, default=30.0)
    tsne_.add_argument("--early_exaggeration", type=float, default=30.0)
    tsne_.add_argument("--learning_rate", type=float, default=200.0)
    tsne_.add_argument("--n_iter", type=int, default=1000)
    _without_effect(tsne_, "--n_iter_without_progress", "--min_grad_norm", "--metric", "--init", "--verbose", "--random_state", "--method", "--angle")

    weights = methods.add_parser("weights", formatter_class=form)
    weights.add_argument("--bin_ae_path", help="model path with %%s for the weight")
    weights.add_argument("--bin_ae_weight", nargs="+", default=[])
    weights.add_argument("--cats_ae_path", help="model path with %%s for the weight")
    weights.add_argument("--cats_ae_weight", nargs="+", default=[])
    return top


def _without_effect(parser: argparse.ArgumentParser, *options: str) -> None:
    """Solver options that have no counterpart here are refused: the answer would not be what they ask for."""

    class Refused(argparse.Action):
        def __call__(self, parser, namespace, values, option_string=None):
            parser.error(f"{option_string} has no effect on this method; leave it out")

    for option in options:
        parser.add_argument(option, action=Refused, dest="refused" + option, help="not supported")


def make_reducer(args: argparse.Namespace) -> Reducer:
    if args.method == "pca":
        return linear.PcaReducer(args.size)
    if args.method == "lda":
        return linear.LdaReducer(args.size, categories=args.categories)
    if args.method == "mds":
        return linear.MdsReducer(args.size)
    if args.method == "tsne":
        return tsne.TsneReducer(args.size, args.perplexity, args.early_exaggeration, args.learning_rate, args.n_iter)
    # mini-batches of 1000 rows within every task, 1500 passes, unless --train says otherwise
    training = {"steps": 1500, "batch_size": 1000, **_training(args.train)}
    return NET_METHODS[args.method](
        args.size, reconstruct=args.reconstruct_loss, reconstruct_weight=args.reconstruct_weight,
        enc_regularizer=args.encoder_regularizer, enc_regularizer_weight=args.enc_regularizer_weight,
        dec_regularizer_weight=args.dec_regularizer_weight, lr=args.lr, lr_decay=args.lr_decay, **training)


def _training(options: dict) -> dict:
    """``epochs`` is accepted for ``steps``."""
    return {"steps" if k == "epochs" else k: v for k, v in options.items()}


def run_experiment(args: argparse.Namespace, data: DataFrame, classifiers=None) -> DataFrame:
    """Fit (or load), score both spaces and, for nets with a label head, the head itself; long score table."""
    runs = 1 if args.method in ("pca", "lda", "mds", "tsne") else args.number
    trial = Experiment(make_reducer(args), runs, classifiers).fit_or_load(data, getattr(args, "model_path", None))
    scores = trial.scores(data)
    if trial.searches:
        preview(trial.best_parameters(data.sparkSession))
    if args.method in ("sup_cats_ae", "bin_ae", "cats_ae"):
        scores = scores.unionByName(trial.own_scores(data))
    return scores


def show_report(scores: DataFrame) -> None:
    for title, folded in (("mean", Experiment.mean(scores)), ("standard deviation", Experiment.std(scores))):
        for task, table in score_report(folded).items():
            print(f"{title} over the runs, {task} labels")
            preview(table)


def preview(table: DataFrame, most: int = 1000) -> None:
    """Print the first rows and say how many there are; the whole table is in --output."""
    rows = table.count()
    table.show(most, truncate=False)
    if rows > most:
        print(f"{most} of {rows} rows shown")


def run_weights(args: argparse.Namespace, spark, columns: list[str]) -> DataFrame | None:
    """(model, param, run, feature, dim, value) of saved nets."""
    frames = []
    for name, pattern, params in (("bin_ae", args.bin_ae_path, args.bin_ae_weight),
                                  ("cats_ae", args.cats_ae_path, args.cats_ae_weight)):
        for param in params if pattern else []:
            trial = Experiment(NET_METHODS[name](args.size), args.number).load(spark, pattern % param, settings=False)
            frames.append(trial.weights(spark, columns).withColumns({"model": F.lit(name), "param": F.lit(param)}))
    if not frames:
        return None
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def main(argv: Sequence[str] | None = None, classifiers=None) -> None:
    args = parser().parse_args(argv)
    spark = get_session("flowlens reduce")
    paths = [f"{args.datapath.rstrip('/')}/{name}" for name in (args.capture, args.train_table, args.test_table)]
    dataset = FlowDataset.load(spark, *paths)
    if args.method == "weights":
        weights = run_weights(args, spark, dataset.columns)
        if weights is None:
            raise SystemExit("give --bin_ae_path or --cats_ae_path")
        for dim, table in weights_report(weights).items():
            print(f"weights {dim + 1}")
            preview(table.orderBy("feature"), 10_000)
        if args.output:
            write_weights_report(weights, args.output)
        return
    scores = run_experiment(args, dataset.data, classifiers or learners.CLASSIFIERS).persist()
    show_report(scores)
    if args.output:
        scores.write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
