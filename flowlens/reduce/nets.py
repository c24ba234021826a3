"""One-bottleneck networks trained by distributed gradient jobs.

encoder: z = LeakyReLU(x W + b); label head: softmax over ten categories or one sigmoid;
reconstruction head: sigmoid(z V + e). Semi-supervised nets use both heads, unsupervised ones only the
reconstruction, supervised ones only the label head.

One step is one pass: weights go out with the task closure, every task folds its Arrow batches into the
gradient of all runs at once, and the sums come back as one vector. Adam runs on that vector.
With ``batch_size`` every task instead walks through its own mini-batches from the common weights and the
results are averaged by rows (local SGD), which takes many more updates per pass.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from flowlens.functions.vectors import list_column, matrix_of
from flowlens.reduce.base import Reducer, ReducerModel
from flowlens.reduce.sums import feature_width, summed
from flowlens.schema import CATEGORIES

SLOPE = 0.2  # fixed value: slope of the encoder activation below zero
_TINY = 1e-7


@dataclass(frozen=True)
class NetSpec:
    """Shape and loss of a net. ``head``: category, binary or none; ``reconstruct``: bce, mse or none."""

    head: str = "category"
    reconstruct: str = "binary_crossentropy"
    reconstruct_weight: float = 0.1
    enc_regularizer: str = "l2"
    enc_regularizer_weight: float = 0.1
    dec_regularizer_weight: float = 0.0

    def __post_init__(self):
        if self.enc_regularizer not in ("l1", "l2"):
            raise ValueError("enc_regularizer must be l1 or l2")
        if self.reconstruct not in ("binary_crossentropy", "mse", "none"):
            raise ValueError("reconstruct must be binary_crossentropy, mse or none")
        if self.head not in ("category", "binary", "none"):
            raise ValueError("head must be category, binary or none")

    @property
    def head_width(self) -> int:
        return {"category": len(CATEGORIES), "binary": 1, "none": 0}[self.head]

    def shapes(self, d: int, size: int) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {"W": (d, size), "b": (size,)}
        if self.head != "none":
            out |= {"U": (size, self.head_width), "c": (self.head_width,)}
        if self.reconstruct != "none":
            out |= {"V": (size, d), "e": (d,)}
        return out


def unpack(theta: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name] = theta[at:at + n].reshape(shape)
        at += n
    return out


def initial(shapes: dict[str, tuple[int, ...]], seed: int) -> np.ndarray:
    """Glorot: normal for the encoder, uniform for the heads, zero offsets."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, shape in shapes.items():
        if len(shape) == 1:
            parts.append(np.zeros(shape))
        elif name == "W":
            parts.append(rng.normal(0, np.sqrt(2 / sum(shape)), shape).ravel())
        else:
            limit = np.sqrt(6 / sum(shape))
            parts.append(rng.uniform(-limit, limit, shape).ravel())
    return np.concatenate(parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def encode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = x @ p["W"] + p["b"]
    return np.where(z > 0, z, SLOPE * z)


def head_scores(p: dict[str, np.ndarray], spec: NetSpec, x: np.ndarray) -> np.ndarray:
    logits = encode(p, x) @ p["U"] + p["c"]
    if spec.head == "binary":
        return _sigmoid(logits)
    power = np.exp(logits - logits.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True)


def data_loss(theta, shapes, spec: NetSpec, x, y) -> tuple[float, np.ndarray]:
    """Loss and gradient summed over the rows, without regularisation. ``y`` holds class codes or 0/1."""
    p = unpack(theta, shapes)
    grad = {name: np.zeros(shape) for name, shape in shapes.items()}
    z = x @ p["W"] + p["b"]
    slope = np.where(z > 0, 1.0, SLOPE)
    a = z * slope
    back = np.zeros_like(a)
    loss = 0.0
    if spec.head != "none":
        scores = head_scores(p, spec, x)
        if spec.head == "category":
            target = np.eye(spec.head_width)[y.astype(int)]
            loss += -np.log(np.maximum(scores[np.arange(len(x)), y.astype(int)], _TINY)).sum()
        else:
            target = y.reshape(-1, 1)
            q = np.clip(scores, _TINY, 1 - _TINY)
            loss += -(target * np.log(q) + (1 - target) * np.log(1 - q)).sum()
        delta = scores - target
        grad["U"], grad["c"] = a.T @ delta, delta.sum(axis=0)
        back += delta @ p["U"].T
    if spec.reconstruct != "none":
        weight = spec.reconstruct_weight if spec.head != "none" else 1.0
        r = _sigmoid(a @ p["V"] + p["e"])
        if spec.reconstruct == "mse":
            loss += weight * np.square(r - x).mean(axis=1).sum()
            delta = weight * 2 * (r - x) * r * (1 - r) / x.shape[1]
        else:
            q = np.clip(r, _TINY, 1 - _TINY)
            loss += weight * -(x * np.log(q) + (1 - x) * np.log(1 - q)).mean(axis=1).sum()
            delta = weight * (r - x) / x.shape[1]
        grad["V"], grad["e"] = a.T @ delta, delta.sum(axis=0)
        back += delta @ p["V"].T
    back *= slope
    grad["W"], grad["b"] = x.T @ back, back.sum(axis=0)
    return loss, np.concatenate([grad[name].ravel() for name in shapes])


def penalty(theta, shapes, spec: NetSpec) -> tuple[float, np.ndarray]:
    """Regularisation and its gradient."""
    p = unpack(theta, shapes)
    loss, parts = 0.0, []
    for name, value in p.items():
        grad = np.zeros_like(value)
        if name in ("W", "b"):
            w = spec.enc_regularizer_weight
            loss += w * (np.square(value).sum() if spec.enc_regularizer == "l2" else np.abs(value).sum())
            grad = w * (2 * value if spec.enc_regularizer == "l2" else np.sign(value))
        elif name in ("U", "c"):
            loss += spec.dec_regularizer_weight * np.square(value).sum()
            grad = spec.dec_regularizer_weight * 2 * value
        parts.append(grad.ravel())
    return loss, np.concatenate(parts)


class Adam:
    def __init__(self, width: int, decay: float = 0.0):
        self.m, self.v, self.t, self.decay = np.zeros(width), np.zeros(width), 0, decay

    def step(self, theta, grad, lr: float):
        rate = lr / (1 + self.decay * self.t)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        scale = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        return theta - rate * scale * self.m / (np.sqrt(self.v) + 1e-7)


class Plateau:
    """Halve the rate when the loss has not improved for ``patience`` steps."""

    def __init__(self, lr: float, factor=0.5, patience=5, cooldown=5, floor=1e-7, delta=1e-4):
        self.lr, self.factor, self.patience, self.cooldown = lr, factor, patience, cooldown
        self.floor, self.delta, self.best, self.wait, self.rest = floor, delta, np.inf, 0, 0

    def see(self, loss: float) -> None:
        if self.rest:
            self.rest, self.wait = self.rest - 1, 0
        if loss < self.best - self.delta:
            self.best, self.wait = loss, 0
        elif not self.rest:
            self.wait += 1
            if self.wait >= self.patience and self.lr > self.floor:
                self.lr, self.rest, self.wait = max(self.lr * self.factor, self.floor), self.cooldown, 0


class NetModel(ReducerModel):
    def _spec(self) -> NetSpec:
        return NetSpec(**self.meta["spec"])

    def embedding(self) -> Column:
        weights = {k: self.params_[k] for k in ("W", "b")}

        @arrow_udf("array<double>")
        def apply(batch: pa.Array) -> pa.Array:
            if len(batch) == 0:
                return pa.array([], pa.list_(pa.float64()))
            return list_column(encode(weights, matrix_of(batch)))

        return apply(self.features)

    def label_scores(self) -> Column:
        """Scores of the label head: ten category shares, or one attack score."""
        if self._spec().head == "none":
            raise ValueError("an unsupervised net has no label head")
        weights, spec = {k: self.params_[k] for k in ("W", "b", "U", "c")}, self._spec()

        @arrow_udf("array<double>")
        def apply(batch: pa.Array) -> pa.Array:
            if len(batch) == 0:
                return pa.array([], pa.list_(pa.float64()))
            return list_column(head_scores(weights, spec, matrix_of(batch)))

        return apply(self.features)

    def feature_matrix(self) -> np.ndarray:
        return self.params_["W"]

    def history(self, spark: SparkSession, run: int = 0) -> DataFrame:
        rows = [(run, i, float(l), float(r)) for i, (l, r) in enumerate(self.meta["history"])]
        return spark.createDataFrame(rows, "run int, step int, loss double, lr double")


class NetReducer(Reducer):
    """Trains ``runs`` independently initialised nets in the same passes over the data."""

    name = "net"

    def __init__(self, spec: NetSpec, size: int = 2, steps: int = 200, lr: float = 1e-3, lr_decay: float = 1e-5,
                 batch_size: int | None = None, seed: int = 1337, runs: int = 1, stop_after: int | None = None,
                 features: str = "features", output: str = "embedding"):
        super().__init__(size, features, output)
        self.spec, self.steps, self.lr, self.lr_decay = spec, steps, lr, lr_decay
        self.batch_size, self.seed, self.runs, self.stop_after = batch_size, seed, runs, stop_after

    def with_run(self, run: int) -> NetReducer:
        other = self.copy()
        other.seed = self.seed + run
        return other

    def identity(self) -> dict:
        return {**super().identity(), "spec": asdict(self.spec)}

    def _fit(self, dataset: DataFrame) -> NetModel:
        return self.fit_runs(dataset, 1)[0]

    def fit_runs(self, dataset: DataFrame, runs: int) -> list[NetModel]:
        spec, d = self.spec, feature_width(dataset, self.features)
        shapes = spec.shapes(d, self.size)
        label = {"category": "category", "binary": "label", "none": None}[spec.head]
        target = F.col(label).cast("double") if label else F.lit(0.0)
        rows = dataset.select(self.features, target.alias("y")).persist()
        try:
            theta = [initial(shapes, self.seed + r) for r in range(runs)]
            plateau = [Plateau(self.lr) for _ in range(runs)]
            if self.batch_size:
                trained, history = self._local_passes(rows, theta, shapes, plateau)
            else:
                trained, history = self._gradient_steps(rows, theta, shapes, plateau)
        finally:
            rows.unpersist()
        flat = [name for name, shape in shapes.items() if len(shape) == 1]
        return [
            NetModel(self.name, {k: v.copy() for k, v in unpack(trained[r], shapes).items()}, self.features,
                     self.output, {"spec": asdict(spec), "size": self.size, "flat": flat, "history": history[r]})
            for r in range(runs)
        ]

    def _gradient_steps(self, rows, theta, shapes, plateau):
        width, spec = len(theta[0]), self.spec
        optimizers = [Adam(width, self.lr_decay) for _ in theta]
        history = [[] for _ in theta]
        for _ in range(self.steps):
            current = [t.copy() for t in theta]

            def fold(batch, current=current):
                x, y = matrix_of(batch[0]), batch[1].to_numpy(zero_copy_only=False)
                parts = [[float(len(x))]]
                for t in current:
                    loss, grad = data_loss(t, shapes, spec, x, y)
                    parts += [[loss], grad]
                return np.concatenate(parts)

            out = summed(rows, 1 + len(theta) * (1 + width), fold)
            n, out = out[0], out[1:].reshape(len(theta), 1 + width)
            for r, t in enumerate(theta):
                extra, extra_grad = penalty(t, shapes, spec)
                loss = out[r, 0] / n + extra
                history[r].append((loss, plateau[r].lr))
                theta[r] = optimizers[r].step(t, out[r, 1:] / n + extra_grad, plateau[r].lr)
                plateau[r].see(loss)
            if self._stalled(history):
                break
        return theta, history

    def _local_passes(self, rows, theta, shapes, plateau):
        """Each pass averages weights and moments of all tasks, weighted by their rows."""
        width, spec, batch_size, decay = len(theta[0]), self.spec, self.batch_size, self.lr_decay
        moments = [(np.zeros(width), np.zeros(width), 0.0) for _ in theta]
        history = [[] for _ in theta]
        for _ in range(self.steps):
            start = [(t.copy(), *m, p.lr) for t, m, p in zip(theta, moments, plateau)]

            def fold(batch, start=start):
                # called once per Arrow batch, which is then one worker's share of the pass
                x, y = matrix_of(batch[0]), batch[1].to_numpy(zero_copy_only=False)
                parts = [[float(len(x))]]
                for t, m, v, count, lr in start:
                    adam = Adam(width, decay)
                    adam.m, adam.v, adam.t = m, v, int(count)
                    total = 0.0
                    for at in range(0, len(x), batch_size):
                        xb, yb = x[at:at + batch_size], y[at:at + batch_size]
                        loss, grad = data_loss(t, shapes, spec, xb, yb)
                        extra, extra_grad = penalty(t, shapes, spec)
                        total += loss + extra * len(xb)
                        t = adam.step(t, grad / len(xb) + extra_grad, lr)
                    parts += [[total], len(x) * t, len(x) * adam.m, len(x) * adam.v, [len(x) * float(adam.t)]]
                return np.concatenate(parts)

            out = summed(rows, 1 + len(theta) * (2 + 3 * width), fold)
            n, out = out[0], out[1:].reshape(len(theta), 2 + 3 * width) / out[0]
            for r in range(len(theta)):
                history[r].append((out[r, 0], plateau[r].lr))
                plateau[r].see(out[r, 0])
                theta[r] = out[r, 1:1 + width]
                moments[r] = (out[r, 1 + width:1 + 2 * width], out[r, 1 + 2 * width:1 + 3 * width], out[r, -1])
            if self._stalled(history):
                break
        return theta, history

    def _stalled(self, history) -> bool:
        """No run improved for ``stop_after`` steps."""
        s = self.stop_after
        return bool(s) and all(
            len(h) > s and min(l for l, _ in h[-s:]) > min(l for l, _ in h[:-s]) - 1e-4 for h in history
        )


def ae_category(size: int = 2, **options) -> NetReducer:
    """Semi-supervised: category head and reconstruction."""
    return _net("cats_ae", NetSpec(head="category"), size, options)


def ae_binary(size: int = 2, **options) -> NetReducer:
    """Semi-supervised: Normal/Attack head and reconstruction."""
    return _net("bin_ae", NetSpec(head="binary"), size, options)


def ae_unsupervised(size: int = 2, **options) -> NetReducer:
    """Reconstruction only."""
    return _net("unsup_ae", NetSpec(head="none"), size, options)


def net_supervised(size: int = 2, **options) -> NetReducer:
    """Category head only; the bottleneck is its embedding."""
    options.pop("reconstruct", None)
    return _net("sup_cats_ae", NetSpec(head="category", reconstruct="none"), size, options)


def _net(name: str, spec: NetSpec, size: int, options: dict) -> NetReducer:
    """Options of the loss go to the spec, the rest to the training; later ones override the defaults."""
    fields = {k: options.pop(k) for k in list(options) if k in NetSpec.__dataclass_fields__}
    reducer = NetReducer(replace(spec, **fields), size, **options)
    reducer.name = name
    return reducer
