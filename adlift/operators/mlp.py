"""Multilayer-perceptron regressors, many networks trained side by side.

Rows are dealt by key hash into groups of about ``ROWS_PER_GROUP`` rows; the number of
groups comes from the row count alone.  One round is one Spark job: a task takes one
group's rows (and, where there are fewer groups than cores, a share of the networks),
trains every network still running for one epoch of minibatch Adam (ReLU layers,
identity output, squared loss, L2 ``alpha``) and returns weights and optimizer state,
weighted by its rows.  Groups are summed in group order, ``FAN_IN`` at a time on the
executors, so the weights depend neither on partitions nor on cores.  A network stops
after ``patience`` epochs in which R2 on the validation share (a hash-chosen tenth of its
rows) has not risen by ``tol``; its best weights are kept and it leaves the rounds.
Where all rows are one group there is nothing to sum and one job trains all epochs.

Every network has the fold it must not see and the affine transform fitted on the other
folds, so all (grid point, fold) networks share one copy of the rows.
"""

from __future__ import annotations

import pickle
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.constants import SEED
from adlift.functions.scalar import hash_unit, key_hash_hex

ROWS_PER_GROUP = 20_000
FAN_IN = 8
DRIVER_BYTES = 32 << 20  # sums of a round that the driver adds itself
RELU_VALUES = 1 << 18
ERROR_ROWS = 256
MIXED_ROWS = 800
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8
NO_FOLD = -1


def _shapes(n_in: int, hidden: tuple) -> list[tuple]:
    sizes = [n_in, *hidden, 1]
    return [(sizes[i], sizes[i + 1]) for i in range(len(sizes) - 1)]


def _layers(flat: np.ndarray, shapes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight and bias views of stacked networks ``(k, weights)``."""
    out, i = [], 0
    for a, b in shapes:
        out.append((flat[:, i:i + a * b].reshape(-1, a, b), flat[:, None, i + a * b:i + a * b + b]))
        i += a * b + b
    return out


def init_weights(n_in: int, hidden: tuple, seed: int = SEED) -> np.ndarray:
    """Glorot-uniform initialisation (as common MLP libraries do)."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in _shapes(n_in, hidden):
        lim = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-lim, lim, a * b), rng.uniform(-lim, lim, b)]
    return np.concatenate(parts)


_ZEROS: dict = {}


def _relu(h: np.ndarray) -> np.ndarray:
    """In place; numpy's maximum with an array takes a quarter of the time of that with a number."""
    if h.size > RELU_VALUES:
        return np.maximum(h, 0.0, out=h)
    if h.dtype not in _ZEROS:
        _ZEROS[h.dtype] = np.zeros(RELU_VALUES, h.dtype)
    zeros = _ZEROS[h.dtype]
    return np.maximum(h, zeros[:h.size].reshape(h.shape), out=h)


def outputs(flat: np.ndarray, shapes, X: np.ndarray) -> np.ndarray:
    """Predictions ``(k, rows)`` of ``k`` stacked networks of one architecture."""
    h, layers = X, _layers(flat, shapes)
    for i, (W, c) in enumerate(layers):
        h = h @ W
        h += c
        if i < len(layers) - 1:
            _relu(h)
    return h[..., 0]


def forward(flat: np.ndarray, shapes, X: np.ndarray) -> np.ndarray:
    """Predictions of one network."""
    return outputs(flat[None], shapes, X)[0]


def _blocks(flat: np.ndarray, shapes) -> list[np.ndarray]:
    """Views ``(k, inputs + 1, outputs)`` of stacked networks: weights, with the biases as last row."""
    out, i = [], 0
    for a, b in shapes:
        out.append(flat[:, i:i + (a + 1) * b].reshape(-1, a + 1, b))
        i += (a + 1) * b
    return out


class _Gradient:
    """Gradients of ``k`` stacked networks ``w`` on batches of ``rows`` rows, written to ``out``.

    Rows run along the last axis, so that a network's layer is one contiguous block, and a row
    of ones below every layer makes the biases a part of the matrix products.  All arrays are
    made once; ``w`` and ``out`` are changed in place by the caller."""

    def __init__(self, w: np.ndarray, out: np.ndarray, shapes, rows: int) -> None:
        k, hidden = len(w), [b for _, b in shapes[:-1]]
        self.w, self.g, self.rows = _blocks(w, shapes), _blocks(out, shapes), rows
        self.h = [np.ones((k, b + 1, rows), w.dtype) for b in hidden]
        self.delta = [np.empty((k, b, rows), w.dtype) for b in hidden]
        self.d = np.empty((k, 1, rows), w.dtype)
        self.back = [np.empty((k, a, b), w.dtype) for a, b in shapes[1:-1]]
        self.below = [np.empty_like(x) for x in self.delta[:-1]]
        self.one = np.ones((max(hidden), rows), w.dtype)
        self.first = np.empty((k * shapes[0][1], shapes[0][0] + 1), w.dtype)

    def _open(self, h: np.ndarray, out: np.ndarray) -> np.ndarray:
        """1 where a unit passes its input on, 0 elsewhere (``h`` is not negative)."""
        return np.ceil(np.minimum(h, self.one[:h.shape[1]], out=out), out=out)

    def __call__(self, X: np.ndarray, XT: np.ndarray, y: np.ndarray) -> None:
        """``X`` has a column of ones at its end, ``XT`` is its transpose."""
        w, g, h, last = self.w, self.g, self.h, len(self.h) - 1
        for i, (layer, x) in enumerate(zip(h, [XT, *h], strict=False)):
            np.matmul(w[i].transpose(0, 2, 1), x, out=layer[:, :-1])
            _relu(layer)
        np.matmul(w[-1].transpose(0, 2, 1), h[-1], out=self.d)
        self.d -= y
        self.d *= self.d.dtype.type(1 / self.rows)
        np.matmul(h[-1], self.d.transpose(0, 2, 1), out=g[-1])
        # the factor of the output weights is taken out of the last layer's deltas
        out_w = w[-1][:, :-1]
        delta = self._open(h[-1][:, :-1], self.delta[-1])
        delta *= self.d
        for i in range(last, 0, -1):
            np.matmul(h[i - 1], delta.transpose(0, 2, 1), out=g[i])
            back = w[i][:, :-1]
            if i == last:
                g[i] *= out_w.transpose(0, 2, 1)
                back = np.multiply(back, out_w.transpose(0, 2, 1), out=self.back[i - 1])
            delta = np.matmul(back, delta, out=self.delta[i - 1])
            delta *= self._open(h[i - 1][:, :-1], self.below[i - 1])
        first = np.matmul(delta.reshape(-1, self.rows), X, out=self.first).reshape(len(w[0]), -1, X.shape[1])
        if last == 0:
            first *= out_w
        g[0][:] = first.transpose(0, 2, 1)


def _with_ones(X: np.ndarray) -> np.ndarray:
    return np.concatenate([X, np.ones((len(X), 1), X.dtype)], axis=1)


def _decay(shapes, alpha: np.ndarray) -> np.ndarray:
    """``alpha`` of every weight, 0 of biases."""
    out = np.zeros((len(alpha), sum((a + 1) * b for a, b in shapes)), alpha.dtype)
    for block in _blocks(out, shapes):
        block[:, :-1] = alpha[:, None, None]
    return out


def gradients(flat: np.ndarray, shapes, X: np.ndarray, y: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Gradient of (mean squared error / 2 + alpha / 2 / rows * squared weights) per network."""
    flat, X = np.ascontiguousarray(flat), _with_ones(X)
    out = np.empty_like(flat)
    _Gradient(flat, out, shapes, len(y))(X, np.ascontiguousarray(X.T), y)
    return out + _decay(shapes, np.asarray(alpha, flat.dtype)) * flat / len(y)


@dataclass
class MLPConfig:
    hidden: tuple = (50, 25)
    alpha: float = 1e-3
    learning_rate: float = 1e-2
    batch_size: int = 200
    max_epochs: int = 500
    patience: int = 20
    tol: float = 1e-4
    seed: int = SEED
    fold: int = NO_FOLD  # rows of this fold are not trained on


@dataclass
class Network:
    """Training state; ``fill``, ``mean``, ``scale`` transform the raw features."""

    cfg: MLPConfig
    affine: tuple[np.ndarray, np.ndarray, np.ndarray]
    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: float = 0.0
    epoch: int = 0
    best: float = -np.inf
    best_w: np.ndarray | None = None
    waited: int = 0
    history: list = field(default_factory=list)

    @property
    def shapes(self):
        return _shapes(len(self.affine[0]), self.cfg.hidden)

    @property
    def done(self) -> bool:
        return self.waited >= self.cfg.patience or self.epoch >= self.cfg.max_epochs

    @property
    def weights(self) -> np.ndarray:
        return self.w if self.best_w is None else self.best_w

    def judge(self, w: np.ndarray, sse: float, n: float, s: float, ss: float) -> None:
        """Early stopping by R2 of ``w`` on the validation share."""
        spread = ss - s * s / n if n else 0.0
        r2 = 1 - sse / spread if spread > 0 else (0.0 if n else np.nan)
        self.history.append((len(self.history), r2))
        if not n or r2 > self.best + self.cfg.tol:
            self.waited = 0
        else:
            self.waited += 1
        if not n or r2 > self.best:
            self.best, self.best_w = r2, w.copy()


def new_network(cfg: MLPConfig, affine) -> Network:
    w = init_weights(len(affine[0]), cfg.hidden, cfg.seed)
    return Network(cfg, tuple(np.asarray(a, float) for a in affine), w, np.zeros_like(w), np.zeros_like(w))


def _transformed(X: np.ndarray, affine) -> np.ndarray:
    fill, mean, scale = affine
    return (np.where(np.isnan(X), fill, X) - mean) / scale


def _stacks(nets: list[Network]) -> list[list[int]]:
    """Networks that train on the same rows in the same batches, by shape."""
    by: dict = {}
    for i, n in enumerate(nets):
        by.setdefault((n.cfg.fold, n.cfg.hidden, n.cfg.batch_size, n.cfg.seed, n.epoch), []).append(i)
    return list(by.values())


def _epoch(nets: list[Network], X: np.ndarray, y: np.ndarray, group: int) -> None:
    """One epoch of networks of one stack on a group's training rows."""
    cfg, shapes = nets[0].cfg, nets[0].shapes
    w, m, v = (np.stack([getattr(n, k) for n in nets]).astype(np.float32) for k in ("w", "m", "v"))
    m /= np.float32(1 - BETA1)  # kept without the factors of their sums: two passes less a step
    v /= np.float32(1 - BETA2)
    decay = _decay(shapes, np.array([n.cfg.alpha for n in nets], np.float32))
    rate = np.array([n.cfg.learning_rate for n in nets], np.float32)[:, None]
    order = np.random.default_rng([cfg.seed, nets[0].epoch, group]).permutation(len(y))
    X, y = _with_ones(X[order]), y[order]
    XT = np.ascontiguousarray(X.T)
    t, g, step, gradient = nets[0].steps, np.empty_like(w), np.empty_like(w), None
    root = np.sqrt(1 - BETA2)
    for s in range(0, len(y), cfg.batch_size):
        batch = slice(s, min(s + cfg.batch_size, len(y)))
        rows = batch.stop - s
        if gradient is None or gradient.rows != rows:
            gradient = _Gradient(w, g, shapes, rows)
        gradient(X[batch], XT[:, batch], y[batch])
        np.multiply(w, decay, out=step)
        step *= np.float32(1 / rows)
        g += step
        t += 1
        m *= np.float32(BETA1)
        m += g
        g *= g
        v *= np.float32(BETA2)
        v += g
        np.sqrt(v, out=g)
        g += np.float32(EPS / root)
        np.divide(m, g, out=step)
        step *= rate * np.float32(np.sqrt(1 - BETA2 ** t) / (1 - BETA1 ** t) * (1 - BETA1) / root)
        w -= step
    m *= np.float32(1 - BETA1)
    v *= np.float32(1 - BETA2)
    for i, n in enumerate(nets):
        n.w, n.m, n.v, n.steps, n.epoch = w[i].astype(float), m[i].astype(float), v[i].astype(float), t, n.epoch + 1


def _errors(nets: list[Network], X, y) -> np.ndarray:
    flat, out = np.stack([n.w for n in nets]), np.zeros(len(nets))
    for s in range(0, len(y), ERROR_ROWS):  # layers that fit the cache
        out += ((outputs(flat, nets[0].shapes, X[s:s + ERROR_ROWS]) - y[s:s + ERROR_ROWS]) ** 2).sum(axis=1)
    return out


# -- groups -----------------------------------------------------------------

def dealt_groups(rows: DataFrame, features: list[str], label: str, key: str, valid, rows_per_group: int = ROWS_PER_GROUP,
                 lanes: int | None = None):
    """``(units, number of groups, lanes)``: one row per (group, lane) with the group's rows as
    arrays, in key hash order.  ``rows`` has ``fold``.  Lanes only share out the networks."""
    y = F.col(label).cast("double")
    src = rows.where(y.isNotNull()).select(F.col(key).cast("long").alias("k"), "fold", *[F.col(c).cast("double").alias(c) for c in features],
                                           y.alias("y"), valid.alias("valid"))
    groups = max(1, -(-src.count() // rows_per_group))
    dealt = src.withColumn("h", F.conv(F.substring(key_hash_hex(F.col("k"), "#mlpdeal"), 1, 12), 16, 10).cast("long"))
    dealt = dealt.withColumn("group", (F.col("h") % groups).cast("int"))

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["h", "k", "fold", *features, "y"])  # repeated keys: by their values
        blob = pickle.dumps((t[features].to_numpy(float), t["y"].to_numpy(float), t["fold"].to_numpy(np.int64), t["valid"].to_numpy(bool)))
        return pd.DataFrame({"group": [int(t["group"].iloc[0])], "rows": [blob]})

    cores = rows.sparkSession.sparkContext.defaultParallelism
    lanes = lanes or max(1, min(20, -(-2 * cores // groups)))
    units = dealt.groupBy("group").applyInPandas(pack, "group int, rows binary")
    units = units.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    block = block_size(groups, cores)
    units = units.withColumn("unit", (F.col("group") / block).cast("int") * lanes + F.col("lane"))
    units = units.repartitionByRange(-(-groups // block) * lanes, "unit").sortWithinPartitions("unit", "group")
    return units.persist(), groups, lanes


def block_size(groups: int, cores: int) -> int:
    """Groups that one task trains in a round: with many groups a whole block of ``FAN_IN``
    neighbours, whose sum leaves the task - what the first adding step would give."""
    return FAN_IN if groups >= 4 * FAN_IN * cores else 1


def _train_unit(shared, lanes: int, alone: bool, block: int = 1):
    """Epochs of a unit's networks: one, or (``alone``: its group is all rows) until each stops.
    One row per (block of groups, lane), its groups added in their order."""
    def epochs(group, lane, blob):
        nets: list[Network] = pickle.loads(shared.value)
        stacks = [s for i, s in enumerate(_stacks(nets)) if i % lanes == lane]
        X, y, fold, valid = pickle.loads(blob)
        out, seen = [], {}
        for stack in stacks:
            part = [nets[i] for i in stack]
            if (known := seen.get(part[0].cfg.fold)) is None or known[0] is not part[0].affine:
                mine = fold != part[0].cfg.fold
                train, held = mine & ~valid, mine & valid
                Xt, yt = _transformed(X[train], part[0].affine).astype(np.float32), y[train].astype(np.float32)
                Xv, yv = _transformed(X[held], part[0].affine), y[held]
                known = seen[part[0].cfg.fold] = (part[0].affine, Xt, yt, Xv, yv)
            _, Xt, yt, Xv, yv = known
            sums = (float(len(yv)), float(yv.sum()), float((yv * yv).sum()))
            if alone:
                left = list(part)
                while left:
                    _epoch(left, Xt, yt, int(group))
                    for n, sse in zip(left, _errors(left, Xv, yv), strict=True):
                        n.judge(n.w, float(sse), *sums)
                    left = [n for n in left if not n.done]
                out += [(i, nets[i]) for i in stack]
            else:
                before = _errors(part, Xv, yv)  # of the weights all groups start from
                _epoch(part, Xt, yt, int(group))
                out += [(i, (np.concatenate([nets[i].w, nets[i].m, nets[i].v]).astype(np.float32),  # as trained: nothing is lost
                             np.array([nets[i].steps, len(yt), e, *sums]))) for i, e in zip(stack, before, strict=True)]
        return pickle.dumps(out)

    def run(frames):
        at, total = None, b""
        for pdf in frames:
            for group, lane, blob in zip(pdf["group"], pdf["lane"], pdf["rows"], strict=True):
                part = epochs(group, lane, blob)
                if at == (here := (int(group) // block, int(lane))):
                    total = _added([total, part])
                    continue
                if at is not None:
                    yield pd.DataFrame({"group": [at[0]], "lane": [at[1]], "part": [total]})
                at, total = here, part
        if at is not None:
            yield pd.DataFrame({"group": [at[0]], "lane": [at[1]], "part": [total]})
    return run


def _weighted(x) -> np.ndarray:
    """A group's weights, optimizer state and steps times its rows; what is already added stays."""
    if isinstance(x, tuple):
        state, (steps, rows, *sums) = x
        x = np.concatenate([rows * state.astype(float), [rows * steps, rows, *sums]])
    return x


def _added(parts: list[bytes]) -> bytes:
    total: dict = {}
    for p in parts:
        for i, x in pickle.loads(p):
            total[i] = total[i] + _weighted(x) if i in total else _weighted(x)
    return pickle.dumps(sorted(total.items()))


def _summed(parts: DataFrame, groups: int, size: int = 0) -> list[bytes]:
    """Parts of ``size`` bytes added in group order, ``FAN_IN`` neighbours at a time, until few
    are left per lane; what is small enough is added the same way on the driver."""
    def add(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("group")
        return pd.DataFrame({"group": [int(t["group"].iloc[0]) // FAN_IN], "lane": [int(t["lane"].iloc[0])], "part": [_added(list(t["part"]))]})
    while groups > FAN_IN and groups * size > DRIVER_BYTES:
        parts = parts.groupBy((F.col("group") / FAN_IN).cast("int").alias("above"), "lane").applyInPandas(add, "group int, lane int, part binary")
        groups = -(-groups // FAN_IN)
    left = [(r["group"], r["lane"], bytes(r["part"])) for r in parts.collect()]
    while groups > FAN_IN:
        by: dict = {}
        for group, lane, part in sorted(left):
            by.setdefault((group // FAN_IN, lane), []).append(part)
        left = [(*k, _added(v)) for k, v in by.items()]
        groups = -(-groups // FAN_IN)
    return [part for _, _, part in sorted(left)]


def train_networks(units: DataFrame, groups: int, lanes: int, nets: list[Network]) -> list[Network]:
    """Train all networks; a job per round, with those still running."""
    sc = units.sparkSession.sparkContext
    schema = "group int, lane int, part binary"
    block = block_size(groups, sc.defaultParallelism)
    while running := [i for i, n in enumerate(nets) if not n.done]:
        shared = sc.broadcast(pickle.dumps([nets[i] for i in running]))  # size set by the networks
        parts = units.mapInPandas(_train_unit(shared, lanes, groups == 1, block), schema)
        if groups == 1:
            for p in _summed(parts, 1):
                for i, n in pickle.loads(p):
                    nets[running[i]] = n
        else:
            size = 24 * sum(len(nets[i].w) for i in running) // lanes
            for i, x in pickle.loads(_added(_summed(parts, -(-groups // block), size))):
                n = nets[running[i]]
                size = len(n.w)
                rows, sse, *sums = x[3 * size + 1:]
                if n.epoch:
                    n.judge(n.w, sse, *sums)
                n.epoch += 1
                if not n.done:
                    n.w, n.m, n.v = (x[k * size:(k + 1) * size] / max(rows, 1.0) for k in range(3))
                    n.steps = x[3 * size] / max(rows, 1.0)
        shared.destroy()
    return nets


def train_side_by_side(units: DataFrame, groups: int, lanes: int, nets: list[Network]) -> list[Network]:
    """``train_networks`` of even and odd folds in rounds of their own: while the sums of one half
    are added and sent out, tasks of the other half train."""
    halves = [[i for i, n in enumerate(nets) if n.cfg.fold % 2 == odd] for odd in (0, 1)]
    halves = [h for h in halves if h]
    if groups == 1 or len(halves) == 1:
        return train_networks(units, groups, lanes, nets)
    nets = list(nets)
    with ThreadPoolExecutor(len(halves)) as pool:
        trained = pool.map(lambda half: train_networks(units, groups, lanes, [nets[i] for i in half]), halves)
        for half, out in zip(halves, trained, strict=True):
            for i, n in zip(half, out, strict=True):
                nets[i] = n
    return nets


def train_mlp(train: DataFrame, features: list[str], label: str, valid_flag, cfg: MLPConfig, key: str,
              rows_per_group: int = ROWS_PER_GROUP) -> Network:
    """One network on prepared features (rows with ``valid_flag`` are the validation share)."""
    m = len(features)
    units, groups, lanes = dealt_groups(train.withColumn("fold", F.lit(0)), features, label, key, valid_flag, rows_per_group, lanes=1)
    try:
        return train_networks(units, groups, lanes, [new_network(cfg, (np.zeros(m), np.zeros(m), np.ones(m)))])[0]
    finally:
        units.unpersist()


def predict(df: DataFrame, net: Network, features: list[str], keep: list[str], out: str = "prediction") -> DataFrame:
    """Score rows batch-wise with the trained weights (mapInPandas)."""
    weights, shapes, affine = net.weights, net.shapes, net.affine

    def run(batches):
        for pdf in batches:
            X = _transformed(pdf[features].to_numpy(dtype=float), affine)
            yield pdf[keep].assign(**{out: forward(weights, shapes, X) if len(pdf) else np.zeros(0)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, *[c for c in features if c not in keep]).mapInPandas(run, f"{schema}, {out} double")


def coalition_values(net: Network, X: np.ndarray, B: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """Mean prediction ``(rows, masks)`` over the rows of ``B``, the columns of a mask taken from the rows of ``X``.

    The first layer is linear in its inputs, so each side's share of it is computed once and the mixed
    rows begin as sums of two; rows alike in a mask (and rows of ``B`` alike outside it) are scored once."""
    def alike(rows: np.ndarray, columns: np.ndarray):
        if not columns.any():
            return np.zeros((1, 0)), np.zeros(len(rows), np.int64), np.array([len(rows)])
        found, at, n = np.unique(rows[:, columns], axis=0, return_inverse=True, return_counts=True)
        return found, at.reshape(-1), n
    X, B, out = _transformed(X, net.affine), _transformed(B, net.affine), np.empty((len(X), len(masks)))
    (W, c), *deeper = [(W[0], c[0]) for W, c in _layers(net.weights[None], net.shapes)]
    for j, mask in enumerate(masks):
        x, at, _ = alike(X, mask)
        b, _, n = alike(B, ~mask)
        x, b, share, values = x @ W[mask], b @ W[~mask] + c, n / n.sum(), np.empty(len(x))
        step = max(1, MIXED_ROWS // len(b))
        for i in range(0, len(x), step):
            h = (x[i:i + step, None] + b).reshape(-1, b.shape[1])
            for V, d in deeper:
                h = _relu(h) @ V
                h += d
            values[i:i + step] = h.reshape(-1, len(b)) @ share
        out[:, j] = values[at]
    return out


def held_errors(rows: DataFrame, nets: list[Network], features: list[str], label: str) -> dict[int, float]:
    """Squared error of every network on the rows of its own fold, in one pass."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(pickle.dumps([(n.cfg.fold, n.affine, n.weights, n.cfg.hidden) for n in nets]))

    def run(batches):
        known = pickle.loads(shared.value)
        stacks: dict = {}
        for i, (fold, _, w, hidden) in enumerate(known):
            stacks.setdefault((fold, hidden), []).append((i, w))
        for pdf in batches:
            X, y, fold = pdf[features].to_numpy(float), pdf[label].to_numpy(float), pdf["fold"].to_numpy()
            out = []
            for (f, hidden), part in stacks.items():
                mine = fold == f
                if mine.any():
                    affine = known[part[0][0]][1]
                    p = outputs(np.stack([w for _, w in part]), _shapes(X.shape[1], hidden), _transformed(X[mine], affine))
                    out += [(i, float(e)) for (i, _), e in zip(part, ((p - y[mine]) ** 2).sum(axis=1), strict=True)]
            yield pd.DataFrame(out, columns=["net", "sse"]).astype({"net": "int32", "sse": "float64"})
    src = rows.where(F.col(label).isNotNull()).select("fold", *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label))
    found = src.mapInPandas(run, "net int, sse double").groupBy("net").agg(F.sum("sse").alias("sse")).collect()
    return {r["net"]: r["sse"] for r in found}


def grid_points(grid: dict | None = None) -> list[dict]:
    """Every combination of the MLP grid (layers x alpha x learning rate)."""
    from itertools import product

    from adlift.constants import MLP_GRID
    g = grid or MLP_GRID
    return [{"layers": tuple(l), "alpha": a, "learningRate": lr}
            for l, a, lr in product(g["layers"], g["alpha"], g["learningRate"])]


def raw_features() -> list[str]:
    """The columns that ``raw_columns`` adds, in the order of the transformed features."""
    from adlift.constants import CATEGORIES, NUMERIC
    return [*NUMERIC, *[f"is_{v.lower()}" for v in CATEGORIES]]


def raw_columns(df: DataFrame) -> DataFrame:
    from adlift.constants import CATEGORICAL, CATEGORIES
    return df.withColumns({f"is_{v.lower()}": F.coalesce(F.col(CATEGORICAL) == v, F.lit(False)).cast("double") for v in CATEGORIES})


def affine_of(prep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fill values, means and scales of a fitted preprocessor over ``raw_features``."""
    from adlift.constants import CATEGORIES
    k = len(CATEGORIES)
    return (np.append(prep.getOrDefault("medians"), np.zeros(k)), np.append(prep.getOrDefault("means"), np.zeros(k)),
            np.append(prep.getOrDefault("scales"), np.ones(k)))


def cross_validate_mlp(folded: DataFrame, grid: list[dict], preps: dict | None = None, n_folds: int | None = None,
                       max_epochs: int = 500, patience: int = 20, label: str | None = None, key: str | None = None,
                       rows_per_group: int = ROWS_PER_GROUP) -> dict:
    """Grid search on the ``fold`` column (X13 + X14): the networks of all points and folds
    train together, each with the preprocessor of its other folds; then the best mean RMSE
    is trained on all rows."""
    from adlift.constants import KEY, N_FOLDS, TARGET
    from adlift.operators import cube

    label, key, folds = label or TARGET, key or KEY, list(range(n_folds or N_FOLDS))
    preps = preps or cube.fit_preprocessors(folded, [*folds, cube.ALL])
    rows, feats = raw_columns(folded), raw_features()
    valid = (hash_unit(F.col(key), "#mlpvalid", 8) % 10) == 0

    def network(p, f):
        cfg = MLPConfig(hidden=tuple(p["layers"]), alpha=p["alpha"], learning_rate=p["learningRate"], max_epochs=max_epochs, patience=patience, fold=f)
        return new_network(cfg, affine_of(preps[f]))

    units, groups, lanes = dealt_groups(rows, feats, label, key, valid, rows_per_group)
    try:
        nets = train_side_by_side(units, groups, lanes, [network(p, f) for p in grid for f in folds])
        sse = held_errors(rows, nets, feats, label)
        y = F.col(label).cast("double")
        sums = {r["fold"]: r for r in rows.where(y.isNotNull()).groupBy("fold").agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss")).collect()}
        results = []
        for i, p in enumerate(grid):
            per = [(sse.get(i * len(folds) + j, 0.0), sums[f]) for j, f in enumerate(folds) if f in sums]
            results.append({"params": p, "cv_rmse": float(np.mean([np.sqrt(e / r["n"]) for e, r in per])),
                            "cv_r2": float(np.mean([1 - e / (r["ss"] - r["s"] ** 2 / r["n"]) for e, r in per]))})
        best = min(results, key=lambda r: r["cv_rmse"])
        final = train_networks(units, groups, lanes, [network(best["params"], cube.ALL)])[0]
    finally:
        units.unpersist()
    return {"best_params": best["params"], "cv_rmse": best["cv_rmse"], "cv_r2": best["cv_r2"], "results": results,
            "preprocessor": preps[cube.ALL], "network": final, "networks": nets, "epochs": final.epoch}
