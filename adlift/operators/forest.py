"""Regression trees on a feature cube, and the models that one growth holds.

``grow`` grows one tree level by level from cell histograms.  A node's split does not
depend on limits met further down, so a tree grown without limits contains the trees
that any depth limit or minimum split size would give (their predictions are read off
on the way down); a forest of 200 trees contains the one of its first 100, and 200
boosting rounds contain the first 100.
"""

from __future__ import annotations

import numpy as np

UNLIMITED = 1 << 30
FLAGS = 6     # 0 / 1 features whose patterns are counted together
TIE = 1e-11  # gains closer than this are equal (the order of sums must not choose): the first feature and border win
NODE_FIELDS = ("feature", "bin", "left", "right", "value", "cover")


def grow(bins: np.ndarray, w: np.ndarray, g: np.ndarray, max_depth: int = UNLIMITED, min_split: float = 2.0,
         ridge: float = 0.0, cuts: tuple = ()) -> tuple[dict, np.ndarray, np.ndarray]:
    """One tree from cells with weights ``w`` and target sums ``g``; a split sends bins up to
    ``bin`` left.  Cells without weight are only routed.

    Returns (nodes, prediction per cell, prediction per (cut, cell)); a cut is (depth limit,
    minimum split size).  A leaf's value is ``g / (w + ridge)``."""
    n, bins = len(bins), narrow(bins)
    flat = bins.T.reshape(-1)
    nodes: dict[str, list] = {k: [] for k in NODE_FIELDS}
    # whether a cut is open is the same for all cells of a node: cuts are kept per node of the level,
    # with the value of the node they closed at; cells only remember where they end
    leaf, cut_values = np.zeros(n, np.int64), []
    open_, closed_at = np.ones((len(cuts), 1), bool), np.zeros((len(cuts), 1))
    cells, at, first, depth = np.arange(n), np.zeros(n, np.int64), 0, 0
    while len(cells):
        k = int(at.max()) + 1  # nodes of this level
        cw, cg = (w, g) if len(cells) == n else (w[cells], g[cells])
        tw, tg = np.bincount(at, cw, k), np.bincount(at, cg, k)
        value = tg / np.maximum(tw + ridge, 1e-300)
        closed_at = np.where(open_, value, closed_at)
        cut_values.append(closed_at)
        for i, (limit, least) in enumerate(cuts):
            open_[i] &= (tw >= least) & (depth < limit)
        score = tg * tg / np.maximum(tw + ridge, 1e-300)
        best, feature, border = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
        can = (tw >= min_split) & (depth < max_depth)
        heavy = (cw > 0) & can[at]
        ha, hc, hw, hg = (at, cells, cw, cg) if heavy.all() else (at[heavy], cells[heavy], cw[heavy], cg[heavy])
        if len(hc):
            for j, gain, bin_, node in _gains(bins, hc, ha, hw, hg, tw, tg, k, ridge):
                better = gain > best[node] * (1 + TIE)
                best[node[better]], feature[node[better]], border[node[better]] = gain[better], j, bin_[better]
        split = can & (best > score * (1 + 1e-9) + 1e-9)
        number = np.cumsum(split) - 1
        left = np.where(split, first + k + 2 * number, -1)
        for name, x in zip(NODE_FIELDS, (np.where(split, feature, -1), np.where(split, border, 0), left,
                                         np.where(split, left + 1, -1), value, tw), strict=True):
            nodes[name].append(x)
        open_, closed_at = (np.repeat(x[:, split], 2, axis=1) for x in (open_, closed_at))
        go = split[at]
        if not go.all():
            stay = ~go
            leaf[cells[stay]] = first + at[stay]
            cells, at = cells[go], at[go]
        right = flat.take(feature[at] * n + cells) > border[at]
        at = 2 * number[at] + right
        first += k
        depth += 1
    nodes = {k: np.concatenate(v) if v else np.zeros(0) for k, v in nodes.items()}
    if not n:
        return nodes, np.zeros(0), np.zeros((len(cuts), 0))
    return nodes, nodes["value"][leaf], np.concatenate(cut_values, axis=1)[:, leaf]


def narrow(bins: np.ndarray) -> np.ndarray:
    """Bins as bytes where they fit, a feature contiguous."""
    if bins.dtype != np.uint8 and bins.size and bins.min() >= 0 and bins.max() < 256:
        return np.asfortranarray(bins, np.uint8)
    return bins


def _grouped(at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Stable order by (node, bin): bins first, then nodes 16 bits at a time, each in linear time."""
    order = np.argsort(x, kind="stable")
    for shift in range(0, max(1, int(at.max()).bit_length()), 16):
        order = order[np.argsort((at[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def _score(w, g, ridge):
    return g * g / (w + ridge)


def _gains(bins, cells, at, w, g, tw, tg, k: int, ridge: float):
    """Best border of every feature in every node: (feature, scores, borders, nodes)."""
    columns = [bins[:, j] if len(cells) == len(bins) else bins[:, j].take(cells) for j in range(bins.shape[1])]
    sizes = [int(x.max()) + 1 for x in columns]
    flags = [j for j, size in enumerate(sizes) if size == 2][:FLAGS]
    table = (1 << len(flags)) * k <= 2 * len(cells) and len(flags) > 1
    if table:  # 0 / 1 features share one table of their patterns
        pattern = at << len(flags)
        for i, j in enumerate(flags):
            pattern += columns[j] << i
        pw, pg = (np.bincount(pattern, v, k << len(flags)).reshape(k, -1) for v in (w, g))
    for j, (x, size) in enumerate(zip(columns, sizes, strict=True)):
        if size < 2:
            continue
        if table and j in flags:
            off = np.flatnonzero(np.arange(1 << len(flags)) >> flags.index(j) & 1 == 0)
            lw, lg = pw[:, off].sum(axis=1), pg[:, off].sum(axis=1)
            ok = (lw >= 0.5) & (tw - lw >= 0.5)
            gain = _score(np.where(ok, lw, 1.0), lg, ridge) + _score(np.where(ok, tw - lw, 1.0), tg - lg, ridge)
            yield j, np.where(ok, gain, -np.inf), np.zeros(k, np.int64), np.arange(k)
            continue
        slot = at * size + x
        if k * size <= 2 * len(cells):  # few nodes: a table of all their bins
            lw = np.bincount(slot, w, k * size).reshape(k, size)[:, :-1].cumsum(axis=1)
            lg = np.bincount(slot, g, k * size).reshape(k, size)[:, :-1].cumsum(axis=1)
            rw, rg = tw[:, None] - lw, tg[:, None] - lg
            ok = (lw >= 0.5) & (rw >= 0.5)  # weights are whole: at least one row on each side
            gain = np.where(ok, _score(np.where(ok, lw, 1.0), lg, ridge) + _score(np.where(ok, rw, 1.0), rg, ridge), -np.inf)
            b = (gain >= gain.max(axis=1, keepdims=True) * (1 - TIE)).argmax(axis=1)
            yield j, gain[np.arange(k), b], b, np.arange(k)
            continue
        order = _grouped(at, x)  # many small nodes: only the bins they hold
        slot, ow, og = slot[order], w[order].cumsum(), g[order].cumsum()
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True))
        slot, ow, og = slot[last], ow[last], og[last]
        node, b = slot // size, slot % size
        first = np.flatnonzero(np.diff(node, prepend=-1))
        start = np.repeat(first, np.diff(np.append(first, len(node))))
        zero = np.zeros(1)
        lw = ow - np.concatenate([zero, ow])[start]
        lg = og - np.concatenate([zero, og])[start]
        rw, rg = tw[node] - lw, tg[node] - lg
        ok = (lw >= 0.5) & (rw >= 0.5)
        gain = np.where(ok, _score(np.where(ok, lw, 1.0), lg, ridge) + _score(np.where(ok, rw, 1.0), rg, ridge), -np.inf)
        top = np.maximum.reduceat(gain, first)
        held = np.flatnonzero(gain >= (1 - TIE) * np.repeat(top, np.diff(np.append(first, len(node)))))
        held = held[np.flatnonzero(np.diff(node[held], prepend=-1))]
        yield j, gain[held], b[held], node[held]


def bootstrap(n: np.ndarray, s: np.ndarray, ss: np.ndarray, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and target sums of a Poisson bootstrap of the rows behind the cells.

    A cell of n rows is drawn Poisson(n) times; the mean of the drawn targets varies around
    the cell's mean with the spread within the cell (none in a cell of one row)."""
    rng = np.random.default_rng([seed, tree])
    w = rng.poisson(n).astype(float)
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    variance = np.divide(ss, n, out=np.zeros_like(s), where=n > 0) - mean * mean
    spread = np.sqrt(np.where((n > 1) & (variance > 1e-10 * mean * mean), variance, 0.0))
    return w, w * mean + np.sqrt(w) * spread * rng.standard_normal(len(n))


def boost(bins: np.ndarray, n: np.ndarray, s: np.ndarray, rounds: int, max_depth: int, rate: float, ridge: float = 1.0,
          marks: tuple[int, ...] = ()) -> tuple[float, list[dict], dict[int, np.ndarray]]:
    """Squared-error boosting: (base value, trees, predictions after each of ``marks`` rounds)."""
    base = float(s.sum() / n.sum()) if n.sum() else 0.0
    has, bins = n > 0, narrow(bins)
    tb, tn, ts = np.asfortranarray(bins[has]), n[has], s[has]
    f, others, trees, seen = np.full(len(tn), base), np.full(int((~has).sum()), base), [], {}
    for r in range(1, rounds + 1):
        nodes, step, _ = grow(tb, tn, ts - tn * f, max_depth, ridge=ridge)
        f = f + rate * step
        if len(others):
            others = others + rate * follow(nodes, bins[~has])
        trees.append(nodes)
        if r in marks:
            seen[r] = np.empty(len(n))
            seen[r][has], seen[r][~has] = f, others
    return base, trees, seen


def follow(nodes: dict, bins: np.ndarray) -> np.ndarray:
    """Predictions of a grown tree."""
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        inner = nodes["left"][at[rows]] >= 0
        rows = rows[inner]
        here = at[rows]
        right = bins[rows, nodes["feature"][here]] > nodes["bin"][here]
        at[rows] = np.where(right, nodes["right"][here], nodes["left"][here])
    return nodes["value"][at]
