"""Sampled SentencePiece segmentations: Gumbel top-k without replacement.

A text's segmentation lattice has one edge per vocabulary piece that matches (or
per unknown character, spelled in byte pieces); a segmentation's log-weight is the
sum of ``-alpha * log(2 - score)`` over its pieces, normalised over the lattice.
No piece holds a space after another character, so the lattice is a chain of
independent units (a space run with the word behind it; punctuation apart from
letters where no piece joins them), and a text's distribution is the product of
its units'.

Search, per text, all draws from a counter-based generator seeded by the row key:

* backward sums give every lattice node's exact log mass (the A* heuristic);
* the first segmentation is an exact draw; its Gumbel value is the root's;
* the rest of the space is split into disjoint sets "same as this one before unit
  j, different at j"; each set's best Gumbel value is drawn truncated at its
  parent's.  The set with the largest value is popped, its segmentation drawn, and
  split again, until k distinct segmentations are found.  This is perturbed A*
  search, so they are a sample without replacement in Gumbel order;
* the largest value left open is the threshold kappa: a segmentation with log
  probability l is included with probability 1 - exp(-exp(l - kappa)), whose log
  is the inclusion score.  If the space is exhausted kappa is -inf and it is 0.

The heavy part is vectorised over blocks of texts: distinct units are walked
through the piece trie together, then all units of all texts are sampled together.

Edge cases: a null or empty text has the one empty segmentation; rows with equal
keys and texts give equal results; a null key has a fixed seed; a text with fewer
than k segmentations gives all it has; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.textops import mix64

ALPHA = 1.0            # weight of a piece: (2 - score) ** -ALPHA
UNKNOWN_SCORE = -1e6   # score of one byte piece
BLOCK_CHARS = 1 << 18   # characters sampled at once; a longer text is a block of its own
KEPT_POSITIONS = 1_000_000  # lattice characters a worker keeps (about 50 MB)
OPEN_MASS = -60.0      # sets lighter than this below the parent cannot win in double precision
SPACE = "▁"
_TEXT_END = 1 << 21    # code of a byte-spelled character: _TEXT_END + code point

#: coarse units (cut before a space run) and fine units (letters apart from all else)
_COARSE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_FINE = re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}*(?:[^\w{SPACE}]|[\d_])+|{SPACE}+")
_FINE_ASCII = re.compile(f"{SPACE}*(?:[A-Za-z]+|[^A-Za-z{SPACE}]+)|{SPACE}+")  # the same where all else is ASCII


class PieceTable:
    """Vocabulary of a SentencePiece model as a hashed trie, with byte strings for decoding."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp, n = sp, sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.text = {i: sp.id_to_piece(i) for i in normal}
        cut = [p for p in self.text.values() if len(_FINE.findall(p)) > 1]
        self.joined = re.compile("|".join(map(re.escape, cut))) if cut else None
        if any(len(_COARSE.findall(p)) > 1 for p in cut):
            raise ValueError("a piece spans a space: its texts have no independent units")
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.unknown_id = sp.unk_id()
        self.has_bytes = bool((self.byte_id != self.unknown_id).all())
        self.byte_weight = -alpha * math.log(2 - UNKNOWN_SCORE)
        # characters -> dense classes, trie edges -> open-addressed table
        chars = sorted({ord(c) for p in self.text.values() for c in p})
        self.class_of = np.zeros(max(chars) + 2, dtype=np.int64)
        self.class_of[chars] = np.arange(1, len(chars) + 1)
        self.n_class = len(chars) + 1
        child: dict[int, int] = {}
        self.piece_at, self.weight_at = [-1], [0.0]
        for i, p in self.text.items():
            node = 0
            for c in p:
                key = node * self.n_class + int(self.class_of[ord(c)])
                node = child.setdefault(key, len(self.piece_at))
                if node == len(self.piece_at):
                    self.piece_at.append(-1), self.weight_at.append(0.0)
            self.piece_at[node], self.weight_at[node] = i, -alpha * math.log(2 - min(0.0, sp.get_score(i)))
        self.piece_at, self.weight_at = np.array(self.piece_at), np.array(self.weight_at)
        self.bits = max(10, int(4 * len(child)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.vals = np.zeros(1 << self.bits, dtype=np.int32)
        for k, v in child.items():
            s = (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[s] >= 0:
                s = (s + 1) & (len(self.keys) - 1)
            self.keys[s], self.vals[s] = k, v
        self.single = np.zeros(len(self.class_of), dtype=bool)
        self.single[[ord(p) for p in self.text.values() if len(p) == 1]] = True
        # decoding: bytes of every id
        raw = [self.text[i].replace(SPACE, " ").encode() if i in self.text else b"" for i in range(n)]
        for b in range(256):
            if self.has_bytes:
                raw[self.byte_id[b]] = bytes([b])
        self.raw_len = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.concatenate(([0], np.cumsum(self.raw_len)))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.id_type = "<u2" if n <= 1 << 16 else "<u4"

    def step(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Child of each node by character class; -1 where there is none."""
        key = node * self.n_class + cls
        s = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[s]
        out = np.where(got == key, self.vals[s], -1)
        todo = np.flatnonzero((got != key) & (got >= 0))
        while len(todo):
            s[todo] = (s[todo] + 1) & (len(self.keys) - 1)
            got = self.keys[s[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.vals[s[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def normalize(self, text: str) -> str:
        return self.sp.normalize(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """Text bytes of ids (the model's leading space is taken off)."""
        n = self.raw_len[ids]
        if not len(ids):
            return b""
        shift = np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n)
        out = self.raw[shift + np.arange(len(shift))].tobytes()
        return out[1:] if out[:1] == b" " else out


@lru_cache(maxsize=2)
def piece_table(path: str, alpha: float = ALPHA) -> PieceTable:
    return PieceTable(path, alpha)


class Lattice:
    """Lattices of distinct units in growing arrays: edges ``off[p]:off[p + 1]`` leave
    character position ``p``.  A worker keeps the units it met first (up to
    ``KEPT_POSITIONS`` characters); later ones are dropped after their block."""

    def __init__(self, t: PieceTable) -> None:
        self.t = t
        self.index: dict[str, int] = {}
        self.first, self.last = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.off, self.to = np.zeros(1, np.int32), np.zeros(0, np.int32)
        self.piece, self.logp, self.upto = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.uint32)

    def units(self, blocks: list[list[str]]) -> np.ndarray:
        """Unit numbers of the blocks' units, new ones added."""
        units, base = list(chain.from_iterable(blocks)), len(self.index)
        out = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        at = np.flatnonzero(out < 0)
        unknown = [units[i] for i in at.tolist()]
        new = dict.fromkeys(unknown)
        new = dict(zip(new, range(base, base + len(new)), strict=True))
        out[at] = np.fromiter(map(new.__getitem__, unknown), np.int64, len(unknown))
        self._add(list(new))
        self.index.update(new)
        return out

    def trim(self) -> None:
        """Forget the units beyond the kept positions."""
        if len(self.off) - 1 <= KEPT_POSITIONS:
            return
        n = max(1, int(np.searchsorted(self.last, KEPT_POSITIONS, side="right")))
        if n == len(self.first):
            return
        pos = int(self.last[n - 1])
        m = int(self.off[pos])
        # views: the next units are joined to them in new arrays
        self.first, self.last, self.off = self.first[:n], self.last[:n], self.off[:pos + 1]
        self.to, self.piece, self.logp, self.upto = (x[:m] for x in (self.to, self.piece, self.logp, self.upto))
        for _ in range(len(self.index) - n):
            self.index.popitem()

    def _add(self, units: list[str]) -> None:
        if not units:
            return
        t = self.t
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(u) for u in units], dtype=np.int64)
        last = np.cumsum(size)
        first = last - size
        n = len(text)
        end = np.repeat(last, size)
        cls = np.where(text < len(t.class_of), t.class_of[np.minimum(text, len(t.class_of) - 1)], 0)
        known = (cls > 0) & t.single[np.minimum(text, len(t.single) - 1)]
        count = np.zeros(n, dtype=np.int32)
        found = []
        node, pos, depth = np.zeros(n, np.int64), np.arange(n), 0
        while len(pos):
            node = t.step(node, cls[pos + depth])
            ok = node >= 0
            node, pos = node[ok], pos[ok]
            depth += 1
            piece = t.piece_at[node]
            hit = np.flatnonzero(piece >= 0)
            p = pos[hit]
            found.append((p, depth, piece[hit], t.weight_at[node[hit]], count[p]))
            count[p] += 1
            ok = pos + depth < end[pos]
            node, pos = node[ok], pos[ok]
        p = np.flatnonzero(~known)  # spelled in bytes
        width = 1 + (text[p] > 0x7F).astype(np.int64) + (text[p] > 0x7FF) + (text[p] > 0xFFFF)
        found.append((p, 1, _TEXT_END + text[p], t.byte_weight * width, count[p]))
        count[p] += 1
        off = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        m = int(off[-1])
        to, pieces, logp = np.zeros(m, np.int64), np.zeros(m, np.int32), np.zeros(m)
        for p, d, piece, w, rank in found:
            e = off[p] + rank
            to[e], pieces[e], logp[e] = p + d, piece, w
        # backward sums, all units in step by the distance to their end; position n stands for
        # every unit's end and has mass 0
        left = end - np.arange(n)
        mass = np.zeros(n + 1)
        src = np.repeat(np.arange(n), count)
        dest = np.where(to < end[src], to, n)
        order = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p = order[a:b]
            c, o = count[p], off[p]
            acc = np.full(len(p), -np.inf)
            sel = np.arange(len(p))
            for r in range(int(c.max(initial=0))):
                sel = sel[c[sel] > r]
                e = o[sel] + r
                acc[sel] = np.logaddexp(acc[sel], logp[e] + mass[dest[e]])
            mass[p] = acc
        logp += mass[dest] - mass[src]
        share, acc, sel = np.exp(logp), np.zeros(n), np.arange(n)
        for r in range(int(count.max(initial=0))):  # sums per position: they depend on the unit alone
            sel = sel[count[sel] > r]
            e = off[sel] + r
            acc[sel] += share[e]
            share[e] = acc[sel]
        upto = np.minimum(share * 2.0 ** 32, 2.0 ** 32 - 1).astype(np.uint32)
        upto[off[1:] - 1] = 0xFFFFFFFF  # the last edge takes what rounding leaves
        at, edges = len(self.off) - 1, len(self.to)
        self.first = np.concatenate([self.first, (first + at).astype(np.int32)])
        self.last = np.concatenate([self.last, (last + at).astype(np.int32)])
        self.off = np.concatenate([self.off, (off[1:] + edges).astype(np.int32)])
        self.to = np.concatenate([self.to, (to + at).astype(np.int32)])
        self.piece = np.concatenate([self.piece, pieces])
        self.logp, self.upto = np.concatenate([self.logp, logp]), np.concatenate([self.upto, upto])

    def sample(self, unit: np.ndarray, seed: np.ndarray):
        """One exact draw per given unit: edges (flat), their offsets, log probabilities."""
        n = len(unit)
        act, pos, stop = np.arange(n), self.first[unit], self.last[unit]
        state, logp, steps = mix64(seed), np.zeros(n), []
        while len(act):
            u = (state >> np.uint64(32)).astype(np.uint32)
            e = self.off[pos]
            todo = np.flatnonzero(u > self.upto[e])
            while len(todo):
                e[todo] += 1
                todo = todo[u[todo] > self.upto[e[todo]]]
            steps.append((act, e))
            logp[act] += self.logp[e]
            pos = self.to[e]
            go = np.flatnonzero(pos < stop)
            act, pos, stop = act[go], pos[go], stop[go]
            state = state[go] * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
        count = np.zeros(n, np.int64)
        for a, _ in steps:
            count[a] += 1
        off = np.concatenate(([0], np.cumsum(count)))
        edges = np.zeros(int(off[-1]), np.int32)
        for k, (a, e) in enumerate(steps):
            edges[off[a] + k] = e
        return edges, off, logp

    def sample_other(self, unit: int, banned: list[tuple[list[int], float]], u) -> tuple[list[int], float]:
        """An exact draw from a unit's segmentations other than the banned
        ``(edges, log probability)`` ones: descends by the mass left below each edge."""
        pos, stop = int(self.first[unit]), int(self.last[unit])
        path: list[int] = []
        total, inside = 0.0, [(b, math.exp(lp)) for b, lp in banned]
        while pos < stop:
            a, b = int(self.off[pos]), int(self.off[pos + 1])
            k = len(path)
            mass = []
            for e in range(a, b):
                gone = sum(p for x, p in inside if x[k] == e)
                here = math.exp(total + float(self.logp[e]))
                mass.append(here - gone if here - gone > 1e-9 * here else 0.0)
            if sum(mass) <= 0:  # what is left is below rounding
                mass = [0.0 if any(x[k] == e for x, _ in inside) else 1e-300 for e in range(a, b)]
                mass = mass if any(mass) else [1.0] * (b - a)
            x, e = next(u) * sum(mass), a
            while e < b - 1 and x >= mass[e - a]:
                x -= mass[e - a]
                e += 1
            while mass[e - a] == 0.0:
                e -= 1
            total += float(self.logp[e])
            inside = [(q, p) for q, p in inside if q[k] == e]
            path.append(e)
            pos = int(self.to[e])
        return path, total


@lru_cache(maxsize=2)
def _lattice(path: str, alpha: float) -> Lattice:
    """The lattice pool a worker keeps between batches."""
    return Lattice(piece_table(path, alpha))


def uniform(seed: np.ndarray, counter) -> np.ndarray:
    """Uniform doubles in (0, 1) from 64-bit seeds and a counter."""
    h = mix64(seed + np.uint64(0x9E3779B97F4A7C15) * np.asarray(counter).astype(np.uint64))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _truncated(mu: np.ndarray, u: np.ndarray, most: float) -> np.ndarray:
    """Gumbel(mu) draws conditioned to stay below ``most``."""
    g = mu + _gumbel(u)
    hi = np.maximum(-most, -g)
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(g), -np.inf, -(hi + np.log(np.exp(-most - hi) + np.exp(-g - hi))))


def _spell(t: PieceTable, pieces: np.ndarray) -> np.ndarray:
    """Vocabulary ids: byte-spelled characters become their byte pieces."""
    at = np.flatnonzero(pieces >= _TEXT_END)
    if len(at) == 0:
        return pieces
    code = pieces[at] - _TEXT_END
    if t.has_bytes and code.max() < 0x80:
        out = pieces.copy()
        out[at] = t.byte_id[code]
        return out
    spelled = [t.byte_id[list(chr(int(c)).encode("utf-8", "replace"))] if t.has_bytes else np.array([t.unknown_id])
               for c in code]
    size = np.ones(len(pieces), np.int64)
    size[at] = [len(x) for x in spelled]
    out = np.repeat(pieces, size)
    flat = np.concatenate([np.arange(len(x)) for x in spelled]) + np.repeat((np.cumsum(size) - size)[at], size[at])
    out[flat] = np.concatenate(spelled)
    return out


def _draws(seed: int, salt: int):
    """Endless uniform draws of one row."""
    one = np.array([seed], np.uint64)
    for i in count(0, 16):
        yield from uniform(one, salt + i + np.arange(16)).tolist()


class _Segmentation:
    """A segmentation found: ``base`` up to unit ``at``, ``unit`` there, fresh draws behind;
    with the open sets split off from it (``val``: their best Gumbel values)."""

    def __init__(self, rnd, base, at, unit, logp) -> None:
        self.round, self.base, self.at, self.unit, self.logp = rnd, base, at, unit, logp
        self.banned: dict[int, list] = {}


def _search_one(lat: Lattice, unit: np.ndarray, seed: int, g: float, fresh: list, a: int, b: int, k: int):
    """The k segmentations of one text (units ``a:b``), the first with Gumbel value ``g``:
    ``(gumbel, logp, edges)`` and kappa."""
    salt = np.array([seed], np.uint64)
    base, at, kappa = None, 0, -math.inf
    sets: list[_Segmentation] = []
    chosen = []

    def edges(x: _Segmentation, upto: int) -> list:
        e, off, _ = fresh[x.round]
        if x.base is None:
            return [e[off[a]:off[a + upto]]]
        if upto <= x.at:
            return edges(x.base, upto)
        return [*edges(x.base, x.at), x.unit[0], e[off[a + x.at + 1]:off[a + upto]]]

    for r in range(k):
        logp = fresh[r][2][a:b]
        if base is None:
            own = _Segmentation(r, None, 0, None, logp)
        else:
            one = lat.sample_other(int(unit[a + at]), base.banned[at], _draws(seed, (r + 1) << 44))
            base.banned[at].append(one)
            own = _Segmentation(r, base, at, one, np.concatenate([base.logp[:at], [one[1]], logp[at + 1:]]))
        lp = own.logp
        own.first = 0 if base is None else at + 1
        start = float(lp[:own.first].sum())
        size = 128
        while True:  # sets far lighter than the heaviest cannot win
            head = lp[own.first:own.first + size]
            before = start + np.cumsum(head) - head
            if len(head) < size or before[-1] < start + OPEN_MASS:
                break
            size *= 8
        own.before = before
        with np.errstate(divide="ignore"):
            mu = before + np.log(np.maximum(-np.expm1(np.minimum(head, 0.0)), 0.0))
        mu[head > -1e-12] = -np.inf  # the only segmentation of its unit
        own.val = _truncated(mu, uniform(salt, np.arange(own.first, own.first + len(mu)) + ((r + 2) << 41)), g)
        sets.append(own)
        chosen.append((g, float(lp.sum()), own))
        if base is not None:  # the popped set loses what was just drawn
            rest = 1.0 - sum(math.exp(x[1]) for x in base.banned[at])
            j = at - base.first
            m = float(base.before[j]) + math.log(rest) if rest > 1e-12 else -math.inf
            base.val[j] = _truncated(np.array([m]), uniform(salt, np.array([at + ((r + 2) << 41) + (1 << 40)])), g)[0]
        best = [float(x.val.max()) if len(x.val) else -math.inf for x in sets]
        base = sets[int(np.argmax(best))]
        kappa = max(best)
        if kappa == -math.inf:
            break
        at = base.first + int(np.argmax(base.val))
        g = kappa
        if at not in base.banned:
            if base.base is not None and at == base.at:
                own_edges = base.unit[0]
            else:
                e, off, _ = fresh[base.round]
                own_edges = e[off[a + at]:off[a + at + 1]].tolist()
            base.banned[at] = [(own_edges, float(base.logp[at]))]
    return [(gv, lp, np.concatenate(edges(x, b - a)).astype(np.int64) if b > a else np.zeros(0, np.int64))
            for gv, lp, x in chosen], kappa


def _search(lat: Lattice, unit: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, k: int):
    """Search every text; text i has units ``bounds[i]:bounds[i + 1]``."""
    row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    within = (np.arange(len(unit)) - bounds[row_of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # a full draw per round; a popped set takes its part behind the changed unit
    step = 0xD1342543DE82EF95
    fresh = [lat.sample(unit, seeds[row_of] + np.uint64((r + 1) * step & 0xFFFFFFFFFFFFFFFF) + within) for r in range(k)]
    roots = _gumbel(uniform(seeds, 1 << 40)).tolist()
    for i in range(len(bounds) - 1):
        yield _search_one(lat, unit, int(seeds[i]), roots[i], fresh, int(bounds[i]), int(bounds[i + 1]), k)


def _units(t: PieceTable, norm: str) -> list[str]:
    """Independent units of a normalised text: fine ones, unless it holds a piece
    that fine units would cut."""
    if t.joined is not None and t.joined.search(norm):
        return _COARSE.findall(norm)
    return (_FINE_ASCII if norm.replace(SPACE, " ").isascii() else _FINE).findall(norm)


def _log_inclusion(logp: float, kappa: float) -> float:
    if kappa == -math.inf:
        return 0.0
    x = logp - kappa
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


SCHEMA = ("key {key}, sample int, gumbel double, log_prob double, log_inclusion double, n_pieces long, ids binary, "
          "decoded_crc32 long, text_crc32 long")


def _sample_batches(path: str, k: int, alpha: float):
    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # other pools keep what blocks no longer use
        t, lat = piece_table(path, alpha), _lattice(path, alpha)
        names = ["key", "sample", "gumbel", "log_prob", "log_inclusion", "n_pieces", "ids", "decoded_crc32", "text_crc32"]
        for b in batches:
            seeds = b.column("seed").to_numpy().view(np.uint64)
            texts = b.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, size, bounds, norms, parts = i, 0, [0], [], []
                while j < len(texts) and (j == i or size < BLOCK_CHARS):
                    norm = t.normalize(texts[j]) if texts[j] else ""
                    norms.append(norm)
                    parts.append(_units(t, norm))
                    bounds.append(bounds[-1] + len(parts[-1]))
                    size += len(norm)
                    j += 1
                unit = lat.units(parts)
                cols: list[list] = [[] for _ in names]
                rows = []
                for r, (segs, kappa) in enumerate(_search(lat, unit, np.array(bounds), mix64(seeds[i:j]), k)):
                    crc = zlib.crc32(norms[r].replace(SPACE, " ")[1:].encode())
                    for s, (g, lp, edges) in enumerate(segs):
                        ids = _spell(t, lat.piece[edges].astype(np.int64))
                        rows.append(i + r)
                        for c, v in zip(cols[1:], (s, g, lp, _log_inclusion(lp, kappa), len(ids),
                                                   ids.astype(t.id_type).tobytes(), zlib.crc32(t.decode(ids)), crc), strict=True):
                            c.append(v)
                kinds = [None, pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                arrays = [b.column("key").take(pa.array(rows, pa.int64()))]
                arrays += [pa.array(c, kind) for c, kind in zip(cols[1:], kinds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)
                lat.trim()
                i = j
    return run


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, alpha: float = ALPHA, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """Up to ``k`` distinct segmentations per row: ``sample`` (0 first), perturbed
    log probability, log probability, inclusion score, piece ids (little-endian
    uint16, uint32 for larger vocabularies), and crc32 of the text decoded from the
    ids and of the normalised text (equal: the round trip holds)."""
    src = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string")).alias("seed"),
                      F.col(text).cast("string").alias("text"))
    return src.mapInArrow(_sample_batches(model, k, alpha), SCHEMA.format(key=dict(src.dtypes)["key"]))


def _decode_batches(path: str):
    def run(batches):
        t = piece_table(path)
        for b in batches:
            text = [t.decode(np.frombuffer(x or b"", t.id_type).astype(np.int64)).decode("utf-8", "replace")
                    for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("sample"), pa.array(text)], ["key", "sample", "text"])
    return run


def decode_segmentations(segments: DataFrame, model: str) -> DataFrame:
    """``key, sample, text`` decoded from piece ids."""
    s = segments.select("key", "sample", "ids")
    return s.mapInArrow(_decode_batches(model), f"key {dict(s.dtypes)['key']}, sample int, text string")
