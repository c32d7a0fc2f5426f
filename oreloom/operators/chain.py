"""L5 over any number of labels: the chain of ``learn.tuned_chain`` trained in one barrier stage.

A chain of hundreds of labels is thousands of passes over the training rows, one after another; as jobs of their own they would
take hours. Here every task keeps its share of the rows in memory and the tasks add up histograms by sockets. Gradients
are whole numbers (multiples of 2^-20), so sums, and with them trees, don't depend on how the rows are spread.
"""

from __future__ import annotations

import os
import pickle
import secrets
import socket
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreloom.operators.learn import fold
from oreloom.session import cut

#: Bins of a feature; a name has three (absent, between as in made-up rows, present).
BINS = 32
#: Shrinkage of a tree, ridge of its leaves, and the unit that gradients are rounded to.
RATE, RIDGE, UNIT = 0.3, 1.0, float(2**20)
#: Made-up rows per positive at most (the weight of positives evens out the rest of the classes) and neighbours they lean on.
COPIES, NEAREST = 10, 3
#: Queries of a block of the search for neighbours, which meets 64 times as many rows.
BLOCK = 64


def _at_once(one: Connection) -> Connection:
    """Without waiting for more to send (40 ms a message otherwise)."""
    with socket.socket(fileno=os.dup(one.fileno())) as same:
        same.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return one


class Team:
    """Sums and messages between the tasks of a barrier stage; the first task passes them on. Connections need a random key."""

    def __init__(self, rank: int = 0, hosts: list[str] | None = None, tell=None) -> None:  # noqa: ANN001
        self.rank, self.size, self.all, self.first = rank, len(hosts or [""]), {}, None
        if self.size == 1:
            return
        door, said = None, ""
        if rank == 0:
            key = secrets.token_bytes(32)
            door = Listener((hosts[0], 0), backlog=self.size, authkey=key)
            said = f"{door.address[1]} {key.hex()}"
        port, key = tell(said)[0].split()
        if rank:
            self.first = _at_once(Client((hosts[0], int(port)), authkey=bytes.fromhex(key)))
            self.first.send_bytes(str(rank).encode())
            return
        for _ in range(self.size - 1):
            one = _at_once(door.accept())
            self.all[int(one.recv_bytes())] = one
        door.close()

    def close(self) -> None:
        for one in [*self.all.values(), *([self.first] if self.first else [])]:
            one.close()

    def share(self, at: int, data: bytes) -> bytes:
        """The data of task ``at``, in every task."""
        if self.rank:
            if self.rank == at:
                self.first.send_bytes(data)
                return data
            return self.first.recv_bytes()
        data = self.all[at].recv_bytes() if at else data
        for r, one in self.all.items():
            if r != at:
                one.send_bytes(data)
        return data

    def total(self, x: np.ndarray) -> np.ndarray | None:
        """The sum over all tasks, in the first one only."""
        if self.rank:
            self.first.send_bytes(np.ascontiguousarray(x).tobytes())
            return None
        for r in sorted(self.all):
            x = x + np.frombuffer(self.all[r].recv_bytes(), x.dtype).reshape(x.shape)
        return x

    def sum(self, x: np.ndarray) -> np.ndarray:
        out = self.total(x)
        return np.frombuffer(self.share(0, b"" if out is None else out.tobytes()), x.dtype).reshape(x.shape)


@dataclass(frozen=True)
class Scheme:
    """Names that are features, edges of the bins of the plain features, names that are labels, number of folds."""

    names: list[str]
    edges: list[np.ndarray]
    labels: list[str]
    folds: int


def _lists(column: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the name) of the known entries of a column of lists."""
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    place = pc.fill_null(pc.index_in(column.flatten(), value_set=pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False)
    return row[place >= 0], place[place >= 0]


def _plain_bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, side="left").astype(np.uint8)


def _score_bins(values: np.ndarray) -> np.ndarray:
    return np.minimum(values * BINS, BINS - 1).astype(np.uint8)


def _name_bins(values: np.ndarray) -> np.ndarray:
    return (values > 0).astype(np.uint8) + (values >= 1).astype(np.uint8)


def _features(batch: pa.RecordBatch, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(plain values, bins of all features), features x rows."""
    n, p = batch.num_rows, len(scheme.edges)
    plain = np.array([batch.column(f"p{i}").to_numpy(zero_copy_only=False) for i in range(p)], float).reshape(p, n)
    bins = np.zeros((p + len(scheme.names), n), np.uint8)
    for i, edges in enumerate(scheme.edges):
        bins[i] = _plain_bins(plain[i], edges)
    row, place = _lists(batch.column("names"), scheme.names)
    bins[p + place, row] = 2
    return plain, bins


def _walk(tree: tuple, column, n: int) -> np.ndarray:  # noqa: ANN001
    """The value of a tree for each of n rows; tree: (features, bins) of its nodes in level order, values of its leaves."""
    feature, bound, leaves = tree
    node, first = np.zeros(n, np.int16), 0
    while first < len(feature):
        node = _step(node, feature[first : 2 * first + 1], bound[first : 2 * first + 1], column)
        first = 2 * first + 1
    return np.asarray(leaves)[node]


def _step(node: np.ndarray, feature: list[int], bound: list[int], column) -> np.ndarray:  # noqa: ANN001
    """One level down; feature -1: all to the left."""
    right = np.zeros(len(node), bool)
    for k, (f, b) in enumerate(zip(feature, bound, strict=True)):
        if f >= 0:
            right |= (node == k) & (column(f) > b)
    return (2 * node + right).astype(np.int16)


def _probability(trees: list[tuple], column, n: int) -> np.ndarray:  # noqa: ANN001
    raw = np.zeros(n)
    for t in trees:
        raw += _walk(t, column, n)
    return 1 / (1 + np.exp(-raw))


def _splits(hist: np.ndarray, codes: np.ndarray, base: np.ndarray, last: bool) -> tuple[list[int], list[int], list[float]]:
    """Best split of every node: (feature, bin) and the values of the two leaves of each where the level is the last.

    hist: (gradient, hessian) x nodes x (whole node, codes); codes: feature * BINS + bin, without the commonest bin of a
    feature, which the whole node gives. Ties: first feature, lowest bin.
    """
    of = np.unique(codes // BINS)
    all_codes = np.sort(np.append(codes, of * BINS + base[of]))
    starts = np.searchsorted(all_codes, of * BINS)
    size = np.diff(np.append(starts, len(all_codes)))
    node = hist[:, :, :1].astype(np.int64)
    v = np.zeros((2, hist.shape[1], len(all_codes)), np.int64)
    v[:, :, np.searchsorted(all_codes, codes)] = hist[:, :, 1:]
    if len(of):
        v[:, :, np.searchsorted(all_codes, of * BINS + base[of])] = node - np.add.reduceat(v, starts, 2)
    left = v.cumsum(2) - np.repeat(np.arange(len(of)), size) * node  # what the features before add up to
    (lg, lh), (rg, rh), (g, h) = left / UNIT, (node - left) / UNIT, node / UNIT
    gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - g**2 / (h + RIDGE)
    gain = np.round(np.where((lh > 0) & (rh > 0), gain, 0), 9)
    feature, bound, leaves = [], [], []
    for k in range(hist.shape[1]):
        i = int(gain[k].argmax()) if len(of) else 0
        good = bool(len(of)) and gain[k, i] > 0
        feature.append(int(all_codes[i] // BINS) if good else -1)
        bound.append(int(all_codes[i] % BINS) if good else 0)
        if last:
            sides = ((lg[k, i], lh[k, i]), (rg[k, i], rh[k, i])) if good else ((g[k, 0], h[k, 0]), (0.0, 0.0))
            leaves += [float(-RATE * x / (y + RIDGE)) for x, y in sides]
    return feature, bound, leaves


def best_threshold(n: np.ndarray, pos: np.ndarray, rare: int = 25, rare_beta: float = 1.5) -> tuple[float, float]:
    """(threshold, F) as evaluate.tuned_threshold, from the counts of rows and positives whose score reaches 0.10 .. 0.90."""
    beta = rare_beta if pos[0] < rare else 1.0
    f = (1 + beta**2) * pos[1:] / np.maximum(beta**2 * pos[0] + n[1:], 1e-300)
    f, t = np.round(np.where(n[1:] + pos[0] > 0, f, 0), 12), np.arange(10, 91)
    coarse = [(-f[i], t[i]) for i in range(len(t)) if t[i] % 5 == 0 and 15 <= t[i] <= 85 and f[i] > 0]
    at = min(coarse)[1] if coarse else 50
    _, _, found = min((-f[i], t[i] != at, t[i]) for i in range(len(t)) if abs(t[i] - at) <= 5)
    return found / 100, float(f[found - 10])


class Trainer:
    """The rows of one task and what it does for the chain; all tasks of the team do the same steps."""

    def __init__(self, team: Team, scheme: Scheme, batches: Iterator[pa.RecordBatch]) -> None:
        self.team, self.scheme, p = team, scheme, len(scheme.edges)
        plain, bins, ids, folds, held, n = [np.zeros((p, 0))], [np.zeros((p + len(scheme.names), 0), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [], 0
        for b in batches:
            x, y = _features(b, scheme)
            plain.append(x)
            bins.append(y)
            ids.append(b.column("id").to_numpy())
            folds.append(b.column("fold").to_numpy())
            row, place = _lists(b.column("held"), scheme.labels)
            held.append((row + n, place))
            n += b.num_rows
        self.plain, self.bins = np.concatenate(plain, 1), list(np.concatenate(bins, 1))
        self.ids, self.fold, self.n = np.concatenate(ids), np.concatenate(folds), n
        row, place = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(2))
        order = np.argsort(place, kind="stable")
        self.held = np.split(row[order], np.searchsorted(place[order], np.arange(1, len(scheme.labels)))) if scheme.labels else []
        self.scores: list[np.ndarray] = []  # out-of-fold scores of the labels so far
        self.base = np.zeros(0, np.int64)  # commonest bin of each feature
        self.nonzero: list[tuple[np.ndarray, np.ndarray]] = []  # rows and codes off the commonest bin, feature by feature
        for f in range(len(self.bins)):
            self._enter(f)

    def _enter(self, f: int) -> None:
        named = len(self.scheme.edges) <= f < len(self.scheme.edges) + len(self.scheme.names)
        most = 0 if named else int(self.team.sum(np.bincount(self.bins[f], minlength=BINS)).argmax())
        self.base = np.append(self.base, most)
        at = np.flatnonzero(self.bins[f] != most).astype(np.int32)
        self.nonzero.append((at, f * BINS + self.bins[f][at].astype(np.int32)))

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The features of rows as numbers, rows x features."""
        first, names = len(self.plain), len(self.scheme.names)
        out = np.zeros((len(rows), len(self.bins)))
        out[:, :first] = self.plain[:, rows].T
        for f in range(first, first + names):
            out[:, f] = self.bins[f][rows] / 2
        for i, s in enumerate(self.scores):
            out[:, first + names + i] = s[rows]
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of numbers, features x rows."""
        first, names = len(self.plain), len(self.scheme.names)
        out = np.empty(x.T.shape, np.uint8)
        for f, edges in enumerate(self.scheme.edges):
            out[f] = _plain_bins(x[:, f], edges)
        out[first : first + names] = _name_bins(x[:, first : first + names]).T
        out[first + names :] = _score_bins(x[:, first + names :]).T
        return out

    def partners(self, x: np.ndarray, ids: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nearest other positives of every own one, by fold of the other: distance, id, task and place; exact, ties by id."""
        shape = (self.scheme.folds, len(x), NEAREST)
        best = [np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, -1), np.full(shape, -1)]
        own = (x * x).sum(1)
        for t in range(self.team.size):
            theirs, their_ids, their_folds = pickle.loads(self.team.share(t, pickle.dumps((x, ids, folds), 5) if t == self.team.rank else b""))  # noqa: S301
            length = (theirs * theirs).sum(1)
            for k in range(self.scheme.folds):
                of = np.flatnonzero(their_folds == k)
                of = of[np.argsort(their_ids[of], kind="stable")]
                for b in range(0, len(of), 64 * BLOCK):
                    at = of[b : b + 64 * BLOCK]
                    base = theirs[at].T
                    for q in range(0, len(x), BLOCK):
                        d = np.round(own[q : q + BLOCK, None] + length[at] - 2 * x[q : q + BLOCK] @ base, 9)
                        if t == self.team.rank:
                            d[np.arange(q, q + len(d))[:, None] == at] = np.inf
                        rows, new = np.arange(len(d)), []
                        for _ in range(min(NEAREST, len(at))):
                            i = d.argmin(1)
                            new.append([d[rows, i], their_ids[at[i]], np.full(len(d), t), at[i]])
                            d[rows, i] = np.inf
                        self._merge(best, k, q, [np.stack(x, 1) for x in zip(*new, strict=True)])
        return tuple(best)

    @staticmethod
    def _merge(best: list[np.ndarray], k: int, q: int, new: list[np.ndarray]) -> None:
        part = [np.concatenate([b[k, q : q + len(n)], n], 1) for b, n in zip(best, new, strict=True)]
        order = np.lexsort((part[1], part[0]), axis=1)[:, :NEAREST]
        for b, x in zip(best, part, strict=True):
            b[k, q : q + len(order)] = np.take_along_axis(x, order, 1)

    def made(self, label: int, n: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        """Bins of the made-up positives of each set (the folds' others, then all): between a positive and one of its nearest.

        As learn.oversampled: until the classes are about even, COPIES a positive at most, none with fewer than two positives.
        """
        copies = [min(COPIES, int((a - b) // b) - 1) if b > 1 else 0 for a, b in zip(n, pos, strict=True)]
        none = np.zeros((len(self.bins), 0), np.uint8)
        if max(copies) <= 0:
            return [none] * len(copies)
        rows = self.held[label]
        x, ids, folds = self.values(rows), self.ids[rows], self.fold[rows]
        near = self.partners(x, ids, folds)
        plan = []  # (set, own row, task, place, share)
        for s, c in enumerate(copies):
            mine = np.flatnonzero(folds != s)
            part = [np.concatenate([b[k, mine] for k in range(self.scheme.folds) if k != s], 1) for b in near]
            order = np.lexsort((part[1], part[0]), axis=1)[:, :NEAREST]
            distance, _, task, place = (np.take_along_axis(p, order, 1) for p in part)
            for copy in range(max(c, 0)):
                r = copy % NEAREST
                ok = np.flatnonzero(np.isfinite(distance[:, r])) if r < distance.shape[1] else np.zeros(0, np.int64)
                plan.append((s, mine[ok], task[ok, r], place[ok, r], _share(ids[mine[ok]], copy)))
        out = [np.zeros((len(self.bins), len(p[1])), np.uint8) for p in plan]
        for t in range(self.team.size):
            theirs = pickle.loads(self.team.share(t, pickle.dumps(x, 5) if t == self.team.rank else b""))  # noqa: S301
            for (_, own, task, place, share), bins in zip(plan, out, strict=True):
                at = np.flatnonzero(task == t)
                if len(at):
                    a = x[own[at]]
                    bins[:, at] = self.binned(a + (theirs[place[at]] - a) * share[at, None])
        return [np.concatenate([none, *[b for p, b in zip(plan, out, strict=True) if p[0] == s]], 1) for s in range(len(copies))]

    def learn(self, label: int, grid: list[dict[str, int]]) -> tuple[list[tuple], float, float]:
        """(trees, threshold, F) of the next label; its out-of-fold scores become a feature."""
        folds, y = self.scheme.folds, np.zeros(self.n, np.int8)
        y[self.held[label]] = 1
        sets = [np.flatnonzero(self.fold != s) for s in range(folds + 1)]
        n, pos = self.team.sum(np.array([[len(r) for r in sets], [y[r].sum() for r in sets]], np.int64))
        made = self.made(label, n, pos)
        parts = [_Part(self, rows, y, extra) for rows, extra in zip(sets, made, strict=True)]
        weigh = self.team.sum(np.array([[len(p.y) for p in parts], [p.y.sum() for p in parts]], np.int64))
        used = np.zeros(len(self.bins) * BINS, np.int64)
        for p in parts:
            used[p.codes] = 1
        codes = np.flatnonzero(self.team.sum(used))
        place = np.zeros(len(used), np.intp)
        place[codes] = np.arange(len(codes))
        for p, a, b in zip(parts, *weigh, strict=True):
            p.start(place, len(codes), float(a - b) / max(1, b))
        fits = [(s, j, _Fit(parts[s], how["depth"], how["trees"])) for s in range(folds + 1) for j, how in enumerate(grid)]
        for t in range(max(how["trees"] for how in grid)):
            for level in range(max(how["depth"] for how in grid)):
                live = [f for _, _, f in fits if t < f.trees and level < f.depth]
                hists = [f.histogram(level) for f in live]
                if not hists:
                    continue
                flat = self.team.total(np.concatenate([h.ravel() for h in hists]))
                found = []
                if flat is not None:
                    for f, h in zip(live, hists, strict=True):
                        one, flat = flat[: h.size].reshape(h.shape), flat[h.size :]
                        f.hist = np.stack([f.hist - one, one], 2).reshape(2, -1, h.shape[2]) if level else one
                        found.append(_splits(f.hist, codes, self.base, level == f.depth - 1))
                for f, x in zip(live, pickle.loads(self.team.share(0, pickle.dumps(found))), strict=True):  # noqa: S301
                    f.grow(*x, last=level == f.depth - 1)
        scores = np.zeros((len(grid), self.n))
        for s, j, f in fits:
            at = np.flatnonzero(self.fold == s)
            if s < folds:
                scores[j, at] = _probability(f.done, lambda c, at=at: self.bins[c][at], len(at))
        bucket = np.minimum(np.floor((scores - 0.10) / 0.01 + 1e-9), 80).astype(np.int64).clip(-1) + 1
        counts = self.team.sum(np.array([[np.bincount(b, minlength=82), np.bincount(b, y, 82).astype(np.int64)] for b in bucket]))
        tuned = [best_threshold(*c[:, ::-1].cumsum(1)[:, ::-1]) for c in counts]
        j = max(range(len(grid)), key=lambda k: tuned[k][1])
        self.scores.append(scores[j])
        self.bins.append(_score_bins(scores[j]))
        self._enter(len(self.bins) - 1)
        return next(f.done for s, k, f in fits if s == folds and k == j), *tuned[j]


def _share(ids: np.ndarray, copy: int, seed: int = 7) -> np.ndarray:
    """A number in [0, 1) from the id and the copy (splitmix64)."""
    z = ids.astype(np.uint64) + np.uint64((copy + 1) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(1000)).astype(float) / 1000


class _Part:
    """The rows of a set in this task, made-up ones behind: which are off the commonest bin, feature by feature."""

    def __init__(self, of: Trainer, rows: np.ndarray, y: np.ndarray, extra: np.ndarray) -> None:
        self.of, self.base_rows, self.extra = of, rows, extra
        self.y = np.concatenate([y[rows], np.ones(extra.shape[1], np.int8)])
        spot = np.full(of.n, -1, np.int32)
        spot[rows] = np.arange(len(rows), dtype=np.int32)
        row, code = (np.concatenate([np.zeros(0, np.int32), *[x[i] for x in of.nonzero]]) for i in range(2))
        row = spot[row]
        f, r = np.nonzero(extra != of.base[:, None])
        self.rows = np.concatenate([row[row >= 0], (len(rows) + r).astype(np.int32)])
        self.codes = np.concatenate([code[row >= 0], (f * BINS + extra[f, r]).astype(np.int32)])

    def start(self, place: np.ndarray, width: int, weight: float) -> None:
        self.rows, self.codes, self.width = self.rows.astype(np.intp), place[self.codes] + 1, width + 1  # intp: numpy would convert at each use
        self.weight = np.where(self.y == 1, weight, 1.0)

    def column(self, f: int) -> np.ndarray:
        return np.concatenate([self.of.bins[f][self.base_rows], self.extra[f]])


class _Fit:
    """Boosted trees for one set and setting, grown level by level."""

    def __init__(self, part: _Part, depth: int, trees: int) -> None:
        self.part, self.depth, self.trees, self.done = part, depth, trees, []
        self.raw, self.hist = np.zeros(len(part.y)), None

    def histogram(self, level: int) -> np.ndarray:
        """(gradient, hessian) x nodes of the level x (whole node, codes); below the first level of right-hand nodes only, since
        those of the left are their parents' without them.
        """
        p = self.part
        if level == 0:
            prob = 1 / (1 + np.exp(-self.raw))
            self.sums = [np.round(p.weight * (prob - p.y) * UNIT), np.round(p.weight * prob * (1 - prob) * UNIT)]
            self.node, self.feature, self.bound = np.zeros(len(p.y), np.int16), [], []
        nodes, at, rows, codes = 1, slice(None), p.rows, p.codes
        if level:
            right = (self.node & 1).astype(bool)
            at, some = np.flatnonzero(right), np.flatnonzero(right[p.rows])
            nodes, rows, codes = 2 ** (level - 1), rows[some], codes[some]
        first = (self.node >> 1).astype(np.intp) * p.width
        key = first[rows] + codes if level > 1 else codes
        out = np.empty((2, nodes * p.width))
        for i, x in enumerate(self.sums):
            out[i] = np.bincount(key, x[rows], nodes * p.width) + np.bincount(first[at], x[at], nodes * p.width)
        return out.reshape(2, nodes, p.width)

    def grow(self, feature: list[int], bound: list[int], leaves: list[float], last: bool) -> None:
        self.node = _step(self.node, feature, bound, self.part.column)
        self.feature, self.bound = self.feature + feature, self.bound + bound
        if last:
            self.raw += np.asarray(leaves)[self.node]
            self.done.append((self.feature, self.bound, leaves))


@dataclass(frozen=True)
class Link:
    """One label of the chain: its place among the labels, its trees, threshold and the F of its out-of-fold scores."""

    label: int
    trees: list[tuple]
    threshold: float
    f: float


def _edges(rows: DataFrame, plain: list[str]) -> list[np.ndarray]:
    """Edges of the bins of plain features, about equally full, from the counts of their values to three digits."""
    out = []
    for c in plain:
        counts = rows.groupBy(F.round(c, 3).alias("v")).count().orderBy("v").toPandas().dropna()
        share = counts["count"].cumsum().to_numpy() / max(1, counts["count"].sum())
        at = np.searchsorted(share, np.arange(1, BINS) / BINS)
        out.append(np.unique(counts["v"].to_numpy(float)[at[at < len(share)]]))
    return out


def all_labels_chain(rows: DataFrame, key: str, plain: list[str], names: str, held: str, grid: list[dict[str, int]], folds: int = 3) -> tuple[list[Link], Scheme]:
    """The chain over every name in ``held`` with two rows or more, by descending frequency (ties by name).

    plain: columns of numbers; names, held: lists of names, features and labels. For each label: rows made up for every
    fold, the settings of the grid compared by the F of their out-of-fold scores at the tuned threshold, the best fitted on
    all rows, its out-of-fold scores a feature of those behind. Needs slots for all its tasks at once (a barrier stage).
    """
    spark = rows.sparkSession
    known = [[(r.item, r["count"]) for r in rows.select(F.explode(F.array_distinct(c)).alias("item")).filter("item IS NOT NULL").groupBy("item").count().collect()] for c in (names, held)]
    labels = [x for x, n in sorted(known[1], key=lambda x: (-x[1], x[0])) if n >= 2]
    scheme = Scheme(sorted(x for x, _ in known[0]), _edges(rows, plain), labels, folds)
    if not labels:
        return [], scheme
    slots = spark.sparkContext.defaultParallelism
    shown = rows.select(F.xxhash64(key).alias("id"), fold(F.col(key), folds).alias("fold"), *_shown(plain, names), F.array_distinct(held).alias("held"))
    shown = cut(shown.repartition(slots, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        task = BarrierTaskContext.get()
        team = Team(task.partitionId(), [x.address.rsplit(":", 1)[0] for x in task.getTaskInfos()], task.allGather)
        trainer = Trainer(team, scheme, batches)
        found = [trainer.learn(i, grid) for i in range(len(labels))]
        team.close()
        yield pa.RecordBatch.from_pydict({"chain": [pickle.dumps(found)] if team.rank == 0 else []}, schema=pa.schema([("chain", pa.binary())]))

    found = pickle.loads(shown.mapInArrow(run, "chain binary", barrier=True).collect()[0].chain)  # noqa: S301
    return [Link(i, *x) for i, x in enumerate(found)], scheme


def _shown(plain: list[str], names: str) -> list:
    return [*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"p{i}") for i, c in enumerate(plain)], F.array_distinct(names).alias("names")]


def score_all_labels(chain: list[Link], scheme: Scheme, rows: DataFrame, key: str, plain: list[str], names: str) -> DataFrame:
    """(key, found): the places of the labels that the chain gives each row, each label's score fed to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, found = list(_features(b, scheme)[1]), []
            for link in chain:
                score = _probability(link.trees, bins.__getitem__, b.num_rows)
                found.append(score >= link.threshold - 1e-12)
                bins.append(_score_bins(score))
            row, place = np.nonzero(np.array(found, bool).reshape(len(chain), b.num_rows).T)
            ends = np.append(0, np.bincount(row, minlength=b.num_rows).cumsum()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32()))], [key, "found"])

    shown = rows.select(key, *_shown(plain, names))
    return shown.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, found array<int>")
