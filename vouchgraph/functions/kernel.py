"""Random walks and their exact expectation, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import rng

#: Walks advanced together.
CHUNK = 20_000
#: Walks times states up to which visits are marked in a table; beyond, they are sorted.
_MARKS = 1 << 23
#: Bytes that an edge and a node take in a task at most.
EDGE_BYTES, NODE_BYTES = 24, 40
#: Edges up to which draws are looked up by a guide of four cells an edge, instead of by halving.
_GUIDED = 1 << 18
#: Largest graph that :func:`exact` takes.
EXACT_NODES = 5_000
#: Numbers that one step of a block of :meth:`Powers.diagonal` holds.
_CELLS = 4_000_000


class Ranges:
    """Edges by source row, with prefix sums of their weights: a draw below a row's total is one of its edges."""

    def __init__(self, row: np.ndarray, to: np.ndarray, weight: np.ndarray, rows: int) -> None:
        """Edges are sorted by row; ``to`` is the state they lead to."""
        first = np.searchsorted(row, np.arange(rows + 1))
        self.sums = np.cumsum(weight)
        edge = np.concatenate([[0], self.sums])[first]
        self.to, self.base, self.total = to.astype(np.int32), edge[:-1], np.diff(edge)
        self.guide = None
        if 0 < len(to) <= _GUIDED:
            self.shift = max(0, int(self.sums[-1]).bit_length() - (4 * len(to)).bit_length())
            self.guide = np.searchsorted(self.sums, np.arange((int(self.sums[-1]) >> self.shift) + 1) << self.shift, side="right")

    def met(self, row: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """States that the draws ``pick`` lead to."""
        key = self.base[row] + pick
        if self.guide is None:
            return self.to[np.searchsorted(self.sums, key, side="right")]
        edge = self.guide[key >> self.shift]
        late = np.flatnonzero(self.sums[edge] <= key)
        for _ in range(3):
            edge[late] += 1
            late = late[self.sums[edge[late]] <= key[late]]
        if len(late):
            edge[late] = np.searchsorted(self.sums, key[late], side="right")
        return self.to[edge]


class Adjacency(Ranges):
    """Outgoing edges of states: a state is a node's place in ``ids``, twice, and the phase.

    In phase 0 a walk takes all edges, a negative one leads to phase 1, where it takes positive ones.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, negative: np.ndarray, ids: np.ndarray | None = None) -> None:
        """``ids``: all that walks can visit after their start, if ``src`` and ``dst`` don't hold them all."""
        self.ids = np.unique(np.concatenate([src, dst]) if ids is None else ids)
        self.states = 2 * len(self.ids)
        order = np.lexsort((dst, src))
        good = order[~negative[order]]
        s = np.concatenate([self.place(src[order]) * 2, self.place(src[good]) * 2 + 1])
        d = np.concatenate([self.place(dst[order]) * 2 + negative[order], self.place(dst[good]) * 2 + 1])
        both = np.argsort(s, kind="stable")
        super().__init__(s[both], d[both], np.concatenate([weight[order], weight[good]])[both], self.states)

    def place(self, node: np.ndarray) -> np.ndarray:
        """Places of ``node`` in ids; what isn't there gets -1."""
        at = np.searchsorted(self.ids, node)
        if not len(self.ids):
            return np.full(len(node), -1)
        return np.where(self.ids[np.minimum(at, len(self.ids) - 1)] == node, at, -1)

    def own(self, place: np.ndarray, dst: np.ndarray, weight: np.ndarray, negative: np.ndarray, rows: int) -> Ranges:
        """First edges of nodes that aren't among the sources: row ``place`` of ``rows`` leads to ``dst``."""
        order = np.lexsort((dst, place))
        return Ranges(place[order], self.place(dst[order]) * 2 + negative[order], weight[order], rows)


def _steps(adj: Adjacency, state: np.ndarray, h: np.ndarray, alpha: float, first: Ranges | None, row: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(walk index, state) of each step after the start; a start that is no state (-1) takes an edge of its ``row`` of ``first``."""
    below, h = rng.go_on_below(alpha), rng.begun(h)
    at, step = np.arange(len(state)), 0
    while len(at):
        total = adj.total[state] if adj.states else np.zeros(len(state), np.int64)
        if step == 0:
            total[state < 0] = 0 if first is None else first.total[row[state < 0]]
        go = np.flatnonzero((rng.drawn(h, 4 * step) < below) & (total > 0))
        at, state, h, total = at[go], state[go], h[go], total[go]
        pick = rng.drawn(h, 4 * step + 1)
        pick <<= 31
        pick += rng.drawn(h, 4 * step + 2)
        pick = (pick.view(np.uint64) % total.view(np.uint64)).view(np.int64)
        if step == 0 and (out := state < 0).any():
            met = np.empty(len(state), np.int32)
            met[out], met[~out] = first.met(row[at[out]], pick[out]), adj.met(state[~out], pick[~out])
            state = met
        else:
            state = adj.met(state, pick)
        step += 1
        yield at, state


def _begin(adj: Adjacency, ego: np.ndarray, number: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """States of the starts, -1 where the ego isn't in ids, and the walks' random states."""
    place = adj.place(ego)
    return np.where(place < 0, -1, place * 2), rng.mix(rng.mix(np.full(len(ego), seed % rng.P, np.int64), ego), number)


def walk(adj: Adjacency, ego: np.ndarray, number: np.ndarray, seed: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(walk index, node, phase) of every visit, the start included; visits of one walk may repeat."""
    start, h = _begin(adj, ego, number, seed)
    found = [(np.arange(len(ego)), ego, np.zeros(len(ego), np.int64))]
    found += [(at, adj.ids[state >> 1], (state & 1).astype(np.int64)) for at, state in _steps(adj, start, h, alpha, None, None)]
    return tuple(np.concatenate(x) for x in zip(*found))


def hits(adj: Adjacency, ego: np.ndarray, number: np.ndarray, seed: int, alpha: float, first: Ranges | None = None, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ego, node, walks that hit it positively, negatively), each walk counted once a node and phase.

    ``first`` has first edges of egos that no edge leads to, by the walks' ``row``; all other edges are in ``adj``.
    """
    start, h = _begin(adj, ego, number, seed)
    egos, mine = np.unique(ego, return_inverse=True)
    known = start >= 0
    width = max(1, adj.states)
    steps = _steps(adj, start, h, alpha, first, row)
    once = []
    if len(ego) * width <= _MARKS:
        seen = np.zeros(len(ego) * width, bool)
        seen[np.flatnonzero(known) * width + start[known]] = True
        for at, state in steps:
            key = at * width + state
            new = np.flatnonzero(~seen[key])
            seen[key[new]] = True
            once.append(mine[at[new]] * width + state[new])
        counts = np.bincount(np.concatenate([mine[known] * width + start[known], *once]), minlength=len(egos) * width).reshape(len(egos), width // 2 or 1, -1)
        who, place = np.nonzero(counts.any(axis=2))
        pos, neg = counts[who, place, 0], counts[who, place, -1] if width > 1 else np.zeros(len(who), np.int64)
    else:
        visits = np.concatenate([np.flatnonzero(known) * width + start[known], *(at * width + state for at, state in steps)])
        visits.sort()
        visits = visits[np.concatenate([[True], visits[1:] != visits[:-1]])] if len(visits) else visits
        keys, which = np.unique(mine[visits // width] * (width // 2) + visits % width // 2, return_inverse=True)
        who, place = keys // (width // 2), keys % (width // 2)
        phase = visits & 1
        pos, neg = (np.bincount(which[phase == p], minlength=len(keys)) for p in (0, 1))
    out = np.bincount(mine[~known], minlength=len(egos))
    far = np.flatnonzero(out)
    return np.concatenate([egos[who], egos[far]]), np.concatenate([adj.ids[place], egos[far]]), np.concatenate([pos, out[far]]), np.concatenate([neg, np.zeros(len(far), np.int64)])


def exact(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ego: int, nodes: int, alpha: float) -> np.ndarray:
    """Score of each node for ``ego`` that walks approach, by two dense solves; for graphs of up to EXACT_NODES nodes."""
    if nodes > EXACT_NODES:
        raise ValueError(f"{nodes} nodes are too many for dense solves; walk instead")
    pos, neg = np.zeros((nodes, nodes)), np.zeros((nodes, nodes))
    up = weight > 0
    pos[src[up], dst[up]] = weight[up]
    neg[src[~up], dst[~up]] = -weight[~up]
    all_, good = (pos + neg).sum(axis=1, keepdims=True), pos.sum(axis=1, keepdims=True)
    share = lambda w, t: alpha * np.divide(w, t, out=np.zeros_like(w), where=t > 0)
    g = np.linalg.inv(np.eye(nodes) - share(pos, all_))
    h = np.linalg.inv(np.eye(nodes) - share(pos, good))
    plus = g[ego] / np.diag(g)
    minus = (g[ego] @ share(neg, all_)) @ (h / np.diag(h))
    return (plus - minus) / (plus + minus).sum()


class Powers:
    """Sums of the powers of a sparse matrix whose rows sum to alpha at most, a few rows at a time: (1 - A)^-1 without its n^2 numbers."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, share: np.ndarray, nodes: int, alpha: float) -> None:
        order = np.argsort(dst, kind="stable")
        self.src, self.share, self.nodes = src[order], share[order], nodes
        self.to, self.first = np.unique(dst[order], return_index=True)
        self.rounds = int(np.ceil(np.log(1e-17) / np.log(alpha)))

    def times(self, x: np.ndarray) -> np.ndarray:
        """Rows ``x`` times the matrix."""
        out = np.zeros_like(x)
        if len(self.src):
            out[:, self.to] = np.add.reduceat(x[:, self.src] * self.share, self.first, axis=1)
        return out

    def summed(self, x: np.ndarray) -> np.ndarray:
        """Row ``x`` times (1 - A)^-1."""
        total, x = x.copy(), x[None, :]
        for _ in range(self.rounds):
            x = self.times(x)
            if not x.any():
                break
            total += x[0]
        return total

    def diagonal(self, nodes: np.ndarray) -> np.ndarray:
        """(1 - A)^-1 of ``nodes`` with themselves, in blocks of rows of _CELLS numbers."""
        out = np.ones(len(nodes))
        step = max(1, _CELLS // max(1, self.nodes, len(self.src)))
        for i in range(0, len(nodes), step):
            own = nodes[i : i + step]
            rows = np.arange(len(own))
            x = np.zeros((len(own), self.nodes))
            x[rows, own] = 1.0
            for _ in range(self.rounds):
                x = self.times(x)
                if not x.any():
                    break
                out[i : i + step] += x[rows, own]
        return out


def powers(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, nodes: int, alpha: float) -> tuple[Powers, Powers, Powers]:
    """Steps of a walk over signed edges: positive ones before a negative one, the negative one, and those after it."""
    up, size = weight > 0, np.abs(weight)
    all_, good = np.bincount(src, size, nodes), np.bincount(src[up], size[up], nodes)
    of = lambda keep, total: Powers(src[keep], dst[keep], alpha * size[keep] / total[src[keep]], nodes, alpha)
    return of(up, all_), of(~up, all_), of(up, good)


def exact_by_powers(steps: tuple[Powers, Powers, Powers], ego: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """:func:`exact` from the diagonals ``before`` and ``after`` a negative step: two rows of sums are all it needs else."""
    start = np.zeros(steps[0].nodes)
    start[ego] = 1.0
    reached = steps[0].summed(start)
    plus, minus = reached / before, steps[2].summed(steps[1].times(reached[None, :])[0]) / after
    return (plus - minus) / (plus + minus).sum()
