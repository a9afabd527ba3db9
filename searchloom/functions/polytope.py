"""Cross-polytope hashing of vectors: rotations, prefix trees over the hashes, and exact search within one cell.

A hash turns a vector by a pseudo-random rotation (three rounds of random signs and a Hadamard transform) and takes
the nearest signed axis. A tree strings such hashes together, deeper where the vectors are denser. Two cells of a tree
that differ in one hash are parted by the plane on which two of the rotated coordinates are equal, so a vector's
distance from that plane is the difference of its coordinates over the square root of 2: it orders the cells that are
worth looking into, and bounds what can lie there. Where a hash fails to split (vectors that all point the same way)
the hashes below it are taken of the differences from the vectors' mean, which do split.
"""

from __future__ import annotations

import numpy as np

#: Hashes of the longest key.
MAX_DEPTH = 24
#: A hash that leaves more than this share of the vectors in one cell has not split them.
POOR_SPLIT = 0.9
#: Rotations up to this width are held as matrices; wider vectors are turned by the fast transform.
AS_MATRIX = 64
#: Queries that are compared at once.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class Rotations:
    """``MAX_DEPTH`` pseudo-random rotations for vectors of ``dim`` elements, determined by ``seed``."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.width = dim, 1 << max(0, dim - 1).bit_length()
        self.axes = 2 * self.width
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(MAX_DEPTH, 3, self.width))
        self.matrix = [self._turn(np.eye(self.width), s)[:dim] for s in self.signs] if self.width <= AS_MATRIX else None

    @staticmethod
    def _turn(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = hadamard(x * s)
        return x

    def signed_axes(self, x: np.ndarray, level: int) -> np.ndarray:
        """The rows' lengths along each of the ``axes`` signed axes."""
        if self.matrix is not None:
            y = x @ self.matrix[level]
        else:
            wide = np.zeros((len(x), self.width))
            wide[:, : self.dim] = x
            y = self._turn(wide, self.signs[level])
        return np.concatenate([y, -y], axis=1)


class CellTree:
    """Cells of vectors: sequences of hashes, ended as soon as a cell is expected to hold ``target`` vectors.

    ``scale`` is how many vectors each row of ``x`` stands for. A node isn't split with fewer than 2 x ``least`` rows, as
    nothing is known then of how its vectors lie; so there are at most ``MAX_DEPTH`` x rows / (2 x ``least``) nodes. A cell
    is numbered by its node and axis, so vectors that the sample didn't show have cells too.
    """

    def __init__(self, x: np.ndarray, rotations: Rotations, scale: float, target: float, least: int = 1):
        self.rotations, self.axes = rotations, rotations.axes
        child: list[np.ndarray] = []
        centre: list[np.ndarray] = []
        level: list[int] = []
        self.expected: dict[int, float] = {}  # of cells that more hashes don't split
        stack = [(-1, 0, 0, np.zeros(x.shape[1]), np.arange(len(x)))]
        while stack:
            parent, axis, depth, middle, rows = stack.pop()
            expect = len(rows) * scale
            if expect <= target:
                continue
            if depth == MAX_DEPTH or len(rows) < 2 * least:
                self.expected[parent * self.axes + axis] = expect
                continue
            node = len(child)
            child.append(np.full(self.axes, -1, dtype=np.int64))
            centre.append(middle)
            level.append(depth)
            if parent >= 0:
                child[parent][axis] = node
            of = rotations.signed_axes(x[rows] - middle, depth).argmax(axis=1)
            for a in np.unique(of):
                inside = rows[of == a]
                below = x[inside].mean(axis=0) if len(inside) > POOR_SPLIT * len(rows) else middle
                stack.append((node, int(a), depth + 1, below, inside))
        assert len(child) <= self.node_bound(len(x), least)
        self.child = np.stack(child) if child else np.zeros((0, self.axes), dtype=np.int64)
        self.centre = np.stack(centre) if centre else np.zeros((0, x.shape[1]))
        self.level = np.array(level, dtype=np.int64)
        self.depth = int(self.level.max()) + 1 if child else 0

    @staticmethod
    def node_bound(rows: int, least: int) -> int:
        return max(1, MAX_DEPTH * rows // (2 * least))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        return self.probe(x, 0)[1]

    def probe(self, x: np.ndarray, probes: int, reach: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether it is the row's own): each row's cell and the ``probes`` others that are nearest to it.

        A cell's distance is taken as the root of the squared distances from the planes that are crossed on the way to it.
        Planes beyond ``reach`` (per row or for all) aren't crossed: what lies behind such a plane is farther away than that.
        """
        n = len(x)
        row, node, code = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        cost = np.zeros(n)
        if not self.depth:
            return row, code, np.ones(n, dtype=bool)
        limit = np.broadcast_to(np.asarray(reach, dtype=np.float64), n)
        for d in range(self.depth):
            live = np.flatnonzero(node >= 0)
            if not len(live):
                break
            at, of = node[live], row[live]
            y = self.rotations.signed_axes(x[of] - self.centre[at], d)
            axis = y.argmax(axis=1)
            if not probes:
                code[live], node[live] = at * self.axes + axis, self.child[at, axis]
                continue
            far = (y[np.arange(len(live)), axis][:, None] - y) / np.sqrt(2.0)
            crossed = far <= limit[of][:, None]
            if probes + 1 < self.axes:  # more than so many of one node's cells are never kept
                crossed &= far <= np.partition(far, probes, axis=1)[:, probes][:, None]
            i, a = np.divmod(np.flatnonzero(crossed.ravel()), self.axes)
            row = np.concatenate([np.delete(row, live), of[i]])
            code = np.concatenate([np.delete(code, live), at[i] * self.axes + a])
            cost = np.concatenate([np.delete(cost, live), cost[live][i] + far[i, a] ** 2])
            node = np.concatenate([np.delete(node, live), self.child[at[i], a]])
            o = np.lexsort((cost, row))
            row, code, cost, node = row[o], code[o], cost[o], node[o]
            keep = _rank(row) <= probes
            row, code, cost, node = row[keep], code[keep], cost[keep], node[keep]
        return row, code, cost == 0.0


def _rank(sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each element among its equals, from 0."""
    n = np.arange(len(sorted_keys))
    head = np.ones(len(sorted_keys), dtype=bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return n - np.maximum.accumulate(np.where(head, n, 0)) if len(n) else n


def within_cell(data: np.ndarray, data_id: np.ndarray, query: np.ndarray, query_id: np.ndarray, k: int, floor: np.ndarray, probes: int, bucket: int, seed: int, tree: CellTree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of ``data`` for each row of ``query``, as (query row, data row, similarity), the best first.

    Rows are unit vectors; similarities are rounded to 12 digits, ties go to the smaller id, a row with the query's own
    id is passed over, and nothing below the query's ``floor`` is returned. Up to 2 x ``bucket`` rows are compared with all
    queries; more are put into cells of about ``bucket`` first, of which a query sees its own and ``probes`` others.
    """
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    if not len(data) or not len(query):
        return none
    bound = np.maximum(floor, -1.5)
    if len(data) <= 2 * bucket and tree is None:
        order, names, first, last = np.arange(len(data)), np.zeros(1, dtype=np.int64), np.array([0]), np.array([len(data)])
        row, cell = np.arange(len(query)), np.zeros(len(query), dtype=np.int64)
    else:
        tree = tree or CellTree(data, Rotations(data.shape[1], seed), 1.0, bucket)
        of = tree.cells(data)
        order = np.argsort(of, kind="stable")
        names, first = np.unique(of[order], return_index=True)
        last = np.append(first[1:], len(order))
        row, cell, own = tree.probe(query, probes, np.sqrt(np.maximum(2.0 - 2.0 * bound, 0.0)) + 1e-6)
        at = np.lexsort((cell, ~own))  # own cells first: what they hold bounds what the others can add
        row, cell = row[at], cell[at]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    stop = np.append(start[1:], len(cell))
    where = np.searchsorted(names, cell[start])
    small, asked = data.astype(np.float32), query.astype(np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b, w in zip(start, stop, where):
        if w == len(names) or names[w] != cell[a]:
            continue
        inside = order[first[w] : last[w]]
        part = small[inside].T
        for lo in range(a, b, BLOCK):
            q = row[lo : min(b, lo + BLOCK)]
            s = asked[q] @ part  # to seven digits; what may be among the best is computed again
            least = (bound[q] - 1e-6).astype(np.float32)
            hit = s >= least[:, None]
            if len(inside) > 4 * k:
                many = np.flatnonzero(hit.sum(axis=1) > 4 * k)
                if len(many):
                    kth = np.partition(s[many], len(inside) - k - 1, axis=1)[:, len(inside) - k - 1] - np.float32(2e-6)  # one more than k: the query itself may be there
                    bound[q[many]] = np.maximum(bound[q[many]], kth)
                    hit[many] = s[many] >= kth[:, None]
            i, j = np.divmod(np.flatnonzero(hit.ravel()), len(inside))
            found.append((q[i], inside[j], s[i, j]))
    if not found:
        return none
    q, d, s = (np.concatenate(c) for c in zip(*found))
    keep = (s >= bound[q].astype(np.float32) - np.float32(2e-6)) & (query_id[q] != data_id[d])
    q, d = q[keep], d[keep]
    return best_per_row(q, d, data_id[d], np.round(np.einsum("ij,ij->i", query[q], data[d]), 12), k, floor)


def _order(q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> np.ndarray:
    """By ``q``, then the largest ``s``, then the smallest id. One whole number sorts faster than three columns, if it is wide enough."""
    if len(q) and q.max() < 1 << 22:
        key = (q.astype(np.int64) << 41) | np.rint((1.0 - s) * 1e12).clip(0, (1 << 41) - 1).astype(np.int64)
        o = np.argsort(key)
        if not (key[o[1:]] == key[o[:-1]]).any():
            return o
        tied = np.zeros(len(q), dtype=bool)
        tied[1:] = key[o[1:]] == key[o[:-1]]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        o[at] = o[at][np.lexsort((ids[o[at]], key[o[at]]))]
        return o
    return np.lexsort((ids, -s, q))


def best_per_row(q: np.ndarray, d: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of each ``q`` with the largest ``s``, ties to the smaller id; an id counts once per ``q``."""
    if floor is not None:
        keep = s >= floor[q] - 1e-12
        q, d, ids, s = q[keep], d[keep], ids[keep], s[keep]
    o = _order(q, ids, s)
    q, d, ids, s = q[o], d[o], ids[o], s[o]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (s[1:] != s[:-1])
    q, d, s = q[new], d[new], s[new]
    keep = _rank(q) < k
    return q[keep], d[keep], s[keep]
