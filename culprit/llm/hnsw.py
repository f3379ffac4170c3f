"""A hierarchical navigable small-world graph whose steps run on many rows at once.

Insertion and search follow the usual scheme (random levels, greedy descent,
beam search at the lower layers, neighbours chosen for diversity), but a whole
batch of points or queries moves through the graph in lockstep, so every step
is a few array operations.  The beam through the layers above the lowest is as
wide as they are (one matrix product), as tight clusters may be islands there.
"""

from __future__ import annotations

import numpy as np


class Hnsw:
    """Inner-product graph over unit vectors (``n x d``, float32)."""

    def __init__(self, vectors: np.ndarray, *, m: int = 12, ef: int = 48, batch: int = 256, seed: int = 1):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.m, self.ef = m, ef
        n = len(self.x)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 8) if n else np.zeros(0, int)
        order = np.argsort(-levels, kind="stable")  # upper layers are complete before the lower ones grow
        self.levels = levels
        top = int(levels.max()) if n else 0
        self.links = [np.full((n, m if k else 2 * m), -1, np.int32) for k in range(top + 1)]
        self.entry = int(order[0]) if n else -1
        self.upper = order[: int((levels > 0).sum())]
        done, size = 1, 1
        while done < n:
            part = order[done : min(done + size, len(self.upper) if done < len(self.upper) else n)]
            self._insert(part)
            done += len(part)
            size = min(batch, max(1, done // 2))
        if n:
            self.upper = np.concatenate([self.upper, self._orphans()])

    def _orphans(self) -> np.ndarray:
        """Nodes that no path of the lowest layer reaches from the upper nodes: crowded clusters prune links to them."""
        seen = np.zeros(len(self.x), bool)
        front = np.append(self.upper, self.entry)
        while len(front):
            seen[front] = True
            front = np.unique(self.links[0][front])
            front = front[(front >= 0) & ~seen[front]]
        return np.flatnonzero(~seen)

    def _insert(self, part: np.ndarray) -> None:
        q = self.x[part]
        at = np.full(len(part), self.entry)
        own = self.x[part] @ self.x[part].T
        np.fill_diagonal(own, -2)
        low = not self.levels[part].any()
        for layer in range(0 if low else len(self.links) - 1, -1, -1):
            here = self.levels[part] >= layer
            ids, sims = self.search_layer(q, self.entries(q) if low else at[:, None], layer, self.ef if here.any() else 1)
            at = np.where(ids[:, 0] >= 0, ids[:, 0], at)
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            ids, sims = ids[rows], sims[rows]
            peers = min(self.m, len(rows) - 1)  # points of the same batch know each other too
            if peers > 0:
                sub = own[np.ix_(rows, rows)]
                k = np.argpartition(-sub, peers - 1, axis=1)[:, :peers]
                ids = np.hstack([ids, part[rows][k]])
                sims = np.hstack([sims, np.take_along_axis(sub, k, axis=1)])
                ids = np.where(sims > -1.5, ids, -1)
            chosen = self.select(ids, sims, self.m)
            self.links[layer][part[rows], : self.m] = chosen
            self._link_back(layer, part[rows], chosen)

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        table = self.links[layer]
        width = table.shape[1]
        to, frm = chosen.ravel(), np.repeat(new, chosen.shape[1])
        ok = to >= 0
        to, frm = to[ok], frm[ok]
        if not len(to):
            return
        sim = np.einsum("ij,ij->i", self.x[to], self.x[frm])
        o = np.lexsort((-sim, to))
        to, frm = to[o], frm[o]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        keep = rank < 2 * width
        extra = np.full((len(nodes), int(min(count.max(), 2 * width))), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count)[keep], rank[keep]] = frm[keep]
        both = np.hstack([table[nodes], extra])
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sims = np.where(both >= 0, np.einsum("bmd,bd->bm", self.x[both], self.x[nodes]), -2)
        table[nodes] = self.select(both, sims, width)

    def select(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` neighbours per row: nearest first, those nearer to a chosen one only if room is left."""
        o = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * m]
        ids, sims = np.take_along_axis(ids, o, axis=1), np.take_along_axis(sims, o, axis=1)
        valid = (ids >= 0) & (sims > -1.5)
        rows, c = ids.shape
        v = self.x[np.where(valid, ids, 0)]
        pair = np.einsum("bcd,bed->bce", v, v)
        taken = np.zeros((rows, c), bool)
        for k in range(c):
            closer = (np.where(taken, pair[:, k], -2).max(axis=1)) > sims[:, k]
            taken[:, k] = valid[:, k] & ~closer & (taken.sum(axis=1) < m)
        room = m - taken.sum(axis=1)
        rest = valid & ~taken
        taken |= rest & (np.cumsum(rest, axis=1) <= room[:, None])
        out = np.where(taken, ids, -1)
        put = np.argsort(~taken, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(out, put, axis=1)
        if out.shape[1] < m:
            out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def search_layer(self, q: np.ndarray, start: np.ndarray, layer: int, ef: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from ``start`` (rows x k); the best ``ef`` ids and similarities, best first."""
        table, n, b = self.links[layer], len(self.x), len(q)
        ids = np.full((b, max(ef, start.shape[1])), -1, np.int64)
        sims = np.full(ids.shape, -2, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.where(start >= 0, np.einsum("bkd,bd->bk", self.x[start], q), -2)
        done = ids < 0
        seen = np.zeros((b, n), bool)
        row = np.arange(b)
        seen[np.repeat(row, start.shape[1]), start.ravel()] = True
        live, expand = row, min(expand, ef)
        while len(live):
            open_sims = np.where(done[live], -3, sims[live])
            pick = np.argpartition(-open_sims, expand - 1, axis=1)[:, :expand] if expand < open_sims.shape[1] else np.broadcast_to(np.arange(open_sims.shape[1]), open_sims.shape)
            usable = np.take_along_axis(open_sims, pick, axis=1) > -1.5
            going = usable.any(axis=1)
            live, pick, usable = live[going], pick[going], usable[going]
            if not len(live):
                break
            node = np.where(usable, ids[live[:, None], pick], 0)
            done[live[:, None], pick] = True
            near = np.where(usable[:, :, None], table[node], -1).reshape(len(live), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r = np.broadcast_to(live[:, None], near.shape)
            fresh &= ~seen[r, np.where(fresh, near, 0)]
            seen[r[fresh], near[fresh]] = True
            s = np.full(near.shape, -2, np.float32)
            s[fresh] = np.einsum("ij,ij->i", self.x[near[fresh]], q[r[fresh]])
            all_ids = np.hstack([ids[live], np.where(fresh, near, -1)])
            all_sims = np.hstack([sims[live], s])
            all_done = np.hstack([done[live], ~fresh])
            best = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            done[live] = np.take_along_axis(all_done, best, axis=1)
        o = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, o, axis=1)[:, :ef], np.take_along_axis(sims, o, axis=1)[:, :ef]

    def entries(self, q: np.ndarray, most: int = 4) -> np.ndarray:
        """The nodes of the upper layers, and of those that have no path, that are nearest to each query; else the first node."""
        if len(self.upper) <= most:
            return np.full((len(q), 1), self.entry)
        sims = q @ self.x[self.upper].T
        return self.upper[np.argpartition(-sims, most, axis=1)[:, :most]]

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of width ``ef`` at the lowest layer for each query."""
        return self.search_layer(q, self.entries(q), 0, ef)
