"""A hierarchical navigable small-world graph over unit vectors, built and searched in blocks.

Queries of a block walk in step: each round expands the best unexpanded nodes of every beam at once, so the
work is a few array operations per round rather than a loop over nodes.
"""

from __future__ import annotations

import numpy as np

#: Links that a node chooses, as many again that choose it; beam while building; nodes expanded per round.
LINKS, BUILD_BEAM, EXPAND = 16, 64, 4
BATCH = 256


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 3):
        """``vectors``: unit rows."""
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int), 6) if n else np.zeros(0, int)
        order = np.argsort(-self.level, kind="stable")  # the entry point first, then in order of the rows
        order = np.concatenate((order[:1], np.setdiff1d(np.arange(n), order[:1])))
        self.top = int(self.level.max()) if n else 0
        self.entry = int(order[0]) if n else 0
        self.links = [np.full((n, 2 * LINKS), -1, np.int32) for _ in range(self.top + 1)]
        self.back = [np.full((n, LINKS), -np.inf, np.float32) for _ in range(self.top + 1)]
        self.done = np.zeros(n, bool)
        for a in range(0, n, BATCH):
            self._insert(order[a : a + BATCH])

    def _insert(self, new: np.ndarray) -> None:
        near = np.full((len(new), 1), self.entry)
        for layer in range(self.top, -1, -1):
            here = self.level[new] >= layer
            ids = new[here]
            if self.done.any():
                beam = BUILD_BEAM if here.any() else 4
                found, sims = self._walk(self.x[new], near, layer, beam)
                near = np.where(found[:, :4] >= 0, found[:, :4], self.entry)
                found, sims = found[here], sims[here]
            else:
                found, sims = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.float32)
            if not len(ids):
                continue
            among = self.x[ids] @ self.x[ids].T
            np.fill_diagonal(among, -np.inf)
            take = min(len(ids), LINKS)
            best = np.argpartition(-among, take - 1, axis=1)[:, :take]
            inside = np.take_along_axis(among, best, 1)
            ids_inside = np.where(np.isfinite(inside), ids[best], -1)
            self._connect(ids, np.concatenate((found, ids_inside), 1), np.concatenate((sims, inside), 1), layer)
        self.done[new] = True

    def _connect(self, ids: np.ndarray, found: np.ndarray, sims: np.ndarray, layer: int) -> None:
        """Links of new nodes to diverse near ones, and back."""
        sims = np.where(found >= 0, sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        b, c = found.shape
        v = self.x[np.maximum(found, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept, closest, count = np.zeros((b, c), bool), np.full((b, c), -np.inf, np.float32), np.zeros(b, int)
        for j in range(c):
            good = (sims[:, j] > closest[:, j]) & (sims[:, j] > -np.inf) & (count < LINKS)
            kept[:, j] = good
            count += good
            closest = np.where(good[:, None], np.maximum(closest, between[:, j]), closest)
        # the diverse ones first, then the nearest of the others
        rank = np.argsort(np.where(kept, 0, 1) + np.where(np.isfinite(sims), 0, 2), axis=1, kind="stable")[:, :LINKS]
        chosen, of = np.take_along_axis(found, rank, 1), np.take_along_axis(sims, rank, 1)
        chosen = np.where(np.isfinite(of), chosen, -1)
        self.links[layer][ids, : chosen.shape[1]] = chosen
        # back links: the nearest of those that chose a node
        good = chosen >= 0
        to, who, how = chosen[good], np.repeat(ids, chosen.shape[1])[good.ravel()], of[good]
        hit = np.unique(to)
        old, old_sims = self.links[layer][hit, LINKS:], self.back[layer][hit]
        have = old >= 0
        to = np.concatenate((to, np.repeat(hit, LINKS)[have.ravel()]))
        who, how = np.concatenate((who, old[have])), np.concatenate((how, old_sims[have]))
        order = np.lexsort((who, -how, to))
        to, who, how = to[order], who[order], how[order]
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        nth = np.arange(len(to)) - np.repeat(starts, np.diff(np.append(starts, len(to))))
        keep = nth < LINKS
        self.links[layer][hit, LINKS:] = -1
        self.back[layer][hit] = -np.inf
        self.links[layer][to[keep], LINKS + nth[keep]] = who[keep]
        self.back[layer][to[keep], nth[keep]] = how[keep]

    def _walk(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the nearest ``beam`` nodes found, nearest first, -1 where there are fewer."""
        n, m = len(self.x), len(q)
        ids, sims = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        new = start.astype(np.int64)
        rows = np.arange(m)
        while True:
            new = np.sort(new, axis=1)
            ok = new >= 0
            ok[:, 1:] &= new[:, 1:] != new[:, :-1]
            ok &= ~seen[rows[:, None], np.maximum(new, 0)]
            r, c = np.nonzero(ok)
            seen[rows[r], new[r, c]] = True
            fresh = np.full(new.shape, -np.inf, np.float32)
            fresh[r, c] = np.einsum("ij,ij->i", self.x[new[r, c]], q[rows[r]])
            all_ids = np.concatenate((ids[rows], np.where(ok, new, -1)), 1)
            all_sims = np.concatenate((sims[rows], fresh), 1)
            all_open = np.concatenate((open_[rows], ok), 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[rows], sims[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[rows] = np.take_along_axis(all_open, best, 1)
            rows = rows[open_[rows].any(1)]
            if not len(rows):
                break
            waiting = np.where(open_[rows], sims[rows], -np.inf)
            width = min(EXPAND, beam)
            at = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            real = np.take_along_axis(open_[rows], at, 1)
            open_[rows[:, None], at] = False
            node = np.where(real, ids[rows[:, None], at], 0)
            new = np.where(real[:, :, None], self.links[layer][node], -1).reshape(len(rows), -1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit row of ``q``: ids and similarities of its beam."""
        near = np.full((len(q), 1), self.entry)
        for layer in range(self.top, 0, -1):
            found, _ = self._walk(q, near, layer, 4)
            near = np.where(found >= 0, found, self.entry)
        return self._walk(q, near, 0, beam)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of at least that similarity; beams that are full of such are widened."""
        n, q = len(self.x), np.ascontiguousarray(q, np.float32)
        out_q, out_n = [], []
        todo = np.arange(len(q))
        while len(todo) and n:
            beam = min(beam, n)
            again = []
            step = max(1, min(512, (64 << 20) // n, (16 << 20) // beam))
            for a in range(0, len(todo), step):
                some = todo[a : a + step]
                ids, sims = self.nearest(q[some], beam)
                hit = (sims >= least) & (ids >= 0)
                full = hit.all(1) & (beam < n)
                again.append(some[full])
                r, c = np.nonzero(hit & ~full[:, None])
                out_q.append(some[r])
                out_n.append(ids[r, c])
            todo = np.concatenate(again)
            beam *= 4
        if not out_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_q), np.concatenate(out_n)
