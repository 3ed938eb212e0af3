"""A hierarchical navigable small-world graph over unit vectors, built and searched many vectors at a time."""

from __future__ import annotations

import io

import numpy as np

#: Links of a vertex in the upper layers; twice as many in the lowest.
LINKS = 12
BUILD_BEAM = 48
BATCH = 256
#: Cells of the table of visited vertices: it bounds the memory of a search.
VISITED = 1 << 25
STEP = 4  # vertices a search opens at once


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _choose(own: np.ndarray, cand: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each row among its candidates (-1: none): first those nearer to it than to any chosen
    before, so that links spread over directions; free places go to the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = cand.shape
    taken = np.zeros((rows, width), bool)
    chosen = np.full((rows, most), -1, np.int64)
    count = np.zeros(rows, np.int64)
    span = np.arange(most)[None, :]
    for j in range(width):
        c = cand[:, j]
        live = np.flatnonzero((c >= 0) & (count < most) & (c != own))
        if not len(live):
            continue
        picked = chosen[live]
        near = np.einsum("rmd,rd->rm", x[np.maximum(picked, 0)], x[c[live]])
        near = np.where(span < count[live][:, None], near, -2.0).max(axis=1)
        live = live[sims[live, j] > near]
        chosen[live, count[live]] = c[live]
        count[live] += 1
        taken[live, j] = True
    for j in range(width):
        c = cand[:, j]
        live = np.flatnonzero((c >= 0) & (count < most) & (c != own) & ~taken[:, j])
        chosen[live, count[live]] = c[live]
        count[live] += 1
    return chosen


class Graph:
    """Vertices are renumbered by falling level, so a layer is a prefix; `order` has their old numbers."""

    def __init__(self, order: np.ndarray, x: np.ndarray, layers: list[np.ndarray]):
        self.order, self.x, self.layers = order, x, layers

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> Graph:
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        level = level[order]
        graph = cls(order, x[order], [])
        top = int(level.max()) if n else 0
        for at in range(top, -1, -1):
            graph._add_layer(int((level >= at).sum()), LINKS * (1 if at else 2))
        return graph

    def _add_layer(self, size: int, most: int) -> None:
        links = np.full((size, most), -1, np.int64)
        self.layers.append(links)
        done = 0
        while done < size:
            new = np.arange(done, min(size, done + max(32, min(done, 4 * BATCH))))
            within = self.x[new] @ self.x[new].T
            np.fill_diagonal(within, -2)
            k = min(len(new) - 1, BUILD_BEAM)
            near = np.argpartition(-within, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(new), 0), int)
            cand, sims = new[near] if k > 0 else near, np.take_along_axis(within, near, 1)
            if done:
                ids, old = self._descend(self.x[new], BUILD_BEAM, len(self.layers) - 1)
                cand, sims = np.hstack([cand, ids]), np.hstack([sims, old])
            links[new] = _choose(new, cand, sims, self.x, most)
            self._link_back(links, new, most)
            done += len(new)

    def _link_back(self, links: np.ndarray, new: np.ndarray, most: int) -> None:
        ends, starts = links[new].ravel(), np.repeat(new, most)
        keep = ends >= 0
        ends, starts = ends[keep], starts[keep]
        sims = np.einsum("ed,ed->e", self.x[ends], self.x[starts])
        by = np.lexsort((-sims, ends))
        ends, starts = ends[by], starts[by]
        heads, first, count = np.unique(ends, return_index=True, return_counts=True)
        place = np.arange(len(ends)) - np.repeat(first, count)
        wide = min(int(count.max()), 2 * most) if len(count) else 0
        ok = place < wide
        added = np.full((len(heads), wide), -1, np.int64)
        added[np.repeat(np.arange(len(heads)), count)[ok], place[ok]] = starts[ok]
        added[(added[:, :, None] == links[heads][:, None, :]).any(axis=2)] = -1
        cand = np.hstack([links[heads], added])
        for at in range(0, len(heads), BATCH):
            h, c = heads[at : at + BATCH], cand[at : at + BATCH]
            s = np.where(c >= 0, np.einsum("rcd,rd->rc", self.x[np.maximum(c, 0)], self.x[h]), -2.0)
            links[h] = _choose(h, c, s, self.x, most)

    def _descend(self, q: np.ndarray, beam: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Search the layers from the top to `depth`, with a narrow beam above the last."""
        batch = max(1, min(BATCH, VISITED // max(1, len(self.x))))
        found = []
        for at in range(0, len(q), batch):
            part = q[at : at + batch]
            ids = np.zeros((len(part), 1), np.int64)
            for layer in range(depth + 1):
                ids, sims = self._beam(part, ids, beam if layer == depth else 4, self.layers[layer])
            found.append((ids, sims))
        return np.vstack([f[0] for f in found]), np.vstack([f[1] for f in found])

    def _beam(self, q: np.ndarray, start: np.ndarray, beam: int, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(links) + 1), bool)  # the last column stands for no vertex
        seen[:, -1] = True
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -2.0, np.float32)
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        seen[rows, ids[:, :width]] = True
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("rcd,rd->rc", self.x[np.maximum(ids[:, :width], 0)], q), -2)
        shut = ids < 0
        while True:
            value = np.where(shut, -3.0, sims)
            k = min(STEP, beam)
            pick = np.argpartition(-value, k - 1, axis=1)[:, :k]
            open_ = np.take_along_axis(value, pick, 1) > -3.0
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                return ids, sims
            pick, open_ = pick[live], open_[live]
            shut[live[:, None], pick] = True
            at = np.where(open_, ids[live[:, None], pick], -1)
            near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)  # a vertex met twice in this step counts once
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            r, c = np.nonzero(near >= 0)
            s = np.full(near.shape, -2.0, np.float32)
            s[r, c] = np.einsum("ed,ed->e", self.x[near[r, c]], q[live[r]])
            all_ids, all_sims = np.hstack([ids[live], near]), np.hstack([sims[live], s])
            all_shut = np.hstack([shut[live], near < 0])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            shut[live] = np.take_along_axis(all_shut, best, 1)

    def within(self, q: np.ndarray, least: float | np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, old vertex number) of vertices found at similarity `least` or more, one for all queries or
        one for each. A query all of whose
        beam is that similar is asked again with a beam four times as wide, up to the whole graph."""
        n = len(self.x)
        least = np.broadcast_to(least, len(q))
        out_q, out_v = [], []
        ask = np.arange(len(q))
        while len(ask) and n:
            beam = min(beam, n)
            again = []
            size = max(1, (1 << 22) // beam)
            for at in range(0, len(ask), size):
                part = ask[at : at + size]
                ids, sims = self._descend(q[part], beam, len(self.layers) - 1)
                hit = (sims >= least[part][:, None]) & (ids >= 0)
                full = hit.all(axis=1) & (beam < n)
                again.append(part[full])
                r, c = np.nonzero(hit & ~full[:, None])
                out_q.append(part[r])
                out_v.append(self.order[ids[r, c]])
            ask, beam = np.concatenate(again), beam * 4
        if not out_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_q), np.concatenate(out_v)

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        layers = {f"layer{i}": x.astype(np.int32) for i, x in enumerate(self.layers)}
        np.savez(out, order=self.order.astype(np.int32), x=self.x, **layers, **more)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(raw)) as f:
            data = {k: f[k] for k in f.files}
        layers = [data.pop(f"layer{i}").astype(np.int64) for i in range(sum(k.startswith("layer") for k in data))]
        return cls(data.pop("order").astype(np.int64), data.pop("x"), layers), data
