"""A small convolutional classifier of sequences in numpy: hashed embeddings, several filter widths, max pooling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Sequences:
    """Features by position: row i of ``ids`` is a position with several ids whose embeddings are summed; sequence k holds
    the positions ``bounds[k]`` to ``bounds[k + 1]``."""

    ids: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def chosen(self, which: np.ndarray) -> Sequences:
        n = np.diff(self.bounds)[which]
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1][which] - bounds[:-1], n)
        return Sequences(self.ids[at], bounds)


def _first_embeddings(rng: np.random.Generator, buckets: int, dim: int, size: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of the embeddings before any training, some rows at a time; id 0 has none."""
    for at in range(0, buckets, size):
        rows = (rng.normal(size=(min(size, buckets - at), dim)) * 0.1).astype(np.float32)
        if not at:
            rows[0] = 0
        yield at, rows


class ConvNet:
    """Logit = v . max over positions of relu(filters) + c. Id 0 is padding: its embedding stays zero."""

    def __init__(self, buckets: int, dim: int, widths: tuple[int, ...], filters: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.seed = widths, seed
        self.w = {
            "emb": np.concatenate([rows for _, rows in _first_embeddings(rng, buckets, dim)]),
            "v": (rng.normal(size=filters * len(widths)) * 0.1).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        for k in widths:
            self.w[f"f{k}"] = (rng.normal(size=(k, dim, filters)) / np.sqrt(k * dim)).astype(np.float32)
            self.w[f"b{k}"] = np.zeros(filters, np.float32)

    def __getstate__(self) -> dict:
        """Embeddings that no sequence has moved are left out: they follow from the seed."""
        emb, moved = self.w["emb"], []
        for at, rows in _first_embeddings(np.random.default_rng(self.seed), *emb.shape):
            moved.append(at + np.flatnonzero((emb[at : at + len(rows)] != rows).any(1)))
        moved = np.concatenate(moved).astype(np.int32)
        rest = {k: v for k, v in self.w.items() if k != "emb"}
        return {"widths": self.widths, "seed": self.seed, "shape": emb.shape, "moved": moved, "rows": emb[moved], "rest": rest}

    def __setstate__(self, state: dict) -> None:
        self.widths, self.seed = state["widths"], state["seed"]
        emb = np.empty(state["shape"], np.float32)
        for at, rows in _first_embeddings(np.random.default_rng(self.seed), *emb.shape):
            emb[at : at + len(rows)] = rows
        emb[state["moved"]] = state["rows"]
        self.w = {"emb": emb, **state["rest"]}

    def _laid(self, seqs: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """Ids with padding behind each sequence, so that a filter may reach over its end but not into the next one."""
        pad = max(self.widths) - 1
        n = np.diff(seqs.bounds)
        begin = seqs.bounds[:-1] + pad * np.arange(len(n))
        ids = np.zeros((len(seqs.ids) + pad * len(n), seqs.ids.shape[1]), seqs.ids.dtype)
        ids[np.arange(len(seqs.ids)) + pad * np.repeat(np.arange(len(n)), n)] = seqs.ids
        return ids, begin

    def _features(self, seqs: Sequences) -> tuple:
        ids, begin = self._laid(seqs)
        emb = self.w["emb"]
        e = emb[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            e += emb[ids[:, k]]
        n = np.diff(seqs.bounds)
        full = np.flatnonzero(n)
        cuts = np.stack([begin[full], begin[full] + n[full]], 1).ravel()
        pooled, signal = [], []
        for k in self.widths:
            f = self.w[f"f{k}"]
            z = e @ f[0]
            for j in range(1, k):
                z[: len(e) - j] += e[j:] @ f[j]
            z += self.w[f"b{k}"]
            h = np.zeros((len(n), f.shape[2]), np.float32)
            if len(full):
                # every other range is padding; a last empty one needs a row to stand on
                most = np.maximum.reduceat(np.vstack([z, z[-1:]]), cuts, axis=0)[::2]
                h[full] = np.maximum(most, 0)
            pooled.append(h)
            signal.append(z)
        return ids, e, begin, n, full, signal, np.hstack(pooled)

    def logits(self, seqs: Sequences) -> np.ndarray:
        if not len(seqs):
            return np.zeros(0, np.float32)
        if not len(seqs.ids):
            return np.full(len(seqs), self.w["c"][0])
        return self._features(seqs)[-1] @ self.w["v"] + self.w["c"]

    def _gradients(self, seqs: Sequences, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        ids, e, begin, n, full, signal, h = self._features(seqs)
        z = h @ self.w["v"] + self.w["c"]
        d = ((1 / (1 + np.exp(-z)) - y) * weight).astype(np.float32) / len(y)
        g = {"v": h.T @ d, "c": d.sum(keepdims=True)}
        de = np.zeros_like(e)
        at = 0
        for k, s in zip(self.widths, signal, strict=True):
            f = self.w[f"f{k}"]
            own = h[:, at : at + f.shape[2]]
            dh = np.outer(d, self.w["v"][at : at + f.shape[2]]) * (own > 0)
            at += f.shape[2]
            gf = np.zeros_like(f)
            for i in full:
                best = begin[i] + s[begin[i] : begin[i] + n[i]].argmax(0)
                for j in range(k):
                    gf[j] += (e[best + j] * dh[i][:, None]).T
                    np.add.at(de, best + j, f[j].T * dh[i][:, None])
            g[f"f{k}"], g[f"b{k}"] = gf, dh.sum(0)
        touched = np.flatnonzero(np.abs(de).sum(1))
        rows = ids[touched].ravel()
        return g, rows, np.repeat(de[touched], ids.shape[1], axis=0)

    def fit(
        self,
        seqs: Sequences,
        y: np.ndarray,
        which: np.ndarray | None = None,
        epochs: int = 12,
        batch: int = 32,
        rate: float = 0.05,
        seed: int = 7,
    ) -> None:
        """Adagrad over shuffled batches of the sequences ``which`` (all); both labels weigh the same in all."""
        rng = np.random.default_rng(seed)
        which = np.arange(len(y)) if which is None else which
        share = max(1, y[which].sum()) / len(which)
        weight = np.where(y > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share)).astype(np.float32)
        sums = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.w.items()}
        for epoch in range(epochs):
            order = rng.permutation(which)
            step = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                g, rows, values = self._gradients(seqs.chosen(own), y[own], weight[own])
                for k, x in g.items():
                    sums[k] += x * x
                    self.w[k] -= step * x / np.sqrt(sums[k])
                values, rows = values[rows > 0], rows[rows > 0]
                if len(rows):
                    kept, where = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(kept), values.shape[1]), np.float32)
                    np.add.at(total, where, values)
                    sums["emb"][kept] += total * total
                    self.w["emb"][kept] -= step * total / np.sqrt(sums["emb"][kept])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
