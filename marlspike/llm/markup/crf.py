"""A linear-chain conditional random field with sparse binary features."""

from __future__ import annotations

import numpy as np


class ChainField:
    """Weights of features by label and of neighbouring labels; ``fit`` by gradient ascent, ``decode`` by Viterbi."""

    def __init__(self, labels: list[str]):
        self.labels, self.index = labels, {label: i for i, label in enumerate(labels)}
        self.features: dict[str, int] = {}
        n = len(labels)
        self.weights, self.moves, self.first = np.zeros((0, n)), np.zeros((n, n)), np.zeros(n)

    def to_dict(self) -> dict:
        """Labels and weights, to three decimals, without zeros."""

        def sparse(row: np.ndarray) -> dict[str, float]:
            return {self.labels[i]: round(float(x), 3) for i, x in enumerate(row) if abs(x) >= 5e-4}

        return {"labels": self.labels, "first": sparse(self.first), "moves": [sparse(row) for row in self.moves], "features": {f: sparse(self.weights[i]) for f, i in self.features.items()}}

    @classmethod
    def from_dict(cls, given: dict) -> ChainField:
        field = cls(given["labels"])

        def dense(row: dict[str, float]) -> np.ndarray:
            return np.array([row.get(label, 0.0) for label in field.labels])

        field.features = {f: i for i, f in enumerate(given["features"])}
        field.weights = np.array([dense(row) for row in given["features"].values()]).reshape(-1, len(field.labels))
        field.first, field.moves = dense(given["first"]), np.array([dense(row) for row in given["moves"]])
        return field

    def _scores(self, sequence: list[list[str]]) -> np.ndarray:
        known = [[k for f in leaf if (k := self.features.get(f)) is not None] for leaf in sequence]
        ends = np.cumsum([len(row) for row in known])
        sums = np.cumsum(np.vstack([np.zeros(len(self.labels)), self.weights[[k for row in known for k in row]]]), axis=0)
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]

    @staticmethod
    def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels and sums of those of label pairs, by the forward and backward sums."""
        t, n = scores.shape
        ahead, back = np.empty((t, n)), np.zeros((t, n))
        ahead[0] = self.first + scores[0]
        for i in range(1, t):
            ahead[i] = scores[i] + self._log_sum(ahead[i - 1][:, None] + self.moves, 0)
        for i in range(t - 2, -1, -1):
            back[i] = self._log_sum(self.moves + (scores[i + 1] + back[i + 1])[None, :], 1)
        whole = self._log_sum(ahead[-1], 0)
        single = np.exp(ahead + back - whole)
        pairs = np.zeros((n, n))
        for i in range(1, t):
            pairs += np.exp(ahead[i - 1][:, None] + self.moves + (scores[i] + back[i])[None, :] - whole)
        return single, pairs

    def fit(self, sequences: list[list[list[str]]], gold: list[list[str]], rounds: int = 6, rate: float = 0.5, shrink: float = 1e-4, seed: int = 3) -> ChainField:
        """Adagrad over the pages' log-likelihoods, in an order drawn with ``seed``, with a pull of ``shrink`` to zero."""
        for sequence in sequences:
            for leaf in sequence:
                for feature in leaf:
                    self.features.setdefault(feature, len(self.features))
        n = len(self.labels)
        self.weights = np.zeros((len(self.features), n))
        seen = [np.full_like(w, 1e-2) for w in (self.weights, self.moves, self.first)]
        draw = np.random.default_rng(seed)
        for _ in range(rounds):
            for s in draw.permutation(len(sequences)):
                sequence, labels = sequences[s], [self.index[x] for x in gold[s]]
                if not sequence:
                    continue
                single, pairs = self._marginals(self._scores(sequence))
                slope = -single
                slope[np.arange(len(labels)), labels] += 1
                turn = -pairs
                np.add.at(turn, (labels[:-1], labels[1:]), 1)
                rows: dict[int, np.ndarray] = {}
                for leaf, step in zip(sequence, slope, strict=True):
                    for k in {self.features[f] for f in leaf}:
                        rows[k] = rows.get(k, 0) + step
                keys = np.fromiter(rows, int)
                for w, total, g in ((self.weights, seen[0], (keys, np.array([*rows.values()]))), (self.moves, seen[1], (slice(None), turn)), (self.first, seen[2], (slice(None), slope[0]))):
                    where, up = g
                    up = up - shrink * w[where]
                    total[where] += up * up
                    w[where] += rate * up / np.sqrt(total[where])
        return self

    def decode(self, sequence: list[list[str]]) -> list[str]:
        """The most probable labels of a page's leaves (Viterbi)."""
        if not sequence:
            return []
        scores = self._scores(sequence)
        best, came = self.first + scores[0], []
        for row in scores[1:]:
            ways = best[:, None] + self.moves
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        path = [int(best.argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        return [self.labels[i] for i in reversed(path)]
