"""A linear-chain conditional random field: sparse binary features, exact likelihood, Viterbi decoding; numpy only."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np


#: Tokens whose scores a process keeps; stretches whose labels it keeps, and their length at most.
KEPT = 200_000
STRETCH = 24


class LinearChain:
    """weights: feature x label; moves: label x label; first: label."""

    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)
        self.index: dict[str, int] = {}
        self.paths: dict[tuple, list[int]] = {}
        self.kept: dict[Hashable, tuple[list[float], bool]] = {}
        n = len(self.labels)
        self.weights, self.moves, self.first = np.zeros((0, n)), np.zeros((n, n)), np.zeros(n)
        self.lists: tuple[list[tuple], list[float]] | None = None
        self.gain: float | None = None

    def fit(self, lines: list[list[list[str]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-4) -> LinearChain:
        """Maximum likelihood with an L2 penalty, by Adam over the whole bounded sample; the same sample gives the same weights."""
        for line in lines:
            for token in line:
                for f in token:
                    self.index.setdefault(f, len(self.index))
        b, t, n = len(lines), max(map(len, lines)), len(self.labels)
        feature, place = [], []
        gold, mask = np.zeros((b, t), int), np.zeros((b, t), bool)
        for i, line in enumerate(lines):
            mask[i, : len(line)] = True
            gold[i, : len(line)] = labels[i]
            for j, token in enumerate(line):
                feature += [self.index[f] for f in token]
                place += [i * t + j] * len(token)
        feature, place = np.array(feature), np.array(place)
        order = np.argsort(place, kind="stable")
        feature, place = feature[order], place[order]
        heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        by_feature = np.argsort(feature, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(feature[by_feature]) != 0])
        params = [np.zeros((len(self.index), n)), np.zeros((n, n)), np.zeros(n)]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        one = np.eye(n)[gold] * mask[..., None]
        pair = np.einsum("btk,btl->kl", one[:, :-1] * mask[:, 1:, None], one[:, 1:])
        for step in range(1, rounds + 1):
            w, moves, first = params
            score = np.zeros((b * t, n))
            score[place[heads]] = np.add.reduceat(w[feature], heads)
            score = score.reshape(b, t, n)
            p, pairs = self.marginals(score, moves, first, mask)
            miss = (p - one).reshape(-1, n)
            grad_w = np.zeros_like(w)
            grad_w[feature[by_feature][cuts]] = np.add.reduceat(miss[place[by_feature]], cuts)
            grads = [grad_w / b + decay * w, (pairs - pair) / b + decay * moves, (p[:, 0] - one[:, 0]).sum(0) / b]
            for k, g in enumerate(grads):
                m, v = state[k]
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves, self.first = params
        self.kept.clear()
        self.paths.clear()
        self.lists = self.gain = None
        return self

    @staticmethod
    def marginals(score: np.ndarray, moves: np.ndarray, first: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward, scaled; padded places pass on what they get."""
        b, t, n = score.shape
        e = np.exp(score - score.max(-1, keepdims=True))
        m = np.exp(moves)
        ahead, back = np.zeros((b, t, n)), np.ones((b, t, n)) / n
        x = e[:, 0] * np.exp(first)
        ahead[:, 0] = x / x.sum(-1, keepdims=True)
        for i in range(1, t):
            x = (ahead[:, i - 1] @ m) * e[:, i]
            ahead[:, i] = np.where(mask[:, i, None], x / x.sum(-1, keepdims=True), ahead[:, i - 1])
        for i in range(t - 2, -1, -1):
            x = (back[:, i + 1] * e[:, i + 1]) @ m.T
            back[:, i] = np.where(mask[:, i + 1, None], x / x.sum(-1, keepdims=True), 1 / n)
        p = ahead * back
        p = p / p.sum(-1, keepdims=True) * mask[..., None]
        pairs = np.zeros((n, n))
        for i in range(1, t):
            own = mask[:, i]
            q = ahead[own, i - 1][:, :, None] * m[None] * (e[own, i] * back[own, i])[:, None, :]
            pairs += (q / q.sum((1, 2), keepdims=True)).sum(0)
        return p, pairs

    def labelled(self, keys: Sequence[Hashable], features: Callable[[Hashable], list[str]]) -> list[int]:
        """The likeliest labels of a line whose tokens have the `features` of their `keys`; features not met in training count nothing. Empty where all labels are the
        first. Scores are kept by key, labels by stretch, `KEPT` of each at most.

        A token whose other labels don't come near the first, whatever its neighbours', has the first on the best path: with any other, putting the first in its
        place would win. So the search runs only over the stretches between such tokens, which changes no label.
        """
        scores, stretches, n = [], [], -2
        for i, key in enumerate(keys):
            found = self.kept.get(key)
            if found is None:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                rows = [k for f in features(key) if (k := self.index.get(f)) is not None]
                own = self.weights[rows].sum(0).tolist()
                found = self.kept[key] = own, max(own[1:]) + self.most() >= own[0]
            if found[1]:
                if n != i - 1:
                    stretches.append(i)
                    scores.append([])
                scores[-1].append(found[0])
                n = i
        if not stretches:
            return []
        out = [0] * len(keys)
        for at, own in zip(stretches, scores):
            end = at + len(own)
            if len(own) > STRETCH:
                out[at:end] = self.path(own, at > 0, end < len(keys))
                continue
            same = (at > 0, end < len(keys), *keys[at:end])
            known = self.paths.get(same)
            if known is None:
                if len(self.paths) >= KEPT:
                    self.paths.clear()
                known = self.paths[same] = self.path(own, at > 0, end < len(keys))
            out[at:end] = known
        return out if any(out) else []

    def steps(self) -> tuple[list[tuple], list[float]]:
        """The moves into each label, and the scores of a line's first label, as lists."""
        if self.lists is None:
            self.lists = list(zip(*self.moves.tolist())), self.first.tolist()
        return self.lists

    def most(self) -> float:
        """What a label other than the first can gain by its place at most: by the first label of a line and by two moves."""
        if self.gain is None:
            self.gain = self.greatest_gain()
        return self.gain

    def greatest_gain(self) -> float:
        into = float((self.moves - self.moves[:, :1]).max())  # from any label to another than the first instead of to the first
        out = float((self.moves - self.moves[:1]).max())
        begin = float((self.first - self.first[0]).max())
        return max(0.0, into, begin) + max(0.0, out)

    def path(self, scores: Sequence[Sequence[float]], behind: bool = False, ahead: bool = False) -> list[int]:
        """The likeliest labels (Viterbi), in time linear in the tokens; of equal ones the first. `behind`, `ahead`: whether a token of the first label stands before and after them."""
        labels = range(len(self.labels))
        into, first = self.steps()
        best = [a + b for a, b in zip(scores[0], [m[0] for m in into] if behind else first)]
        back = []
        for s in scores[1:]:
            came, new = [], []
            for k in labels:
                ways = [a + b for a, b in zip(best, into[k])]
                top = max(ways)
                came.append(ways.index(top))
                new.append(top + s[k])
            back.append(came)
            best = new
        if ahead:
            best = [a + b for a, b in zip(best, into[0])]
        out = [best.index(max(best))]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]
