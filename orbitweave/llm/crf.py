"""A two-state linear-chain conditional random field over a stream of tokens. Sequences stand one
after another in the stream; forward and backward passes run over equal blocks side by side (block
products first, then a scan over blocks, then all blocks again), so that one very long sequence
costs no more than many short ones."""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field

import numpy as np

CLIP = 20.0


def messages(e: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """e: score of state 1 over state 0 of each token; first: where a sequence begins. Forward and
    backward messages, each (n, 2) and scaled to sum 1, and the step potentials."""
    n = len(e)
    width = max(1, int(n**0.5))
    blocks = -(-n // width)
    pad = blocks * width - n
    x = np.exp(np.clip(np.concatenate((e, np.zeros(pad))), -CLIP, CLIP))
    begin = np.concatenate((first, np.ones(pad, bool)))
    t, s = np.exp(transition), np.exp(start)
    step = [np.where(begin, s[0], t[0, 0]), np.where(begin, s[1], t[0, 1]) * x, np.where(begin, s[0], t[1, 0]), np.where(begin, s[1], t[1, 1]) * x]
    m = [np.ascontiguousarray(y.reshape(blocks, width).T) for y in step]
    del step, x
    p = [m[0][0], m[1][0], m[2][0], m[3][0]]
    for k in range(1, width):
        a, b, c, d = m[0][k], m[1][k], m[2][k], m[3][k]
        p = [p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d]
        if k % 8 == 0:
            z = p[0] + p[1] + p[2] + p[3]
            p = [y / z for y in p]
    enter, leave = np.empty((2, blocks)), np.empty((2, blocks))
    u = v = 0.5
    rows = np.array(p)
    for k in range(blocks):
        enter[0, k], enter[1, k] = u, v
        a, b, c, d = rows[:, k]
        u, v = u * a + v * c, u * b + v * d
        z = u + v
        u, v = u / z, v / z
    u = v = 0.5
    for k in range(blocks - 1, -1, -1):
        leave[0, k], leave[1, k] = u, v
        a, b, c, d = rows[:, k]
        u, v = a * u + b * v, c * u + d * v
        z = u + v
        u, v = u / z, v / z
    alpha, beta = np.empty((2, width, blocks)), np.empty((2, width, blocks))
    u, v = enter
    for k in range(width):
        u, v = u * m[0][k] + v * m[2][k], u * m[1][k] + v * m[3][k]
        z = u + v
        u, v = u / z, v / z
        alpha[0, k], alpha[1, k] = u, v
    u, v = leave
    for k in range(width - 1, -1, -1):
        beta[0, k], beta[1, k] = u, v
        u, v = m[0][k] * u + m[1][k] * v, m[2][k] * u + m[3][k] * v
        z = u + v
        u, v = u / z, v / z
    flat = lambda y: y.transpose(2, 1, 0).reshape(-1, 2)[:n]
    return flat(alpha), flat(beta), [y.T.reshape(-1)[:n] for y in m]


def marginals(e: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each token."""
    if not len(e):
        return np.zeros(0)
    alpha, beta, _ = messages(e, first, transition, start)
    both = alpha * beta
    return both[:, 1] / both.sum(1)


def pair_counts(e: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, expected transitions (2, 2) and expected starts (2)."""
    alpha, beta, m = messages(e, first, transition, start)
    both = alpha * beta
    p = both / both.sum(1, keepdims=True)
    inner = np.flatnonzero(~first)
    a, b = alpha[inner - 1], beta[inner]
    xi = np.stack([a[:, 0] * m[0][inner] * b[:, 0], a[:, 0] * m[1][inner] * b[:, 1], a[:, 1] * m[2][inner] * b[:, 0], a[:, 1] * m[3][inner] * b[:, 1]])
    xi = (xi / xi.sum(0)).sum(1).reshape(2, 2)
    return p[:, 1], xi, p[first].sum(0)


def features(word: str) -> list[str]:
    """Of a token: itself, its beginnings and its end."""
    out = ["w:" + word]
    for k in range(3, 9):
        if len(word) > k:
            out.append(f"p{k}:" + word[:k])
    if len(word) > 3:
        out.append("s3:" + word[-3:])
    return out


@dataclass
class Tagger:
    """Weights by feature for a token itself, the one before and the one after; transitions."""

    weights: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    bias: float = -5.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, words: list[str]) -> np.ndarray:
        """(n, 3): what each word adds to its own score, to the next token's and to the last's."""
        get, out = self.weights.get, []
        for w in words:
            own = before = after = 0.0
            for x in map(get, features(w)):
                if x is not None:
                    own += x[0]
                    before += x[1]
                    after += x[2]
            out.append((own, before, after))
        return np.array(out, float).reshape(-1, 3)

    def emissions(self, word: np.ndarray, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = scores[word, 0] + self.bias
        inner = np.flatnonzero(~first)
        e[inner] += scores[word[inner - 1], 1]
        e[inner - 1] += scores[word[inner], 2]
        return e


def fit(docs: list[list[str]], tags: list[np.ndarray], rounds: int = 60, l2: float = 1.0, least: int = 2) -> Tagger:
    """Maximum-likelihood weights by Adam over all tokens. docs: words of each; tags: 0 or 1 of
    each word. Features that no word seen least times has are left out."""
    words = sorted({w for d in docs for w in d})
    number = {w: i for i, w in enumerate(words)}
    word = np.array([number[w] for d in docs for w in d], np.int64)
    y = np.concatenate([np.asarray(t, float) for t in tags]) if tags else np.zeros(0)
    first = np.zeros(len(word), bool)
    first[np.cumsum([0, *(len(d) for d in docs if d)])[:-1]] = True
    if not y.sum():
        return Tagger()
    seen = np.bincount(word, minlength=len(words))
    # features of words seen once stay out: few tokens could teach them, and they are most of all
    names: dict[str, int] = {}
    rows, cols = array("i"), array("i")
    for i in np.flatnonzero(seen >= least).tolist():
        for f in features(words[i]):
            rows.append(i)
            cols.append(names.setdefault(f, len(names)))
    for i in np.flatnonzero(seen < least).tolist():
        for f in features(words[i]):
            if f in names:
                rows.append(i)
                cols.append(names[f])
    row, col = np.array(rows, np.int64), np.array(cols, np.int64)
    inner = np.flatnonzero(~first)
    tagger = Tagger(bias=float(np.log(y.mean() / (1 - y.mean()))))
    n_f = len(names)
    x = np.zeros(3 * n_f + 7)  # weights, bias, transitions, starts
    x[3 * n_f] = tagger.bias
    t = y.astype(int)
    seen_pairs = np.bincount(2 * t[inner - 1] + t[inner], minlength=4).reshape(2, 2)
    seen_starts = np.bincount(t[first], minlength=2)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        w = x[: 3 * n_f].reshape(3, n_f)
        scores = np.stack([np.bincount(row, w[j][col], len(words)) for j in range(3)], 1)
        tagger.bias, tagger.transition, tagger.start = x[3 * n_f], x[3 * n_f + 1 : 3 * n_f + 5].reshape(2, 2), x[3 * n_f + 5 :]
        p, pairs_expected, starts = pair_counts(tagger.emissions(word, scores, first), first, tagger.transition, tagger.start)
        r = y - p
        by_word = [np.bincount(word, r, len(words)), np.bincount(word[inner - 1], r[inner], len(words)), np.bincount(word[inner], r[inner - 1], len(words))]
        g = np.concatenate([*(np.bincount(col, b[row], n_f) for b in by_word), [r.sum()], (seen_pairs - pairs_expected).ravel(), seen_starts - starts])
        g -= l2 * x
        g /= max(1.0, y.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    w = x[: 3 * n_f].reshape(3, n_f)
    tagger.bias, tagger.transition, tagger.start = float(x[3 * n_f]), x[3 * n_f + 1 : 3 * n_f + 5].reshape(2, 2).copy(), x[3 * n_f + 5 :].copy()
    tagger.weights = {f: tuple(float(z) for z in w[:, i]) for f, i in names.items() if np.abs(w[:, i]).max() > 0.02}
    return tagger
