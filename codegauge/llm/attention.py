"""A small causal self-attention language model over subword ids, in numpy.

A position attends to the positions before it in its window (two heads, learned bias by
distance), and its state is its own embedding beside what it attended to. The next id is
predicted in two steps, its class and then the id within the class, so that a step costs
the size of a class and not of the vocabulary. Ids that the sample holds rarely share one
class in which they are told apart by their frequency.

Texts are scored in overlapping windows: each window scores ``STRIDE`` new positions and
only looks at ``OVERLAP`` positions before them, so every id is scored once. As embeddings,
queries, keys and values depend on the id alone, they are looked up in tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

STRIDE, OVERLAP = 24, 8
REACH = STRIDE + OVERLAP
HEADS, HEAD = 2, 8
WIDTH = HEADS * HEAD  # of embeddings and of what is attended to
CLASSES, CLASS_SIZE = 48, 48
SMOOTHING = 0.1
SEEN = 400  # rows whose followers tell the classes apart
MASK = np.float32(-30)


@dataclass
class Weights:
    """All parameters; ``index`` maps a subword id to its row (0: any rare id)."""

    index: np.ndarray
    of_class: np.ndarray  # class of each row; row 0 has the last class
    slot: np.ndarray  # place of each row in its class
    embed: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    bias: np.ndarray  # by head and distance
    out_class: np.ndarray  # 2 * WIDTH (+1 for the constant) x classes
    out_token: np.ndarray  # class x 2 * WIDTH (+1) x class size
    filled: np.ndarray  # class x class size: whether a slot is an id
    rare: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log probability of each id among the rare

    def trained(self) -> list[np.ndarray]:
        """What training changes, in the order of ``gradients``."""
        return [self.embed, self.query, self.key, self.value, self.bias, self.out_class, self.out_token]

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring looks up by row."""
        e = self.embed
        q, k = (e @ self.query / np.sqrt(HEAD)).astype(np.float32), (e @ self.key).astype(np.float32)
        longest = np.sqrt((q * q).sum(1).max() * (k * k).sum(1).max()) + np.abs(self.bias).max()
        return {
            "q": q,
            "kv": np.concatenate([k, (e @ self.value).astype(np.float32)], axis=1),
            "steep": bool(longest > 60),  # only then could an exponential overflow
            "class": (e @ self.out_class[:WIDTH] + self.out_class[-1]).astype(np.float32),
        }


def grouped(rows: np.ndarray, counts: np.ndarray, following: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of each row: rows that follow the same ids share a class (k-means of equal sizes)."""
    n = len(rows)
    profile = following / np.maximum(following.sum(1, keepdims=True), 1)
    profile = np.sqrt(profile) @ rng.standard_normal((profile.shape[1], 24)) / 5
    centre = profile[np.argsort(-counts, kind="stable")[:CLASSES]].copy()
    if len(centre) < CLASSES:
        centre = np.concatenate([centre, rng.standard_normal((CLASSES - len(centre), 24))])
    for _ in range(8):
        away = ((profile[:, None, :] - centre[None]) ** 2).sum(2)
        near = away.argmin(1)
        for c in range(CLASSES):
            own = near == c
            if own.any():
                centre[c] = np.average(profile[own], axis=0, weights=counts[own])
    of_class, slot, room = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(CLASSES, np.int64)
    for r in np.argsort(-counts, kind="stable"):  # frequent rows choose first
        c = int(np.where(room < CLASS_SIZE, away[r], np.inf).argmin())
        of_class[r], slot[r] = c, room[c]
        room[c] += 1
    return of_class, slot


def listed_ids(counts: dict[int, int], size: int) -> tuple[list[int], np.ndarray]:
    """The ids that get a row of their own, most frequent first, and the row of every id."""
    listed = sorted(counts, key=lambda k: (-counts[k], k))[: CLASSES * CLASS_SIZE]
    index = np.zeros(size, np.int64)
    index[listed] = np.arange(1, len(listed) + 1)
    return listed, index


def following_shape(counts: dict[int, int]) -> tuple[int, int]:
    """Rows, and how many of the most frequent ones are looked at before them."""
    n = min(len(counts), CLASSES * CLASS_SIZE) + 1
    return n, min(n, SEEN)


def following_counts(index: np.ndarray, shape: tuple[int, int], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each row comes after each of the frequent ones, in texts laid out as for ``log_scores``."""
    source = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
    before, after = index[ids[source]], index[ids[source + 1]]
    keep = before < shape[1]
    return np.bincount(after[keep] * shape[1] + before[keep], minlength=shape[0] * shape[1])


def start(
    texts: list[np.ndarray], counts: dict[int, int], size: int, seed: int = 7, following: np.ndarray | None = None
) -> Weights:
    """Untrained weights for a vocabulary of ``size`` ids whose frequencies are ``counts``.

    ``following`` holds the ``following_counts`` of a whole corpus; left out, those of the texts are taken.
    """
    rng = np.random.default_rng(seed)
    listed, index = listed_ids(counts, size)
    shape = following_shape(counts)
    n = shape[0]
    if following is None:
        following = following_counts(index, shape, np.concatenate(texts), np.array([len(x) - 1 for x in texts]))
    following = following.reshape(shape).astype(np.float32)
    freq = np.array([counts[k] for k in listed], float)
    of_class, slot = np.full(n, CLASSES, np.int64), np.zeros(n, np.int64)
    of_class[1:], slot[1:] = grouped(np.arange(1, n), freq, following[1:], rng)
    filled = np.zeros((CLASSES, CLASS_SIZE), np.bool_)
    filled[of_class[1:], slot[1:]] = True
    rare = np.full(size, SMOOTHING)
    for k, c in counts.items():
        rare[k] += c
    rare[listed] = 0
    with np.errstate(divide="ignore"):
        rare = np.log(rare / rare.sum())
    out_token = np.zeros((CLASSES, 2 * WIDTH + 1, CLASS_SIZE), np.float32)
    out_token[:, -1][of_class[1:], slot[1:]] = np.log(freq + 1)
    out_class = np.zeros((2 * WIDTH + 1, CLASSES + 1), np.float32)
    out_class[-1] = np.log(np.append(np.bincount(of_class[1:], freq, CLASSES), sum(counts.values()) - freq.sum()) + 1)
    out_class[-1, :CLASSES][~filled.any(1)] = MASK  # a class without ids is never predicted
    draw = lambda *s: rng.standard_normal(s).astype(np.float32)
    bias = np.zeros((HEADS, REACH), np.float32)
    bias[0] = -1.0 * np.arange(REACH)
    return Weights(
        index, of_class, slot, draw(n, WIDTH) * 0.5, draw(WIDTH, WIDTH) * 0.25, draw(WIDTH, WIDTH) * 0.25,
        draw(WIDTH, WIDTH) * 0.25, bias, out_class, out_token, filled, rare.astype(np.float32),
    )


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many positions, laid after one another: first position and text's first, per window."""
    n = -(-sizes // STRIDE)
    base = np.repeat(np.cumsum(sizes) - sizes, n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return base + step * STRIDE, base


def attended(w: Weights, t: dict[str, np.ndarray], rows: np.ndarray, first: np.ndarray, base: np.ndarray, keep: bool = False):
    """What the STRIDE positions of each window attended to: (windows, STRIDE, WIDTH).

    A window's keys are the OVERLAP positions before its first one and its own; positions
    before the text or after the one that attends are masked.
    """
    at = first[:, None] + np.arange(-OVERLAP, STRIDE)
    begins = first - OVERLAP < base
    r = rows[np.clip(at, 0, len(rows) - 1)]
    kv = t["kv"][r]
    n = len(first)
    q = t["q"][r[:, OVERLAP:]].reshape(n, STRIDE, HEADS, HEAD).transpose(0, 2, 1, 3)
    k = kv[..., :WIDTH].reshape(n, REACH, HEADS, HEAD).transpose(0, 2, 3, 1)
    v = kv[..., WIDTH:].reshape(n, REACH, HEADS, HEAD).transpose(0, 2, 1, 3)
    away = np.arange(STRIDE)[:, None] + OVERLAP - np.arange(REACH)
    s = np.matmul(q, k)
    s += np.where(away >= 0, w.bias[:, np.abs(away)], MASK)
    if begins.any():  # few windows begin a text
        s[begins] += np.where(at[begins] >= base[begins][:, None], np.float32(0), MASK)[:, None, None, :]
    if t["steep"]:
        np.minimum(s, np.float32(60), out=s)
    np.exp(s, out=s)
    total = s.sum(-1, keepdims=True)
    if keep:
        s /= total
        return np.matmul(s, v).transpose(0, 2, 1, 3).reshape(n, STRIDE, WIDTH), (r, q, k, v, s, away)
    return (np.matmul(s, v) / total).transpose(0, 2, 1, 3).reshape(n, STRIDE, WIDTH)


def log_scores(w: Weights, t: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Natural-log probability of every id from the second of each text on.

    ``ids`` are the texts after one another, each with its first id; sizes count positions
    that predict (ids minus one per text). The result is laid out like those positions.
    """
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    texts = np.repeat(np.arange(len(sizes)), sizes)
    source = np.arange(len(texts)) + texts  # one id per text has no prediction after it
    del starts
    rows, goal_id = w.index[ids[source]], ids[source + 1]
    goal = w.index[goal_id]
    first, base = windows(sizes)
    ends = np.repeat(np.cumsum(sizes), -(-sizes // STRIDE))
    result = np.zeros(len(rows), np.float32)
    for a in range(0, len(first), chunk):
        f, b, e = first[a : a + chunk], base[a : a + chunk], ends[a : a + chunk]
        got = attended(w, t, rows, f, b).reshape(-1, WIDTH)
        at = (f[:, None] + np.arange(STRIDE)).ravel()
        real = at < np.repeat(e, STRIDE)
        if not real.all():
            at, got = at[real], got[real]
        r, g = rows[at], goal[at]
        c = w.of_class[g]
        z = got @ w.out_class[WIDTH:-1]
        z += t["class"][r]
        own = z[np.arange(len(at)), c]
        np.exp(z, out=z)
        score = own - np.log(z.sum(1))
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(CLASSES + 2))
        state = np.concatenate([w.embed[r[order]], got[order]], axis=1)
        inner = np.zeros(len(at), np.float32)
        for k in range(CLASSES):
            x, y = edges[k], edges[k + 1]
            if x == y:
                continue
            n = int(w.filled[k].sum())
            z = state[x:y] @ w.out_token[k, :-1, :n]
            z += w.out_token[k, -1, :n]
            own = z[np.arange(y - x), w.slot[g[order[x:y]]]]
            np.exp(z, out=z)
            inner[x:y] = own - np.log(z.sum(1))
        x = edges[CLASSES]
        inner[x:] = w.rare[goal_id[at[order[x:]]]]
        score[order] += inner
        result[at] = score
    return result


class Adam:
    def __init__(self, arrays: list[np.ndarray], rate: float, decay: float = 0.0) -> None:
        self.arrays, self.rate, self.decay, self.k = arrays, rate, decay, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.k += 1
        scale = self.rate * np.sqrt(1 - 0.99**self.k) / (1 - 0.9**self.k)
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v, strict=True):
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            a -= np.float32(scale) * m / (np.sqrt(v) + np.float32(1e-6)) + np.float32(self.rate * self.decay) * a


def train(w: Weights, texts: list[np.ndarray], steps: int, chunk: int = 256, rate: float = 0.02, seed: int = 3) -> Weights:
    """Fits all weights to the texts (arrays of ids, first id included) by Adam on windows drawn in turn."""
    sizes = np.array([len(x) - 1 for x in texts])
    ids = np.concatenate(texts)
    source = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
    rows, goal = w.index[ids[source]], w.index[ids[source + 1]]
    first, base = windows(sizes)
    ends = np.repeat(np.cumsum(sizes), -(-sizes // STRIDE))
    rng = np.random.default_rng(seed)
    adam = Adam(w.trained(), rate)
    deck = rng.permutation(len(first))
    for step in range(steps):
        pick = np.take(deck, np.arange(step * chunk, (step + 1) * chunk), mode="wrap")
        adam.rate = rate * min(1, (step + 1) / 20) * max(0.05, 1 - step / steps)
        adam.step(gradients(w, rows, goal, first[pick], base[pick], ends[pick]))
    return w


class Learner:
    """Goes on training weights over texts that come in batches; every window is learned once."""

    def __init__(self, w: Weights, rate: float = 0.003, chunk: int = 256, seed: int = 5) -> None:
        self.w, self.rate, self.chunk = w, rate, chunk
        self.adam, self.rng, self.windows = Adam(w.trained(), rate), np.random.default_rng(seed), 0

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Texts laid out as for ``log_scores``; steps of about ``chunk`` windows in drawn order."""
        source = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
        rows, goal = self.w.index[ids[source]], self.w.index[ids[source + 1]]
        first, base = windows(sizes)
        ends = np.repeat(np.cumsum(sizes), -(-sizes // STRIDE))
        for pick in np.array_split(self.rng.permutation(len(first)), -(-len(first) // self.chunk)):
            share = len(pick) / self.chunk
            self.adam.rate = self.rate * min(1, (self.adam.k + 1) / 20) * share / np.sqrt(1 + self.adam.k / 200)
            self.adam.step(gradients(self.w, rows, goal, first[pick], base[pick], ends[pick]))
        self.windows += len(first)


def gradients(w: Weights, rows, goal, first, base, ends) -> list[np.ndarray]:
    """Gradients of the mean loss over the windows' real positions, in the order of ``train``'s parameters."""
    t = w.tables()
    out, (r, q, k, v, s, away) = attended(w, t, rows, first, base, keep=True)
    n = len(first)
    at = (first[:, None] + np.arange(STRIDE)).ravel()
    real = at < np.repeat(ends, STRIDE)
    at = np.minimum(at, len(rows) - 1)
    own, g = rows[at], goal[at]
    state = np.concatenate([w.embed[own], out.reshape(-1, WIDTH), np.ones((len(at), 1), np.float32)], axis=1)
    total = max(1, int(real.sum()))
    c = w.of_class[g]
    z = state @ w.out_class
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(at)), c] -= 1
    z[~real] = 0
    z /= total
    d_class = state.T @ z
    d_state = z @ w.out_class.T
    d_token = np.zeros_like(w.out_token)
    order = np.argsort(np.where(real, c, CLASSES + 1), kind="stable")
    edges = np.searchsorted(np.where(real, c, CLASSES + 1)[order], np.arange(CLASSES + 2))
    for j in range(CLASSES):
        i = order[edges[j] : edges[j + 1]]
        m = int(w.filled[j].sum())
        if not len(i) or not m:
            continue
        y = state[i] @ w.out_token[j, :, :m]
        y = np.exp(y - y.max(1, keepdims=True))
        y /= y.sum(1, keepdims=True)
        y[np.arange(len(i)), w.slot[g[i]]] -= 1
        y /= total
        d_token[j, :, :m] = state[i].T @ y
        d_state[i] += y @ w.out_token[j, :, :m].T
    d_embed = np.zeros_like(w.embed)
    d_out = d_state[:, WIDTH:-1].reshape(n, STRIDE, HEADS, HEAD).transpose(0, 2, 1, 3)
    d_s = np.matmul(d_out, v.transpose(0, 1, 3, 2))
    d_v = np.matmul(s.transpose(0, 1, 3, 2), d_out)
    d_s = s * (d_s - (d_s * s).sum(-1, keepdims=True))
    d_bias = np.zeros_like(w.bias)
    by_place = d_s.sum(0)
    for h in range(HEADS):
        np.add.at(d_bias[h], np.abs(away)[away >= 0], by_place[h][away >= 0])
    d_q = np.matmul(d_s, k.transpose(0, 1, 3, 2)).transpose(0, 2, 1, 3).reshape(-1, WIDTH) / np.float32(np.sqrt(HEAD))
    d_k = np.matmul(d_s.transpose(0, 1, 3, 2), q).transpose(0, 2, 1, 3).reshape(-1, WIDTH)
    d_v = d_v.transpose(0, 2, 1, 3).reshape(-1, WIDTH)
    asked, held = r[:, OVERLAP:].ravel(), r.ravel()
    e_own, e_held = w.embed[asked], w.embed[held]
    d_query, d_key, d_value = e_own.T @ d_q, e_held.T @ d_k, e_held.T @ d_v
    scatter(d_embed, own, d_state[:, :WIDTH])
    scatter(d_embed, asked, d_q @ w.query.T)
    scatter(d_embed, held, d_k @ w.key.T + d_v @ w.value.T)
    return [d_embed, d_query, d_key, d_value, d_bias, d_class, d_token]


def scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows that may repeat."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    into[sorted_[first]] += np.add.reduceat(values[order], first, axis=0)
