"""A bidirectional gated recurrent network with attention pooling over words, in numpy.

A word enters as its own vector (for words that the training texts hold often enough) beside
the mean of the vectors of its character trigrams. Two gated recurrent layers read a window
in both directions, attention weighs their states, and the weighted state gives the logit of
the window. A text's logit is that of its highest window.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np

from codegauge.llm.attention import Adam, scatter

WINDOW, STRIDE = 64, 48
WORD, CHAR, HIDDEN, ATTEND = 12, 12, 12, 8
INPUT = WORD + CHAR
GRAMS = 1 << 13
LISTED = 8000
DECAY = 0.02
LONG, PIECE, PIECE_STEP = 48, 32, 16  # bytes of a word that is read whole, of a longer one's pieces, and between these
FORGET = 0.3  # share of words that training sees by their letters alone
MARKS = b".,;:!?\"'()[]{}"
Z = np.float32


@dataclass
class Network:
    words: dict[bytes, int]  # row of each listed word; 0 is any other
    word: np.ndarray
    char: np.ndarray
    into: np.ndarray  # direction x (INPUT + 1) x 3 HIDDEN: update, reset, new
    back: np.ndarray  # direction x HIDDEN x 3 HIDDEN
    attend: np.ndarray  # 2 HIDDEN x ATTEND
    weigh: np.ndarray  # ATTEND
    out: np.ndarray  # 2 HIDDEN + 1
    rate: float = 0.0  # share of toxic texts, the score where nothing can be learned
    shift: float = 0.0  # added to a text's logit

    def parameters(self) -> list[np.ndarray]:
        return [self.word, self.char, self.into, self.back, self.attend, self.weigh, self.out]


def tokens(text: str) -> list[bytes]:
    """Lower-cased words without the marks around them; a word over ``LONG`` bytes as overlapping pieces.

    Writing without blanks is one long word: every byte of it is in a piece, and whatever is
    at most ``PIECE`` - ``PIECE_STEP`` bytes long lies whole in one.
    """
    out = []
    for w in text.lower().encode().split():
        w = w.strip(MARKS) or w
        if len(w) <= LONG:
            out.append(w)
        else:
            out += [w[k : k + PIECE] for k in range(0, len(w) - (PIECE - PIECE_STEP), PIECE_STEP)]
    return out


def grams(word: bytes) -> list[int]:
    """Hashed trigrams of a word between its ends."""
    word = b"<" + word + b">"
    return [zlib.crc32(word[k : k + 3]) % GRAMS for k in range(len(word) - 2)] or [0]


def windows(n: int) -> list[tuple[int, int]]:
    """First and last place of overlapping windows that cover n words."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def start(listed: list[bytes], rate: float, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(Z)
    net = Network(
        {w: k + 1 for k, w in enumerate(listed)}, draw(len(listed) + 1, WORD, by=0.1), draw(GRAMS, CHAR, by=1.0),
        draw(2, INPUT + 1, 3 * HIDDEN), draw(2, HIDDEN, 3 * HIDDEN), draw(2 * HIDDEN, ATTEND), draw(ATTEND), draw(2 * HIDDEN + 1), rate,
    )
    net.word[0] = 0
    return net


@dataclass
class Batch:
    """Distinct words with their trigrams, and windows of places in that list (-1: none)."""

    rows: np.ndarray
    grams: np.ndarray
    cuts: np.ndarray
    places: np.ndarray


def batch_of(net: Network, texts: list[list[bytes]], spans: list[tuple[int, int, int]], known: dict[bytes, bytes]) -> Batch:
    """Windows (text, first, last) of texts; ``known`` caches the packed trigrams of words."""
    index: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
    lengths = np.array([b - a for _, a, b in spans], np.int64)
    places = np.full((len(spans), WINDOW), -1, np.int64)
    numbers = map(index.__getitem__, chain.from_iterable(texts[t][a:b] for t, a, b in spans))
    places[np.arange(WINDOW) < lengths[:, None]] = np.fromiter(numbers, np.int64, int(lengths.sum()))
    found = list(map(known.get, index))
    for k, w in enumerate(index):
        if found[k] is None:
            found[k] = np.array(grams(w), np.int64).tobytes()
            if len(known) > 300_000:
                known.clear()
            known[w] = found[k]
    sizes = np.array([len(g) // 8 for g in found] or [0])
    rows = np.array([net.words.get(w, 0) for w in index], np.int64)
    return Batch(rows, np.frombuffer(b"".join(found), np.int64), np.cumsum(sizes) - sizes, places)


def inputs(net: Network, b: Batch) -> np.ndarray:
    """One input vector per distinct word, and a constant one."""
    if not len(b.rows):
        return np.zeros((1, INPUT + 1), Z)
    size = np.diff(np.append(b.cuts, len(b.grams)))[:, None]
    chars = np.add.reduceat(net.char[b.grams], b.cuts, axis=0) / np.sqrt(size).astype(Z)
    return np.concatenate([net.word[b.rows], chars, np.ones((len(b.rows), 1), Z)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(net: Network, b: Batch, keep: bool = False):
    """Logit of each window; with ``keep`` also what the gradients need."""
    x = inputs(net, b)
    n, real = len(b.places), b.places >= 0
    last = int(real.any(0).sum()) or 1
    states = np.zeros((last, n, 2 * HIDDEN), Z)
    kept = []
    for d in range(2):
        entry = x @ net.into[d]
        h = np.zeros((n, HIDDEN), Z)
        for t in range(last) if d == 0 else range(last - 1, -1, -1):
            g = entry[np.maximum(b.places[:, t], 0)]
            zr = h @ net.back[d][:, : 2 * HIDDEN]
            zr += g[:, : 2 * HIDDEN]
            zr = sigmoid(zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ net.back[d][:, 2 * HIDDEN :])
            on = real[:, t : t + 1]
            if keep:
                kept.append((d, t, h, z, r, new, on))
            after = h + z * (new - h)
            h = after if on.all() else np.where(on, after, h)
            states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
    u = np.tanh(states @ net.attend)
    s = u @ net.weigh
    s = np.where(real[:, :last].T, s, Z(-30))
    s = np.exp(s - s.max(0))
    s /= s.sum(0)
    pooled = (states * s[:, :, None]).sum(0)
    logit = pooled @ net.out[:-1] + net.out[-1]
    return (logit, (x, states, kept, u, s, pooled, real, last)) if keep else logit


def gradients(net: Network, b: Batch, goal: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted mean cross entropy, in the order of ``parameters``."""
    logit, (x, states, kept, u, s, pooled, real, last) = forward(net, b, keep=True)
    d_logit = ((sigmoid(logit) - goal) * weight / max(1e-6, weight.sum())).astype(Z)
    d_out = np.append(pooled.T @ d_logit, d_logit.sum()).astype(Z)
    d_pooled = d_logit[:, None] * net.out[:-1]
    d_states = s[:, :, None] * d_pooled
    d_s = (states * d_pooled).sum(2)
    d_s = s * (d_s - (d_s * s).sum(0))
    d_weigh = np.einsum("tna,tn->a", u, d_s)
    d_u = d_s[:, :, None] * net.weigh * (1 - u * u)
    d_attend = states.reshape(-1, 2 * HIDDEN).T @ d_u.reshape(-1, ATTEND)
    d_states = d_states + d_u @ net.attend.T
    d_into, d_back, d_x = np.zeros_like(net.into), np.zeros_like(net.back), np.zeros_like(x)
    d_entry = [np.zeros((len(x), 3 * HIDDEN), Z) for _ in range(2)]
    d_h, before = None, -1
    for d, t, h, z, r, new, on in reversed(kept):
        if d != before:
            d_h, before = np.zeros_like(h), d
        d_h = d_h + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
        g = d_h * on
        d_new = g * z * (1 - new * new)
        d_z = g * (new - h) * z * (1 - z)
        d_rh = d_new @ net.back[d][:, 2 * HIDDEN :].T
        d_r = d_rh * h * r * (1 - r)
        d_back[d][:, : 2 * HIDDEN] += h.T @ np.concatenate([d_z, d_r], axis=1)
        d_back[d][:, 2 * HIDDEN :] += (r * h).T @ d_new
        through = g * (1 - z) + d_rh * r + np.concatenate([d_z, d_r], axis=1) @ net.back[d][:, : 2 * HIDDEN].T
        d_h = np.where(on, through, d_h)
        scatter(d_entry[d], np.maximum(b.places[:, t], 0), np.concatenate([d_z, d_r, d_new], axis=1))
    for d in range(2):
        d_into[d] = x.T @ d_entry[d]
        d_x += d_entry[d] @ net.into[d].T
    d_word, d_char = np.zeros_like(net.word), np.zeros_like(net.char)
    if len(b.rows):
        scatter(d_word, b.rows, d_x[:, :WORD])
        d_word[0] = 0
        size = np.diff(np.append(b.cuts, len(b.grams)))
        scatter(d_char, b.grams, np.repeat(d_x[:, WORD:INPUT] / np.sqrt(size)[:, None], size, axis=0).astype(Z))
    return [d_word, d_char, d_into, d_back, d_attend, d_weigh, d_out]


def fit(texts: list[list[bytes]], toxic: list[int], threshold: float = 0.3, every: int = 5) -> Network:
    """Trains on all texts but every fifth of each kind, which then place the threshold.

    The network's logits are shifted so that ``threshold`` lies where it tells the texts that
    were kept back apart with the fewest faults, in the middle of the places that do.
    """
    before = np.cumsum(toxic) - np.array(toxic) if toxic else []
    order = [before[k] if t else k - before[k] for k, t in enumerate(toxic)]
    back = [k for k in range(len(texts)) if order[k] % every == every - 1]
    kept = set(back)
    net = train([t for k, t in enumerate(texts) if k not in kept], [t for k, t in enumerate(toxic) if k not in kept])
    marks = np.array([toxic[k] for k in back])
    if len(set(marks.tolist())) == 2:
        logit = np.log(scores(net, [texts[k] for k in back], {}).clip(1e-12, 1 - 1e-12))
        logit -= np.log1p(-np.exp(logit))
        edges = np.unique(logit)
        tried = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]])
        faults = np.array([((logit >= c) != (marks == 1)).sum() for c in tried])
        best = tried[faults == faults.min()]
        net.shift = float(np.log(threshold / (1 - threshold)) - (best[0] + best[-1]) / 2)
    return net


def train(texts: list[list[bytes]], toxic: list[int], rounds: int = 6, steps: int = 500, chunk: int = 192, rate: float = 0.01, seed: int = 5) -> Network:
    """Fits a network to texts and their marks.

    Marks belong to texts, not to windows: in the first round every window has its text's mark;
    from then on a marked text's highest windows have it (fewer round by round), and of an
    unmarked text its highest window and others drawn. Both kinds weigh the same in all.
    """
    rng = np.random.default_rng(seed)
    seen: dict[bytes, int] = {}
    for words in texts:
        for w in set(words):
            seen[w] = seen.get(w, 0) + 1
    listed = sorted((w for w, n in seen.items() if n >= 4), key=lambda w: (-seen[w], w))[:LISTED]
    net = start(listed, float(np.mean(toxic)) if toxic else 0.0)
    if not toxic or len(set(toxic)) < 2:
        net.words = {}
        return net
    net.words.setdefault(b"", 0)
    spans = [(t, a, b) for t, words in enumerate(texts) for a, b in windows(len(words))]
    owner = np.array([s[0] for s in spans])
    mark = np.array(toxic)[owner]
    adam, known = Adam(net.parameters(), rate, DECAY), {}
    rounds = max(rounds, -(-steps // (len(spans) // chunk + 1)))  # few texts are gone through more often
    steps_in_all = rounds * (len(spans) // chunk + 1)
    step = 0
    for k in range(rounds):
        use = np.arange(len(spans))
        if k:
            logit = np.concatenate(
                [forward(net, batch_of(net, texts, spans[a : a + 2048], known)) for a in range(0, len(spans), 2048)]
            )
            order = np.lexsort((-logit, owner))
            place = np.empty(len(spans), np.int64)
            first = np.searchsorted(owner, owner)  # spans are in the order of their texts
            place[order] = np.arange(len(spans)) - first[order]
            size = np.bincount(owner)[owner]
            take = np.where(mark == 1, place < np.maximum(1, size // 2 ** min(k, 4)), (place < 2) | (rng.random(len(spans)) < 0.25))
            use = np.flatnonzero(take)
        use = rng.permutation(use)
        share = mark[use].mean()
        for a in range(0, len(use), chunk):
            pick = use[a : a + chunk]
            goal = mark[pick].astype(Z)
            weight = np.where(goal == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(Z)
            step += 1
            adam.rate = rate * min(1, step / 20) * max(0.1, 1 - step / steps_in_all)
            batch = batch_of(net, texts, [spans[i] for i in pick], known)
            batch.rows[rng.random(len(batch.rows)) < FORGET] = 0
            adam.step(gradients(net, batch, goal, weight))
    return net


def scores(net: Network, texts: list[list[bytes]], known: dict[bytes, bytes], chunk: int = 2048) -> np.ndarray:
    """Between 0 and 1 for each text: the logistic of its highest window's logit.

    Next to 0 without words; the share of toxic texts where the network had nothing to learn.
    """
    best = np.full(len(texts), -np.inf)
    spans = [(t, a, b) for t, words in enumerate(texts) if words for a, b in windows(len(words))]
    for k in range(0, len(spans), chunk):
        part = spans[k : k + chunk]
        np.maximum.at(best, [s[0] for s in part], forward(net, batch_of(net, texts, part, known)))
    if not net.words:
        return np.full(len(texts), net.rate)
    return sigmoid(np.where(np.isfinite(best), best + net.shift, -30.0))
