"""A small gated recurrent language model in numpy, and log-likelihoods of whole documents under it.

Words outside the model's vocabulary are one symbol to the network; which of them it is, a smoothed count of all
training tokens says. The output softmax is factored: first a class, then a word within the class. Training is
backpropagation through time, truncated to windows, with the state carried from window to window; so is scoring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASSES = 32
WORDS = 32  # of a class
UNKNOWN, END = 0, 1  # symbols, each a class of its own; then come the words
FIRST = 2
WIDTH = 16
STEPS = 32


def class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < FIRST, symbols, FIRST + (symbols - FIRST) // WORDS)


@dataclass
class GatedLM:
    vocabulary: np.ndarray  # sorted word hashes
    symbol: np.ndarray  # of each
    table: np.ndarray  # symbol to input of the three gates
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    ww: np.ndarray
    bw: np.ndarray

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.symbol[at], UNKNOWN).astype(np.int32)

    def _step(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        g, k = self.table[s], h @ self.u
        zr = 1 / (1 + np.exp(-(g[:, : 2 * WIDTH] + k[:, : 2 * WIDTH])))
        n = np.tanh(g[:, 2 * WIDTH :] + zr[:, WIDTH:] * k[:, 2 * WIDTH :])
        return n + zr[:, :WIDTH] * (h - n)

    def _log(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol after each state."""
        c = class_of(s)
        z = h @ self.wc + self.bc
        out = z[np.arange(len(s)), c] - np.log(np.exp(z).sum(1))
        order = np.argsort(c, kind="stable")
        bounds = np.searchsorted(c[order], np.arange(FIRST, FIRST + CLASSES + 1))
        for k in range(CLASSES):
            at = order[bounds[k] : bounds[k + 1]]
            if len(at):
                z = h[at] @ self.ww[k] + self.bw[k]
                out[at] += z[np.arange(len(at)), (s[at] - FIRST) % WORDS] - np.log(np.exp(z).sum(1))
        return out

    def score(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each document's symbols and the end after them."""
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order] + 1
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        flat = np.append(symbols, END)
        out = np.zeros(len(lengths))
        h = np.zeros((len(lengths), WIDTH), np.float32)
        t, top = 0, int(size.max(initial=0))
        while t < top:
            states, asked, who = [], [], []
            held = 0
            while t < top and held < 20000:  # a window: states are kept, then scored together
                live = int(np.searchsorted(-size, -t, "left"))  # documents with a symbol t
                at = first[:live] + t
                s = np.where(size[:live] == t + 1, END, flat[np.minimum(at, len(symbols))])
                h = h[:live]
                states.append(h)
                asked.append(s)
                who.append(live)
                h = self._step(h, s)
                held += live
                t += 1
            p = self._log(np.concatenate(states), np.concatenate(asked))
            doc = np.concatenate([np.arange(n) for n in who])
            out[: who[0]] += np.bincount(doc, p, who[0])
        back = np.empty_like(out)
        back[order] = out
        return back


PARAMETERS = ("table", "u", "wc", "bc", "ww", "bw")


def fresh(vocabulary: np.ndarray, symbol: np.ndarray, seed: int = 1) -> GatedLM:
    """An untrained model of a vocabulary: sorted word hashes, and the symbol of each."""
    rng = np.random.default_rng(seed)
    f, n = np.float32, FIRST + CLASSES * WORDS
    return GatedLM(
        vocabulary,
        symbol,
        table=rng.normal(0, 0.1, (n, 3 * WIDTH)).astype(f),
        u=rng.normal(0, 0.25, (WIDTH, 3 * WIDTH)).astype(f),
        wc=rng.normal(0, 0.1, (WIDTH, FIRST + CLASSES)).astype(f),
        bc=np.zeros(FIRST + CLASSES, f),
        ww=rng.normal(0, 0.1, (CLASSES, WIDTH, WORDS)).astype(f),
        bw=np.zeros((CLASSES, WORDS), f),
    )


def vocabulary_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their symbols) of the most frequent words; the more frequent have the smaller symbols."""
    top = np.lexsort((words, -counts))[: CLASSES * WORDS]
    own = np.argsort(words[top])
    return words[top][own], (own + FIRST).astype(np.int32)


class Trainer:
    """Backpropagation through windows of STEPS symbols over parallel streams, with Adam's step sizes."""

    def __init__(self, model: GatedLM, rate: float = 0.01):
        self.model, self.rate, self.tick = model, rate, 0
        self.par = {k: getattr(model, k) for k in PARAMETERS}
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in self.par.items()} for _ in range(2))

    def learn(self, row: np.ndarray, streams: int) -> None:
        """One pass over symbols, dealt to streams that are followed side by side."""
        streams = max(1, min(streams, len(row) // 2))
        width = len(row) // streams
        grid = row[: width * streams].reshape(streams, width)
        h = np.zeros((streams, WIDTH), np.float32)
        for begin in range(0, width, STEPS):
            h = self._window(grid[:, begin : begin + STEPS], h)
        if len(row) > width * streams:  # what is left over is a stream of its own
            self._window(row[None, width * streams :], np.zeros((1, WIDTH), np.float32))

    def _window(self, window: np.ndarray, h: np.ndarray) -> np.ndarray:
        par, streams, steps = self.par, *window.shape
        kept = []
        for t in range(steps):
            s = window[:, t]
            g, k = par["table"][s], h @ par["u"]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * WIDTH] + k[:, : 2 * WIDTH])))
            z, r = zr[:, :WIDTH], zr[:, WIDTH:]
            c = np.tanh(g[:, 2 * WIDTH :] + r * k[:, 2 * WIDTH :])
            kept.append((h, s, z, r, c, k[:, 2 * WIDTH :]))
            h = (c + z * (h - c)) * (s != END)[:, None]  # a document starts from nothing
        grad = {k: np.zeros_like(v) for k, v in par.items()}
        hs, ss = np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])
        cls = class_of(ss)
        p = np.exp(hs @ par["wc"] + par["bc"])
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(ss)), cls] -= 1
        grad["wc"], grad["bc"] = hs.T @ p, p.sum(0)
        dh = p @ par["wc"].T
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(FIRST, FIRST + CLASSES + 1))
        for j in range(CLASSES):
            at = order[bounds[j] : bounds[j + 1]]
            if not len(at):
                continue
            own = hs[at]
            q = np.exp(own @ par["ww"][j] + par["bw"][j])
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(at)), (ss[at] - FIRST) % WORDS] -= 1
            grad["ww"][j], grad["bw"][j] = own.T @ q, q.sum(0)
            dh[at] += q @ par["ww"][j].T
        dh = dh.reshape(steps, streams, WIDTH)
        later, gates = np.zeros((streams, WIDTH), np.float32), [None] * steps
        for t in range(steps - 1, -1, -1):
            before, s, z, r, c, kn = kept[t]
            d = later * (s != END)[:, None]
            dc = d * (1 - z) * (1 - c * c)
            gates[t] = np.concatenate([d * (before - c) * z * (1 - z), dc * kn * r * (1 - r), dc], 1)
            back = gates[t].copy()
            back[:, 2 * WIDTH :] *= r
            grad["u"] += before.T @ back
            later = d * z + back @ par["u"].T + dh[t]
        order = np.argsort(ss, kind="stable")
        first = np.flatnonzero(np.diff(ss[order], prepend=-1))
        grad["table"][ss[order][first]] = np.add.reduceat(np.concatenate(gates)[order], first)
        self.tick += 1
        for name, v in par.items():
            g = np.clip(grad[name] / streams, -5, 5)
            m1, m2 = self.m1[name], self.m2[name]
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            v -= self.rate * (m1 / (1 - 0.9**self.tick)) / (np.sqrt(m2 / (1 - 0.999**self.tick)) + 1e-8)
        return h


def symbols_of(model: GatedLM, documents: list[np.ndarray]) -> np.ndarray:
    """Symbols of documents given as arrays of word hashes, each with its end, one after another."""
    return np.concatenate([np.zeros(0, np.int32), *(np.append(model.symbols(d), np.int32(END)) for d in documents)])


def warmed(model: GatedLM, documents: list[np.ndarray], updates: int = 400, streams: int = 16) -> GatedLM:
    """Train on a few documents, in as many whole passes as give that many updates; every task goes on from here."""
    row = symbols_of(model, documents)
    share = np.bincount(class_of(row), minlength=FIRST + CLASSES) + 0.5
    model.bc[:] = np.log(share / share.sum())
    trainer = Trainer(model)
    while len(row) > 1 and trainer.tick < updates:
        trainer.learn(row, streams)
    return model
