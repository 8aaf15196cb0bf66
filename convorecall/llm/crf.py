"""A linear-chain conditional random field over word shapes, in numpy.

Tokens are runs of letters, runs of digits and single other signs. A token's features are small codes of its own shape and
those of its neighbours, of the written word it is in and of the chain of digit groups around it; each code of each
template has a weight for every label, and each pair of labels one more. Trained by gradient steps on the exact
log-likelihood (forward and backward sums over padded batches), decoded by Viterbi over batches of segments.
"""

from __future__ import annotations

import re

import numpy as np

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
SIGNS = "@.-_+()[]{}/:,;#*%&=<>|!?\"'"
#: Words that are shapes of their own: how an address is spelled out, ends of hosts, what is said before a number.
CUES = {w: k for k, words in enumerate((("at",), ("dot", "punkt", "point", "punto"), ("com", "org", "net", "de", "fr", "es", "io", "edu"), ("tel", "phone", "call", "fax", "mobile", "telefon"), ("card", "visa", "mastercard", "karte", "tarjeta", "carte"), ("ip", "host", "server", "address"))) for w in words}
_DIGIT, _LETTER, _CUE = 1, 20, 60
_SIGN = _CUE + 8
_OPENING, _CLOSING = ([_SIGN + SIGNS.index(c) for c in signs] for signs in ("([{", ")]}"))
SHAPES = 100
#: Shapes told apart in longer patterns only by sort.
_COARSE = np.zeros(SHAPES, np.int64)
_COARSE[_DIGIT:_LETTER] = np.minimum(np.arange(_LETTER - _DIGIT), 4) + 1
_COARSE[_LETTER:_CUE] = 6
_COARSE[_CUE:_SIGN] = np.arange(8) + 7
_COARSE[_SIGN:] = [15, 16, 17, 17, 18, 19, 20, 19, 20, 19, 20, *[21] * (SHAPES - _SIGN - 11)]
SLOTS = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
NEAR = 3  # tokens on either side that features look at
ROUNDS, RATE, RIDGE = 40, 0.2, 2e-3


def _shape(token: str) -> int:
    c = token[0]
    n = len(token)
    if "0" <= c <= "9":
        return _DIGIT + (n - 1 if n < 3 else 2 + (int(token) > 255) if n == 3 else n if n < 12 else 12 if n < 20 else 13)
    if c.isalpha():
        cue = CUES.get(token.lower()) if n < 11 else None
        if cue is not None:
            return _CUE + cue
        case = 0 if token.islower() else 1 if c.isupper() and (n == 1 or token[1:].islower()) else 2 if token.isupper() else 3
        return _LETTER + 5 * case + (n - 1 if n < 4 else 3 if n < 7 else 4)
    at = SIGNS.find(c)
    return _SIGN + at if at >= 0 else SHAPES - 1


class Tokens:
    """Tokens of one text: bounds, shapes, and codes of the words and digit chains they are in."""

    def __init__(self, text: str):
        known: dict[str, int] = {}
        starts, ends, shapes = [], [], []
        for m in TOKEN.finditer(text):
            token = m[0]
            shape = known.get(token)
            if shape is None:
                shape = _shape(token)
                if len(token) < 20:
                    known[token] = shape
            starts.append(m.start())
            ends.append(m.end())
            shapes.append(shape)
        self.start, self.end, self.shape = (np.array(x, np.int64) for x in (starts, ends, shapes))

    def cues(self) -> np.ndarray:
        """Places of tokens that may belong to personal data: digits, ``@``, ``dot`` and ``at`` in brackets."""
        s = self.shape
        out = (s < _LETTER) | (s == _SIGN) | (s == _CUE + 1)
        out[1:-1] |= (s[1:-1] == _CUE) & np.isin(s[:-2], _OPENING) & np.isin(s[2:], _CLOSING)
        return np.flatnonzero(out)

    def segments(self, reach: int) -> list[tuple[int, int]]:
        """Ranges of tokens that are at most ``reach`` from a cue."""
        at = self.cues()
        if not len(at):
            return []
        lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(self.shape))
        fresh = np.ones(len(at), bool)
        fresh[1:] = lo[1:] > hi[:-1]
        first = np.flatnonzero(fresh)
        return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(at)) - 1].tolist()))

    def codes(self, lo: int, hi: int) -> np.ndarray:
        """Feature slots [token, template] of the tokens lo to hi; neighbours outside are seen too."""
        n = len(self.shape)
        a, b = max(lo - 64, 0), min(hi + 64, n)  # words and chains are looked at this far
        s = self.shape[a:b]
        gap = np.ones(b - a + 1, np.int64)
        gap[1:-1] = np.minimum(self.start[a + 1 : b] - self.end[a : b - 1], 2)
        digit, letter = s < _LETTER, (s >= _LETTER) & (s < _SIGN)
        size = np.where(digit, self.end[a:b] - self.start[a:b], 0)
        word = np.cumsum(gap[:-1] > 0) - 1
        joins = digit | np.isin(s, [_SIGN + SIGNS.index(c) for c in ".-+()/"])
        chain = np.cumsum(~joins | np.append(True, ~joins[:-1]) | (gap[:-1] > 1))
        chain -= chain[0]

        def total(groups: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.bincount(groups, x)[groups].astype(np.int64)

        dots = np.minimum(total(word, s == _SIGN + 1), 3)
        words = dots * 8 + (total(word, s == _SIGN) > 0) * 4 + (total(word, letter) > 0) * 2 + (total(word, digit) > 0)
        chained = np.minimum(total(chain, size), 20) * 8 + np.minimum(total(chain, digit), 7)
        begins = np.append(True, chain[1:] != chain[:-1])
        opening = total(chain, begins * (1 * (s == _SIGN + 4) + 2 * (s == _SIGN + 5)))
        coarse = _COARSE[s]

        def at(x: np.ndarray, k: int) -> np.ndarray:
            i = np.arange(lo - a, hi - a) + k
            return np.where((i >= 0) & (i < len(x)), x[np.clip(i, 0, len(x) - 1)], 99)

        def space(k: int) -> np.ndarray:
            i = np.arange(lo - a, hi - a) + k
            return gap[np.clip(i, 0, len(gap) - 1)]

        one, here = [at(s, k) for k in range(-NEAR, NEAR + 1)], NEAR
        few = [at(coarse, k) for k in range(-NEAR, NEAR + 1)]
        rows = [one[k] * 3 + space(k - here + (k <= here)) for k in range(2 * NEAR + 1)]
        rows += [(one[here - 1] * 100 + one[here]) * 3 + space(0), (one[here] * 100 + one[here + 1]) * 3 + space(1), one[here - 1] * 100 + one[here + 1]]
        rows += [((few[k] * 32 + few[k + 1]) * 32 + few[k + 2]) * 9 + space(k - 2) * 3 + space(k - 1) for k in (here - 2, here - 1, here)]
        rows += [at(words, 0) * 32 + few[here], at(words, -1) * 32 + at(words, 1)]
        rows += [(at(chained, 0) * 3 + at(opening, 0)) * 4 + at(begins, 0) * 2 + at(digit, 0), at(chained, 0) * 100 + one[here]]
        out = np.empty((hi - lo, len(rows)), np.int32)
        for t, codes in enumerate(rows):
            h = (codes.astype(np.uint64) + np.uint64(t + 1) * np.uint64(1_000_003)) * _MIX
            out[:, t] = t * SLOTS + (h >> np.uint64(52)).astype(np.int32)
        return out


TEMPLATES = 2 * NEAR + 1 + 3 + 3 + 2 + 2
#: Labels that may follow each other: inside only after begin or inside of its kind.
_FORBIDDEN = np.array([[to and to % 2 == 0 and was not in (to, to - 1) for to in range(LABELS)] for was in range(LABELS)])
_STARTS = np.array([bool(to and to % 2 == 0) for to in range(LABELS)])
_NEVER = -1e4


def _padded(parts: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts)), *parts[0].shape[1:]), fill, parts[0].dtype)
    for k, part in enumerate(parts):
        out[k, : len(part)] = part
    return out


class Field:
    """Weights of feature slots and of pairs of labels."""

    def __init__(self):
        self.unary = np.zeros((TEMPLATES * SLOTS, LABELS), np.float32)
        self.pairs = np.where(_FORBIDDEN, _NEVER, 0.0)

    def _scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), LABELS))
        for t in range(TEMPLATES):
            out += self.unary[codes[:, t]]
        return out

    def decode(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each segment's codes: Viterbi over segments of similar length at once."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and len(parts[order[hi]]) <= 1.5 * len(parts[order[lo]]):
                hi += 1
            group = order[lo:hi]
            scores = _padded([self._scores(parts[k]) for k in group], 0)
            lengths = np.array([len(parts[k]) for k in group])
            for k, labels, n in zip(group, self._viterbi(scores, lengths), lengths):
                found[k] = labels[:n]
            lo = hi
        return found

    def _viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        size, steps, _ = scores.shape
        best = scores[:, 0] + np.where(_STARTS, _NEVER, 0)
        back = np.zeros((steps, size, LABELS), np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + self.pairs
            back[t] = through.argmax(1)
            now = through.max(1) + scores[:, t]
            live = (t < lengths)[:, None]
            back[t] = np.where(live, back[t], np.arange(LABELS))
            best = np.where(live, now, best)
        out = np.zeros((size, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(size), out[:, t]]
        return out

    def train(self, parts: list[np.ndarray], labels: list[np.ndarray]) -> Field:
        """Fit to labelled sequences by adaptive gradient steps on their mean log-likelihood, with a small ridge."""
        if not parts:
            return self
        used, flat = np.unique(np.concatenate(parts), return_inverse=True)
        flat = flat.reshape(-1, TEMPLATES)
        ends = np.cumsum([len(x) for x in parts])
        order = np.argsort([len(x) for x in parts], kind="stable")
        groups = []  # of similar length
        for own in np.array_split(order, max(1, len(order) // 150)):
            lengths = np.array([len(parts[k]) for k in own])
            mask = np.arange(lengths.max()) < lengths[:, None]
            rows = np.concatenate([np.arange(ends[k] - len(parts[k]), ends[k]) for k in own])
            groups.append((mask, rows))
        truth = np.eye(LABELS)[np.concatenate(labels)]
        seen = np.zeros((LABELS, LABELS))
        for x in labels:
            np.add.at(seen, (x[:-1], x[1:]), 1)
        unary, pairs = np.zeros((len(used), LABELS)), np.zeros((LABELS, LABELS))
        squares = [np.full_like(unary, 1e-8), np.full_like(pairs, 1e-8)]
        for _ in range(ROUNDS):
            scores = sum(unary[flat[:, t]] for t in range(TEMPLATES))
            likely = np.exp(scores - scores.max(1, keepdims=True))
            moves = np.where(_FORBIDDEN, 0, np.exp(pairs))
            off, expected = truth.copy(), np.zeros_like(pairs)
            for mask, rows in groups:
                own = np.ones((*mask.shape, LABELS))
                own[mask] = likely[rows]
                marginal, both = _expected(own, moves, mask)
                off[rows] -= marginal[mask]
                expected += both
            slope = np.stack([np.bincount(flat.ravel(), np.repeat(off[:, k], TEMPLATES), len(used)) for k in range(LABELS)], 1)
            for x, g, square in ((unary, slope / len(parts) - RIDGE * unary, squares[0]), (pairs, np.where(_FORBIDDEN, 0, seen - expected) / len(parts) - RIDGE * pairs, squares[1])):
                square += g * g
                x += RATE * g / np.sqrt(square)
        self.unary[used] = unary
        self.pairs = np.where(_FORBIDDEN, _NEVER, pairs)
        return self


def _expected(own: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label at each place [sequence, place, label], and expected numbers of pairs: forward and backward sums, scaled at each place."""
    size, steps, _ = own.shape
    ahead, behind, scale = np.empty_like(own), np.ones_like(own), np.ones((size, steps, 1))
    ahead[:, 0] = own[:, 0] * ~_STARTS
    for t in range(steps):
        if t:
            ahead[:, t] = np.where(mask[:, t, None], (ahead[:, t - 1] @ moves) * own[:, t], ahead[:, t - 1])
        scale[:, t] = ahead[:, t].sum(1, keepdims=True)
        ahead[:, t] /= scale[:, t]
    both = np.zeros_like(moves)
    for t in range(steps - 2, -1, -1):
        live = mask[:, t + 1, None]
        onward = own[:, t + 1] * behind[:, t + 1] / scale[:, t + 1]
        behind[:, t] = np.where(live, onward @ moves.T, 1)
        both += (ahead[:, t] * live).T @ onward
    return ahead * behind, both * moves


def spans(labels: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the labelled runs."""
    out = []
    for k, label in enumerate(labels.tolist()):
        if label % 2:
            out.append([int(start[k]), KINDS[label // 2], int(end[k])])
        elif label:
            out[-1][2] = int(end[k])
    return [tuple(x) for x in out]
