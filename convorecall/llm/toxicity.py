"""Toxicity by compression distance: two zstandard dictionaries, and the bytes either saves on short windows.

Both dictionaries come from zstandard's trainer. Each learns from the labelled texts of one kind, near copies left out, of
which it is given the words that tell the kinds apart (words and word beginnings that one kind has far more often) and
the words most common in both: whole texts of both kinds agree in nearly all that a dictionary can hold. Words are coded
so that a match can only begin where a word begins. A text is cut into windows of whole words; the difference of a window's
compressed lengths under the two dictionaries is its evidence. A logistic curve, fitted to labelled documents that the
dictionaries have not seen, turns the evidence of all windows into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convorecall.llm.scratch import drawn, texts_of
from convorecall.llm.textkit import map_texts, string_column

#: Labelled documents of either kind that training takes at most, in the order of a hash of their ids.
SAMPLE = 1500
WINDOW = 32
STEP = 3  # bytes of difference that count as one
SPAN = (-8, 16)  # steps; differences beyond count as these
LEAST = 15  # deviations by which a mark is more frequent than in the other kind of text
MARKED = 16_384  # coded bytes of marks of one kind that are told apart, the strongest first
COMMON = 10  # words most common in both kinds of text
DICTIONARY = 8192  # bytes of a dictionary
SEGMENT, MATCH = 32, 8  # bytes of the trainer's segments and of the matches it counts
THRESHOLD = 0.3
_CUT = re.compile(r"[.,;:!?\"()\[\]]+")


def _code(word: str) -> bytes:
    """Two bytes for each beginning of the word, the last with its end: two words agree in as many as they begin alike."""
    h, out = 0, bytearray()
    for c in word + " ":
        h = zlib.crc32(c.encode("utf-8", "replace"), h)
        out += (h & 0xFFFF).to_bytes(2, "little")
    return bytes(out)


def _windows(text: str, codes: dict[str, bytes]) -> Iterator[bytes]:
    """Coded windows of the text; ``codes`` keeps the codes of short words."""
    part: list[bytes] = []
    size = 0
    for word in _CUT.sub(" ", text.lower()).split():
        code = codes.get(word)
        if code is None:
            code = _code(word)
            if len(codes) < 50_000 and len(word) < 40:
                codes[word] = code
        part.append(code)
        size += len(word) + 1
        if size >= WINDOW:
            yield b"".join(part)
            part, size = [], 0
    if part:
        yield b"".join(part)


def _apart(texts: list[str]) -> list[list[str]]:
    """Words of the texts, without those of which half the five-word shingles came before."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = _CUT.sub(" ", text.lower()).split()
        own = {hash(tuple(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        if 2 * len(own & seen) < len(own):
            out.append(words)
        seen |= own
    return out


def _stems(words: list[str]) -> list[str]:
    """Distinct words, each with its end, and their beginnings of four to seven letters."""
    own = set(words)
    return sorted({w + " " for w in own} | {w[:n] for w in own for n in (4, 5, 6, 7) if len(w) >= n})


def _marks(a: Counter, n: int, b: Counter, m: int) -> list[str]:
    """Words and beginnings much more frequent among the n texts counted in a than among the m in b; none begins with another."""
    scored = []
    for word, c in a.items():
        p, q = c / n, (b[word] + 0.5) / (m + 1)
        if c >= 4 and p > q and len(word) >= 4:
            scored.append(((p - q) / np.sqrt(q * (1 - q) / n + 1e-9), -len(word), word))
    scored.sort(reverse=True)
    kept: dict[str, None] = {}
    size = 0
    for z, _, word in scored:
        size += 2 * len(word)
        if z <= LEAST or size > MARKED:
            break
        if any(word[:i] in kept for i in range(4, len(word))):
            size -= 2 * len(word)
        else:
            kept[word] = None
    return list(kept)


def _dictionary(texts: list[list[str]], marks: set[str], common: set[str]) -> bytes:
    """zstandard's dictionary of the marked and the common words of the texts; of too few of them, the words themselves."""

    def told(word: str) -> bool:
        whole = word + " "
        return whole in common or any(whole[:i] in marks for i in range(4, len(whole) + 1))

    samples = [x for words in texts if (x := b"".join(_code(w) for w in words if told(w)))]
    try:
        return zstandard.train_dictionary(DICTIONARY, sorted(samples), k=SEGMENT, d=MATCH, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:].rjust(16, b"\n")


class Model:
    """Dictionaries and curve; it is sent to the workers as plain bytes and numbers."""

    def __init__(self, dictionaries: tuple[bytes, bytes], weights: np.ndarray):
        self.dictionaries, self.weights = dictionaries, weights
        self.ratios = np.zeros(SPAN[1] - SPAN[0] + 1)
        self._pair: list | None = None
        self._codes: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"_pair": None, "_codes": {}}

    def differences(self, text: str) -> np.ndarray:
        """Of each window: bytes under the ordinary dictionary less bytes under the toxic one, from 0 for the least."""
        if self._pair is None:
            how = zstandard.ZstdCompressionParameters(compression_level=1, strategy=zstandard.STRATEGY_LAZY2, min_match=6, window_log=17, hash_log=14, chain_log=14, search_log=5, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._pair = []
            for raw in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
                d.precompute_compress(compression_params=how)
                self._pair.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)
        toxic, ordinary = self._pair
        d = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in _windows(text, self._codes)), np.int64)
        return np.clip(np.rint(d / STEP).astype(np.int64), *SPAN) - SPAN[0]

    def evidence(self, text: str) -> np.ndarray:
        """Log-likelihood ratios of the windows' differences: sum, mean and sum of the three largest."""
        ratio = self.ratios[self.differences(text)]
        if not len(ratio):
            return np.zeros(3)
        return np.array([ratio.sum() / 10, ratio.mean() * 10, np.sort(ratio)[-3:].sum() / 5])

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        z = evidence @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), 0.1)
        ridge[-1] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[str], ordinary: list[str], prior: float | None = None) -> Model:
    """Fit to texts of either kind: two thirds make the dictionaries, the rest the curve.

    ``prior`` is the share of toxic documents; it moves the curve if the lists are not in that proportion.
    """
    texts = [_apart([t for i, t in enumerate(kind) if i % 3]) for kind in (toxic, ordinary)]
    (a, n), (b, m) = [(Counter(w for t in kept for w in _stems(t)), max(len(kept), 1)) for kept in texts]
    marks = [set(_marks(a, n, b, m)), set(_marks(b, m, a, n))]
    often = sorted((-c, w) for w, c in (a + b).items() if w.endswith(" ") and not any(w[:i] in marks[0] | marks[1] for i in range(4, len(w) + 1)))
    common = {w for _, w in often[:COMMON]}
    model = Model(tuple(_dictionary(kept, own, common) for kept, own in zip(texts, marks)), np.zeros(4))
    fit = [(t, 1) for t in toxic[::3]] + [(t, 0) for t in ordinary[::3]]
    if not fit:
        return model
    seen = np.ones((2, len(model.ratios)))
    for text, k in fit:
        seen[k] += np.bincount(model.differences(text), minlength=len(model.ratios))
    seen /= seen.sum(1, keepdims=True)
    model.ratios = np.log(seen[1] / seen[0])
    x, y = np.array([model.evidence(t) for t, _ in fit]), np.array([k for _, k in fit], float)
    model.weights = _curve(x, y)
    if prior and 0 < y.mean() < 1:
        model.weights[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` toxic and twice as many ordinary documents; a doc_id labelled both ways is toxic.

    Without labelled texts, all scores are 0.5.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = drawn(marked.where("toxic = 1"), sample, 11).unionByName(drawn(marked.where("toxic = 0"), 2 * sample, 11))
    rows = texts_of(docs, picked).select("text", "toxic").limit(6 * sample).collect()  # at most 3 * sample rows, if ids are unique
    share = marked.agg(F.avg("toxic")).first()[0]
    kinds = [[r.text for r in rows if r.toxic == k] for k in (1, 0)]
    return train(*kinds, prior=share if share and share < 1 else None)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "_text")
            x = np.array([model.evidence(t.as_py() or "") for t in texts]).reshape(-1, 3)
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of each row's whole text; null and empty texts have no windows, and the curve's base score.

    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    return map_texts(docs.select("doc_id", F.col("text").alias("_text")), _score(model), "doc_id long, score double, predicted int")
