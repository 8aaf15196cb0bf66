"""Token ids of whole texts with the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut where its pre-tokenizer cuts anyway, whatever the context; the pieces' ids in order are the text's ids.
"""

from __future__ import annotations

import os
import re

import numpy as np

from convorecall.llm.textkit import _RAW, _SPACE, _powers, mix

#: Pieces that a worker remembers; the memory is emptied beyond it.
REMEMBERED = 500_000
_LINE = 100_000
#: Lower-cased words that no normalizer changes and no pre-tokenizer of words parts.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_PROBE = ["a", "ab", "straße", "élève", "mañana", "informationstheorie", *"bcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"]


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Bytes of Unicode white space outside ASCII."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    for lead, second, thirds in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A, 0xA0), (0x80, 0x8E)), (0xE2, (0x80, 0x81), None), (0xE3, (0x80,), (0x80,))):
        hit = np.flatnonzero((data[:-1] == lead) & np.isin(data[1:], second))
        if thirds:
            hit = hit[hit + 2 < len(data)]
            hit = hit[np.isin(data[hit + 2], thirds)]
        for j in range(3 if lead != 0xC2 else 2):
            out[np.minimum(hit + j, len(data) - 1)] = True
    return out


class PieceEncoder:
    """Encodes slices of rows. kind "byte": byte-level vocabulary that keeps spaces; "word": white space only parts words."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = kind
        self.mark = "\n" if kind == "byte" else " \x01 "
        mark = self.tokenizer.encode(f"a{self.mark}a", add_special_tokens=False).ids
        self.mark_id = mark[1]
        if len(mark) != 3:
            raise ValueError("the tokenizer does not keep the mark apart")
        self.plain = self._plain_words(path) if kind == "word" else None
        self._forget()

    def _plain_words(self, path: str):
        """A tokenizer of the same model that is given plain words as bytes in its alphabet, and which ids end a word; none if the whole one differs on some."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tool = Tokenizer.from_file(path)
        suffix = getattr(tool.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        alphabet = {b: chr(256 + k) for k, b in enumerate(hidden) if b != 32}
        tool.normalizer, tool.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = tool.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.plain = tool, ends, alphabet
        flat, size = self._encode_plain(_PROBE)
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(_PROBE, add_special_tokens=False)]
        return self.plain if size is not None and size.tolist() == [len(x) for x in whole] and flat.tolist() == sum(whole, []) else None

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids of plain words one after another and each word's number of ids; nothing for it if the words are not told apart."""
        tool, ends, alphabet = self.plain
        line = " ".join(words).encode().decode("latin-1").translate(alphabet)
        ids = np.array(tool.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(ends[ids])
        return ids, np.diff(last, prepend=-1) if len(last) == len(words) and len(ids) == last[-1] + 1 else None

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = [np.zeros(0, np.uint16)]
        self.pooled = 0

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if self.kind == "word":
            solid = ~_SPACE[data]
            cut = np.ones(n + 1, bool)
            letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
            cut[1:n] = (solid[1:] != solid[:-1]) | (letter[:-1] & ((data[1:] == 44) | (data[1:] == 46)))
        else:
            safe = (data > 32) & (data != 127)
            safe &= ~_odd_space(data)
            around = np.zeros(n, bool)
            around[1:-1] = safe[:-2] & safe[2:]
            line = (data == 10) & around
            cut = np.zeros(n + 1, bool)
            cut[:n] = ((data == 32) | (data == 10)) & around
            cut[1:] |= line
            letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
            cut[1:n] |= letter[:-1] & ((data[1:] == 44) | (data[1:] == 46))
        cut[offsets] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if self.kind == "word":
            keep = solid[start] if n else np.zeros(0, bool)
            start, end = start[keep], end[keep]
        return start, end

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in any order, and where each piece's begin and how many they are."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)] if self.plain else []
        flat, begin, size, total = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32), 0
        for lo in range(0, len(plain), _LINE // 10):
            own = plain[lo : lo + _LINE // 10]
            ids, sizes = self._encode_plain([texts[i] for i in own])
            if sizes is None:
                raise ValueError("pieces ran together")
            size[own], begin[own] = sizes, total + np.cumsum(sizes) - sizes
            flat.append(ids)
            total += len(ids)
        known = set(plain)
        others = [i for i in range(len(texts)) if i not in known]
        if others:
            ids = self._encode_whole([texts[i] for i in others])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            size[others], begin[others] = sizes, total + np.cumsum(sizes) - sizes
            flat += ids
        return np.concatenate(flat), begin, size

    def _encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        mark = self.mark.strip(" ")
        alone = [i for i, t in enumerate(texts) if mark in t or (self.kind == "byte" and (t[0].isspace() and t[0] != " " or t[-1:].isspace()))]
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False) if alone else []):
            out[i] = np.array(e.ids, np.uint32)
        skip = set(alone)
        rest = [i for i in range(len(texts)) if i not in skip]
        lo = 0
        while lo < len(rest):
            hi, total = lo, 0
            while hi < len(rest) and total < _LINE:
                total += len(texts[rest[hi]]) + 1
                hi += 1
            line = self.mark.join(texts[i] for i in rest[lo:hi])
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            parts = np.flatnonzero(ids == self.mark_id)
            if len(parts) != hi - lo - 1:
                raise ValueError("pieces ran together")
            begin = 0
            for i, end in zip(rest[lo:hi], [*parts.tolist(), len(ids)]):
                out[i] = ids[begin:end]
                begin = end + 1
            lo = hi
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids of each row)."""
        rows = len(offsets) - 1
        start, end = self._cuts(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
        if self.kind == "word" and len(data):
            # capitals of ASCII, which the file's normalizer lowers, but not before what may combine with them
            capital = (data >= 65) & (data <= 90)
            capital[:-1] &= data[1:] < 128
            data = np.where(capital, data | np.uint8(32), data) if self.plain else data
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(rows, np.int64)
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RAW[data] * power[: len(data)], out=total[1:])
        key = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        own, first, piece = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(own) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = data.tobytes()
            flat, begin, size = self._encode([raw[start[i] : end[i]] for i in first[fresh].tolist()])
            self.pool.append(flat.astype(np.uint16))  # both vocabularies have fewer than 65,536 ids
            self.keys = np.insert(self.keys, at[fresh], own[fresh])
            self.at = np.insert(self.at, at[fresh], self.pooled + begin)
            self.pooled += len(flat)
            self.size = np.insert(self.size, at[fresh], size)
            at = np.searchsorted(self.keys, own)
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        size = self.size[at][piece].astype(np.int64)
        last = np.cumsum(size)
        where = np.repeat(self.at[at][piece] - (last - size), size) + np.arange(last[-1])
        bounds = np.concatenate([[0], last])[np.searchsorted(start, offsets)]
        return self.pool[0][where], np.diff(bounds)


_LOADED: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    if (path, kind) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, kind] = PieceEncoder(path, kind)
    return _LOADED[path, kind]
