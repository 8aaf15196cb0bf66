"""Scores of a block of queries and a slice of memories as products of matrices, and what of them a task has to keep."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa

#: Frequent terms that are multiplied as a full matrix, and the share of a block's queries from which a term is frequent.
DENSE, FREQUENT = 1024, 0.05
#: Pairs of a memory's term and a query that has it, of terms that are not frequent, which a task holds at once.
ENTRIES = 1_000_000
#: Scores of like rows may differ by this, as sums are not always taken in one order.
TIES = 1e-12
#: Steps of keyword scores at which a task knows its k-th best vector score.
LEVELS = 16


class Asked:
    """The known terms of a block of queries: a full matrix for the frequent ones, and lists of queries for the others."""

    def __init__(self, queries: pa.Table, terms: pa.Table):
        self.ids = queries.combine_chunks().sort_by("query_id").column("query_id").combine_chunks()
        self.n = len(self.ids)
        terms = terms.combine_chunks()
        query = self.places(terms.column("query_id"))
        self.terms, at = np.unique(terms.column("id").to_numpy(), return_inverse=True)
        times = terms.column("qtf").to_numpy().astype(float)
        self.held = np.bincount(at, minlength=len(self.terms))
        often = np.argsort(-self.held, kind="stable")[:DENSE]
        often = often[self.held[often] > FREQUENT * self.n]
        self.dense = np.full(len(self.terms), -1, np.int64)
        self.dense[often] = np.arange(len(often))
        self.width, self.matrix, self.ones = len(often), None, None
        order = np.argsort(at, kind="stable")
        self.queries, self.times = query[order], times[order]
        self.starts = np.cumsum(self.held) - self.held

    def places(self, ids: pa.ChunkedArray) -> np.ndarray:
        place = pa.table({"query_id": self.ids, "place": pa.array(np.arange(self.n))})
        rows = pa.table({"query_id": ids, "row": pa.array(np.arange(len(ids)))})
        return rows.join(place, "query_id").sort_by("row").column("place").to_numpy()

    def table(self) -> pa.Table:
        """``query_id, id, qtf`` of the block."""
        return pa.table({"query_id": self.ids.take(pa.array(self.queries)), "id": np.repeat(self.terms, self.held), "qtf": self.times})

    def scores(self, terms: pa.ListArray, impacts: pa.ListArray, summed=None) -> tuple[np.ndarray, np.ndarray]:
        """[memory, query]: sums of the impacts of shared terms, by ``summed``, and whether any is shared."""
        lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        term, impact = terms.flatten().to_numpy(), impacts.flatten().to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        if not len(self.terms):
            return np.zeros((len(lengths), self.n)), np.zeros((len(lengths), self.n), bool)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        row, at, impact = row[known], at[known], impact[known]
        out = (summed or self._summed)(len(lengths), row, at, impact)
        if len(impact) and (impact.min() <= 0 or self.times.min() <= 0):
            return out, self._once(len(lengths), row, at, np.ones(len(impact))) > 0
        return out, out > 0

    def counted(self, terms: pa.ListArray, numbers: pa.ListArray) -> np.ndarray:
        """[row, query]: sums of the numbers of shared terms, each term of a query once."""
        return self.scores(terms, numbers, self._once)[0]

    def _once(self, *rows) -> np.ndarray:
        times, matrix = self.times, self.matrix
        self.times, self.matrix = np.ones(len(times)), self.ones
        out = self._summed(*rows)
        self.ones = self.matrix
        self.times, self.matrix = times, matrix
        return out

    def _summed(self, n: int, row: np.ndarray, at: np.ndarray, impact: np.ndarray) -> np.ndarray:
        column, width = self.dense[at], self.width
        full = column >= 0
        if self.matrix is None:  # made in the task
            term = np.repeat(self.dense, self.held)
            self.matrix = np.zeros((width, self.n))
            self.matrix[term[term >= 0], self.queries[term >= 0]] = self.times[term >= 0]
        own = np.bincount(row[full] * width + column[full], impact[full], n * width).reshape(n, width) if width else np.zeros((n, 0))
        out = own @ self.matrix
        row, at, impact = row[~full], at[~full], impact[~full]
        many = self.held[at]
        ends = np.cumsum(many)
        lo = 0
        while lo < len(many) and ends[-1] > 0:  # rows ascend, so a part of the entries is a few rows
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + ENTRIES)))
            part, begin, end = many[lo:hi], row[lo], row[hi - 1] + 1
            entry = np.repeat(self.starts[at[lo:hi]] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            place = np.repeat(row[lo:hi] - begin, part) * self.n + self.queries[entry]
            out[begin:end] += np.bincount(place, np.repeat(impact[lo:hi], part) * self.times[entry], (end - begin) * self.n).reshape(end - begin, self.n)
            lo = hi
        return out


def first(rows: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of each query ``q``, by ``v``, in which less than ``TIES`` counts as equal, and ``key``."""
    rows = rows[np.lexsort((rows["v"], rows["q"]))]
    if len(rows):
        new = (np.diff(rows["q"], prepend=rows["q"][0]) != 0) | (np.diff(rows["v"], prepend=rows["v"][0]) > TIES)
        rows = rows[np.lexsort((rows["key"], np.cumsum(new)))]
    rows = rows.view(np.recarray)
    start = np.searchsorted(rows.q, rows.q)
    return rows[np.arange(len(rows)) - start < k]


def band(words: np.ndarray, vectors: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among the best k of one query under some weights that are not negative; ties go by key."""
    best: list[float] = []  # the k best vector scores so far, ascending
    kept, alike, last = [], 0, None
    order = np.lexsort((keys, -vectors, -words))
    for i, w, v in zip(order.tolist(), words[order].tolist(), vectors[order].tolist()):
        alike = alike + 1 if (w, v) == last else 0
        last = (w, v)
        if alike < k and (len(best) < k or v >= best[0]):
            kept.append(i)
        if len(best) < k or v > best[0]:
            insort(best, v)
            del best[:-k]
    # by words alone, ties go by key
    return np.union1d(kept, np.lexsort((keys, -words))[:k]).astype(np.int64)


class Band:
    """A task's rows that may be among the best k of its queries, under any weights that are not negative.

    For steps of the keyword score, a query's k-th best vector score among the rows that have that much is known; a
    row below it is beaten in both scores by k others and goes at once. Rows that stay are looked at one by one when they have
    doubled.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.step = np.ones(n)
        self.least = np.full((n, LEVELS + 2), -np.inf)
        self.word, self.key = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)  # of the k-th by words alone
        self.held: list[np.ndarray] = []
        self.size, self.limit, self.begun = 0, 0, False

    def _above(self, query: np.ndarray, words: np.ndarray) -> np.ndarray:
        level = np.clip(np.ceil(words / self.step[query]), 0, LEVELS + 1).astype(np.int64)
        level = np.minimum(level + (level * self.step[query] < words), LEVELS + 1)  # a step that rounding has put below the score
        return self.least[query, level]

    def add(self, ok: np.ndarray, words: np.ndarray, vectors: np.ndarray, keys: np.ndarray, content: np.ndarray) -> None:
        """A slice of memories [memory, query]; ``ok`` those that pass the query's filters."""
        if not self.begun:
            self.begun = True
            self.step = np.maximum(words.max(0, initial=0.0), 1e-9) / LEVELS
            if len(words) >= self.k:
                for i in range(LEVELS + 1):
                    self.least[:, i] = np.partition(np.where(ok & (words >= i * self.step), vectors, -np.inf), -self.k, axis=0)[-self.k]
                own = np.where(ok, words, -np.inf)[np.argsort(keys, kind="stable")]
                kth = np.partition(own, -self.k, axis=0)[-self.k]
                alike = np.cumsum(own == kth, axis=0) >= self.k - (own > kth).sum(0)
                self.word, self.key = kth, np.where(kth > -np.inf, np.sort(keys)[alike.argmax(0)], self.key)
        # what is beaten at the last level whose k-th is known, and has no more words than that, is beaten at its own level
        last = (self.least > -np.inf).sum(1) - 1
        bar, reach = np.where(last < 0, -np.inf, self.least[np.arange(self.n), last]), np.where(last < 0, -np.inf, last * self.step)
        more = words > self.word
        early = np.flatnonzero(keys < self.key.max())
        more[early] |= (words[early] == self.word) & (keys[early, None] < self.key)
        row, query = np.nonzero(ok & ((vectors >= bar) | (words > reach) | more))
        near = (vectors[row, query] >= self._above(query, words[row, query])) | more[row, query]
        row, query = row[near], query[near]
        self.held.append(np.rec.fromarrays([query, words[row, query], vectors[row, query], keys[row], content[row, query]], names="q,w,v,key,c"))
        self.size += len(row)
        if self.size > 2 * self.limit + 100_000:
            self._prune()

    def _prune(self) -> None:
        rows = np.concatenate(self.held)
        rows = rows[np.argsort(rows["q"], kind="stable")]
        ends = np.flatnonzero(np.diff(rows["q"], append=-1)) + 1
        keep, begin = [], 0
        for end in ends.tolist():
            own = rows[begin:end]
            keep.append(begin + (band(own["w"], own["v"], own["key"], self.k) if end - begin > self.k else np.arange(end - begin)))
            begin = end
        rows = rows[np.concatenate(keep)] if keep else rows
        self.held, self.size, self.limit = [rows], len(rows), len(rows)
        most = np.zeros(self.n)
        np.maximum.at(most, rows["q"], rows["w"])
        self.step = np.maximum(most, 1e-9) / LEVELS
        self.least[:] = -np.inf
        rows = rows[np.lexsort((-rows["v"], rows["q"]))]
        for i in range(LEVELS + 1):
            kth = self._kth(rows[rows["w"] >= i * self.step[rows["q"]]])
            self.least[kth["q"], i] = kth["v"]
        kth = self._kth(rows[np.lexsort((rows["key"], -rows["w"], rows["q"]))])
        self.word[kth["q"]], self.key[kth["q"]] = kth["w"], kth["key"]

    def _kth(self, rows: np.ndarray) -> np.ndarray:
        """The k-th row of each query that has so many, of rows in order."""
        return rows[np.arange(len(rows)) - np.searchsorted(rows["q"], rows["q"]) == self.k - 1]

    def rows(self) -> tuple[np.ndarray, ...]:
        """Query, key, keyword, content and vector score of the rows that are left."""
        if self.held:
            self._prune()
        rows = self.held[0] if self.held else np.zeros(0, [(n, float if n in "wvc" else np.int64) for n in ("q", "w", "v", "key", "c")])
        return rows["q"], rows["key"], rows["w"], rows["c"], rows["v"]
