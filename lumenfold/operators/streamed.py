"""Documents stream past a stated set of queries: scores of all pairs of a slice of documents in numpy, never as rows.

The queries' terms, weights and ids, at most ``retrieval.MAX_QUERY_BYTES``, go to all workers. A task holds the scores of one
slice of documents with all queries; what leaves it is the best of each query, the wanted pairs, or counts. A score is the sum
of its shared terms' weights in the order of the terms' numbers, so documents with the same terms score the same to
the last bit, in whichever task they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS, ADDS = 400_000, 8_000_000


@dataclass(frozen=True)
class Asked:
    """names: the queries' ids; tokens: the different terms they ask for; of the term t, who[start[t]:start[t + 1]] are
    the queries with it and weight[...] its weights in them."""

    names: list
    tokens: list[str]
    start: np.ndarray
    who: np.ndarray
    weight: np.ndarray

    @property
    def rows(self) -> int:
        """Documents of a slice: bounded cells of scores, and bounded sums also where each shares all terms."""
        return max(1, min(CELLS // max(1, len(self.names)), ADDS // max(1, len(self.who))))


def asked(names: list, pairs: list[tuple]) -> Asked:
    """pairs: query id, term, weight."""
    number = {n: i for i, n in enumerate(names)}
    tokens = sorted({p[1] for p in pairs})
    at = {t: i for i, t in enumerate(tokens)}
    t = np.array([at[p[1]] for p in pairs], np.int64)
    order = np.argsort(t, kind="stable")
    who = np.array([number[p[0]] for p in pairs], np.int64)[order]
    return Asked(names, tokens, np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(tokens)))]), who, np.array([p[2] for p in pairs], np.float64)[order])


def summed(a: Asked, doc: np.ndarray, token: np.ndarray, factor: np.ndarray, n: int) -> np.ndarray:
    """[queries, documents]: the sums of weight times factor over the rows (doc, token, factor), which are ordered by doc and token."""
    counts = a.start[token + 1] - a.start[token]
    at = np.repeat(a.start[token] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    cell = np.repeat(doc, counts) * len(a.names) + a.who[at]
    return np.bincount(cell, a.weight[at] * np.repeat(factor, counts), n * len(a.names)).reshape(n, len(a.names)).T


def hits(terms: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) numbers of the lists' strings that are tokens, ordered."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(terms), 0))
    token = np.asarray(pc.fill_null(pc.index_in(terms.flatten(), value_set=tokens), -1)).astype(np.int64)
    doc = np.repeat(np.arange(len(terms)), lengths)
    known = token >= 0
    key = np.sort(doc[known] * max(1, len(tokens)) + token[known])
    return key // max(1, len(tokens)), key % max(1, len(tokens))


def counted(doc: np.ndarray, token: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ordered rows (document, token) once each, and how often."""
    key, c = np.unique(doc * max(1, tokens) + token, return_counts=True)
    return key // max(1, tokens), key % max(1, tokens), c.astype(np.float64)


def lengths(terms: pa.Array) -> np.ndarray:
    """Of each list of strings the length of the vector of its counts."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(terms), 0))
    code = terms.flatten().dictionary_encode()
    key, c = np.unique(np.repeat(np.arange(len(terms)), sizes) * max(1, len(code.dictionary)) + np.asarray(code.indices).astype(np.int64), return_counts=True)
    return np.sqrt(np.bincount(key // max(1, len(code.dictionary)), c.astype(np.float64) ** 2, len(terms)))


class Best:
    """The best k of each query so far, by falling score and then rising place; a score of -inf is none."""

    def __init__(self, queries: int, k: int):
        self.n, self.k = queries, k
        self.who, self.score, self.pos, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), None
        self.low, self.at = np.full(queries, -np.inf), np.full(queries, np.inf)

    def add(self, s: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> None:
        low = self.low[:, None]
        who, what = np.nonzero((s > low) | ((s == low) & (pos[None, :] < self.at[:, None]) & (s > -np.inf)))
        if not len(who):
            return
        who, score, at = np.concatenate([self.who, who]), np.concatenate([self.score, s[who, what]]), np.concatenate([self.pos, pos[what]])
        ids = ids[what] if self.ids is None else np.concatenate([self.ids, ids[what]])
        order = np.lexsort((at, -score, who))
        first = np.searchsorted(who[order], np.arange(self.n))
        place = np.arange(len(order)) - first[who[order]]
        keep = order[place < self.k]
        self.who, self.score, self.pos, self.ids = who[keep], score[keep], at[keep], ids[keep]
        full = order[place == self.k - 1]
        self.low[who[full]], self.at[who[full]] = score[full], at[full]


Slices = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]  # scores [queries, documents], ids, places


def run(score: Callable[[Iterator[pa.RecordBatch]], Slices], use: Callable[[Slices], Iterator[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: the slices that score makes, as the rows (columns of schema) that use makes of them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in use(score(batches)):
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.tolist() if c.dtype == object else c).cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return go


def best_of(names: list, k: int) -> Callable[[Slices], Iterator[tuple]]:
    def use(slices: Slices) -> Iterator[tuple]:
        best = Best(len(names), k)
        for s, ids, pos in slices:
            best.add(s, ids, pos)
        if best.ids is not None:
            yield np.array(names)[best.who], best.ids, best.pos.astype(np.int64), best.score

    return use


def all_of(names: list) -> Callable[[Slices], Iterator[tuple]]:
    def use(slices: Slices) -> Iterator[tuple]:
        for s, ids, pos in slices:
            who, what = (x.ravel() for x in np.indices(s.shape))
            yield np.array(names)[who], ids[what], pos[what], s.ravel()

    return use


def those_of(names: list, wanted: dict) -> Callable[[Slices], Iterator[tuple]]:
    """The wanted pairs; wanted: ids of documents by query id."""

    def use(slices: Slices) -> Iterator[tuple]:
        for s, ids, pos in slices:
            for i, n in enumerate(names):
                if n in wanted and len(what := np.flatnonzero(np.isin(ids, wanted[n][0]))):
                    yield np.full(len(what), n), ids[what], pos[what], s[i, what]

    return use


def counts_of(names: list, found: dict, before: Callable) -> Callable[[Slices], Iterator[tuple]]:
    """How many of a task's documents stand before each wanted pair; found: ids, scores and places by query id."""

    def use(slices: Slices) -> Iterator[tuple]:
        total: dict = {}
        for s, _, pos in slices:
            for i, n in enumerate(names):
                if n in found:
                    c = before(s[i], pos, found[n][1], found[n][2])
                    total[n] = total[n] + c if n in total else c
        for n, c in total.items():
            yield np.full(len(c), n), found[n][0], c

    return use
