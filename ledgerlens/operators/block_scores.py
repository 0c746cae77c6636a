"""Scores of a block of rows for all questions, of which only rows leave that can be among the best (an array kernel on Arrow tables)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores of questions and rows that a task holds at a time.
CELLS = 4_000_000


def kernel(k: int, weigh: Callable, near: int, qid: str, row: str, grouped: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a block's counts (row, __len, __term, __tf and, if ``grouped``, __group) and the questions' terms (qid, __term, __idf, __mean).

    It gives (qid, row, __w): sums of ``weigh(idf, tf, len, mean)`` over shared terms, whole numbers. Rows of a question leave that are
    less than ``near`` behind its ``k``-th best row, and those less than ``near`` behind the best row of their group; of one sum only the first
    ``k`` (of a group: the first) in order of ``row``. Repetitions of a row and a term add up. All that it calls is made here, so that
    executors need no copy of this package.
    """

    def firsts(scores: np.ndarray) -> np.ndarray:
        """Places of scores above 0 less than ``near`` behind the ``k``-th; of equal ones the first ``k``."""
        least = max(1, int(np.partition(scores, -k)[-k]) - near) if len(scores) > k else 1
        places = np.flatnonzero(scores >= least)
        if len(places) <= k:
            return places
        places = places[np.argsort(-scores[places], kind="stable")]
        start = np.flatnonzero(np.diff(scores[places], prepend=-1))
        nth = np.arange(len(places)) - np.repeat(start, np.diff(start, append=len(places)))
        return places[nth < k]

    def members_of(group: pa.Array, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in a group, sorted by it and by place, and where each group begins."""
        of = np.full(n, -1)
        of[at] = pc.fill_null(group.dictionary_encode().indices, -1).to_numpy()
        rows = np.flatnonzero(of >= 0)
        rows = rows[np.argsort(of[rows], kind="stable")]
        return rows, np.flatnonzero(np.diff(of[rows], prepend=-1))

    def heads(scores: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of each group the rows with a score above 0 less than ``near`` behind its best; of equal ones the first."""
        if not len(rows):
            return rows
        s = scores[rows]
        group = np.repeat(np.arange(len(start)), np.diff(start, append=len(rows)))
        kept = np.flatnonzero(s >= np.maximum(1, np.maximum.reduceat(s, start) - near)[group])
        kept = kept[np.lexsort((s[kept], group[kept]))]
        again = (np.diff(s[kept], prepend=-1) == 0) & (np.diff(group[kept], prepend=-1) == 0)
        return rows[kept[~again]]

    def best(counts: pa.Table, asks: pa.Table) -> pa.Table:
        terms = asks.column("__term").combine_chunks().dictionary_encode()
        counts = counts.filter(pc.and_(pc.is_in(counts.column("__term"), value_set=terms.dictionary), pc.is_valid(counts.column(row))))
        asked = asks.column(qid).combine_chunks().dictionary_encode()
        held = counts.column(row).combine_chunks().dictionary_encode()
        order = pc.sort_indices(held.dictionary)
        n, ids = len(order), held.dictionary.take(order)
        place = np.empty(n, np.int64)
        place[order.to_numpy()] = np.arange(n)
        at, term = place[held.indices.to_numpy()], terms.indices.to_numpy()
        idf = np.zeros(len(terms.dictionary))
        idf[term] = asks.column("__idf").to_numpy()
        of = pc.index_in(counts.column("__term"), value_set=terms.dictionary).to_numpy().astype(np.int64)
        mean = asks.column("__mean")[0].as_py() if len(asks) else 1.0
        w = np.maximum(weigh(idf[of], counts.column("__tf").to_numpy(), counts.column("__len").to_numpy(), mean), 1)
        key, where = np.unique(of * n + at, return_inverse=True)
        weight = np.zeros(len(key), np.int64)
        np.add.at(weight, where, w)
        docs, ends = key % max(n, 1), np.searchsorted(key, np.arange(len(idf) + 1) * n)
        members = members_of(counts.column("__group").combine_chunks(), at, n) if grouped else None
        found, step, question = [], max(1, CELLS // max(n, 1)), asked.indices.to_numpy()
        for first in range(0, len(asked.dictionary) if n else 0, step):
            scores = np.zeros((min(step, len(asked.dictionary) - first), n), np.int64)
            mine = np.flatnonzero((question >= first) & (question < first + step))
            mine = mine[np.argsort(term[mine], kind="stable")]
            for own in np.split(mine, np.flatnonzero(np.diff(term[mine])) + 1):
                part = slice(ends[term[own[0]]], ends[term[own[0]] + 1])
                scores[np.ix_(question[own] - first, docs[part])] += weight[part]
            for i, s in enumerate(scores):
                rows = firsts(s)
                rows = rows if members is None else np.union1d(rows, heads(s, *members))
                found.append((np.full(len(rows), first + i), rows, s[rows]))
        q, r, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({qid: asked.dictionary.take(pa.array(q)), row: ids.take(pa.array(r)), "__w": pa.array(s, pa.int64())})

    return best
