"""Many BM25 queries against pages with counted words: blocks of pages meet blocks of queries by matrix products.

A row of the one matrix is a page's weights of words, a column of the other a query's idf; both are made dense for some words at
a time. What a task keeps are the first `limit` pages of each query, so that no page meets a query as a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pages, queries and words that are multiplied at once.
PAGES, QUERIES, WORDS = 512, 256, 4096


class Best:
    """The first `limit` pages (score rounded to 6 places, then key) of each query.

    asked: id, term, idf; a term once for each id. Pages: key, n, terms (term, tf).
    """

    def __init__(self, asked: pa.Table, limit: int, mean: float, k1: float, b: float):
        self.limit, self.mean, self.k1, self.b = limit, mean, k1, b
        ids = pc.dictionary_encode(asked.column("id").combine_chunks(), null_encoding="encode")
        terms = pc.dictionary_encode(asked.column("term").combine_chunks())
        self.ids, self.terms = ids.dictionary, terms.dictionary
        query, term, idf = ids.indices.to_numpy(), terms.indices.to_numpy(), asked.column("idf").to_numpy()
        order = np.argsort(query, kind="stable")
        query, term, idf = query[order], term[order], idf[order]
        self.blocks = []
        for low in range(0, len(self.ids), QUERIES):
            here = slice(*np.searchsorted(query, [low, low + QUERIES]))
            words, place = np.unique(term[here], return_inverse=True)
            self.blocks.append((low, min(QUERIES, len(self.ids) - low), words, place, query[here] - low, idf[here]))
        self.best: list[pa.Table | None] = [None] * len(self.blocks)
        self.least = np.zeros(len(self.ids))

    def add(self, pages: pa.RecordBatch | pa.Table) -> None:
        for at in range(0, pages.num_rows, PAGES):
            self._add(pages.slice(at, PAGES))

    def _add(self, pages: pa.RecordBatch | pa.Table) -> None:
        lists, n = pages.column("terms"), pages.column("n").to_numpy()
        found = pc.list_flatten(lists)
        at = pc.index_in(pc.struct_field(found, "term"), value_set=self.terms)
        kept = np.asarray(pc.is_valid(at))
        page = np.repeat(np.arange(len(n)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[kept]
        at, tf = pc.drop_null(at).to_numpy(), pc.struct_field(found, "tf").to_numpy()[kept].astype(np.float64)
        weight = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * n[page] / self.mean))
        for k, (low, size, words, place, query, idf) in enumerate(self.blocks):
            own = np.minimum(np.searchsorted(words, at), len(words) - 1)
            mine = words[own] == at
            own, row, value = own[mine], page[mine], weight[mine]
            score = np.zeros((len(n), size))
            for first in range(0, len(words), WORDS):
                width = min(WORDS, len(words) - first)
                left, right = np.zeros((len(n), width)), np.zeros((width, size))
                p, q = (own >= first) & (own < first + width), (place >= first) & (place < first + width)
                left[row[p], own[p] - first] = value[p]
                right[place[q] - first, query[q]] = idf[q]
                score += left @ right
            self._keep(k, np.floor(score * 1e6 + 0.5) / 1e6, low, pages.column("key"))

    def _keep(self, k: int, score: np.ndarray, low: int, keys: pa.Array | pa.ChunkedArray) -> None:
        rows, size = score.shape
        least = self.least[low : low + size]
        if rows > self.limit:
            least = np.maximum(least, np.partition(score, rows - self.limit, axis=0)[rows - self.limit])
        row, query = np.nonzero((score >= least) & (score > 0))
        if not len(row):
            return
        made = pa.table({"query": query, "score": score[row, query], "key": keys.take(pa.array(row))})
        made = made if self.best[k] is None else pa.concat_tables([self.best[k], made])
        made = made.take(pc.sort_indices(made, [("query", "ascending"), ("score", "descending"), ("key", "ascending")]))
        query = made.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.limit - 1
        self.least[low + query[last]] = made.column("score").to_numpy()[last]
        self.best[k] = made.filter(pa.array(place < self.limit)).combine_chunks()

    def tables(self) -> Iterator[pa.Table]:
        """id, key, score."""
        for (low, *_), made in zip(self.blocks, self.best, strict=True):
            if made is not None:
                ids = self.ids.take(pa.array(low + made.column("query").to_numpy()))
                yield pa.table({"id": ids, "key": made.column("key"), "score": made.column("score")})


def best_of(batches: Iterable[pa.RecordBatch | pa.Table], asked: pa.Table, *how) -> Iterator[pa.Table]:
    if not asked.num_rows:
        return
    best = Best(asked, *how)
    for batch in batches:
        best.add(batch)
    yield from best.tables()
