"""Ranked lexical search over inverted treaps.

Documents are cut into shards. In a shard every term that the queries ask for has a treap: a search tree by document and a
heap by impact at once, so a node's impact bounds those of its subtree. A query walks the treaps of its terms together: a
range of documents has one node a term (the largest impact in the range), and the sum of their scores bounds every document
of the range. Ranges whose bound can't enter the k best so far are dropped whole; the others are split at the document of
the largest node, which is scored exactly on the way, best bounds first. The k best of a task live through all its shards,
and the tasks' lists are merged by a window that keeps k rows an item before the shuffle.

Two passes: the first writes postings of the queries' terms by shard, with the counts that all weights need; the second
builds the treaps, since impacts depend on the mean length, and searches them. Queries go in blocks of QUERY_BYTES of text,
so what travels to the executors is bounded (a single query of a larger text is a block of its own).

Edge cases: null and empty texts, and texts without a term, aren't documents and are never found; a query without terms has
no rows; rows that repeat a query's id are one query with the terms of all; rows that repeat a document's id are documents
of their own and may share a rank's score (equal scores: smaller id first); a null id of either side counts as -2^63 and is
null in the result; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm.common import NO_ID, id_column, materialise, mix64, read_table, schema, text_column, utf8_parts

#: Bytes of query texts in a block; documents of a shard and postings after which it is closed; ranges that are split at once.
QUERY_BYTES, SHARD_DOCS, SHARD_POSTINGS, RANGES = 8_000_000, 8192, 600_000, 4096

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """The terms of texts that lie one behind the other: (row, start, size)."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return np.searchsorted(offsets, start, side="right") - 1, start, np.flatnonzero(ends) + 1 - start


class Terms:
    """A vocabulary, found exactly: terms of up to 16 bytes as two words, longer ones in a table."""

    def __init__(self, terms: list[bytes]):
        self.count = len(terms)
        self.long = {t: k for k, t in enumerate(terms) if len(t) > 16}
        short = [(t.ljust(16, b"\0"), k) for k, t in enumerate(terms) if len(t) <= 16]
        words = np.frombuffer(b"".join(t for t, _ in short), dtype="<u8").reshape(-1, 2)
        ids, self.seed = np.array([k for _, k in short], dtype=np.int32), 0
        while True:
            hashes = self._hash(words[:, 0], words[:, 1])
            if len(np.unique(hashes)) == len(hashes):
                break
            self.seed += 1
        order = np.argsort(hashes)
        self.hashes, self.first, self.second, self.ids = hashes[order], words[order, 0], words[order, 1], ids[order]

    def _hash(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix64(first ^ mix64(second + np.uint64(0x9E3779B97F4A7C15 + self.seed)))

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """Terms of each text, and (row, term) of those in the vocabulary."""
        row, start, size = _pieces(data, offsets)
        sizes = np.bincount(row, minlength=len(offsets) - 1)
        low = np.concatenate([_LOWER[data], np.zeros(24, dtype=np.uint8)])
        eight = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
        found = np.full(len(start), -1, dtype=np.int32)
        if len(self.hashes) and len(start):
            first = eight[start] & _KEEP[np.minimum(size, 8)]
            second = eight[start + 8] & _KEEP[np.clip(size - 8, 0, 8)]
            at = np.minimum(np.searchsorted(self.hashes, self._hash(first, second)), len(self.hashes) - 1)
            hit = (self.first[at] == first) & (self.second[at] == second) & (size <= 16)
            found[hit] = self.ids[at[hit]]
        if self.long:
            for k in np.flatnonzero(size > 16).tolist():
                found[k] = self.long.get(low[start[k] : start[k] + size[k]].tobytes(), -1)
        known = found >= 0
        return sizes, row[known], found[known]


_POSTINGS = "n_docs long, n_terms long, terms <int>, counts <int>, ids binary, sizes binary, docs binary, times binary"
_POSTING_TYPES = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("ids", "sizes", "docs", "times"))])


def _shard(ids: list, sizes: list, keys: list, times: list) -> pa.RecordBatch:
    """One row: documents by id, postings by term and document. Keys are term << 32 | document in the order of arrival."""
    ids, sizes, keys, times = (np.concatenate(x) for x in (ids, sizes, keys, times))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    keys = (keys >> 32 << 32) | place[keys & (2**32 - 1)]
    by = np.argsort(keys)
    terms, counts = np.unique(keys[by] >> 32, return_counts=True)
    binary = (ids[order].astype("<i8"), sizes[order].astype("<i8"), (keys[by] & (2**32 - 1)).astype("<u2"), times[by].astype("<u4"))
    row = [[len(ids)], [int(sizes.sum())], [terms.astype(np.int32)], [counts.astype(np.int32)], *([x.tobytes()] for x in binary)]
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(row, _POSTING_TYPES, strict=True)], schema=_POSTING_TYPES)


def postings(docs: DataFrame, terms: Terms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of documents with the postings of a vocabulary; documents without any term are left out."""

    def run(batches):
        held, size, count = ([], [], [], []), 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in utf8_parts(batch.column(1)):
                sizes, row, term = terms.find(data, offsets)
                real = sizes > 0
                place = np.cumsum(real) - 1 + size
                keys, times = np.unique((term.astype(np.int64) << 32) | place[row], return_counts=True)
                for into, new in zip(held, (ids[first : first + len(sizes)][real], sizes[real], keys, times), strict=True):
                    into.append(new)
                size, count = size + int(real.sum()), count + len(keys)
                if size + 2000 > SHARD_DOCS or count > SHARD_POSTINGS:
                    yield _shard(*held)
                    held, size, count = ([], [], [], []), 0, 0
        if size:
            yield _shard(*held)

    return docs.select(id_column(docs, doc_id).alias("id"), text_column(text).alias("text")).mapInArrow(run, schema(_POSTINGS))


def treaps(term_ends: np.ndarray, docs: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children of every posting, and the root of every term; postings are sorted by term and document. Equal impacts are
    ordered by a hash of the document, which keeps the depth of a treap logarithmic among ties."""
    order = (impact << 32 | (mix64(docs.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.int64)).tolist()
    left, right, roots, start = [-1] * len(order), [-1] * len(order), [], 0
    for end in term_ends.tolist():
        spine: list[int] = []
        for k in range(start, end):
            key, last = order[k], -1
            while spine and order[spine[-1]] < key:
                last = spine.pop()
            left[k] = last
            if spine:
                right[spine[-1]] = k
            spine.append(k)
        roots.append(spine[0] if spine else -1)
        start = end
    return np.array(left, dtype=np.int32), np.array(right, dtype=np.int32), np.array(roots, dtype=np.int32)


class Best:
    """The k best documents of every query so far."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.query = self.score = self.ident = np.zeros(0, dtype=np.int64)
        self.least, self.last = np.zeros(queries, dtype=np.int64), np.full(queries, NO_ID)

    def open(self, query: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether documents of at most this score and at least this id can enter."""
        return (bound > self.least[query]) | ((bound == self.least[query]) & (least_id < self.last[query]))

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        new = self.open(query, score, ident)
        if not new.any():
            return
        query, score, ident = (np.concatenate([a, b[new]]) for a, b in ((self.query, query), (self.score, score), (self.ident, ident)))
        by = np.lexsort((ident, -score, query))
        query, score, ident = query[by], score[by], ident[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.score, self.ident = (x[rank < self.k] for x in (query, score, ident))
        last = rank == self.k - 1
        self.least[query[last]], self.last[query[last]] = score[last], ident[last]


class Shard:
    """The treaps of a shard: nodes with document, score (weight times impact) and children."""

    def __init__(self, terms, counts, ids, sizes, docs, times, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.docs, self.terms = ids, docs.astype(np.int32), terms
        scale = 50 + 50 * sizes * n_docs // n_terms
        times = times.astype(np.int64)
        impact = 1_000_000_000 * times // (1000 * times + 20 * scale[self.docs])
        self.left, self.right, self.roots = treaps(np.cumsum(counts), self.docs, impact)
        self.score = impact * np.repeat(weights[terms], counts)

    def search(self, query: np.ndarray, term: np.ndarray, best: Best) -> None:
        """For queries as (query, term) pairs sorted by query, with terms of positive weight."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        if not known.any():
            return
        query, node = query[known], self.roots[at[known]]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        none = np.zeros(len(begin), dtype=np.int32)
        waiting = [(query[begin], none, none + np.int32(len(self.ids) - 1), np.diff(begin, append=len(query)), node)]
        while waiting:
            batch = [waiting.pop()]
            while waiting and sum(len(b[0]) for b in batch) < RANGES:
                batch.append(waiting.pop())
            query, low, high, size, node = (np.concatenate(x) for x in zip(*batch, strict=True)) if len(batch) > 1 else batch[0]
            bound = np.add.reduceat(self.score[node], np.cumsum(size) - size)
            keep = best.open(query, bound, self.ids[low])
            if not keep.any():
                continue
            if keep.sum() > RANGES:
                first = np.zeros(len(keep), dtype=bool)
                first[np.argpartition(np.where(keep, bound - best.least[query], -1), -RANGES)[-RANGES:]] = True
                waiting.append(_ranges(keep & ~first, query, low, high, size, node))
                keep &= first
            waiting += self._split(*_ranges(keep, query, low, high, size, node), best)

    def _split(self, query, low, high, size, node, best: Best):
        """Scores one document of every range and leaves the ranges on its sides."""
        owner = np.repeat(np.arange(len(size)), size)
        score = self.score[node]
        top = np.flatnonzero(score == np.maximum.reduceat(score, np.cumsum(size) - size)[owner])
        middle = self.docs[node[top[np.flatnonzero(np.diff(owner[top], prepend=-1))]]]
        low_of, high_of, middle_of = low[owner], high[owner], middle[owner]
        before, after = np.full(len(node), -1, dtype=np.int32), np.full(len(node), -1, dtype=np.int32)
        hits = np.zeros(len(node), dtype=np.int64)
        walk, now = np.arange(len(node)), node
        while len(walk):
            doc, aim = self.docs[now], middle_of[walk]
            less, more = doc < aim, doc > aim
            take = walk[less & (before[walk] < 0) & (doc >= low_of[walk])]
            before[take] = now[less & (before[walk] < 0) & (doc >= low_of[walk])]
            mask = more & (after[walk] < 0) & (doc <= high_of[walk])
            after[walk[mask]] = now[mask]
            same = ~less & ~more
            if same.any():
                entry, met = walk[same], now[same]
                hits[entry] = self.score[met]
                for side, child, other, outside in ((before, self.left, self.right, lambda d, e: d < low_of[e]), (after, self.right, self.left, lambda d, e: d > high_of[e])):
                    want, down = entry[side[entry] < 0], child[met[side[entry] < 0]]
                    while len(want):
                        want, down = want[down >= 0], down[down >= 0]
                        out = outside(self.docs[down], want)
                        side[want[~out]] = down[~out]
                        want, down = want[out], other[down[out]]
            now = np.where(less, self.right[now], self.left[now])
            on = ~same & (now >= 0)
            walk, now = walk[on], now[on]
        best.add(query, np.add.reduceat(hits, np.cumsum(size) - size), self.ids[middle])
        for side, first, last in ((after, middle + np.int32(1), high), (before, low, middle - np.int32(1))):
            real = side >= 0
            count = np.bincount(owner[real], minlength=len(query))
            some = count > 0
            if some.any():
                yield query[some], first[some], last[some], count[some], side[real]


def _ranges(mask, query, low, high, size, node):
    return query[mask], low[mask], high[mask], size[mask], node[np.repeat(mask, size)]


_FOUND = "query int, doc long, score long"
_FOUND_TYPES = pa.schema([("query", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])


def search(shards: DataFrame, query: np.ndarray, term: np.ndarray, queries: int, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc, score): the k best of every task, which hold the k best of all."""

    def run(batches):
        best = Best(queries, k)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, counts = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in ("terms", "counts"))
                kinds = {"ids": "<i8", "sizes": "<i8", "docs": "<u2", "times": "<u4"}
                arrays = [np.frombuffer(batch.column(c)[row].as_buffer(), dtype=kind) for c, kind in kinds.items()]
                if len(terms):
                    Shard(terms, counts, *arrays, weights, n_docs, n_terms).search(query, term, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.query, pa.int32()), pa.array(best.ident), pa.array(best.score)], schema=_FOUND_TYPES)

    return shards.select("terms", "counts", "ids", "sizes", "docs", "times").mapInArrow(run, schema(_FOUND))


def _query_terms(rows: list) -> tuple[list, list[set[bytes]]]:
    held: dict = {}
    for r in rows:
        data = r.text.encode()
        _, start, size = _pieces(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])) if data else (None, np.zeros(0, int), np.zeros(0, int))
        low = _LOWER[np.frombuffer(data, dtype=np.uint8)].tobytes()
        held.setdefault(r.id, set()).update(low[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True))
    return list(held), list(held.values())


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of highest score above 0 for every query."""
    spark = docs.sparkSession
    asked = queries.select(id_column(queries, query_id).alias("id"), text_column(query_text).alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES
    out = spark.createDataFrame([], schema("id long, rank int, doc long, score long"))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        ids, sets = _query_terms(rows)
        vocabulary = sorted(set().union(*sets)) if sets else []
        if not vocabulary:
            continue
        number = {t: n for n, t in enumerate(vocabulary)}
        shards = materialise(postings(docs, Terms(vocabulary), doc_id, text), "postings")
        n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        zipped = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        for r in zipped.collect():  # one row a term of the block's queries
            df[r.terms] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        pairs = sorted((q, number[t]) for q, terms in enumerate(sets) for t in terms if weights[number[t]] > 0)
        if not pairs:
            continue
        query, term = np.array(pairs, dtype=np.int64).T.copy()
        found = search(shards, query, term, len(ids), weights, n_docs, n_terms, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), schema("query int, id long"))
        out = out.unionByName(ranked.join(F.broadcast(names), "query").select("id", "rank", "doc", "score"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(null("id").alias(query_id), "rank", null("doc").alias(doc_id), "score")


def op13_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return rank_documents(docs, items)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE = f"""
WITH word AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY doc_id, term),
doc AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weight AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), whole),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weight JOIN tf USING (term) JOIN doc USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
