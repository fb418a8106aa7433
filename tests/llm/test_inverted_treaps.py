import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import inverted_treaps
from wattline.llm.inverted_treaps import Best, Shard, Terms, op13_inverted_treaps, rank_documents, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    held = [(i, terms_of(t)) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in queries:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for q, terms in asked.items():
        scored = []
        for i, t in held:
            m = 50 + 50 * len(t) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in terms if x in t)
            if s > 0:
                scored.append((-s, -(2**63) if i is None else i))
        out += [(q, n, None if i == -(2**63) else i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def sample(rnd, n):
    words = ["Alpha", "beta", "GAMMA", "a", "été", "naïve", "世界世界世界世界", "x1y2", "0", "verylongwordofmorethan16bytes", "sixteen_bytes_ok"]
    words += ["".join(rnd.choices("abcdef", k=rnd.randint(1, 4))) for _ in range(60)]
    join = [" ", ", ", "\n", "\x7f", "'", "—"]
    text = lambda m: "".join(rnd.choice(words) + rnd.choice(join) for _ in range(rnd.randint(0, m)))
    docs = [(rnd.randrange(10**6), text(60)) for _ in range(n)]
    docs += [(5, None), (6, ""), (7, " .,;"), (None, "alpha beta"), (8, "Alpha " * 3000), (9, "!" * 5000)]
    docs += [(1000 + k, "alpha beta gamma delta") for k in range(40)] + [(77, "beta"), (77, "beta"), (77, "gamma beta")]
    return docs, [(k, text(12)) for k in range(12)] + [(50, None), (51, "?"), (None, "alpha"), (0, "été alpha"), (52, "ALPHA beta Gamma"), (53, "nowhere")]


@pytest.mark.parametrize("k", [1, 7, 50, 1000])
def test_against_scoring_everything(spark, monkeypatch, k):
    monkeypatch.setattr(inverted_treaps, "SHARD_DOCS", 2080)
    monkeypatch.setattr(inverted_treaps, "RANGES", 5)
    docs, queries = sample(random.Random(k), 250)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("score", F.lit(0))
    rows = sorted((tuple(r) for r in rank_documents(df, asked, k).collect()), key=repr)
    assert rows == brute(docs, queries, k)


def test_many_small_shards_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(inverted_treaps, "SHARD_POSTINGS", 20)
    monkeypatch.setattr(inverted_treaps, "QUERY_BYTES", 60)
    docs, queries = sample(random.Random(3), 60)
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert sorted((tuple(r) for r in rank_documents(*args, 5).collect()), key=repr) == brute(docs, queries, 5)


def test_treaps_are_search_trees_and_heaps():
    rnd = np.random.default_rng(1)
    docs = np.concatenate([np.flatnonzero(rnd.random(500) < p) for p in (0.5, 0.1, 0.9)])
    ends = np.flatnonzero(np.diff(docs, append=-1) < 0) + 1
    impact = rnd.integers(1, 6, len(docs))
    left, right, roots = treaps(ends, docs, impact)
    start = 0
    for end, root in zip(ends.tolist(), roots.tolist(), strict=True):
        seen, stack = [], [(root, -1, 10**9, 10**9)]
        while stack:
            node, low, high, most = stack.pop()
            if node >= 0:
                assert low < docs[node] < high and impact[node] <= most
                seen.append(node)
                stack += [(left[node], low, docs[node], impact[node]), (right[node], docs[node], high, impact[node])]
        assert sorted(seen) == list(range(start, end))
        start = end


def test_ranges_are_pruned(monkeypatch):
    """A few documents of high impact among many: nearly nothing else is scored."""
    n = 5000
    times = np.ones(n, dtype=np.int64)
    times[::500] = 40
    shard = Shard(np.array([0]), np.array([n]), np.arange(n), np.full(n, 50), np.arange(n), times, np.array([1000]), n, n * 50)
    scored, add = [], Best.add
    monkeypatch.setattr(Best, "add", lambda self, query, score, ident: (scored.append(len(query)), add(self, query, score, ident))[1])
    best = Best(1, 5)
    shard.search(np.array([0]), np.array([0]), best)
    assert best.ident.tolist() == [0, 500, 1000, 1500, 2000] and sum(scored) < 60


def test_terms_of_any_length_are_told_apart():
    words = [b"a", b"abcdefgh", b"abcdefghi", b"abcdefghijklmnop", b"abcdefghijklmnopq", "é世".encode() * 5]
    text = b" ".join(words[::-1]) + b" ab abcdefghijklmnopqr B"
    sizes, row, term = Terms(words).find(np.frombuffer(text + b"A", dtype=np.uint8), np.array([0, len(text), len(text) + 1]))
    assert sizes.tolist() == [9, 1] and term.tolist() == [5, 4, 3, 2, 1, 0, 0] and row.tolist() == [0] * 6 + [1]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items, nobody = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rank_documents(none, items).collect() == [] == rank_documents(docs, nobody).collect()
    # one document: its terms have a weight of floor(1000 * ln(4 / 3))
    assert [r.doc_id for r in rank_documents(docs, items).collect()] == [1]


def test_query_over_its_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_inverted_treaps(spark, sf_dir).collect()), key=repr) == brute(docs, items, 50)
