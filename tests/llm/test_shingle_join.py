import random
import re

from wattline.llm import shingle_join
from wattline.llm.shingle_join import keep_first, near_duplicates, op7_shingle_join


def shingles(text, width=4):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(docs, similar=85):
    """{(id, text): (size, smallest id)} with every pair compared."""
    keys = sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    sets = {k: shingles(k[1]) for k in keys}
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= similar * max(len(x), len(y)) and 100 * len(x & y) >= similar * len(x | y):
                ra, rb = find(a), find(b)
                if ra != rb:
                    lo, hi = sorted((ra, rb), key=keys.index)
                    up[hi] = lo
    return {k: (len(sets[k]), find(k)[0]) for k in keys}


def family(rnd, words, n, length, edits):
    base = rnd.choices(words, k=length)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append(" ".join(w))
    return out


def made(seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rnd.choices(words, k=30))
    texts = []
    for _ in range(25):
        texts += family(rnd, words, rnd.randint(1, 8), rnd.randint(5, 150), 6)
    texts += [passage + " " + " ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(40)]
    texts += family(rnd, words, 60, 120, 5)
    texts += [None, "", " \t\n", "one", "ONE", "one two three", "one\ttwo\nthree", "a b c d", "A B  C D", "é à", "x"]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5])]


def check(spark, docs):
    want = brute(docs)
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert len(rows) == len(docs)
    got = {}
    for r in rows:
        got.setdefault(None if r.doc == shingle_join.NO_ID else r.doc, set()).add((r.size, None if r.comp_doc == shingle_join.NO_ID else r.comp_doc))
    expected = {}
    for (doc, _), v in want.items():
        expected.setdefault(doc, set()).add(v)
    assert got == expected


def test_against_all_pairs(spark):
    check(spark, made())


def test_small_blocks_split_groups(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_MEMBERS", 7)
    check(spark, made(8))


def test_no_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SHARE", 1)
    check(spark, made(9))


def test_counts_that_are_equal_in_the_order(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "MOST_COUNTED", 3)
    monkeypatch.setattr(shingle_join, "SHARE", 2)
    check(spark, made(10))


def test_keep_first_and_other_columns(spark):
    docs = made(4)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, th string, size int")
    kept = keep_first(df)
    assert kept.columns == df.columns
    want = sorted((d for (d, _), (_, c) in brute(docs).items() if d == c), key=lambda d: (d is not None, d or 0))
    assert sorted((r.doc_id for r in kept.collect()), key=lambda d: (d is not None, d or 0)) == want


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {k[0]: v for k, v in brute(docs).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op7_shingle_join(spark, sf_dir).collect()} == want


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
