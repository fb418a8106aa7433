import hashlib
import random

from wattline.llm.suffix_dedup import WIDTH, drop_repeated_strings, op9_suffix_dedup


PLAIN = "".join(random.Random(9).choices("abcdefghij ", k=900))


def brute(docs):
    """docs: distinct (id, text); {(id, text): (n_bytes, n_removed, n_spans, kept)} by looking at every window."""
    seen, out = set(), {}
    for doc, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - WIDTH + 1):
            window = data[k : k + WIDTH]
            if window in seen:
                gone[k : k + WIDTH] = b"\1" * WIDTH
            seen.add(window)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc, text] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    rows = drop_repeated_strings(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d = r.dedup
        assert (d.n_bytes, d.n_removed, d.n_spans, bytes(d.kept)) == want[r.doc_id, r.text], r.doc_id


def test_random_passages(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcé", k=rnd.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(10, 60))) for _ in range(12)]
    docs = []
    for k in range(150):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=rnd.randint(1, 50))) for _ in range(rnd.randint(1, 5))]
        docs.append((k, " ".join(parts)))
    base = docs[0][1]
    docs += [(200 + k, base[: 37 * k] + "X" + base[37 * k :]) for k in range(10)]
    check(spark, docs)


def test_odd_texts(spark):
    long = "0123456789" * 40
    docs = [(1, None), (2, ""), (3, "short"), (4, "a" * 700), (5, "a" * 99), (6, "a" * 100), (7, long), (7, long), (8, long[:250] + "\0" * 150), (9, "\0" * 120), (None, long[5:180]), (12, PLAIN), (12, PLAIN), (12, PLAIN), (14, PLAIN[50:] + "new"), (14, PLAIN[50:] + "new"), (10, "ab" * 300), (11, "ba" * 99)]
    check(spark, docs)


def test_hot_anchor(spark, monkeypatch):
    import wattline.llm.suffix_dedup as m

    rnd = random.Random(1)
    middle = "the passage that all share is long enough to hold more than one hundred bytes of text, which it is, surely."
    docs = [(k, "".join(rnd.choices("xyz", k=60)) + middle + "".join(rnd.choices("xyz", k=60))) for k in range(60)]
    monkeypatch.setattr(m, "BLOCK", 10)
    monkeypatch.setattr(m, "HOT_ANCHOR", 20)
    rows = [(1, d, 1, 0, 20, t.encode()[40:200]) for d, t in docs]
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 5 else pa.int64()) for k in range(6)], m.CONTEXT.names)
    out = pa.Table.from_batches(list(m.settle(iter([batch])))).to_pylist()
    assert sum(r["open"] for r in out) == sum(len(r[5]) - WIDTH + 1 for r in rows) and np.unique([r["doc"] for r in out]).size == 60


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {k[0]: v for k, v in brute(docs).items()}
    for r in op9_suffix_dedup(spark, sf_dir).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_empty_table(spark):
    assert drop_repeated_strings(spark.createDataFrame([], "doc_id long, text string, route string")).collect() == []
