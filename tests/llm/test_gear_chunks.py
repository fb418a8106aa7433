import random

import xxhash

from wattline.llm.gear_chunks import BITS, GEAR, LEAST, MOST, SHORTEST, drop_repeated_chunks, op5_gear_chunks


def chunked(data):
    """Starts and ends, one byte at a time."""
    out, at = [], 0
    while at < len(data):
        h, k = 0, at
        while True:
            h = ((h << 1) + int(GEAR[data[k]])) & 0xFFFFFFFF
            k += 1
            if k == len(data) or k - at == MOST or (k - at >= LEAST and h >> (32 - BITS) == 0):
                break
        out.append((at, k))
        at = k
    return out


def brute(docs):
    seen, out = set(), {}
    for doc, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        data = (text or "").encode()
        runs, gone = [], 0
        for a, b in chunked(data):
            key = xxhash.xxh3_128_digest(data[a:b])
            if key in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(key)
        runs = [r for r in runs if r[1] - r[0] >= SHORTEST]
        gone = sum(b - a for a, b in runs)
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + data[at:a], b
        out[doc, text] = (len(data), gone, len(runs), kept + data[at:])
    return out


def test_against_byte_by_byte(spark):
    rnd = random.Random(2)
    passages = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz é", k=rnd.randint(150, 900))) for _ in range(6)]
    docs = [(k, " ".join(rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefghij ", k=rnd.randint(1, 400))) for _ in range(rnd.randint(1, 4)))) for k in range(80)]
    docs += [(100, None), (101, ""), (102, "x" * 2000), (None, passages[0]), (103, docs[3][1]), (103, docs[3][1]), (104, "unique " + "".join(rnd.choices("qrst", k=500))), (0, docs[0][1])]
    want = brute(docs)
    rows = drop_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        c = r.chunked
        assert (c.n_bytes, c.n_removed, c.n_spans, bytes(c.kept)) == want[r.doc_id, r.text], r.doc_id


def test_insertions_move_few_chunks():
    data = random.Random(3).randbytes(20_000)
    a = {data[s:e] for s, e in chunked(data)}
    other = data[:5000] + b"inserted" + data[5000:]
    b = {other[s:e] for s, e in chunked(other)}
    assert len(b - a) < 6


def test_query_finds_long_repeated_passages(spark, sf_dir):
    want = {k[0]: v[:3] for k, v in brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op5_gear_chunks(spark, sf_dir).collect()} == want


def test_short_copies_go(spark):
    docs = [(1, "A short text of one line."), (2, "A short text of one line."), (3, "Another one.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: bytes(r.chunked.kept) for r in drop_repeated_chunks(df).collect()} == {1: docs[0][1].encode(), 2: b"", 3: docs[2][1].encode()}
    assert [r.chunked.n_removed for r in drop_repeated_chunks(df, shortest=100).collect()] == [0, 0, 0]
