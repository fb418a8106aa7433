import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import phrase_names
from wattline.llm.common import mix64
from wattline.llm.phrase_names import SHIFTS, SLOTS, compare_with_next, fingerprint_column, fingerprints, likeness, likeness_column, op11_phrase_names, parse

ALL = 2**64 - 1
WORD = 0x9E3779B97F4A7C15


def mix(x):
    return int(mix64(np.array([x & ALL], dtype=np.uint64))[0])


def place(k):
    return mix((k + 1) * WORD) | 1


def plain_level(names):
    """One level of parsing of one text, symbol by symbol."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if r == 1 else mix(x * place(8) + r) for x, r in runs]
    labels = names
    for _ in range(4):
        after = []
        for k, x in enumerate(labels):
            left = labels[k - 1] if k else x ^ 1
            bit = next(b for b in range(64) if (x ^ left) >> b & 1)
            after.append(2 * bit + (x >> bit & 1))
        labels = after
    assert all(x < 6 for x in labels) and all(a != b for a, b in zip(labels, labels[1:], strict=False))
    for gone in (5, 4, 3):
        labels = [x if x != gone else min({0, 1, 2} - set(labels[max(0, k - 1) : k] + labels[k + 1 : k + 2])) for k, x in enumerate(labels)]
    n = len(labels)
    tops = {k for k in range(1, n - 1) if labels[k] > labels[k - 1] and labels[k] > labels[k + 1]}
    lows = {k for k in range(1, n - 1) if labels[k] < labels[k - 1] and labels[k] < labels[k + 1] and not {k - 1, k + 1} & tops}
    begins = sorted({0} | {k for k in tops | lows if k > 1})
    blocks = [names[a:b] for a, b in zip(begins, begins[1:] + [n], strict=True)]
    assert all(len(b) > 1 for b in blocks) or n == 1
    return [mix(sum(x * place(k) for k, x in enumerate(b)) + len(b) * WORD) for b in blocks]


def plain_fingerprint(text):
    names, level, ranks = [ord(c) for c in text], 0, set()
    while names:
        names = plain_level(names)
        ranks |= {x >> 24 << SHIFTS[min(level, 2)] for x in names}
        level += 1
        if len(names) == 1:
            break
    return "".join(f"{x:012x}" for x in sorted(ranks)[:SLOTS])


def samples():
    rnd = random.Random(4)
    letters = "abcdefghij klmno é世\n"
    out = ["", "a", "ab", "aa", "a" * 500, "ab" * 300, "abc" * 40, "\U0001f600" * 3 + "x", "same line\n" * 200]
    out += ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(40)]
    out += ["".join(rnd.choices(letters, k=rnd.randint(1000, 4000))) for _ in range(4)]
    return out


def test_against_symbol_by_symbol(monkeypatch):
    texts = samples()
    want = [plain_fingerprint(t) for t in texts]
    assert fingerprints(texts) == want
    monkeypatch.setattr(phrase_names, "SLICE", 50)
    assert fingerprints(texts) == want and fingerprints([]) == []


def test_equal_substrings_share_phrases_at_any_offset():
    rnd = random.Random(5)
    inner = "".join(rnd.choices("abcdefghij klmnop", k=3000))
    names = []
    for before in ("", "x", "some other words before it ", inner[::-1]):
        symbols = np.frombuffer((before + inner + before[:7]).encode("utf-32-le"), dtype=np.uint32)
        names.append([set(n.tolist()) for _, n in parse(symbols, np.array([len(symbols)]))])
    for other in names[1:]:
        for level in range(5):
            assert len(names[0][level] & other[level]) >= len(names[0][level]) - 12


def test_likeness_follows_the_shared_part():
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghijklmnopqrst", k=rnd.randint(2, 9))) for _ in range(5000)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    a, b = text(4000), text(4000)
    half = a[: len(a) // 2] + b[: len(b) // 2]
    fa, fb, fh, shifted = fingerprints([a, b, half, "one more " + a])
    assert likeness(fa, fa) == 1 and likeness(fa, fb) < 0.1 and 0.35 < likeness(fa, fh) < 0.65 and likeness(fa, shifted) > 0.9
    assert likeness("", "") == 1 and likeness("", fa) == 0 == likeness(fa, "")


def brute(docs):
    key = lambda x: -(2**63) if x is None else x
    heads = {}
    for i, t in docs:
        heads[key(i)] = min(heads.get(key(i), t or ""), t or "", key=str.encode)
    order = sorted(heads, reverse=True)
    out = []
    for i, t in docs:
        t = t or ""
        after = heads[order[(order.index(key(i)) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        f, e, n = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, round(likeness(f, e), 9), round(likeness(f, n), 9)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shape", ["mixed", "hot", "one", "repeated"])
def test_compare_with_next(spark, shape):
    rnd = random.Random(7)
    texts = samples()
    docs = [(rnd.randrange(-10, 1000), rnd.choice(texts)) for _ in range(60)]
    if shape == "mixed":
        docs += [(None, "null id"), (5, None), (5, ""), (5, "b"), (2**62, "large"), (-(2**62), "small")]
    elif shape == "hot":
        docs += [(77, rnd.choice(texts)) for _ in range(150)] + [(None, t) for t in texts]
    elif shape == "one":
        docs = [(3, "only one document here")]
    else:
        docs = docs[:5] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("span", F.lit(1)).withColumn("id", F.lit("x")).withColumn("own", F.lit(None))
    assert found(compare_with_next(df.repartition(3))) == brute(docs)


def test_hot_ids_are_dealt_over_parts(spark):
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(70)).otherwise(F.col("id")).alias("id"))
    spans = phrase_names.Spans(ids)
    assert spans.parts.get(70, 1) > 2 and len([g for g in spans.guests() if g[2]]) == spans.parts[70] - 1


def test_empty_table_and_letter_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert compare_with_next(empty).collect() == [] and compare_with_next(empty).columns[0] == "doc_id"
    rows = compare_with_next(spark.createDataFrame([("a", "x y"), ("b", "z")], "key string, body string"), "key", "body").collect()
    assert len(rows) == 2 and all(0 <= r.near_next <= 1 for r in rows)


def test_columns(spark):
    df = spark.createDataFrame([("abc", "abc"), (None, ""), ("a", None)], "a string, b string")
    rows = df.select(fingerprint_column(F.col("a")).alias("f"), fingerprint_column(F.col("b")).alias("g")).select(likeness_column(F.col("f"), F.col("g"))).collect()
    assert [r[0] for r in rows] == [1.0, 1.0, 0.0]


def test_query_over_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op11_phrase_names(spark, sf_dir).collect()
    assert len(rows) == docs.count() == len({r.doc_id for r in rows})
    assert {r.doc_id: r.n_chars for r in rows} == {r.doc_id: len(r.text or "") for r in docs.collect()}
    assert sum(r.near_edited for r in rows) / len(rows) > 0.4 and sum(r.near_next for r in rows) / len(rows) < 0.2
