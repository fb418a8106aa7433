import pytest

from wattline.llm import mixing
from wattline.llm.mixing import MARGINS, TARGETS, cell_sums, margin_shares, mix, op8_mixing, probabilities, tokens_of, topic_of


def fitted(rows, targets, temperatures, sweeps=500):
    """Plain raking over a dictionary of cells."""
    weight = {k: float(n) for k, n in rows.items() if n}
    total = sum(weight.values())
    factor = dict.fromkeys(weight, 1.0)
    shares = []
    for m in range(3):
        sums = {}
        for k, n in weight.items():
            sums[k[m]] = sums.get(k[m], 0) + n
        shares.append(margin_shares(sums, targets.get(MARGINS[m]), temperatures.get(MARGINS[m], 1.0)))
    for _ in range(sweeps):
        for m in range(3):
            now = {}
            for k, n in weight.items():
                now[k[m]] = now.get(k[m], 0) + n * factor[k] / total
            factor = {k: f * (shares[m][k[m]] / now[k[m]] if now[k[m]] else 0) for k, f in factor.items()}
    return {k: f / max(factor.values()) for k, f in factor.items()}, shares


CELLS = {("a", "en", "prose"): 900, ("a", "fr", "prose"): 50, ("b", "en", "list"): 30, ("b", "de", "prose"): 20, (None, "en", "prose"): 10, ("b", "xx", "prose"): 5, ("a", "de", "list"): 7, (None, "fr", "list"): 3}


@pytest.mark.parametrize("most", [10_000, 2])
def test_probabilities_meet_the_margins(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    monkeypatch.setattr(mixing, "SWEEPS", 200 if most > 2 else 4)
    targets = {"lang": {"en": 0.5, "fr": 0.2, "de": 0.2}, "topic": {"prose": 0.8, "list": 0.2}}
    want, shares = fitted(CELLS, targets, {"source": 0.5}, 500 if most > 2 else 4)
    df = spark.createDataFrame([(*k, float(n), 1) for k, n in CELLS.items()], "source string, lang string, topic string, tokens double, n_docs long")
    got = {(r.source, r.lang, r.topic): r.probability for r in probabilities(df, targets, {"source": 0.5}).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
    if most > 2:
        weights = {k: CELLS[k] * got[k] for k in got}
        for m in range(3):
            for c, share in shares[m].items():
                assert sum(w for k, w in weights.items() if k[m] == c) / sum(weights.values()) == pytest.approx(share, abs=1e-4)


def test_sample_follows_the_targets(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mix(docs).collect()
    assert len(rows) > 1000
    total = sum(r.mixed.n_tokens for r in rows)
    for lang, share in TARGETS["lang"].items():
        assert sum(r.mixed.n_tokens for r in rows if r.lang == lang) / total == pytest.approx(share, abs=0.04)
    assert {r.doc_id for r in op8_mixing(spark, "/root/testdata/sf0.1").collect()} == {r.doc_id for r in rows}


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "s", "en"), (3, "a\tb  c\n", "s", "en"), (None, "x", "s", "de"), (4, "a | b | c | d", "t", "fr")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lang string, topic string")
    assert [r.n for r in df.select(tokens_of().alias("n")).collect()] == [0, 0, 0, 3, 1, 7]
    assert [r.t for r in df.select(topic_of().alias("t")).collect()] == ["empty"] * 3 + ["prose", "prose", "list"]
    out = mix(df)
    assert out.columns == [*df.columns, "mixed"] and {r.topic for r in out.collect()} <= {"clash"}
    assert mix(df.limit(0)).collect() == []
    assert cell_sums(df.limit(0).withColumn("n_tokens", tokens_of())).collect() == []


def test_topics_by_words_and_digits(spark):
    rows = [("\t\n \n",), ("12 345 6789",), ("a | b",), ("one two three four | five six",), ("one 2 three",)]
    df = spark.createDataFrame(rows, "text string")
    assert [r.t for r in df.select(topic_of().alias("t")).collect()] == ["empty", "record", "list", "prose", "prose"]
    assert [r.t for r in df.select(topic_of("text", tokens_of()).alias("t")).collect()] == ["empty", "record", "list", "prose", "prose"]


@pytest.mark.parametrize("most", [10_000, 2])
def test_languages_without_a_target_keep_their_share(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_CELLS", most)
    monkeypatch.setattr(mixing, "SWEEPS", 200 if most > 2 else 2)
    cells = [("a", "en", "prose", 70.0, 1), ("a", "fr", "prose", 20.0, 1), ("a", None, "prose", 6.0, 1), ("a", "xx", "prose", 4.0, 1)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double, n_docs long")
    p = {r.lang: r.probability for r in probabilities(df).collect()}
    kept = {lang: n * p[lang] for _, lang, _, n, _ in cells}
    assert kept[None] / sum(kept.values()) == pytest.approx(0.06, abs=1e-6) and kept["xx"] / sum(kept.values()) == pytest.approx(0.04, abs=1e-6)
