"""Each stage of the pipeline against a plain version on the rows that the stage before kept."""

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_shingle_join import shingles
from wattline.llm.line_rules import judge
from wattline.llm.pii_spans import KINDS, detect, find_spans, redact


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality(stages):
    want = {r.doc_id: judge(r.text) for r in stages[0].collect()}
    assert {r.doc_id: r.text for r in stages[1].collect()} == {k: v["clean_text"] for k, v in want.items() if v["kept"]}


def test_near_duplicates(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    sets = {d: shingles(t, 5) for d, t in rows}
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for d in sets:
        for e in sets:
            if e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    assert {r.doc_id: r.text for r in stages[2].collect()} == {d: t for d, t in rows if find(d) == d}


def test_personal_data(stages):
    want = {}
    for r in stages[2].collect():
        base, added = find_spans(r.text)
        want[r.doc_id] = redact(r.text, {k: base[k] + added[k] for k in KINDS})
    got = {r.doc_id: r.text for r in stages[3].collect()}
    assert got == want and not any(found for t in got.values() for found in detect(t).values())


def test_mixing(stages):
    before = {r.doc_id: tuple(r) for r in stages[3].collect()}
    after = {r.doc_id: tuple(r) for r in stages[4].collect()}
    assert 0 < len(after) < len(before) and all(before[d] == v for d, v in after.items())


def test_encoding(stages):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == len(texts) and all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)
