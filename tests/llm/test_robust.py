"""Operators and pipeline stages on nulls, empty and very long texts, repeated rows, empty tables and columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattline.llm.gear_chunks import drop_repeated_chunks
from wattline.llm.line_rules import clean_documents
from wattline.llm.mixing import mix
from wattline.llm.pii_spans import redact_documents
from wattline.llm.shingle_join import keep_first
from wattline.llm.suffix_dedup import drop_repeated_strings

CASES = {
    "op1": redact_documents,
    "op2": clean_documents,
    "op5": drop_repeated_chunks,
    "op7": keep_first,
    "op8": mix,
    "op9": drop_repeated_strings,
    **{name: (lambda stage: lambda docs: stage(docs.sparkSession, docs, ""))(stage) for name, stage in corpus_pipeline.STAGES},
}
CLASHING = ("doc", "th", "plain", "starts", "ends", "__s", "__t", "__doc", "__th", "clean", "__clean", "own_lang", "cell_source", "cell_probability", "_OWN_topic", "cls", "size", "token")
ADDED = {"op5": "chunked", "op8": "mixed", "op9": "dedup"}


def documents(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(300)]
    prose = [". ".join(" ".join(rnd.choices(words, k=9)) for _ in range(rnd.randint(3, 12))) + "." for _ in range(20)]
    texts = [None, "", " \n\t ", *prose, prose[0], prose[1] + " " + prose[2], " ".join(rnd.choices(words, k=50_000)), "x" * 300_000, " " * 300_000, "dot" + " " * 100_000 + "x", "mail a@b.org or +1 212 555 0100 now"]
    rows = [(k, t, rnd.choice(["en", "fr", "xx", None]), rnd.choice(["web", "book", None]), len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose[3], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def plain(df, names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("name", CASES)
def test_clashing_columns_change_nothing(spark, name):
    docs, f = documents(spark), CASES[name]
    alone = f(docs)
    wide = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in CLASHING})
    if name in ADDED:
        wide = wide.withColumn(ADDED[name], F.lit("given"))
    out = f(wide)
    assert plain(alone, alone.columns) == plain(out, alone.columns)
    if name != "encoding":
        assert set(CLASHING) <= set(out.columns) and len(out.columns) == len(set(out.columns))
        for r in out.select("doc_id", *CLASHING).collect():
            assert all(r[c] == c + str(-1 if r.doc_id is None else r.doc_id) for c in CLASHING)


@pytest.mark.parametrize("name", CASES)
def test_empty_table(spark, name):
    assert CASES[name](documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op5", "op7", "op8", "op9"])
def test_ids_of_letters(spark, name):
    docs, f = documents(spark), CASES[name]
    n = f(docs.where("doc_id is not null")).count()
    named = f(docs.where("doc_id is not null").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))))
    assert named.schema["doc_id"].dataType.simpleString() == "string"
    assert name == "op8" or named.count() == n
