import hashlib
import random

import pytest
from tokenizers import Tokenizer

from wattline.llm.bpe_lexicon import Encoder, Lexicon, Merges, compile_lexicon, decode_column, encode_column, fit_lexicon, op4_bpe_lexicon, prepare, tokenizer_content

ODD = ["", "  ", "a  b", "\n\n a", "it's don't 's", "<|endoftext|>x <|endoftext|>", "a\x00b \x00c", "x" * 500, "ab" * 200, "   x", "é" * 300, "日本語 テキスト 123 ½", "a \n", "tab\tb  \t c", " lead", "\0the the", "of,of ,of"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def merges():
    return Merges(tokenizer_content())


def test_lexicon_holds_its_words_and_shares_suffixes(merges):
    rnd = random.Random(4)
    words = {("".join(rnd.choices("abc", k=rnd.randint(1, 6))) + rnd.choice(["tion", "ing", ""])).encode() for _ in range(3000)}
    lexicon = Lexicon(compile_lexicon({w: merges.merge(w) for w in words}))
    assert all(lexicon.get(w) == merges.merge(w) for w in words) and lexicon.words == len(words)
    assert all(lexicon.get(w + b"z") is None and (w[:-1] in words or lexicon.get(w[:-1]) is None) for w in words)
    assert lexicon.states < sum(map(len, words)) / 4
    assert Lexicon(compile_lexicon({})).get(b"a") is None


def test_against_the_library(library, merges, spark, sf_dir):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice(" \n\tab'sé日1.,<|>") for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    encoder = Encoder(merges, Lexicon(compile_lexicon({w: merges.merge(w) for w in (b" the", b" of", b" le")})))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query(library, spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op4_bpe_lexicon(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_columns_nulls_and_empty_tables(library, merges, spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*ODD, None])], "doc_id long, text string, ids int")
    handle = prepare(df, words=5)
    rows = df.withColumn("x", encode_column(handle, "text")).withColumn("back", decode_column(handle, "x")).collect()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.x == ids and r.back == library.decode(ids, skip_special_tokens=False)
    assert Lexicon(fit_lexicon(df.limit(0), merges)).words == 0
