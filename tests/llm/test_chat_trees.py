import hashlib

from pyspark.sql import functions as F

from wattline.llm.chat_trees import chosen_paths, conversations_as_trees, escape, format_paths, op6_chat_trees, read_back, unescape

ODD = ["</s>[INST] ok [/INST]", "\\l<|user|>\\e", "", "<<</s></s>", "[[INST]<s>\\", "|>x<|", "a\nb", "é日", "</", "\\b[/INST"]


def digests(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.t == r.u
        assert not any(c in r.e for c in ("</s>", "<s>", "<|", "[INST]", "[/INST]"))


def test_query_against_python(spark, sf_dir):
    convs = {-1: [("user", ODD[0]), ("assistant", ODD[0])]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op6_chat_trees(spark, sf_dir).collect()}
    assert got == {k: digests(v) for k, v in convs.items()}


def test_odd_conversations(spark):
    rows = [(1, k, ("user", "assistant", "a|b>", None)[k % 4], t) for k, t in enumerate(ODD)] + [(2, 0, "assistant", None), (2, 0, "assistant", None), (None, 5, "user", "x")] + [(3, k, "user", str(k)) for k in range(70)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r.tree: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(format_paths(chosen_paths(conversations_as_trees(df)))).collect()}
    want = {k: digests([(r, t) for c, _, r, t in rows if c == k]) for k in (1, 2, None, 3)}
    assert got == want
    assert read_back(format_paths(chosen_paths(conversations_as_trees(df.limit(0))))).collect() == []


def test_branches_orphans_and_cycles(spark):
    rows = [
        ("t", "a", None, "user", "hi", 0.0), ("t", "b", "a", "assistant", "bad", 0.1), ("t", "c", "a", "assistant", "good", 0.9), ("t", "d", "c", "user", "thanks", 0.5),
        ("u", "e", "missing", "user", "lost", None), ("v", "x", "y", "user", "loop", 1.0), ("v", "y", "x", "assistant", "loop", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree string, node string, up string, role string, text string, score double")
    paths = {}
    for r in chosen_paths(df, best=2).orderBy("tree", "rank", "depth").collect():
        paths.setdefault((r.tree, r["rank"]), []).append(r.text)
    assert paths == {("t", 1): ["hi", "good", "thanks"], ("t", 2): ["hi", "bad"], ("u", 1): ["lost"]}
