import re
from collections import Counter

from wattline.llm.line_rules import clean_documents, judge, line_fault, op2_line_rules

PROSE = "The river ran past the old mill and the children watched it go. " * 3


def brute(text):
    """Base figures read off the definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {k + j for k, w in enumerate(windows) if w in twice for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "base_failed": n < 20 or 100 * len(repeated) > 30 * n,
    }


ODD = ["", None, " \n\t", "a b", "x\n" * 50, "a b c d e f g h " * 5, "é\u00a0x\u2003y z", "one\x1ctwo", "w " * 30000, "\n".join(["same line here"] * 4), "a\x0bb\x0cc\rd"]


def test_base_figures(spark, sf_dir):
    texts = ODD + [PROSE, PROSE + "\n" + PROSE] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        got = judge(text)
        assert {k: got[k] for k in brute(text)} == brute(text)
        assert not (got["base_failed"] and got["kept"])


def test_line_faults():
    fault = lambda line: line_fault(line, len(line.split()))
    assert fault("Home | News | Sport | Contact | About") == "navigation"
    assert fault("We use cookies to improve this site. Click here.") == "boilerplate"
    assert fault("Chapter") == "punctuation" and fault("### $$$ %%% &&& ***") == "punctuation" and fault("12 34 56.") == "punctuation"
    assert fault("She went home.") == "" and fault("A heading without a full stop") == ""


def test_documents_that_lose_too_much_go(spark):
    good = " ".join(f"Sentence{k} tells{k} of day{k} at sea{k}." for k in range(8))
    bad = "\n".join([f"Page {k} | Next | Last | Top | Index | More" for k in range(9)] + ["One true sentence stands here, which the others do not."])
    rows = [(1, good + "\nHome | A | B | C | D"), (2, bad), (3, None), (4, good), (4, good)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_chars long, kept string")
    out = clean_documents(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert got == [(1, good, len(good)), (4, good, len(good)), (4, good, len(good))]
    assert clean_documents(df.limit(0)).collect() == []


def test_query_and_clean_documents_stay(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op2_line_rules(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r.kept for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / max(1, len(bad)) < 0.2
