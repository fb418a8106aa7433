"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go.

Edge cases: a null or empty text has no words, fails the base rule and is not kept; lines without a word are neither
judged nor counted; repeated rows are judged each for themselves and alike; other columns of the input stay untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import free_names, read_table, schema

SPACE = " \t\n\v\f\r"
SYMBOLS = re.compile(r"[#*$%&|<>]")
TERMINAL = tuple(".!?…:;\"'”’»)。！？")
SEPARATORS = re.compile(r"[|>»›·•/]")
LETTERS = re.compile(r"[^\W\d_]")
#: Phrases of our own choice that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright", "©", "javascript", "subscribe to",
    "sign up for", "click here", "read more", "share this", "share on", "follow us", "log in", "powered by", "lorem ipsum",
    "permission is hereby granted", "licensed under", "datenschutz", "impressum", "mentions légales", "tous droits réservés",
    "todos los derechos reservados", "alle rechte vorbehalten",
)
#: A line fails the punctuation rule if it doesn't end a sentence and has fewer words than this.
MIN_OPEN_WORDS = 3
#: ... or if it has as many of the symbols above as words, and so many at least.
MIN_MARKS = 4
#: A line fails the navigation rule if it has at least this many separators and at most this many words for each.
MIN_SEPARATORS, WORDS_PER_SEPARATOR = 3, 3
#: A boilerplate phrase condemns lines of at most this many words.
BOILERPLATE_WORDS = 40
#: Documents that keep a smaller share of their words are rejected.
MIN_KEPT = 0.6


def line_fault(line: str, words: int, phrases: tuple[str, ...] = BOILERPLATE) -> str:
    """The first rule that a line of so many words breaks, or ''; phrases: those to look for."""
    separators = len(SEPARATORS.findall(line))
    if separators >= MIN_SEPARATORS and words - separators <= WORDS_PER_SEPARATOR * separators:
        return "navigation"
    if phrases and words <= BOILERPLATE_WORDS and any(p in line.lower() for p in phrases):
        return "boilerplate"
    if words < MIN_OPEN_WORDS and not line.rstrip().endswith(TERMINAL):
        return "punctuation"
    return "punctuation" if len(SYMBOLS.findall(line)) >= max(words, MIN_MARKS) or not LETTERS.search(line) else ""


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """How many words stand in a window of `width` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    last = dict(zip(words, range(len(words)), strict=True))
    if len(last) == len(words):
        return 0
    ids = np.array([last[w] for w in words], dtype=np.int64)
    span = 1
    while span < width:  # exact names for windows of 2, 4 and 8 words
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        names, ids = np.unique(pairs, return_inverse=True)
        if len(names) == len(ids):
            return 0
        span *= 2
    twice = np.bincount(ids)[ids] > 1
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    steps[:-width] += twice
    steps[width:] -= twice
    return int((np.cumsum(steps[:-1]) > 0).sum())


def judge(text: str | None) -> dict:
    """Base figures, the verdict and what is left of the text."""
    text = text or ""
    words = text.encode().split()  # bytes.split() knows exactly the six ASCII spaces
    seen, kept, faults = set(), [], {"navigation": 0, "boilerplate": 0, "punctuation": 0}
    low = text.lower()
    phrases = tuple(p for p in BOILERPLATE if p in low)
    dup_lines = lost_words = n_lines = 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            n_lines += 1
            dup_lines += line in seen
            seen.add(line)
            if fault := line_fault(line, n, phrases):
                faults[fault] += 1
                lost_words += n
                continue
        kept.append(line)
    n_words, repeats = len(words), repeated_words(words)
    failed = n_words < 20 or 100 * repeats > 30 * n_words
    return {
        "n_words": n_words,
        "word_chars": len(text) - sum(text.count(c) for c in SPACE),
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": not failed and n_words - lost_words >= MIN_KEPT * n_words,
        "n_lines": n_lines,
        "n_lines_removed": sum(faults.values()),
        "n_navigation": faults["navigation"],
        "n_boilerplate": faults["boilerplate"],
        "n_punctuation": faults["punctuation"],
        "clean_text": "\n".join(kept),
    }


FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_lines_removed long, n_navigation long, n_boilerplate long, n_punctuation long"
)
NAMES = [x.split()[0] for x in FIGURES.split(", ")]


@F.pandas_udf(schema(FIGURES))
def line_figures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(x) for x in texts], columns=NAMES)


@F.pandas_udf(schema("kept boolean, clean_text string"))
def line_cleaned(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judge(x) for x in texts], columns=["kept", "clean_text"])


def judge_lines(text: str | Column = "text") -> Column:
    """A struct of figures and verdict for a text column."""
    return line_figures(F.col(text) if isinstance(text, str) else text)


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents that pass, their failing lines taken out; `n_chars` follows the new text."""
    # Not deterministic by declaration only, so that the filter below doesn't make a second evaluation of it.
    (clean,) = free_names(docs, "clean")
    out = docs.withColumn(clean, line_cleaned.asNondeterministic()(F.col(text))).where(F.col(clean)["kept"])
    out = out.withColumn(text, F.col(clean)["clean_text"].cast(docs.schema[text].dataType)).drop(clean)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars and n_chars in docs.columns else out


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", judge_lines().alias("j")).select("doc_id", "j.*")
