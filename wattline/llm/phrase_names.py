"""Fingerprints from locally consistent parsing.

A text is a sequence of symbols (code points). One level of parsing turns it into a sequence of phrases, each with a 64-bit
name that is a function of its characters' names alone: runs of one symbol become one symbol; deterministic coin tossing
(the lowest bit in which a symbol differs from its left neighbour, and that bit's value) shrinks the alphabet to six labels
in four rounds, three more rounds leave three labels, and local maxima, then minima away from maxima, begin phrases of two
symbols and more. A level's boundaries depend on a few symbols around them only, so equal substrings get equal phrases
inside, whatever comes before them and wherever they start; levels are parsed until one symbol, the root, is left.

A fingerprint is the SLOTS smallest ranks of the distinct phrases of all levels (a bottom-k sketch). Phrases of the lowest
levels are two to six characters that all texts of a language share: their ranks are shifted up by SHIFTS bits, so they count
in short texts only. The likeness of two fingerprints is the Dice coefficient of the sketched phrase sets.

Edge cases: null and empty texts have the empty fingerprint, of likeness 1 to each other and 0 to all else; equal texts have
equal fingerprints at any position of any table; texts are parsed whole, and a text that is longer than a slice is a slice of
its own. For `compare_with_next`: the next document is the one of the next smaller id (the largest after the smallest; with
one id, itself); rows that repeat an id all follow the next larger id, whose next text is the smallest of the texts of that
id; a null id counts as -2^63; other columns aren't carried, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import NO_ID, id_column, mix64, read_table, schema, text_column

#: Ranks in a fingerprint, hexadecimal digits of each, and bits by which the ranks of the lowest levels are shifted up.
SLOTS, DIGITS, SHIFTS = 64, 12, (8, 4, 0)
#: Code points that are parsed at once, unless one text is longer.
SLICE = 200_000
#: Sampled ids for each span of neighbouring ids, and spans for each shuffle partition.
SAMPLED, SPANS = 32, 4

_WORD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = mix64(np.arange(1, 17, dtype=np.uint64) * _WORD) | np.uint64(1)
_NONE = 7


def _toss_table() -> np.ndarray:
    left, own = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differ = (left ^ own).astype(np.uint8)
    bit = np.bitwise_count((differ & -differ) - np.uint8(1)) & 7
    return (2 * bit + ((own >> bit) & 1)).astype(np.uint8).ravel()


def _triples() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """By left << 6 | own << 3 | right, where _NONE is the end of the text: the rounds that remove the labels 5, 4 and 3, and what is a
    maximum or a minimum inside a text."""
    left, own, right = (x.ravel() for x in np.meshgrid(*[np.arange(8)] * 3, indexing="ij"))
    free = np.select([(left != k) & (right != k) for k in range(3)], range(3)).astype(np.uint8)
    inside = (left != _NONE) & (right != _NONE)
    return [np.where(own == k, free, own).astype(np.uint8) for k in (5, 4, 3)], inside & (own > left) & (own > right), inside & (own < left) & (own < right)


_TOSS = _toss_table()
_REDUCE, _MAXIMUM, _MINIMUM = _triples()


def _triple(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = labels.astype(np.uint16) << 3
    out[1:] |= np.where(first[1:], _NONE, labels[:-1]).astype(np.uint16) << 6
    out[:-1] |= np.where(first[1:], _NONE, labels[1:])
    out[0] |= _NONE << 6
    out[-1] |= _NONE
    return out


def _landmarks(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin, for texts without equal neighbours; first marks the first symbol of each text."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = names[first] ^ np.uint64(1)
    differ = names ^ left
    bit = np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.uint64) & np.uint64(63)
    labels = (2 * bit + ((names >> bit) & np.uint64(1))).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[first] = labels[first] ^ 1
        labels = _TOSS[(before.astype(np.uint16) << 7) | labels]
    for table in _REDUCE:
        labels = table[_triple(labels, first)]
    at = _triple(labels, first)
    top, out = _MAXIMUM[at], _MINIMUM[at]
    out[1:] &= ~top[:-1]
    out[:-1] &= ~top[1:]
    out |= top
    out[1:] &= ~first[:-1]  # the first phrase has two symbols at least
    return out | first


def parse(symbols: np.ndarray, sizes: np.ndarray):
    """Level by level, for texts that lie one behind the other: (row, name) of every phrase, until each text is one phrase."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    names = symbols.astype(np.uint64)
    while len(names):
        first = np.empty(len(names), dtype=bool)
        first[0], first[1:] = True, row[1:] != row[:-1]
        begins = first.copy()
        begins[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(begins)
        if len(at) < len(names):
            run = np.diff(at, append=len(names)).astype(np.uint64)
            names, row, first = names[at], row[at], first[at]
            names = np.where(run > 1, mix64(names * _PLACE[8] + run), names)
        at = np.flatnonzero(_landmarks(names, first))
        size = np.diff(at, append=len(names))
        place = np.arange(len(names)) - np.repeat(at, size)
        names = mix64(np.add.reduceat(names * _PLACE[place], at) + size.astype(np.uint64) * _WORD)
        row = row[at]
        yield row, names
        more = np.bincount(row, minlength=len(sizes))[row] > 1
        names, row = names[more], row[more]


def _ranks(texts: list[str]) -> list[np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows, ranks = [], []
    for level, (row, names) in enumerate(parse(symbols, sizes)):
        rows.append(row)
        ranks.append((names >> np.uint64(24)) << np.uint64(SHIFTS[min(level, len(SHIFTS) - 1)]))
    if not rows:
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    high = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *rows[len(SHIFTS) - 1 :]]), minlength=len(texts))
    row, rank = np.concatenate(rows).astype(np.uint64), np.concatenate(ranks)
    # Four times as many of a text's ranks as needed lie under this bound on average; where too few do, all are looked at.
    bound = np.minimum(2.0**48, 2.0**40 * 4 * SLOTS / np.maximum(high, 1))
    low = rank < bound.astype(np.uint64)[row.astype(np.int64)]
    keys = np.unique((row[low] << np.uint64(48)) | rank[low])
    count = np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(texts))
    few = (count < SLOTS)[row.astype(np.int64)] & ~low
    if few.any():
        keys = np.unique(np.concatenate([keys, (row[few] << np.uint64(48)) | rank[few]]))
    cut = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(48))
    keys &= np.uint64(2**48 - 1)
    return [keys[a : min(b, a + SLOTS)] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fingerprints(texts: list[str]) -> list[str]:
    """The ranks of each text in ascending order, as hexadecimal digits one behind the other."""
    out, start, size = [], 0, 0
    for end in range(len(texts) + 1):
        if end == len(texts) or (end > start and (size + len(texts[end]) > SLICE or end - start >= 2**15)):
            out += ["".join([f"{x:0{DIGITS}x}" for x in ranks.tolist()]) for ranks in _ranks(texts[start:end])]
            start, size = end, 0
        if end < len(texts):
            size += len(texts[end])
    return out


def likeness(one: str, other: str) -> float:
    """The Dice coefficient of the phrases behind two fingerprints, judged on the ranks that both know all about."""
    if one == other:
        return 1.0
    a, b = ({s[k : k + DIGITS] for k in range(0, len(s), DIGITS)} for s in (one, other))
    full = [s[-DIGITS:] for s in (one, other) if len(s) == SLOTS * DIGITS]
    if full:
        known = min(full)
        a, b = {x for x in a if x <= known}, {x for x in b if x <= known}
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.tolist()))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def likeness_column(one: Column, other: Column) -> Column:
    """The likeness of two fingerprint columns, 0 to 1; null where one is null."""

    @F.pandas_udf("double")
    def run(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else likeness(a, b) for a, b in zip(one, other, strict=True)], dtype="float64")

    return run(one, other)


class Spans:
    """Ranges of neighbouring ids of about equal numbers of rows, from a sample of bounded size. An id that fills a range alone
    is one, and its rows are dealt further by their texts."""

    def __init__(self, ids: DataFrame):
        spark = ids.sparkSession
        self.wanted = SPANS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = ids.count()
        sampled = sorted(r[0] for r in ids.sample(min(1.0, SAMPLED * self.wanted / max(1, rows)), seed=11).collect())
        step = max(1, len(sampled) // self.wanted)
        counts = Counter(sampled)
        self.parts = {x: -(-c // step) for x, c in counts.items() if c >= 2 * step}
        self.starts = np.array(sorted({*sampled[::step], *self.parts, *(x + 1 for x in self.parts if x < 2**63 - 1)}), dtype=np.int64)
        # The last id of every span that has rows: as many rows as spans.
        tops = ids.groupBy(self.number(F.col("id")).alias("span")).agg(F.max("id").alias("id")).collect()
        self.tops = sorted((r.span, r.id) for r in tops)

    def number(self, ids: Column) -> Column:
        starts = self.starts

        @F.pandas_udf("int")
        def run(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(starts, ids.to_numpy(), side="right").astype(np.int32))

        return run(ids)

    def part(self, ids: Column, by: Column) -> Column:
        """Which part of its span a row goes to: 0 but for ids that fill a span."""
        if not self.parts:
            return F.lit(0)
        parts = F.create_map(*[F.lit(x) for pair in sorted(self.parts.items()) for x in pair])
        return F.coalesce(F.pmod(F.xxhash64(by), F.element_at(parts, ids)).cast("int"), F.lit(0))

    def guests(self) -> list[tuple[int, int, int]]:
        """(id, span, part): whose text must be known where, because the smallest id there has it as its next document's."""
        out = []
        for k, (span, top) in enumerate(self.tops):
            for part in range(self.parts.get(top, 1)):
                out.append((self.tops[k - 1][1], span, part))
        return out


_COMPARED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    """Rows sorted by span, part, guest first, id, text: every id's next document is that of the id before it."""
    where, following, leading = None, "", ""
    for batch in batches:
        span, part, own, ids, new = (batch.column(k).to_pylist() for k in range(5))
        texts, behind, place, lead = [following, leading, *new], [], 0, 1
        for k, key in enumerate(zip(span, part, own, ids, strict=True)):
            if key != where:
                if own[k]:
                    place = lead
                lead, where = k + 2, key
            behind.append(place)
        rows = [k for k in range(len(new)) if own[k]]
        following, leading = texts[place], texts[lead]
        prints = fingerprints(texts)
        edited = [new[k][: len(new[k]) - len(new[k]) // 2] + texts[behind[k]][: len(new[k]) // 2] for k in rows]
        changed = fingerprints(edited)
        yield pa.RecordBatch.from_pydict(
            {
                "id": [ids[k] for k in rows],
                "n_chars": [len(new[k]) for k in rows],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": [prints[k + 2] for k in rows],
                "edited_fingerprint": changed,
                "near_edited": [likeness(prints[k + 2], c) for k, c in zip(rows, changed, strict=True)],
                "near_next": [likeness(prints[k + 2], prints[behind[k]]) for k in rows],
            },
            schema=pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
        )


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: its fingerprint, that of the text whose second half the start of the next document's text
    replaced, and how like its own both this and the next document's are.

    Texts are shuffled once, to spans of neighbouring ids; a span knows the text that its first id needs from the span before
    it. What reaches the driver is a bounded sample of ids and one id for each span."""
    spark = docs.sparkSession
    rows = docs.select(id_column(docs, doc_id).alias("id"), text_column(text).alias("text"))
    spans = Spans(rows.select("id"))
    if not spans.tops:
        return spark.createDataFrame([], schema(_COMPARED.replace("id long", f"{doc_id} long", 1)))
    placed = rows.select(spans.number(F.col("id")).alias("span"), spans.part(F.col("id"), F.col("text")).alias("part"), F.lit(1).alias("own"), "id", "text")
    guests = spark.createDataFrame(spans.guests(), schema("id long, span int, part int"))
    known = rows.join(F.broadcast(guests.select("id").distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
    known = known.join(F.broadcast(guests), "id").select("span", "part", F.lit(0).alias("own"), "id", "text")
    sorted_rows = placed.unionByName(known).repartition("span", "part").sortWithinPartitions("span", "part", "own", "id", "text")
    out = sorted_rows.mapInArrow(_compare, schema(_COMPARED))
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", doc_id)


def op11_phrase_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
