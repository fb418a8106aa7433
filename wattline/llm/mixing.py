"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probability.

Tokens are summed by cell (source, language, topic). Raking scales the cells until the source, language and topic margins
have their target shares; a document is kept with the probability of its cell, the cell's factor over the largest factor,
decided by a hash of its id, text and the seed, so a run can be repeated and a lost task recomputed.

Cells are one row for each combination that occurs, summed before the shuffle. Up to MOST_CELLS of them (a few MB) are
raked on the driver; beyond that the same steps run as DataFrame sums, so their number isn't limited.

Edge cases: null source, language or topic are categories of their own; categories without a target share keep their own
share of what the targets leave (or their own share of all tokens if they leave nothing); targets for categories that don't occur are ignored
and the others scaled up; documents without a token have weight 0 and follow their cell; rows that repeat id and text are
kept or dropped together; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import free_names, id_column, materialise, read_table, text_column

MARGINS = ("source", "lang", "topic")
#: Production targets: languages by share; sources and topics by a power of their own share, which lifts the small ones
#: without letting the rarest set the scale for all.
TARGETS = {"lang": {"en": 0.5, "fr": 0.2, "de": 0.18, "es": 0.12}}
TEMPERATURES = {"source": 0.5, "topic": 0.9}
SWEEPS, CLOSE, MOST_CELLS, SEED = 200, 1e-9, 200_000, 17
#: Shares are given to so many digits, so that sums in any order sample alike.
DIGITS = 12


def tokens_of(text: str | Column = "text") -> Column:
    """The number of words of a text."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(column, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def topic_of(text: str | Column = "text", n_tokens: Column | None = None) -> Column:
    """A coarse topic from a text's form, for tables without such a column: empty (no word), list (a bar for every four words
    at least), record (more digits than words) or prose. n_tokens: the text's words where they were counted before."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = tokens_of(column) if n_tokens is None else n_tokens
    bars = F.length(column) - F.length(F.replace(column, F.lit(" | "), F.lit("  ")))
    digits = F.length(column) - F.length(F.regexp_replace(column, "[0-9]+", ""))
    return F.when(words == 0, "empty").when(4 * bars > words, "list").when(digits > words, "record").otherwise("prose")


def left_over(targets: dict, own: float) -> float:
    """The share of all categories without a target: what the targets leave, or their own if that is nothing."""
    free = 1 - sum(targets.values())
    return free if free > CLOSE else own


def margin_shares(sums: dict, targets: dict | None, temperature: float = 1.0) -> dict:
    """The target share of each category that occurs. sums: its tokens."""
    total = sum(sums.values()) or 1
    if targets is None:
        powers = {c: (n / total) ** temperature if n else 0.0 for c, n in sums.items()}
        return {c: p / (sum(powers.values()) or 1) for c, p in powers.items()}
    named = {c: targets[c] for c, n in sums.items() if c in targets and n}
    rest = {c: n for c, n in sums.items() if c not in targets}
    free = left_over(targets, sum(rest.values()) / total) if rest and sum(rest.values()) else 0.0
    scale = (1 - free) / (sum(named.values()) or 1)
    return {c: named[c] * scale if c in named else free * rest[c] / sum(rest.values()) if c in rest and free else 0.0 for c in sums}


def rake(cells: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """The factor of each cell after fitting the margins in turn until all of them hold."""
    weight = cells / cells.sum()
    factor = np.ones(len(cells))
    for _ in range(SWEEPS):
        worst = 0.0
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, weight * factor, minlength=len(share))
            worst = max(worst, float(np.abs(now - share).max()))
            factor *= np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
        if worst < CLOSE:
            break
    return factor


def cell_sums(docs: DataFrame) -> DataFrame:
    """docs: source, lang, topic, n_tokens. One row for each combination."""
    return docs.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("n_docs"))


def probabilities(cells: DataFrame, targets: dict = TARGETS, temperatures: dict = TEMPERATURES) -> DataFrame:
    """(source, lang, topic, probability) of each cell; targets: shares by margin, a missing margin follows the temperatures."""
    spark = cells.sparkSession
    cells = materialise(cells, "cells")
    if cells.count() > MOST_CELLS:
        return _probabilities_of_many(cells, targets, temperatures)
    rows = cells.orderBy(*MARGINS).collect()
    kept = [r for r in rows if r.tokens]
    factor = np.zeros(0)
    if kept:
        codes, shares = [], []
        for margin in MARGINS:
            names = {c: k for k, c in enumerate(dict.fromkeys(r[margin] for r in kept))}
            code = np.array([names[r[margin]] for r in kept])
            sums = np.bincount(code, [r.tokens for r in kept])
            wanted = margin_shares(dict(zip(names, sums.tolist(), strict=True)), targets.get(margin), temperatures.get(margin, 1.0))
            codes.append(code)
            shares.append(np.array([wanted[c] for c in names]))
        factor = rake(np.array([r.tokens for r in kept]), codes, shares)
        factor = np.round(factor / factor.max(), DIGITS)
    by_cell = {tuple(r[m] for m in MARGINS): p for r, p in zip(kept, factor.tolist(), strict=True)}
    out = [(*(r[m] for m in MARGINS), float(by_cell.get(tuple(r[m] for m in MARGINS), 1.0))) for r in rows]
    # At most MOST_CELLS rows, so they may be broadcast.
    return F.broadcast(spark.createDataFrame(out, ", ".join(f"{m} string" for m in MARGINS) + ", probability double"))


def _probabilities_of_many(cells: DataFrame, targets: dict, temperatures: dict) -> DataFrame:
    """The same raking with margins as DataFrames; categories may be as many as there are rows."""
    spark = cells.sparkSession
    state = cells.withColumn("key", F.struct(*MARGINS)).withColumn("w", F.col("tokens") / F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 1)))
    shares = {}
    for margin in MARGINS:
        own = state.groupBy(margin).agg(F.sum("w").alias("own"))
        given = targets.get(margin)
        if given is None:
            powers = own.withColumn("power", F.when(F.col("own") > 0, F.pow("own", F.lit(temperatures.get(margin, 1.0)))).otherwise(0.0))
            share = F.col("power") / F.lit(float(powers.agg(F.sum("power")).first()[0] or 1))
            shares[margin] = materialise(powers.select(margin, share.alias("share")), "share")
            continue
        known = spark.createDataFrame(list(given.items()), f"{margin} string, goal double")
        both = own.join(F.broadcast(known), margin, "left")
        sums = both.agg(F.sum(F.when(F.col("own") > 0, F.col("goal"))).alias("named"), F.sum(F.when(F.col("goal").isNull(), F.col("own"))).alias("rest")).first()
        free = left_over(given, sums.rest) if sums.rest else 0.0
        named = F.when(F.col("own") > 0, F.col("goal") * (1 - free) / (sums.named or 1)).otherwise(0.0)
        rest = F.col("own") * free / (sums.rest or 1)
        shares[margin] = materialise(both.select(margin, F.when(F.col("goal").isNotNull(), named).otherwise(rest).alias("share")), "share")
    start = state.select("key", *MARGINS, F.col("w").alias("base"), "w")
    state = start
    for _ in range(SWEEPS):
        worst = 0.0
        for margin in MARGINS:
            sums = state.groupBy(F.col(margin).alias("m")).agg(F.sum("w").alias("now"))
            ratio = sums.join(shares[margin].withColumnRenamed(margin, "n"), F.col("m").eqNullSafe(F.col("n"))).select("m", "now", "share")
            worst = max(worst, ratio.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0)
            scaled = state.join(ratio, F.col(margin).eqNullSafe(F.col("m")))
            state = materialise(scaled.select("key", *MARGINS, "base", F.when(F.col("now") > 0, F.col("w") * F.col("share") / F.col("now")).otherwise(0.0).alias("w")), "raked")
        if worst < CLOSE:
            break
    factors = state.withColumn("f", F.when(F.col("base") > 0, F.col("w") / F.col("base")))
    largest = float(factors.agg(F.max("f")).first()[0] or 1)
    return factors.select(*MARGINS, F.coalesce(F.round(F.col("f") / largest, DIGITS), F.lit(1.0)).alias("probability"))


def chance(docs: DataFrame, doc_id: str, text: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from id, text and seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column(docs, doc_id), text_column(text)), 11).cast("double") / F.lit(float(2**53))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, targets: dict = TARGETS, temperatures: dict = TEMPERATURES, seed: int = SEED, into: str = "mixed") -> DataFrame:
    """The sampled documents with a struct column `into`, in place of one that has its name: (topic, n_tokens, probability)."""
    own_names = dict(zip(MARGINS, free_names(docs, *(f"own_{m}" for m in MARGINS)), strict=True))
    cell_names = dict(zip(MARGINS, free_names(docs, *(f"cell_{m}" for m in MARGINS)), strict=True))
    tokens, chosen = free_names(docs, "own_tokens", "cell_probability")
    counted = docs.withColumn(tokens, tokens_of(text))
    topics = F.col(topic).cast("string") if topic else topic_of(text, F.col(tokens))
    own = counted.withColumns({own_names["source"]: F.col(source).cast("string"), own_names["lang"]: F.col(lang).cast("string"), own_names["topic"]: topics})
    sums = cell_sums(own.select(*(F.col(n).alias(m) for m, n in own_names.items()), F.col(tokens).alias("n_tokens")))
    p = probabilities(sums, targets, temperatures).select(*(F.col(m).alias(n) for m, n in cell_names.items()), F.col("probability").alias(chosen))
    same = [F.col(own_names[m]).eqNullSafe(F.col(cell_names[m])) for m in MARGINS]
    joined = own.join(p, same).where(chance(docs, doc_id, text, seed) < F.col(chosen))
    mixed = F.struct(F.col(own_names["topic"]).alias("topic"), F.col(tokens).alias("n_tokens"), F.col(chosen).alias("probability")).alias(into)
    return joined.select(*(c for c in docs.columns if c.lower() != into.lower()), mixed)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "mixed.topic", "mixed.n_tokens", F.round("mixed.probability", 9).alias("probability"))
