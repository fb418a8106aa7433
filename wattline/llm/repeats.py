"""First occurrences of keyed stretches of text, and texts without given stretches.

Stretches arrive as rows (route, k2, doc, th, start, size, done): equal (route, k2) means equal content, (doc, th, start) is
the order of occurrence. th is a hash of the text, so rows that share an id but not a text stay apart. Mappers already settle
what repeats inside a slice (done: it is a repeat for sure and is dealt by document), so a stretch that a third of all
documents hold arrives once for each slice, and the pass over the sorted rows holds one row at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import free_names, id_column, mix64, schema, text_column, utf8_parts

STRETCHES = schema("route long, k2 long, doc long, th long, start long, size long, done boolean")
FOUND = schema("open boolean, route long, doc long, th long, start long, size long")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, text) of every document, none of them null."""
    plain = text_column(text)
    return docs.select(id_column(docs, doc_id).alias("doc"), F.xxhash64(plain).alias("th"), plain.alias("text"))


def batch_of(columns: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names)


def settle_slice(route, k2, doc, th, start, size) -> pa.RecordBatch:
    """The slice's stretches, repeats inside it marked as done."""
    order = np.lexsort((start, th, doc, k2, route))
    route, k2, doc, th, start, size = (x[order] for x in (route, k2, doc, th, start, size))
    again, same = np.zeros(len(route), dtype=bool), np.zeros(len(route), dtype=bool)
    again[1:] = (route[1:] == route[:-1]) & (k2[1:] == k2[:-1])
    # Rows that repeat id and text hold the same occurrence, not a later one.
    same[1:] = again[1:] & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (start[1:] == start[:-1])
    route, k2, doc, th, start, size, again = (x[~same] for x in (route, k2, doc, th, start, size, again))
    # Overlapping and adjoining repeats of a document become one row; plain stretches stay as they are.
    order = np.lexsort((start[again], th[again], doc[again]))
    d, t, s, e = (x[again][order] for x in (doc, th, start, start + (size & 0xFFFFFFFF)))
    if len(d):
        fresh = np.ones(len(d), dtype=bool)
        fresh[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        base = np.cumsum(fresh).astype(np.int64) << 33
        reach = np.maximum.accumulate(base + e)
        fresh[1:] |= (base + s)[1:] > reach[:-1]
        at = np.flatnonzero(fresh)
        ends = reach[np.append(at[1:], len(d)) - 1] - base[at]
        d, t, s, e = d[at], t[at], s[at], ends
    n = len(d)
    keep = ~again
    columns = {
        "route": np.concatenate([route[keep], mix64(d.astype(np.uint64)).view(np.int64)]), "k2": np.concatenate([k2[keep], np.zeros(n, np.int64)]), "doc": np.concatenate([doc[keep], d]),
        "th": np.concatenate([th[keep], t]), "start": np.concatenate([start[keep], s]), "size": np.concatenate([size[keep], e - s]), "done": np.concatenate([np.zeros(keep.sum(), bool), np.ones(n, bool)]),
    }
    return batch_of(columns, STRETCHES.names)


def map_slices(documents: DataFrame, stretches) -> DataFrame:
    """stretches(bytes, offsets) gives (row, route, k2, start, size) of a slice of documents, as arrays."""

    def mapped(batches):
        for batch in batches:
            doc, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at, data, offsets in utf8_parts(batch.column(2)):
                row, route, k2, start, size = stretches(data, offsets)
                if len(row):
                    yield settle_slice(route, k2, doc[at + row], th[at + row], start, size)

    return documents.mapInArrow(mapped, STRETCHES)


def first_seen(rows: DataFrame, groups: bool = False) -> DataFrame:
    """Repeats as rows with open = false: every stretch but the first of its content. With groups, the first stretches of
    routes that have several contents come as well, with open = true."""

    def passed(batches):
        keys = ["route", "k2", "doc", "th", "start"]
        last = None  # these of the last row
        pending = None  # the last first stretch: [values, whether its route has another content before it]
        names = ["route", "doc", "th", "start", "size"]
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in STRETCHES.names}
            done = c.pop("done")
            out = {n: c[n][done] for n in names}
            live = {n: x[~done] for n, x in c.items()}
            count = len(live["route"])
            if count:
                differs = {n: np.append(last is None or last[n] != live[n][0], live[n][1:] != live[n][:-1]) for n in keys}
                last = {n: live[n][-1] for n in keys}
                new = differs["route"] | differs["k2"]
                place = new | differs["doc"] | differs["th"] | differs["start"]  # else the same occurrence, of a repeated row
                live, new = {n: x[place] for n, x in live.items()}, new[place]
                out = {n: np.concatenate([out[n], live[n][~new]]) for n in names}
                if groups and new.any():
                    first = {n: live[n][new] for n in names}
                    before = False
                    if pending:
                        first = {n: np.concatenate([[pending[0][n]], first[n]]) for n in names}
                        before = pending[1]
                    same = first["route"][1:] == first["route"][:-1]
                    several = np.append(same, False) | np.append(before, same)
                    pending = [{n: first[n][-1] for n in names}, bool(several[-1])]
                    several[-1] = False
                    if several.any():
                        yield batch_of({n: x[several] for n, x in first.items()} | {"open": np.ones(several.sum(), bool)}, FOUND.names)
            if len(out["doc"]):
                yield batch_of(out | {"open": np.zeros(len(out["doc"]), bool)}, FOUND.names)
        if pending and pending[1]:
            yield batch_of({n: np.array([v], dtype=np.int64) for n, v in pending[0].items()} | {"open": np.ones(1, bool)}, FOUND.names)

    dealt = rows.repartition("route").sortWithinPartitions("route", "k2", "doc", "th", "start")
    return dealt.mapInArrow(passed, FOUND)


@F.pandas_udf(schema("n_bytes long, n_removed long, n_spans long, kept binary, span_starts <long>, span_ends <long>"))
def cut_out(texts: pd.Series, starts: pd.Series, ends: pd.Series, least: pd.Series) -> pd.DataFrame:
    """The UTF-8 bytes of a text outside the given spans; joined spans shorter than `least` stay in."""
    rows = []
    for text, s, e, short in zip(texts, starts, ends, least, strict=True):
        data = text.encode()
        if s is None or not len(s):
            rows.append((len(data), 0, 0, data, [], []))
            continue
        order = np.argsort(s, kind="stable")
        s, reach = s[order], np.maximum.accumulate(e[order])
        fresh = np.append(True, s[1:] > reach[:-1])
        at = np.flatnonzero(fresh)
        s, e = s[at], reach[np.append(at[1:], len(s)) - 1]
        s, e = s[e - s >= short], e[e - s >= short]
        edges = [0, *np.column_stack([s, e]).ravel().tolist(), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        rows.append((len(data), int((e - s).sum()), len(s), kept, s.tolist(), e.tolist()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "span_starts", "span_ends"])


def without(docs: DataFrame, spans: DataFrame, doc_id: str, text: str, into: str, least: int = 1) -> DataFrame:
    """docs with a struct column `into`, in place of one that has its name: (n_bytes, n_removed, n_spans, kept, span_starts,
    span_ends). spans: (doc, th, start, size)."""
    doc, th, plain, starts, ends = free_names(docs, "doc", "th", "plain", "starts", "ends")
    by_doc = spans.groupBy(F.col("doc").alias(doc), F.col("th").alias(th)).agg(F.collect_list("start").alias(starts), F.collect_list(F.col("start") + F.col("size")).alias(ends))
    own = docs.withColumns({doc: id_column(docs, doc_id), th: F.xxhash64(text_column(text)), plain: text_column(text)})
    joined = own.join(by_doc, [doc, th], "left")
    cut = cut_out(plain, starts, ends, F.lit(least)).alias(into)
    return joined.select(*(c for c in docs.columns if c.lower() != into.lower()), cut)
