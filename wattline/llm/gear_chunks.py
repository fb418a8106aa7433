"""Substring deduplication over content-defined chunks.

A gear hash rolls over the bytes of a text (each step shifts it by one and adds the byte's random number, so 32 bytes count);
a chunk ends where the top BITS bits are zero, after LEAST bytes at least and MOST at most. Cuts depend on content, so an
insertion moves only the chunks around it. Chunks are told apart by 128-bit digests; every chunk but the first of its
digest, by (doc_id, position), is a repeat and removed. The option `shortest` leaves joined repeats of fewer bytes in; SHORTEST
leaves none.

Edge cases: null and empty texts have no chunks and stay; rows that repeat id and text count as one occurrence and get equal
results; a null id sorts first; other columns are untouched.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import materialise, mix64, read_table
from wattline.llm.repeats import first_seen, keyed, map_slices, without

LEAST, MOST, BITS, SHORTEST = 32, 512, 5, 1

GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The hash after every byte, by doubling the number of bytes that count."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of texts that lie one behind the other."""
    ends = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0).tolist()
    starts_out, ends_out = [], []
    for at, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        k = bisect_left(ends, at)
        while at < stop:
            k = bisect_left(ends, at + LEAST - 1, k)
            end = min(stop, at + MOST, ends[k] + 1 if k < len(ends) else stop)
            starts_out.append(at)
            ends_out.append(end)
            at = end
    return np.array(starts_out, dtype=np.int64), np.array(ends_out, dtype=np.int64)


def chunks(data: np.ndarray, offsets: np.ndarray):
    starts, ends = cut(data, offsets)
    raw = data.tobytes()
    digest = xxhash.xxh3_128_digest
    keys = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, keys[:, 0], keys[:, 1], starts - offsets[row], ends - starts


def drop_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "chunked", shortest: int = SHORTEST) -> DataFrame:
    """docs with a struct column: (n_bytes, n_removed, n_spans, kept, span_starts, span_ends)."""
    repeats = materialise(first_seen(map_slices(keyed(docs, doc_id, text), chunks)).select("doc", "th", "start", "size"), "chunks")
    return without(docs, repeats, doc_id, text, into, shortest)


def op5_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_chunks(docs)
    return out.select("doc_id", "chunked.n_bytes", "chunked.n_removed", "chunked.n_spans", F.sha2("chunked.kept", 256).alias("kept_sha256"))
