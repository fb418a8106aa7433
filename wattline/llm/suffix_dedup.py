"""Exact removal of byte strings of WIDTH that occurred before, by sorting suffixes.

Which windows can be equal: every window of WIDTH bytes contains GRAM-byte strings; the one with the lowest hash is its
anchor. Equal windows have equal anchors at equal places, so neighbouring windows with one anchor travel as one stretch,
keyed by anchor and content. All but the first stretch of a content are repeats as a whole. What is left are anchors whose
stretches differ, where repeated passages begin and end: there the suffixes that start at the anchors, to the right and
(reversed) to the left, are sorted deep-shallow: multikey quicksort on 8-byte words to SHALLOW bytes, then blind tries for
groups that still agree. Two windows at the same distance from their anchors are equal if their common prefixes to both
sides reach their edges, which the sorted order and its common prefix lengths tell for all stretches at once.

Edge cases: null and empty texts, and those shorter than WIDTH bytes, lose nothing; rows that repeat id and text count as
one occurrence and get equal results; a null id sorts first; other columns are untouched. An anchor with more than
HOT_ANCHOR different stretches is settled by digests of its single windows, dealt over all tasks, so no task ever holds more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import materialise, mix64, read_table, schema
from wattline.llm.repeats import FOUND, STRETCHES, batch_of, first_seen, keyed, map_slices, without

WIDTH, GRAM, SHALLOW = 100, 16, 64
SPAN = WIDTH - GRAM + 1  # windows that can share an anchor
LONGEST = WIDTH + SPAN - 1  # bytes of a stretch
#: Groups of at most so many suffixes go to a blind trie even above the shallow depth; larger ones than TRIE_MOST stay with quicksort.
SMALL, TRIE_MOST = 8, 4096
#: Stretches sorted at once, and of one anchor.
BLOCK, HOT_ANCHOR = 20_000, 200_000
RANDOM = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR = 0x9E3779B97F4A7C55


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling."""
    h, step = RANDOM[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(FACTOR, step, 2**64)) + h[step:]
        step *= 2
    return mix64(h)


def stretches(data: np.ndarray, offsets: np.ndarray):
    """Runs of windows with one anchor; size holds the anchor's distance from the start above 32 bits."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if len(data) < WIDTH:
        return none
    h = gram_hashes(data)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (SPAN - step)], low[SPAN - step :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, dtype=np.int32)
    lengths = np.diff(offsets)
    long = lengths >= WIDTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, np.minimum(offsets[1:][long] - WIDTH + 1, len(anchor)), -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return none
    own = anchor[at]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
    start, last = at[first], at[np.append(first[1:], len(at)) - 1]
    end = last + WIDTH
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    k2 = np.array([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, h[own[first]].view(np.int64), k2, start - offsets[row], (end - start) | (own[first] - start) << 32


def common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def blind_trie(items: list[int], texts) -> list[int]:
    """Sorts equally long texts: a trie that keeps only branching depths and bytes; each text is compared with one leaf."""
    root: list | int = items[0]
    alike: dict[int, list[int]] = {items[0]: [items[0]]}
    for item in items[1:]:
        text, node = texts[item], root
        while type(node) is list:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
            node = node[0]
        other = texts[node]
        depth = common_prefix(text, other)
        if depth == len(text):
            alike[node].append(item)
            continue
        alike[item] = [item]
        above, node = None, root
        while type(node) is list and node[0] < depth:
            above = node[1][text[node[0]]]
            node = above[0]
        if type(node) is list and node[0] == depth:
            node[1][text[depth]] = [item]
            continue
        branch = [depth, {text[depth]: [item], other[depth]: [node]}]
        if above is None:
            root = branch
        else:
            above[0] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack.extend(node[1][b][0] for b in sorted(node[1], reverse=True))
        else:
            out.extend(alike[node])
    return out


class Rows:
    """Equally long texts, cut from one block when asked for."""

    def __init__(self, matrix: np.ndarray):
        self.raw, self.width = matrix.tobytes(), matrix.shape[1]

    def __getitem__(self, k: int) -> bytes:
        return self.raw[k * self.width : (k + 1) * self.width]


def deep_shallow(matrix: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """An order of the rows of a byte matrix that sorts each group (groups: starts, and the number of rows at the end)."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), dtype=np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    words, texts = padded.view(">u8").astype(np.uint64), Rows(matrix)
    order = np.arange(len(matrix))
    sizes = np.diff(groups)
    stack = [(a, a + n, 0) for a, n in zip(groups[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True)]
    while stack:
        low, high, depth = stack.pop()
        size = high - low
        if size < 2 or depth >= words.shape[1]:
            continue
        if size <= SMALL or (8 * depth >= SHALLOW and size <= TRIE_MOST):
            order[low:high] = blind_trie(order[low:high].tolist(), texts)
            continue
        part = order[low:high]
        keys = words[part, depth]
        pivot = np.sort(keys[[0, size // 2, -1]])[1]
        less, same, more = keys < pivot, keys == pivot, keys > pivot
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([part[less], part[same], part[more]])
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def prefix_classes(matrix: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and the common prefix of each row in it with the row before; -1 where a group starts."""
    order = deep_shallow(matrix, groups)
    differ = np.ones((len(order), matrix.shape[1] + 1), dtype=bool)
    differ[1:, :-1] = matrix[order[1:]] != matrix[order[:-1]]
    common = differ.argmax(axis=1)
    common[groups[:-1]] = -1
    return order, common


def repeated_windows(texts: list[bytes], lead: np.ndarray, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches sorted by route and occurrence: the first and last window that an earlier stretch of the route has, -1 for none."""
    n = len(texts)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = np.cumsum(size) - size
    groups = np.append(np.flatnonzero(np.append(True, route[1:] != route[:-1])), n)

    def aligned(length: np.ndarray, at: np.ndarray, sign: int, width: int) -> np.ndarray:
        place = np.arange(width)
        index = at[:, None] + sign * place[None, :]
        there = place[None, :] < length[:, None]
        return np.where(there, flat[np.where(there, index, 0)], 0).astype(np.uint8)

    right_order, right_common = prefix_classes(aligned(size - lead, begin + lead, 1, WIDTH), groups)
    left_order, left_common = prefix_classes(aligned(lead, begin + lead - 1, -1, SPAN - 1), groups)
    first, last = np.full(n, -1), np.full(n, -1)
    windows = size - WIDTH + 1
    named = np.empty(n, dtype=np.int64)
    for back in range(SPAN):  # windows that start so many bytes before the anchor
        has = np.flatnonzero((back <= lead) & (lead - back < windows))
        if len(has) < 2:
            continue
        named[right_order] = np.cumsum(right_common < WIDTH - back)
        key = named[has] * (n + 1)
        named[left_order] = np.cumsum(left_common < back)
        key += named[has]
        order = np.argsort(key, kind="stable")
        again = np.append(False, key[order][1:] == key[order][:-1])
        rows = has[order[again]]
        place = lead[rows] - back
        first[rows] = place  # back grows, so the place falls: the last one written is the first window
        last[rows] = np.maximum(last[rows], place)
    return first, last


CONTEXT = schema("route long, doc long, th long, start long, lead long, context binary")
SETTLED = schema("open boolean, route long, k2 long, doc long, th long, start long, size long")


def contexts(batches):
    """The bytes of the open stretches of each document."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = {n: [] for n in CONTEXT.names}
            for x in batch.slice(at, 200).to_pylist():
                data = x["text"].encode() if x["open"] else b""
                for s in x["open"] or ():
                    size, lead = s["size"] & 0xFFFFFFFF, s["size"] >> 32
                    for n, v in (("route", s["route"]), ("doc", x["doc"]), ("th", x["th"]), ("start", s["start"]), ("lead", lead), ("context", data[s["start"] : s["start"] + size])):
                        rows[n].append(v)
            if rows["doc"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], pa.binary() if n == "context" else pa.int64()) for n in CONTEXT.names], CONTEXT.names)


def settle(batches):
    """Sorts the suffixes of complete anchors in blocks; spans of repeats, or single windows of anchors that are too hot."""
    held: list[tuple] = []
    hot = None

    def block(rows):
        route, doc, th, start, lead = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(5))
        first, last = repeated_windows([r[5] for r in rows], lead, route)
        k = np.flatnonzero(first >= 0)
        zero = np.zeros(len(k), dtype=np.int64)
        return batch_of({"open": np.zeros(len(k), bool), "route": route[k], "k2": zero, "doc": doc[k], "th": th[k], "start": start[k] + first[k], "size": last[k] - first[k] + WIDTH}, SETTLED.names)

    def windows(rows):
        for at in range(0, len(rows), 2000):
            out = {n: [] for n in SETTLED.names[1:]}
            for _, doc, th, start, _, text in rows[at : at + 2000]:
                for k in range(len(text) - WIDTH + 1):
                    d = xxhash.xxh3_128_intdigest(text[k : k + WIDTH])
                    for n, v in zip(SETTLED.names[1:], ((d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, doc, th, start + k, WIDTH), strict=True):
                        out[n].append(v)
            yield batch_of({n: np.array(v, dtype=np.int64) for n, v in out.items()} | {"open": np.ones(len(out["doc"]), bool)}, SETTLED.names)

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in CONTEXT.names), strict=True):
            if held and row[:4] == held[-1][:4]:  # of a row that repeats id and text
                continue
            if hot is not None and row[0] != hot:
                yield from windows(held)
                held, hot = [], None
            if held and hot is None and len(held) >= BLOCK:
                if row[0] != held[-1][0]:
                    yield block(held)
                    held = []
                elif len(held) >= HOT_ANCHOR:
                    k = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] != row[0]), -1) + 1
                    if k:
                        yield block(held[:k])
                    held = held[k:]
                    if len(held) >= HOT_ANCHOR:
                        hot = row[0]
            held.append(row)
            if hot is not None and len(held) >= BLOCK:
                yield from windows(held)
                held = []
    if held:
        yield from windows(held) if hot is not None else iter([block(held)])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, start, size): stretches of bytes covered by windows that occurred before."""
    documents = keyed(docs, doc_id, text)
    found = materialise(first_seen(map_slices(documents, stretches), groups=True), "stretches")
    whole = found.where(~F.col("open")).select("doc", "th", "start", F.col("size").bitwiseAND(0xFFFFFFFF).alias("size"))
    by_doc = found.where("open").groupBy("doc", "th").agg(F.collect_list(F.struct("route", "start", "size")).alias("open"))
    joined = documents.join(by_doc, ["doc", "th"], "inner").select("doc", "th", "text", "open")
    dealt = joined.mapInArrow(contexts, CONTEXT).repartition("route").sortWithinPartitions("route", "doc", "th", "start")
    settled = materialise(dealt.mapInArrow(settle, SETTLED), "settled")
    single = settled.where("open").select(*[n for n in STRETCHES.names[:-1]], F.lit(False).alias("done"))
    spans = settled.where(~F.col("open")).select("doc", "th", "start", "size")
    return whole.unionByName(spans).unionByName(first_seen(single).select("doc", "th", "start", "size"))


def drop_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "dedup") -> DataFrame:
    """docs with a struct column: (n_bytes, n_removed, n_spans, kept, span_starts, span_ends)."""
    return without(docs, repeated_spans(docs, doc_id, text), doc_id, text, into)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_strings(docs)
    return out.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))
