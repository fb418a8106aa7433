"""Exact Jaccard join of word n-gram sets by T-occurrence search (DivideSkip), and its connected components.

Sets are hashed shingles (64 bits); documents with equal sets form a class (128-bit digest) and travel as one. Two sets that
link share one of their first |A| - ceil(0.85 |A|) + 1 tokens in any order of all tokens. The order is by frequency, so
passages that many documents share come last at every size of the corpus:

1. Tokens of the lowest part of the hash range (twice the share that a prefix takes) are counted, a token a stream; those of
   one class come first in the order and need no further work, since nothing shares them. The others go back to their class
   with their counts. Sets with too few tokens in that part go on with their lowest tokens beyond it, and last of all come
   the frequent tokens (of 1 / SHARE of all classes and more, at most SHARE x the mean size of a set), which are never counted.
2. Classes that share a prefix token and lie in two neighbouring bands of size form a group; groups with the same members are
   one. Nothing is collected: a group is known by its number of members, its first member and 128 bits of their digests.
3. Each group is searched from its first class (a star). Components of the links so far are found; groups that lie in one
   component are done.
4. In the other groups every class outside the group's largest component searches for classes of other components, in blocks
   of a chunk of those that ask and a part of the group. Components are found again.

Before texts travel, bitmaps of the sets rule out members that can link with nobody in their block (an upper bound of the
overlap, so no link is lost). A search takes the query's inverted lists in a block, sets the longest aside, merges the others and keeps what occurs often
enough to reach the needed overlap T with the lists set aside, which are then probed by binary search. Links inside a known
component are skipped: they change no component. Nothing is capped: all pairs of a group across components are searched.

Edge cases: null and empty texts have an empty set, link with nothing and are components of their own; texts with fewer
words than WORDS are one shingle; rows that repeat id and text are equal members of their class; rows that share an id only
are told apart by their text; a null id sorts first; ids that are no whole numbers are ordered by a hash; other columns
are untouched.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm.common import NO_ID, discard, free_names, hold_few_bytes, id_column, materialise, mix64, read_table, schema, text_column, utf8_parts
from wattline.llm.repeats import keyed

#: Words of a shingle, and the similarity that links, in hundredths.
WORDS, SIMILAR = 4, 85
#: Tokens of a class in so many, as far as slices hold them twice, are frequent and not counted one by one.
SHARE = 512
#: Counts above this are equal in the order, so a token's stream needs no more rows in memory.
MOST_COUNTED = 4096
#: Tokens of a class by which stars are drawn before groups are searched.
LOWEST = 3
#: Members of a block.
BLOCK_MEMBERS = 512
#: Bits of a set's bitmap for each token; bitmaps bound the overlap of two sets from above.
BITS = 4
RANDOM = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
FACTOR = 0x9E3779B97F4A7C55
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """FACTOR^k and FACTOR^-k for k < n, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((FACTOR, pow(FACTOR, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the slice and how many words lie before each text's begin."""
    space = SPACES[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] |= ~space[inner]
    stops = ~space
    stops[:-1] &= space[1:]
    stops[inner - 1] |= ~space[inner - 1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(RANDOM[LOWER[data]] * up[: len(data)], out=total[1:])
    hashes = mix64((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text behind the other; and where each text's begin."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(at[:-1], counts)
    left = np.repeat(counts, counts) - place
    head = np.flatnonzero((left >= width) | (place == 0))
    value = np.zeros(len(head), dtype=np.uint64)
    for k in range(width):
        there = left[head] > k
        value = value * np.uint64(FACTOR) + np.where(there, words[np.minimum(head + k, len(words) - 1)], np.uint64(0)) if len(words) else value
    value = mix64(value + np.minimum(left[head], width).astype(np.uint64))
    rows = row[head]
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.append(True, (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, bool)
    value, rows = value[new], rows[new]
    return value, np.searchsorted(rows, np.arange(len(counts) + 1))


def slices(batches, width: int):
    """(doc, th, tokens, begins, class digests) of each slice of documents (doc, th, text)."""
    for batch in batches:
        doc, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for at, data, offsets in utf8_parts(batch.column(2)):
            tokens, begins = shingle_sets(data, offsets, width)
            raw = tokens.tobytes()
            names = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            n = len(names)
            yield doc[at : at + n], th[at : at + n], tokens, begins, names


def _first_of_each(names: list) -> np.ndarray:
    seen, out = set(), np.zeros(len(names), dtype=bool)
    for k, name in enumerate(names):
        if name is not None and name not in seen:
            seen.add(name)
            out[k] = True
    return out


def bitmaps(tokens: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """A bitmap for each set: the bits of its tokens' hashes, BITS times as many as tokens or up to twice that, a power of two."""
    sizes = np.diff(begins)
    width = 1 << np.ceil(np.log2(np.maximum(BITS * sizes, 64))).astype(np.int64)
    at = np.append(0, np.cumsum(width))
    bits = np.zeros(at[-1], dtype=bool)
    bits[np.repeat(at[:-1], sizes) + ((tokens >> np.uint64(20)).astype(np.int64) & np.repeat(width - 1, sizes))] = True
    raw = np.packbits(bits).tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of equal width, that of the narrowest: the bitmap of half the width is the union of both halves."""
    least, rows = min(map(len, bits)), []
    for raw in bits:
        row = np.frombuffer(raw, dtype=np.uint64)
        while 8 * len(row) > least:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows)


def digests(column: pa.Array) -> np.ndarray:
    """A column of 16-byte digests as rows of two numbers."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    return np.frombuffer(column.buffers()[2], dtype=np.uint64, count=2 * len(column), offset=int(offsets[column.offset])).reshape(-1, 2)


def digest_column(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


SURVEYED = schema("doc long, th long, size long, cls binary, token long, n long")


def survey(documents: DataFrame, width: int) -> DataFrame:
    """A row (doc, th, size, cls) for each document, and rows (token, n) for tokens that several classes of a slice share."""

    def surveyed(batches):
        for doc, th, tokens, begins, names in slices(batches, width):
            empty = pa.nulls(len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(np.diff(begins)), pa.array(names, pa.binary()), empty, empty], SURVEYED.names)
            first = _first_of_each(names)
            value, count = np.unique(tokens[np.repeat(first, np.diff(begins))], return_counts=True)
            often = (count > 1) & (count * SHARE >= first.sum())
            value, count = value[often], count[often]
            empty = pa.nulls(len(value), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.nulls(len(value), pa.binary()), pa.array(value.view(np.int64)), pa.array(count)], SURVEYED.names)

    return documents.mapInArrow(surveyed, SURVEYED)


POSTED = schema("token long, cls binary, size int, inside int")
COUNTED = schema("token long, cls binary, size int, inside int, df int")


def prefix_length(size, similar: int):
    return size - (similar * size + 99) // 100 + 1


def postings(documents: DataFrame, frequent, width: int, similar: int) -> DataFrame:
    """The tokens of each class that are counted, with their number in the set (inside); and, with inside = -1, the tokens
    beyond them that its prefix needs. frequent: a broadcast pair (tokens, sorted; their place in the order)."""
    bound = np.uint64(min(2**64 - 1, 2**64 * 2 * (100 - similar) // 100))

    def posted(batches):
        known, rank = frequent.value
        for _, _, tokens, begins, names in slices(batches, width):
            sizes = np.diff(begins)
            row = np.repeat(np.arange(len(sizes)), sizes)
            own = _first_of_each(names)
            late = np.zeros(len(tokens), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                late = np.where(known[at] == tokens, rank[at], 0)
            counted = (tokens < bound) & (late == 0)
            inside = np.bincount(row[counted], minlength=len(sizes))
            need = np.where(own, prefix_length(sizes, similar) - inside, 0)
            rest = np.flatnonzero(~counted & (need > 0)[row])
            rest = rest[np.lexsort((tokens[rest], late[rest], row[rest]))]
            place = np.arange(len(rest)) - np.searchsorted(row[rest], row[rest])
            rest = rest[place < need[row[rest]]]
            pick = np.flatnonzero(counted & own[row])
            rows = np.concatenate([row[pick], row[rest]])
            known_classes = np.frombuffer(b"".join(x or bytes(16) for x in names), dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[np.concatenate([pick, rest])].view(np.int64)), digest_column(known_classes[rows]), pa.array(sizes[rows].astype(np.int32)), pa.array(np.where(np.arange(len(rows)) < len(pick), inside[rows], -1).astype(np.int32))],
                POSTED.names,
            )

    return documents.mapInArrow(posted, POSTED)


def counted_tokens(posted: DataFrame) -> DataFrame:
    """The postings with the number of classes of their token, without tokens of one class. Those with inside = -1 are spread
    over all tasks and pass as they are."""

    def counted(batches):
        held, flushed = None, None

        def rows(c, df):
            keep = (df > 1) | (c["inside"] < 0)
            return pa.RecordBatch.from_arrays([pa.array(c["token"][keep]), digest_column(c["cls"][keep]), pa.array(c["size"][keep]), pa.array(c["inside"][keep]), pa.array(df[keep].astype(np.int32))], COUNTED.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("token", "size", "inside")} | {"cls": digests(batch.column("cls"))}
            if held is not None:
                c = {n: np.concatenate([held[n], c[n]]) for n in c}
            same = (c["token"][1:] == c["token"][:-1]) & (c["cls"][1:] == c["cls"][:-1]).all(axis=1)
            fresh = np.append(True, ~same)  # classes that several slices hold come several times
            c = {n: x[fresh] for n, x in c.items()}
            new = np.append(True, c["token"][1:] != c["token"][:-1])
            begins = np.flatnonzero(new)
            lengths = np.diff(np.append(begins, len(new)))
            df = np.repeat(np.minimum(lengths, MOST_COUNTED), lengths)
            if flushed is not None:
                df[c["token"] == flushed] = MOST_COUNTED
            end = len(new)
            if lengths[-1] < MOST_COUNTED and c["token"][-1] != flushed:
                end = begins[-1]  # the last token may go on in the next batch
            else:
                flushed, end = c["token"][-1], end - 1  # the last row stays, to know its copies by
            held = {n: x[end:] for n, x in c.items()}
            yield rows({n: x[:end] for n, x in c.items()}, df[:end])
        if held is not None:
            n = len(held["token"])
            yield rows(held, np.full(n, MOST_COUNTED if held["token"][0] == flushed else n))

    route = F.when(F.col("inside") >= 0, F.col("token")).otherwise(F.xxhash64("token", "cls"))
    return posted.repartition(route).sortWithinPartitions("token", "cls").mapInArrow(counted, COUNTED)


def prefixes(counted: DataFrame, similar: int) -> DataFrame:
    """(token, cls, size, prefix, lowest): the tokens of each class's prefix that other classes may hold, and the LOWEST of
    smallest hash that they do hold (like the minima of MinHash, copies mostly agree in them)."""
    by_class = Window.partitionBy("cls")
    length = F.col("size") - F.floor((similar * F.col("size") + 99) / 100) + 1
    repeated = F.count(F.when(F.col("inside") >= 0, 1)).over(by_class)
    inside = F.max("inside").over(by_class)
    # Tokens that no other class holds come first; they fill a part of the prefix and are not here.
    left = F.when(inside >= 0, length - (inside - repeated)).otherwise(length)
    place = F.row_number().over(by_class.orderBy("df", "token"))
    smallest = F.row_number().over(by_class.orderBy(F.col("inside") < 0, F.col("token").bitwiseXOR(F.lit(-(2**63)))))
    placed = counted.select("token", "cls", "size", "inside", place.alias("place"), left.alias("left"), (smallest <= LOWEST).alias("lowest"))
    return placed.select("token", "cls", "size", F.expr("inside < 0 or place <= left").alias("prefix"), "lowest").where("prefix or lowest")


def groups_of(posted: DataFrame, similar: int) -> DataFrame:
    """(token, low, cls): the members of groups of at least two classes that share a token and lie in the bands of size low and
    low + 1, one group for each set of members. Sizes that can link lie in one band or in neighbouring ones."""
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(np.log(100 / similar) * 1.0001)).cast("int")
    spread = posted.select("token", "cls", F.explode(F.array(band - 1, band)).alias("low"))
    digest = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"d{k}") for k in (1, 2)]
    groups = spread.groupBy("token", "low").agg(F.count("*").alias("n"), F.min("cls").alias("first"), *digest).where("n > 1")
    groups = groups.groupBy("n", "first", "d1", "d2").agg(F.min(F.struct("token", "low")).alias("g")).select("g.*")
    return spread.join(groups, ["token", "low"])


class Block:
    """Sets of a block, their inverted lists, and searches among them."""

    def __init__(self, sets: list[np.ndarray], comps: list, similar: int):
        self.similar, self.count = similar, len(sets)
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        new = np.append(True, tokens[1:] != tokens[:-1])
        number = np.cumsum(new) - 1
        self.owners = owner[order]
        self.begins = np.append(np.flatnonzero(new), len(tokens))
        self.lists = np.empty(len(tokens), dtype=np.int64)
        self.lists[order] = number
        self.at = np.append(0, np.cumsum(self.sizes))
        self.keys = number * len(sets) + self.owners  # sorted: a list is probed by binary search for its part of this
        names: dict = {}
        self.comp = np.array([names.setdefault(c, len(names)) for c in comps])

    def search(self, query: int) -> list[int]:
        """Members of other components that link with the query; their components are joined with the query's."""
        size = int(self.sizes[query])
        fits = (self.comp != self.comp[query]) & (100 * np.minimum(self.sizes, size) >= self.similar * np.maximum(self.sizes, size))
        if not fits.any():
            return []
        least = -(-self.similar * (size + int(self.sizes[fits].min())) // (100 + self.similar))
        lists = self.lists[self.at[query] : self.at[query + 1]]
        length = self.begins[lists + 1] - self.begins[lists]
        lists, length = lists[length > 1], length[length > 1]
        order = np.argsort(length, kind="stable")
        lists, length = lists[order], length[order]
        if len(lists) < least:
            return []
        aside = min(least - 1, int(least / (0.01 * np.log2(int(length[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        members, counts = self.merge(short, int(length[: len(short)].sum()))
        pick = (counts >= least - aside) & fits[members]
        members, counts = members[pick], counts[pick]
        if len(members) and len(long):
            wanted = long[None, :] * self.count + members[:, None]
            found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            counts = counts + (self.keys[found] == wanted).sum(axis=1)
        linked = members[100 * counts >= self.similar * (size + self.sizes[members] - counts)]
        out = []
        for m in linked.tolist():
            if self.comp[m] != self.comp[query]:
                self.comp[self.comp == self.comp[m]] = self.comp[query]
                out.append(m)
        return out

    def merge(self, lists: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each member occurs in the lists: a heap over short inputs, a merge sort of the runs over long ones."""
        runs = [self.owners[a:b] for a, b in zip(self.begins[lists].tolist(), self.begins[lists + 1].tolist(), strict=True)]
        if total <= 256:
            members, counts = [], []
            for m in heapq.merge(*(r.tolist() for r in runs)):
                if members and members[-1] == m:
                    counts[-1] += 1
                else:
                    members.append(m)
                    counts.append(1)
            return np.array(members, dtype=np.int64), np.array(counts, dtype=np.int64)
        return np.unique(np.concatenate(runs), return_counts=True)


HOPEFUL = "key binary, cls binary, comp binary, asks boolean"


def hopeful(rows: DataFrame, similar: int, best: bool = False) -> DataFrame:
    """rows: key, cls, comp, asks, size, bits. Those that may link with a member of another component of their block; or, with
    best, rows (key, cls) of pairs, the most similar by bitmaps first, that would join the components of the block into as few
    as possible.

    A token in one set only sets a bit that the other may lack, so two bitmaps that differ in d bits have an overlap of at most
    (|A| + |B| - d) / 2; members for which no partner reaches the needed overlap need no text. Nothing else is left out."""

    def filtered(batches):
        held: list[tuple] = []

        def kept():
            out = []
            if len({r[2] for r in held}) > 1:
                names: dict = {}
                comp = np.array([names.setdefault(r[2], len(names)) for r in held])
                size = np.array([r[4] for r in held], dtype=np.int64)
                bits = folded([r[5] for r in held])
                stays = np.zeros(len(held), dtype=bool)
                for k in np.flatnonzero([r[3] for r in held]):
                    other = np.flatnonzero(comp != comp[k])
                    differ = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
                    most = np.minimum((size[other] + size[k] - differ) // 2, np.minimum(size[other], size[k]))
                    near = 100 * most >= similar * (size[other] + size[k] - most)
                    if best:
                        found, likeness = other[near], (most / (size[other] + size[k] - most))[near]
                        for m in found[np.argsort(-likeness, kind="stable")].tolist():
                            if comp[m] != comp[k]:  # as if they linked, so a block gives fewer rows than it has members
                                out.append((held[k][1], held[m][1], held[m][2], False))
                                comp[comp == comp[m]] = comp[k]
                    stays[other[near]] = True
                    stays[k] |= near.any()
                if not best:
                    out = [held[k][:4] for k in np.flatnonzero(stays)]
            held.clear()
            return out

        def batch_of_rows(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.bool_() if k == 3 else pa.binary()) for k in range(4)], ["key", "cls", "comp", "asks"])

        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and held[-1][0] != row[0]:
                    found += kept()
                if held and held[-1][1] == row[1]:
                    held[-1] = (*held[-1][:3], held[-1][3] or row[3], *held[-1][4:])
                    continue
                held.append(row)
            if len(found) > 10_000:
                yield batch_of_rows(found)
                found = []
        found += kept()
        if found:
            yield batch_of_rows(found)

    named = rows.select(F.unhex(F.md5(F.to_json("key"))).alias("key"), "cls", "comp", "asks", "size", "bits")
    return named.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(filtered, HOPEFUL)


LINKS = schema("a binary, b binary")


def search_blocks(rows: DataFrame, key: str, width: int, similar: int) -> DataFrame:
    """rows: key, cls, comp, asks, text. Links (a, b) that join the components of each block, searched from those that ask."""

    def searched(batches):
        held: list[tuple] = []

        def links():
            out = []
            if len({r[2] for r in held}) > 1:
                offsets = np.append(0, np.cumsum([len(r[4]) for r in held]))
                tokens, begins = shingle_sets(np.frombuffer(b"".join(r[4] for r in held), dtype=np.uint8), offsets, width)
                tokens = tokens.view(np.int64)
                block = Block([tokens[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], [r[2] for r in held], similar)
                out = [(held[q][1], held[m][1]) for q, r in enumerate(held) if r[3] for m in block.search(q)]
            held.clear()
            return out

        found: list[tuple] = []
        for batch in batches:
            texts = batch.column(4).cast(pa.large_binary())
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if held and held[-1][0] != row[0]:
                    found += links()
                if held and held[-1][1] == row[1]:  # of rows that repeat id and text
                    held[-1] = (*held[-1][:3], held[-1][3] or row[3], held[-1][4])
                    continue
                held.append((*row, texts[k].as_py()))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], LINKS.names)
                found = []
        found += links()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], LINKS.names)

    dealt = rows.select(key, "cls", "comp", "asks", "text").repartition(key).sortWithinPartitions(key, "cls")
    return dealt.mapInArrow(searched, LINKS)


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class that can be reached, for every class with a link. Labels go to neighbours and then
    jump to their own label, until none changes."""
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"cls": "b", "comp": "other"}), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near.withColumnRenamed("a", "cls"), "cls", "left").select("cls", F.least("comp", "other").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("further"))
        step = materialise(step.join(jump, "comp", "left").select("cls", F.least("comp", "further").alias("comp"), "old"), "labels")
        discard(labels)
        labels = step
        if not step.where("comp != old").limit(1).count():
            discard(both)
            return step


FETCHED = schema("cls binary, size long, bits binary, text string")


def fetched(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, size, bits, text) of the classes (cls, doc, th), each from one document."""

    def with_bits(batches):
        for batch in batches:
            for at, data, offsets in utf8_parts(batch.column(1)):
                tokens, begins = shingle_sets(data, offsets, width)
                n = len(begins) - 1
                bits = pa.array(bitmaps(tokens, begins), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(begins)), bits, batch.column(1).slice(at, n)], FETCHED.names)

    return documents.join(wanted.hint("merge"), ["doc", "th"]).dropDuplicates(["doc", "th"]).select("cls", "text").mapInArrow(with_bits, FETCHED)


def with_bits(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts.select("cls", "size", "bits").hint("merge"), "cls")


def searched_with_texts(rows: DataFrame, texts: DataFrame, width: int, similar: int) -> DataFrame:
    return materialise(search_blocks(rows.join(texts.select("cls", "text").hint("merge"), "cls"), "key", width, similar), "links")


def frequent_tokens(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, and their place in the order, from 1. What slices report of them adds up to 1 / SHARE of the
    documents at least, so there are no more of them than SHARE times the mean size of a set."""
    counts = surveyed.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") * SHARE >= F.lit(surveyed.where("cls is not null").count())).toPandas()
    tokens = found["token"].to_numpy(dtype=np.int64).view(np.uint64)
    place = np.empty(len(tokens), dtype=np.int64)
    place[np.lexsort((tokens, found["n"].to_numpy(dtype=np.int64)))] = np.arange(1, len(tokens) + 1)
    order = np.argsort(tokens)
    return tokens[order], place[order]


def drawn_stars(posted: DataFrame, similar: int) -> DataFrame:
    """(center, cls): of the classes that share a token one, chosen by a hash, and all whose size it can link with."""
    center = F.min(F.struct(F.xxhash64("token", "cls").alias("draw"), "cls", "size")).alias("c")
    centers = posted.groupBy("token").agg(center).select("token", F.col("c.cls").alias("center"), F.col("c.size").alias("center_size"))
    reached = (F.col("cls") != F.col("center")) & (100 * F.least("size", "center_size") >= similar * F.greatest("size", "center_size"))
    return posted.join(centers, "token").where(reached).select("center", "cls")


def star_blocks(pairs: DataFrame) -> DataFrame:
    """Rows (key, cls, comp, asks): each center asks its classes, in blocks."""
    stars = materialise(pairs.distinct(), "stars")
    many = stars.groupBy("center").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("salts"))
    asked = stars.join(many, "center").select(F.struct("center", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt")).alias("key"), "cls", F.lit(False).alias("asks"))
    asks = many.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asks = asks.select(F.struct("center", "salt").alias("key"), F.col("center").alias("cls"), F.lit(True).alias("asks"))
    return asked.unionByName(asks).withColumn("comp", F.col("cls"))


def open_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, cls, comp, asks) of the groups whose members are in several components: a chunk of those outside the largest
    component asks a part of the group."""
    named = members.join(labels, "cls", "left").select("token", "low", "cls", F.coalesce("comp", "cls").alias("comp"))
    by_comp = named.groupBy("token", "low", "comp").agg(F.count("*").alias("n"))
    sizes = by_comp.groupBy("token", "low").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("comps"))
    blocks = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")
    left = sizes.where("comps > 1").select("token", "low", F.col("m.comp").alias("major"), blocks(F.col("n")).alias("parts"), blocks(F.col("n") - F.col("m.n")).alias("chunks"))
    left = materialise(named.join(left, ["token", "low"]), "open")
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = left.select("token", "low", "cls", "comp", every("chunks").alias("chunk"), mine("parts").alias("part"), F.lit(False).alias("asks"))
    asking = left.where("comp != major").select("token", "low", "cls", "comp", mine("chunks").alias("chunk"), every("parts").alias("part"), F.lit(True).alias("asks"))
    return asked.unionByName(asking).select(F.struct("token", "low", "chunk", "part").alias("key"), "cls", "comp", "asks")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """(doc, th, size, comp_doc, comp_th) for every document: its set's size and the first document it is connected with.
    doc is NO_ID for a null id, th the hash of the text."""
    spark, documents = docs.sparkSession, keyed(docs, doc_id, text)
    hold_few_bytes(spark)
    surveyed = materialise(survey(documents, width), "survey")
    placed = surveyed.where("doc is not null").select("doc", "th", "size", "cls")
    classes = placed.where("cls is not null").groupBy("cls").agg(F.min(F.struct("doc", "th")).alias("first"))
    sent = spark.sparkContext.broadcast(frequent_tokens(surveyed))
    posted = materialise(prefixes(counted_tokens(postings(documents, sent, width, similar)), similar), "prefixes")
    members = materialise(groups_of(posted.where("prefix"), similar), "members")
    wanted = materialise(members.select("cls").distinct(), "wanted")
    texts = materialise(fetched(documents, classes.join(wanted, "cls").select("cls", "first.*"), width), "texts")
    # Stars first, then the pairs that would join each group's components, then whatever is left.
    stars = star_blocks(drawn_stars(posted.where("lowest").join(wanted, "cls", "left_semi"), similar))
    near = materialise(hopeful(with_bits(stars, texts), similar), "hopeful")
    links = searched_with_texts(near, texts, width, similar)
    discard(near)
    labels = components(links)
    pairs = hopeful(with_bits(open_blocks(members, labels), texts), similar, best=True).select(F.col("key").alias("center"), "cls")
    links = links.unionByName(searched_with_texts(star_blocks(pairs), texts, width, similar))
    discard(labels)
    labels = components(links)
    near = materialise(hopeful(with_bits(open_blocks(members, labels), texts), similar), "hopeful")
    more = searched_with_texts(near, texts, width, similar)
    discard(near)
    discard(posted, labels, members, wanted, texts)
    labels = components(links.unionByName(more))

    named = classes.join(labels, "cls", "left").select("cls", "first", F.coalesce("comp", "cls").alias("comp"))
    firsts = named.groupBy("comp").agg(F.min("first").alias("comp_first"))
    reached = named.join(firsts, "comp").select("cls", "comp_first")
    out = placed.join(reached, "cls", "left")
    return out.select("doc", "th", "size", F.coalesce("comp_first.doc", "doc").alias("comp_doc"), F.coalesce("comp_first.th", "th").alias("comp_th"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """The documents without those that are connected with an earlier one; of rows that repeat id and text one stays."""
    doc, th = free_names(docs, "doc", "th")
    firsts = near_duplicates(docs, doc_id, text, width, similar).where("doc = comp_doc and th = comp_th").select(F.col("doc").alias(doc), F.col("th").alias(th))
    own = docs.withColumns({doc: id_column(docs, doc_id), th: F.xxhash64(text_column(text))})
    return own.join(firsts, [doc, th], "left_semi").dropDuplicates([doc, th]).select(*docs.columns)


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return near_duplicates(docs).select(real("doc").alias("doc_id"), F.col("size").alias("n_shingles"), real("comp_doc").alias("component_id"))
