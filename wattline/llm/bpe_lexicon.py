"""Byte-level BPE encoding and decoding with a lexicon compiled into a minimal acyclic automaton.

Word counts over all documents give the most frequent words; their exact merges are computed once and compiled into a
minimal acyclic transducer: states with equal futures are shared while sorted words are added, and the number of words
passed on the way to a word's end is its index into the table of id sequences. The file goes to the shared folder, Spark
hands it to every executor and workers map it into memory. Words that it doesn't hold are merged exactly.

Edge cases: a null or empty text has no ids; special tokens in a text become their id, as the library does; runs of spaces
and words of any length are whole words (long ones are merged with a heap); equal texts give equal ids; other columns stay.
Letters assigned by Unicode versions later than the tokenizers library's may be split elsewhere than there.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
from array import array
from collections import Counter

import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import materialise, read_table, schema, shared_dir

#: Words in the lexicon, and bytes of the longest; both bound the file.
LEXICON_WORDS, LONGEST_WORD = 20_000, 48
#: Entries that a worker remembers before it forgets them all (about 250 bytes each), and words that it counts at once.
MEMORY, COUNTED = 600_000, 200_000
#: Stands for the rank of a pair that is never merged.
NEVER = 2**31
#: Longer words are merged with a heap.
SHORT_WORD = 64

# Fixed value: the published pattern of byte-level pre-tokenization, as published.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
SINGLE_SPACE = regex.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the letters from U+0100 on."""
    letters, more = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(256 + more)
            more += 1
    return letters


class Merges:
    """The vocabulary of a tokenizer file and exact merging."""

    def __init__(self, content: str):
        told = json.loads(content)
        to_byte = {c: b for b, c in byte_letters().items()}
        vocab = told["model"]["vocab"]
        raw = {token: bytes(to_byte[c] for c in token) for token in vocab if all(c in to_byte for c in token)}
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", ())}
        self.token = {vocab[token]: b for token, b in raw.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.rank, self.new = {}, []  # of each pair, and what it becomes by rank
        for rank, merge in enumerate(told["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[left], vocab[right]] = rank
            self.new.append(vocab[left + right])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in piece]
        return self._merge_short(ids) if len(ids) <= SHORT_WORD else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, new = self.rank.get, self.new
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            ids[at] = one = new[best]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get((one, ids[at + 1]), NEVER)
            if at:
                ranks[at - 1] = get((ids[at - 1], one), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order, lowest rank first and leftmost among equals, from a heap over a linked list."""
        n = len(ids)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.rank.get
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j < 0 or ids[j] != right:
                continue
            ids[k], ids[j], after[k] = self.new[rank], -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] >= 0 and (r := get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words and their ids as one block of bytes."""
    finals, edges = [False], [{}]  # state 0 is the root
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # unchecked (state, byte, child)

    def settle(length: int) -> None:
        while len(path) > length:
            state, byte, child = path.pop()
            future = (finals[child], tuple(edges[child].items()))
            edges[state][byte] = register.setdefault(future, child)

    last = b""
    ordered = sorted(w for w in words if w)
    for word in ordered:
        common = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            finals.append(False)
            edges.append({})
            child = len(finals) - 1
            edges[state][byte] = child
            path.append((state, byte, child))
            state = child
        finals[state] = True
        last = word
    settle(0)

    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for child in edges[stack.pop()].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    counts: dict[int, int] = {}
    for state in _children_first(edges):
        counts[state] = finals[state] + sum(counts[c] for c in edges[state].values())
    first, final, labels, targets, skips = array("i", [0]), bytearray(), bytearray(), array("i"), array("i")
    for state in order:
        passed = int(finals[state])
        final.append(passed)
        for byte, child in sorted(edges[state].items()):
            labels.append(byte)
            targets.append(number[child])
            skips.append(passed)
            passed += counts[child]
        first.append(len(labels))
    ids, offsets = array("i"), array("i", [0])
    for word in ordered:
        ids.extend(words[word])
        offsets.append(len(ids))
    head = struct.pack("<4sIIII", b"MAT1", len(order), len(labels), len(ordered), len(ids))
    return head + first.tobytes() + targets.tobytes() + skips.tobytes() + offsets.tobytes() + ids.tobytes() + bytes(final) + bytes(labels)


def _children_first(edges: list[dict[int, int]]):
    seen, stack = set(), [(0, iter(edges[0].values()))]
    while stack:
        state, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if state not in seen:
                seen.add(state)
                yield state
        elif child not in seen:
            stack.append((child, iter(edges[child].values())))


class Lexicon:
    """A compiled lexicon, read where it lies: a mapped file or bytes."""

    def __init__(self, data):
        self.data = data
        magic, self.states, edges, self.words, ids = struct.unpack_from("<4sIIII", data)
        if magic != b"MAT1":
            raise ValueError("not a lexicon")
        view, at = memoryview(data), struct.calcsize("<4sIIII")

        def ints(n: int):
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("i")

        self.first, self.targets, self.skips, self.offsets, self.ids = ints(self.states + 1), ints(edges), ints(edges), ints(self.words + 1), ints(ids)
        self.final = view[at : at + self.states]
        self.labels = at + self.states

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        state = index = 0
        first, find, labels = self.first, self.data.find, self.labels
        for k in range(len(word)):
            edge = find(word[k : k + 1], labels + first[state], labels + first[state + 1]) - labels
            if edge < 0:
                return None
            index += self.skips[edge]
            state = self.targets[edge]
        return list(self.ids[self.offsets[index] : self.offsets[index + 1]]) if self.final[state] and word else None


class Encoder:
    """Encodes and decodes texts: memory of this worker, then the lexicon, then exact merges."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None = None):
        self.merges, self.lexicon = merges, lexicon
        self.known: dict[str, tuple[int, ...]] = {}
        self.spelled = {i: str(i) for i in merges.token}

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        found = self.lexicon.get(raw) if self.lexicon else None
        return found if found is not None else self.merges.merge(raw)

    def pieces(self, text: str) -> tuple[int, ...]:
        """The ids of a word with its signs; words of letters that were seen without them are remembered."""
        if text.isascii() and (text[1:] if text[0] == " " else text).isalpha():
            return tuple(self.piece(text))
        parts = PIECES.findall(text)
        if len(parts) == 1:
            return tuple(self.piece(text))
        ids: list[int] = []
        for p in parts:
            found = self.known.get(p[1:]) if p[0] == " " else None
            ids.extend(self.piece(p) if found is None else found)
        return tuple(ids)

    def plain(self, text: str) -> list[int]:
        """A single space between two characters that aren't spaces always begins a piece, so what follows it up to the next
        such space can be remembered."""
        known, ids = self.known, []
        if len(known) > MEMORY:
            known.clear()
        words = text.split(" ")
        for k, word in enumerate(words):
            key = word if k else "\0" + word
            found = known.get(key)
            if found is None:
                if not word or word[0].isspace() or word[-1].isspace() or word[0] == "\0":
                    return self.any_spaces(text)
                found = known[key] = self.pieces(" " + word if k else word)
            ids.extend(found)
        return ids

    def any_spaces(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(SINGLE_SPACE.split(text)):
            ids.extend(self.pieces(" " + part if k else part))
        return ids

    def encode(self, text: str) -> list[int]:
        if not self.merges.cut or not any(s in text for s in self.merges.special):
            return self.plain(text) if text else []
        ids: list[int] = []
        for part in self.merges.cut.split(text):
            ids.extend([self.merges.special[part]] if part in self.merges.special else self.plain(part) if part else [])
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.merges.token.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer_content(path: str | None = None) -> str:
    """The tokenizer file, by default the public 50k byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word of letters stands after a space or at the start, in all documents."""

    def counted(batches):
        counts: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts.update(w for w in (x or "").split(" ") if w.isalpha())
                if len(counts) > COUNTED:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, schema("word string, n long"))
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, merges: Merges, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The automaton of the most frequent words, each as it stands after a space: all words of more sightings than a bound
    that at most `words` exceed. The bound comes from a histogram of at most a few hundred rows, so no more than `words` words
    reach the driver."""
    counts = materialise(count_words(docs, text).where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST_WORD)).withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    bound, seen = None, 0
    for level, n in sorted(((r.level, r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        seen += n
        if seen > words:
            break
        bound = level
    top = counts.where(F.col("level") >= bound).collect() if bound is not None else []
    pieces = {" " + r.word for r in top}
    return compile_lexicon({p.encode(): merges.merge(p.encode()) for p in pieces if PIECES.findall(p) == [p]})


def hand_out(spark: SparkSession, data: bytes) -> str:
    """Write the lexicon to the shared folder and let Spark give it to every executor; its file name."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, True)
        out.write(bytearray(data))
        out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


_ENCODERS: dict[str, Encoder] = {}


class Handle:
    """What a worker needs to build its encoder once: the broadcast tokenizer file and the lexicon's name."""

    def __init__(self, spark: SparkSession, content: str, lexicon: bytes | None):
        self.content = spark.sparkContext.broadcast(content)
        self.lexicon = hand_out(spark, lexicon) if lexicon is not None else ""
        self.key = hashlib.sha256(content.encode()).hexdigest() + self.lexicon

    def encoder(self) -> Encoder:
        if self.key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[self.key] = Encoder(Merges(self.content.value), Lexicon.mapped(SparkFiles.get(self.lexicon)) if self.lexicon else None)
        return _ENCODERS[self.key]


def prepare(docs: DataFrame, text: str = "text", tokenizer: str | None = None, words: int = LEXICON_WORDS) -> Handle:
    """Fit the lexicon on all documents and hand it out."""
    content = tokenizer_content(tokenizer)
    return Handle(docs.sparkSession, content, fit_lexicon(docs, Merges(content), text, words))


def encode_column(handle: Handle, text: str | Column) -> Column:
    """An array of ids for a text column."""

    @F.pandas_udf(schema("x <int>").fields[0].dataType)
    def ids(texts: pd.Series) -> pd.Series:
        e = handle.encoder()
        return pd.Series([e.encode(x or "") for x in texts], dtype=object)

    return ids(F.col(text) if isinstance(text, str) else text)


def decode_column(handle: Handle, ids: str | Column) -> Column:
    @F.pandas_udf(schema("x string").fields[0].dataType)
    def texts(found: pd.Series) -> pd.Series:
        e = handle.encoder()
        return pd.Series([e.decode(x if x is not None else ()) for x in found], dtype=object)

    return texts(F.col(ids) if isinstance(ids, str) else ids)


FIGURES = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_figures(handle: Handle, text: str | Column, with_ids: bool = False) -> Column:
    """Number and digest of a text's ids, and digest of what they decode to; the ids as well if asked for."""
    names = [x.split()[0] for x in FIGURES.split(", ")] + ["ids"] * with_ids

    @F.pandas_udf(schema(FIGURES + ", ids <int>" * with_ids))
    def figures(texts: pd.Series) -> pd.DataFrame:
        e, rows = handle.encoder(), []
        spelled = e.spelled.__getitem__
        for x in texts:
            ids = e.encode(x or "")
            rows.append((len(ids), hashlib.sha256(",".join(map(spelled, ids)).encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest(), *[ids] * with_ids))
        return pd.DataFrame(rows, columns=names)

    return figures(F.col(text) if isinstance(text, str) else text)


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", encode_figures(prepare(docs), "text").alias("e")).select("doc_id", "e.*")
