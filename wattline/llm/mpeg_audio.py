"""MPEG audio columns: resynchronise frame headers, parse tags and variable-bitrate tables, verify checksums, and keep
exact durations and frame seek offsets; and a writer that stores bytes losslessly as a silent, valid stream.

The writer makes MPEG-1 layer III frames at 48 kHz, mono, with CRC and empty granules (a player hears silence); the bytes
after the side information are free for ancillary data and hold the payload in units of 192 bytes. Frames of 672, 480 and
240 bytes hold 3, 2 and 1 units, so the bitrate varies; an ID3v2.3 tag holds the unpadded length and a Xing frame holds
frame count, byte count and the table of contents.

Edge cases: a null or empty text becomes one unit of spaces; equal texts give equal streams; junk between frames, lost
bytes and cut-off ends are counted and skipped; a stream without a frame has no duration (0 samples); a null stream is
parsed as an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import read_table, schema

UNIT = 192
# Fixed values of the MPEG audio standard: kbit/s by (version 1?, layer) and index, samples a second by version and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Layer III kbit/s at 48 kHz by payload units in a frame.
KBITS = {3: 224, 2: 160, 1: 80}
SEEK_EVERY = 16


def _crc_table() -> list[int]:
    """For the polynomial x^16 + x^15 + x^2 + 1, most significant bit first."""
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


CRC = _crc_table()


def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC[value >> 8 ^ byte]
    return value


def header(word: bytes) -> dict | None:
    """What four header bytes say, or None if they are no frame header."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, kbit = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or kbit in (0, 15):
        return None
    first, mono = version == 3, word[3] >> 6 == 3
    hz, kbits, pad = RATES[version][rate], BITRATES[first, layer][kbit], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbits // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + pad
    side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return {"version": version, "layer": layer, "hz": hz, "kbits": kbits, "samples": samples, "size": size, "side": side, "crc": not word[1] & 1, "mono": mono}


def _syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """Where the tag at `at` ends, and its text frames; user texts by their description."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at, {}
    end = at + 10 + _syncsafe(data[at + 6 : at + 10])
    texts, pos, version = {}, at + 10, data[at + 3]
    while version >= 3 and pos + 10 <= min(end, len(data)) and data[pos]:
        name = data[pos : pos + 4].decode("latin-1")
        size = _syncsafe(data[pos + 4 : pos + 8]) if version >= 4 else int.from_bytes(data[pos + 4 : pos + 8])
        body = data[pos + 10 : pos + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            texts[key] = value
        pos += 10 + size
    return end, texts


def vbr_table(frame: bytes, head: dict) -> dict:
    """Frame count, byte count and table of contents of a Xing or Info frame."""
    at = 4 + head["side"]
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        return {}
    flags, pos, out = int.from_bytes(frame[at + 4 : at + 8]), at + 8, {"kind": frame[at : at + 4].decode()}
    for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
        if flags & bit:
            out[name] = bytes(frame[pos : pos + size]) if name == "toc" else int.from_bytes(frame[pos : pos + size])
            pos += size
    return out


def parse(data: bytes | None) -> dict:
    """Tags, VBR table and frames of a stream; two headers in a row, or one that ends the stream, make a synchronisation."""
    data = data or b""
    at, tags = id3v2(data)
    end = len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    frames, bad_crc, skipped, samples, vbr, known = [], 0, 0, 0, {}, {}
    synced, hz = False, 0
    while at + 4 <= end:
        word = data[at : at + 4]
        head = known[word] if word in known else known.setdefault(word, header(word))
        if head and at + head["size"] <= end:
            follows = at + head["size"]
            if synced or follows == end or header(data[follows : follows + 4]):
                frame = data[at:follows]
                if not frames and not vbr and (vbr := vbr_table(frame, head)):
                    at, synced = follows, True
                    continue
                if head["crc"] and head["layer"] == 3:
                    bad_crc += crc16(frame[2:4] + frame[6 : 6 + head["side"]]) != int.from_bytes(frame[4:6])
                frames.append((at, head))
                samples += head["samples"]
                hz = head["hz"]
                at, synced = follows, True
                continue
        synced = False
        found = data.find(b"\xff", at + 1, end)
        found = end if found < 0 else found
        skipped += found - at
        at = found
    return {"tags": tags, "vbr": vbr, "frames": frames, "bad_crc": bad_crc, "skipped": skipped + max(0, end - at), "samples": samples, "hz": hz}


def _frame(units: bytes) -> bytes:
    n = len(units) // UNIT
    kbits = KBITS[n]
    first = bytes((0xFF, 0xFA, BITRATES[True, 3].index(kbits) << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    crc = crc16(first[2:] + side)
    body = first + crc.to_bytes(2) + side + units
    return body.ljust(144 * kbits // 48, b"\0")


_EMPTY = {n: _frame(bytes(n * UNIT)) for n in KBITS}


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the text's UTF-8 with spaces up to a positive multiple of the unit."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def store(payload: bytes, n_bytes: int) -> bytes:
    """A stream whose frames hold the payload."""
    frames = []
    for at in range(0, len(payload), 3 * UNIT):
        units = payload[at : at + 3 * UNIT]
        empty = _EMPTY[len(units) // UNIT]
        frames.append(empty[:23] + units + empty[23 + len(units) :])
    body = b"\0" + b"n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + len(body).to_bytes(4) + b"\0\0" + body
    size = len(tag)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    total, ends = 480, []
    for f in frames:
        ends.append(total)
        total += len(f)
    toc = bytes(min(255, ends[k * len(frames) // 100] * 256 // total) for k in range(100))
    info = (bytes((0xFF, 0xFB, BITRATES[True, 3].index(160) << 4 | 1 << 2, 0xC0)) + bytes(17) + b"Xing" + struct.pack(">III", 15, len(frames), total) + toc + struct.pack(">I", 100)).ljust(480, b"\0")
    return tag + info + b"".join(frames)


def read_payload(data: bytes, parsed: dict) -> bytes:
    """The payload out of the stored frames."""
    out = []
    for at, head in parsed["frames"]:
        start = 4 + 2 * head["crc"] + head["side"]
        out.append(data[at + start : at + start + (head["size"] - start) // UNIT * UNIT])
    return b"".join(out)


def feature(parsed: dict, n_bytes: int) -> str:
    """Exact duration as a fraction of a second, and the seek offsets of every SEEK_EVERY-th frame."""
    kbits: dict[int, int] = {}
    for _, head in parsed["frames"]:
        kbits[head["kbits"]] = kbits.get(head["kbits"], 0) + 1
    seeks = ",".join(str(at) for at, _ in parsed["frames"][::SEEK_EVERY])
    rates = ",".join(f"{k}x{n}" for k, n in sorted(kbits.items()))
    agrees = parsed["vbr"].get("frames") == len(parsed["frames"])
    return f"duration={parsed['samples']}/{parsed['hz']};frames={len(parsed['frames'])};kbits={rates};bad_crc={parsed['bad_crc']};skipped={parsed['skipped']};vbr={parsed['vbr'].get('kind', '')}:{int(agrees)};toc={zlib.crc32(parsed['vbr'].get('toc', b''))};seeks={seeks}"


FIGURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@F.pandas_udf(schema(FIGURES))
def stored_figures(media: pd.Series) -> pd.DataFrame:
    """What stored streams hold, read from their bytes alone."""
    rows = []
    for data in media:
        data = bytes(data)
        parsed = parse(data)
        n, payload = int(parsed["tags"]["n_bytes"]), read_payload(data, parsed)
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(parsed, n)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FIGURES.split(", ")])


@F.pandas_udf(schema("x binary").fields[0].dataType)
def stored(texts: pd.Series) -> pd.Series:
    """The stream of each text."""
    return pd.Series([store(p, n) for n, p in map(payload_of, texts)], dtype=object)


PARSED = "n_frames long, n_samples long, hz long, seconds double, kbits double, bad_crc long, skipped_bytes long, vbr_frames long, vbr_bytes long, seek_offsets <long>, title string"


@F.pandas_udf(schema(PARSED))
def parsed_audio(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        p = parse(bytes(data) if data is not None else None)
        n, seconds = len(p["frames"]), p["samples"] / p["hz"] if p["hz"] else 0.0
        rows.append((n, p["samples"], p["hz"], seconds, sum(h["kbits"] for _, h in p["frames"]) / n if n else 0.0, p["bad_crc"], p["skipped"], p["vbr"].get("frames"), p["vbr"].get("bytes"), [at for at, _ in p["frames"]], p["tags"].get("TIT2")))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])


def parse_audio(media: str | Column) -> Column:
    """A struct of durations, checksums and seek offsets for a binary column of MPEG audio."""
    return parsed_audio(F.col(media) if isinstance(media, str) else media)


def store_text(text: str | Column = "text") -> Column:
    return stored(F.col(text) if isinstance(text, str) else text)


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", store_text().alias("media")).select("doc_id", stored_figures("media").alias("m")).select("doc_id", "m.*")
