import hashlib
import zlib

from wattline.llm.mpeg_audio import UNIT, crc16, header, op3_mpeg_audio, parse, parse_audio, payload_of, read_payload, store, store_text


def test_round_trip_of_odd_payloads():
    for text in (None, "", " ", "x" * 191, "x" * 192, "x" * 193, "é日" * 1000, "\0" * 400, "a" * 60_000):
        n, payload = payload_of(text)
        data = store(payload, n)
        parsed = parse(data)
        assert read_payload(data, parsed) == payload and int(parsed["tags"]["n_bytes"]) == n == len((text or "").encode())
        assert len(payload) % UNIT == 0 and len(payload) >= UNIT and parsed["bad_crc"] == parsed["skipped"] == 0
        assert parsed["vbr"]["frames"] == len(parsed["frames"]) and parsed["samples"] == 1152 * len(parsed["frames"]) and parsed["hz"] == 48000
        assert parsed["vbr"]["bytes"] == len(data) - (len(data) - parsed["vbr"]["bytes"]) and list(parsed["vbr"]["toc"]) == sorted(parsed["vbr"]["toc"])


def test_headers_of_the_standard():
    assert header(bytes((0xFF, 0xFB, 0x90, 0x64)))["size"] == 417  # 128 kbit/s at 44.1 kHz
    assert header(bytes((0xFF, 0xFD, 0x84, 0x00)))["layer"] == 2
    assert header(b"\xff\xff\xff\xff") is None and header(b"\xff\xe8\x90\x00") is None and header(b"\xff") is None
    assert crc16(b"123456789") == 0xAEE7


def test_resynchronises_after_junk_and_counts_bad_checksums():
    n, payload = payload_of("word " * 2000)
    data = store(payload, n)
    frames = parse(data)["frames"]
    cut = frames[3][0]
    junk = data[:cut] + b"\xff\x00junk\xff\xfb" * 3 + data[cut:]
    parsed = parse(junk)
    assert len(parsed["frames"]) == len(frames) and parsed["skipped"] == 24 and read_payload(junk, parsed) == payload
    broken = bytearray(data)
    broken[frames[2][0] + 10] ^= 1
    assert parse(bytes(broken))["bad_crc"] == 1
    assert len(parse(data[: frames[-1][0] + 7])["frames"]) == len(frames) - 1
    tagged = data + b"TAG" + b"Title".ljust(125, b"\0")
    assert parse(tagged)["tags"]["TIT2"] == "Title" and len(parse(tagged)["frames"]) == len(frames)
    assert parse(None)["samples"] == 0 and parse(b"no audio here")["frames"] == []


def test_columns_and_query(spark, sf_dir):
    df = spark.createDataFrame([(1, "a" * 1000, "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, feature string")
    out = df.withColumn("media", store_text()).withColumn("audio", parse_audio("media")).collect()
    assert [r.audio.n_frames for r in out] == [2, 1, 1, 1] and all(r.audio.n_samples == 1152 * r.audio.n_frames and r.audio.bad_crc == 0 for r in out)
    assert out[1].media == out[2].media == out[3].media
    assert spark.createDataFrame([(None,)], "m binary").select(parse_audio("m").alias("a")).first().a.n_frames == 0
    assert df.limit(0).withColumn("media", store_text()).collect() == []
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op3_mpeg_audio(spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
