import io
import struct

import llm_cases as cases
import zstandard

from strandloom.llm import warc

NAMES = [*cases.CLASHING, "response", "payload", "uri", "large", "h", "size", "page_id_", "frame"]
PAGES = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in dict.fromkeys(NAMES))


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(set(NAMES))) for r in rows], PAGES).repartition(3)


ROWS = [(k, f"http://e.org/{k}", f"<html>{'page text ' * 40}{k % 40}</html>") for k in range(120)] + [
    (200, "http://e.org/a", None),
    (201, None, ""),
    (202, "http://e.org/é\r\nx", "<p>ünï \U0001f600\r\n\r\nContent-Length: 3</p>"),
    (203, "http://e.org/long", "x" * 500_000),
    (None, "http://e.org/none", "<html>null id</html>"),
    (204, "http://e.org/none", "<html>null id</html>"),
    (205, "u", "same"),
    (205, "u", "same"),
    (206, "u", "same"),
]


def expected(rows, least=0):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            best[h or ""] = max(best.get(h or "", -1), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = best.get(h or "") if i is not None and len(data) >= least and best[h or ""] != i else None
        out.append((i, "revisit" if refers is not None else "response", refers, len(data), warc.sha1_base32(data)))
    return out


def test_round_trip(spark):
    got = warc.archive_round_trip(pages(spark, ROWS))
    assert cases.same(got.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect(), expected(ROWS))


def test_smaller_payloads_are_all_responses(spark):
    got = warc.archive_round_trip(pages(spark, ROWS), min_bytes=10)
    assert cases.same(got.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect(), expected(ROWS, 10))


def test_many_repeated_payloads(spark, monkeypatch):
    """Without the broadcast of digests the records are the same."""
    monkeypatch.setattr(warc, "SENT_DIGESTS", 0)
    got = warc.archive_round_trip(pages(spark, ROWS))
    assert cases.same(got.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect(), expected(ROWS))


def test_payloads_and_files(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write_archives(pages(spark, ROWS), path)
    files = sorted((tmp_path / "out").glob("*.warc.zst"))
    assert files
    got = {(r.page_id, r.payload) for r in warc.read_archives(spark, path).filter("record_type = 'response'").collect()}
    for i, kind, *_ in expected(ROWS):
        if kind == "response":
            assert any(i == g[0] for g in got)
    assert (202, bytearray(ROWS[122][2].encode())) in [(a, b) for a, b in got] or any(a == 202 and bytes(b) == ROWS[122][2].encode() for a, b in got)
    data = files[0].read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and data[8 : 8 + 4] == bytes.fromhex("37a430ec")  # a dictionary's own magic number
    shared = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(io.BytesIO(data), read_across_frames=True)
    text = reader.read()  # any reader gets the records, one after the other
    assert text == b"".join(warc.frames_of(data)) and text.startswith(b"WARC/1.1\r\n")
    for record in warc.frames_of(data):
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and b"WARC-Payload-Digest: sha1:" in record


def test_dictionary_helps():
    samples = [warc.record(k, f"http://e.org/{k}", f"<html>{'common words ' * 5}{k}</html>".encode(), None, "d") for k in range(300)]
    shared = zstandard.ZstdCompressionDict(warc.train_dictionary(samples, 65536))
    plain, own = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(dict_data=shared)
    assert sum(len(own.compress(s)) for s in samples) < 0.5 * sum(len(plain.compress(s)) for s in samples)


def test_edges(spark, tmp_path):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0
    few = [(1, "u", "only one")]
    got = warc.archive_round_trip(pages(spark, few)).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(1, "response")]
    assert warc.train_dictionary([b"x"] * 3, 1000) == b"" and warc.train_dictionary([], 1000) == b""


def test_damage_is_noticed(spark):
    data = warc.record(1, "u", b"payload", None, "d").replace(b"payload", b"pAyload")
    import pytest

    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(data)
    frame = zstandard.ZstdCompressor().compress(b"x" * 1000)
    with pytest.raises(ValueError, match="ends"):
        list(warc.frames_of(frame[:-3]))
