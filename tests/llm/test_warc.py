"""Archives: exact round trips, and errors on damage."""

import base64
import hashlib

import pytest

from clientele.llm import warc


def plain(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload]
        last = max((p for p in same if p is not None), default=None)
        out.append((
            page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "response" if page_id == last else "revisit", None if page_id == last else last,
        ))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/\r\nx", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://c", ""),
    (5, "http://d", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (6, "http://e", "é😀" * 100_000), (7, "http://f", "é😀" * 100_000),
    (8, "http://g", "z" * 300_000), (8, "http://g", "z" * 300_000), (None, "http://h", "z" * 300_000), (None, "http://i", "own"), (9, "u", "0\r\n\r\n"),
]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(3)
    back = warc.archive_round_trip(pages).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert got == plain(ROWS)
    payloads = {bytes(r.payload).decode() for r in back if r.payload is not None}
    assert payloads == {h or "" for _, _, h in ROWS}
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 100])
def test_chunked_framing(size):
    payload = bytes(range(size))
    assert warc.unchunked(warc.chunked(payload, 8)) == payload
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(payload + b"x", 8)[:-6])


def parts_of(page):
    records = list(warc.parse_archive(warc.END.join([*page, b""])))
    return [{"number": r[5], "block": r[9], "total": r[6], "copies": 1} for r in records], records[0]


def test_segments_are_verified():
    page = list(warc.page_records(4, "u", "abc" * 100_000, None, False))
    parts, first = parts_of(page)
    assert len(parts) > 3 and first[0] == first[0] and parts[-1]["total"] == sum(len(p["block"]) for p in parts)
    page_id, *_, payload, size, _ = warc.page_of(first[0], first[1], first[2], None, first[7], first[8], parts[::-1])
    assert (page_id, payload, size) == (4, b"abc" * 100_000, 300_000)
    for damaged in (parts[:-1], parts[:1] + parts[2:], [*parts[:-1], parts[-1] | {"block": parts[-1]["block"][:-1]}], [*parts, parts[-1]]):
        with pytest.raises(ValueError):
            warc.page_of(first[0], first[1], first[2], None, first[7], first[8], damaged)


def test_cut_archive_is_an_error():
    page = b"".join(r + warc.END for r in warc.page_records(1, "u", "text", None, False))
    assert len(list(warc.parse_archive(page))) == 1
    for cut in (page[:-3], page[5:], page[:40]):
        with pytest.raises(ValueError):
            list(warc.parse_archive(cut))
