import base64
import hashlib
from collections import Counter

import zstandard
from hypothesis import given
from hypothesis import strategies as st

from ratelab.llm import frames, queries, warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def made(n=5, dictionary=b""):
    pages = [b"<p>page %d</p>" % i * (i + 1) for i in range(n)]
    return pages, warc.archive([warc.record(i, f"http://x/{i} ü", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(pages)], dictionary)


@given(st.integers(-2**63, 2**63 - 1))
def test_record_id_carries_the_page(page_id):
    assert warc.page_of(warc.record_id(page_id, "ab" * 20)) == page_id


def test_page_of_other_ids():
    assert warc.page_of(None) is None and warc.page_of("<urn:uuid:12>") is None and warc.page_of(warc.record_id(None, "ab" * 20)) is None


def test_archive_round_trip_with_and_without_dictionary():
    dictionary = zstandard.train_dictionary(2048, [b"<p>page %d</p> some more text %d" % (i, i * i) * 9 for i in range(300)]).as_bytes()
    for used in (b"", dictionary):
        pages, data = made(5, used)
        found = list(warc.records(data))
        assert [f["payload"] for f in found] == pages and not any(f["problem"] for f in found)
        assert (int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC) == bool(used)
        assert sum(1 for *_, magic in warc.frames(data) if magic not in warc.SKIPPABLE) == 5


def test_raw_dictionary_frame_is_read_too():
    dictionary = zstandard.train_dictionary(2048, [b"<p>page %d</p> some more text %d" % (i, i * i) * 9 for i in range(300)]).as_bytes()
    _, data = made(3, dictionary)
    end = next(warc.frames(data))[1]
    plain = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    assert not any(f["problem"] for f in warc.records(plain + data[end:]))


def test_damage_is_told_and_the_rest_is_read():
    _, data = made()
    spots = [(a, b) for a, b, _ in warc.frames(data)]
    cut = list(warc.records(data[:spots[4][1] - 3]))
    assert [bool(f["problem"]) for f in cut] == [False] * 4 + [True]
    assert [bool(f["problem"]) for f in warc.records(data[:spots[1][1]] + b"noise" + data[spots[1][1]:])] == [False, False, True]
    body = bytearray(data)
    body[spots[2][1] - 1] ^= 255
    assert [bool(f["problem"]) for f in warc.records(bytes(body))] == [False, False, True, False, False]
    assert list(warc.records(b"")) == []


def test_header_checks():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse(good)["problem"] is None
    for old, new in ((b"WARC/1.1", b"WORC/1.1"), (b"WARC-Date: ", b"X-Date: "), (b"Content-Length: 8", b"Content-Length: 9"), (b"abc\r\n", b"abd\r\n"),
                     (b"WARC-Type: response\r\n", b"WARC-Type: response\r\nWARC-Type: response\r\n"), (b"WARC-Date: ", b"WARC-Date "), (b"HTTP/1.1", b"HTTQ/1.1")):
        assert old in good and warc.parse(good.replace(old, new, 1))["problem"], old
    repeat = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 7)
    assert warc.parse(repeat)["problem"] is None and warc.page_of(warc.parse(repeat)["refers_to"]) == 7
    assert warc.parse(repeat.replace(b"WARC-Refers-To", b"WARC-Referred-To"))["problem"]


def test_pages_of_every_kind(spark):
    rows = [(1, "u", "a"), (3, "u", "a"), (2, None, "a"), (3, "u", "a"), (4, "", None), (5, "u\r\nX: y", ""), (None, "u", "a"), (None, "u", "lonely"), (None, "u", "lonely"),
            (6, "u", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    folder = frames.shared_folder(spark, "warc-test")
    got = warc.read(warc.write(pages, folder, archive_bytes=500), folder).collect()
    assert not any(r.problem for r in got)
    best = {"a": 3, "": 5, "é" * 300_000: 6, "lonely": None}
    want = Counter()
    for page, _, html in rows:
        keep, data = best[html or ""], (html or "").encode()
        kind = ("response", None) if keep is None or keep == page else ("revisit", keep)
        want[(page, len(data), digest(data), *kind)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in got) == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)


def test_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string").limit(0)
    assert warc.write(pages, frames.shared_folder(spark, "warc-test")).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    best = {}
    for p in pages:
        best[p.html] = max(best.get(p.html, p.page_id), p.page_id)
    want = sorted((p.page_id, len(p.html.encode()), digest(p.html.encode()), *(("response", None) if best[p.html] == p.page_id else ("revisit", best[p.html]))) for p in pages)
    got = queries.QUERIES["op4_warc"](spark, folder).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
