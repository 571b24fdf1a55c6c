import base64
import gzip
import hashlib
import json
import random
import zlib

import pytest

from quillframe.llm import warc
from quillframe.llm.common import new_path


def by_hand(rows, least=0):
    out, tops = [], {}
    for i, _, html in rows:
        if i is not None:
            tops[html or ""] = max(tops.get(html or "", i), i)
    for i, _, html in rows:
        raw, top = (html or "").encode(), tops.get(html or "")
        again = len(raw) >= least and top is not None and (i is None or i < top)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def pages():
    r = random.Random(6)
    bodies = [None, "", "é" * 50, "\r\n\r\nWARC/1.1\r\n", "x" * 3_000_000] + ["<p>" + "".join(r.choice("ab \n") for _ in range(r.randint(0, 3000))) for _ in range(20)]
    rows = [(i, r.choice(["http://a/é b\r\nX: y", None, "http://c"]), r.choice(bodies)) for i in range(120)]
    return rows + [(119, None, "twice"), (119, None, "twice"), (None, None, "twice"), (None, None, "nowhere else")]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    rows = pages()
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), least).collect()
    assert sorted((tuple(x) for x in got), key=str) == by_hand(rows, least)


def test_normaliser_and_index(spark):
    rows = [(i, f"http://x/{i}", f"body {i} é" * 500) for i in range(200)]
    raw, own = new_path(spark, "raw"), new_path(spark, "own")
    made = warc.write_archives(warc.with_kinds(spark.createDataFrame(rows, "page_id long, url string, html string")), raw, roll=200_000).collect()
    assert sum(r["records"] for r in made) == 200 and len(made) > 4
    for f in warc.archives(spark, raw).select("content").collect():  # one stream each
        stream = zlib.decompressobj(31)
        stream.decompress(f["content"])
        assert stream.eof and not stream.unused_data
    done = warc.normalise(warc.archives(spark, raw), own).collect()
    seen = 0
    for r in done:
        with open(r["index"].removeprefix("file://")) as f:
            entries = [json.loads(x) for x in f]
        assert len(entries) == r["records"]
        for e in entries[::17]:
            found = warc.fetch(r["path"], e["offset"], e["length"])
            assert found["payload"].decode() == f"body {e['page_id']} é" * 500 and found["url"] == f"http://x/{e['page_id']}" and found["payload_digest"] == e["digest"]
        seen += len(entries)
    assert seen == 200


def test_inflate():
    data = b"".join(gzip.compress(bytes([i]) * 100_000) for i in range(5))
    assert b"".join(warc.inflate(data, 777)) == b"".join(bytes([i]) * 100_000 for i in range(5))
    whole = b"".join(warc.record(i, None, b"x" * i, None) for i in range(50))
    assert len(list(warc.split_records(whole[k : k + 13] for k in range(0, len(whole), 13)))) == 50
    with pytest.raises(ValueError):
        list(warc.split_records([whole[:-3]]))
    packed = gzip.compress(bytes(50_000_000))
    assert max(map(len, warc.inflate(packed, 1 << 20))) <= 1 << 20 and sum(map(len, warc.inflate(packed, 1 << 20))) == 50_000_000
    for lost in (1, 4, 8, 9):
        with pytest.raises(ValueError):
            list(warc.inflate(data[:-lost], 777))


def test_records_conform(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "other")]
    raw = new_path(spark, "raw")
    made = warc.write_archives(warc.with_kinds(spark.createDataFrame(rows, "page_id long, url string, html string")), raw, date="2024-05-06T07:08:09Z").collect()
    heads = {}
    for r in made:
        records = list(warc.records_of(r["path"]))
        assert warc.headers(records[0])["warc-type"] == "warcinfo" and len(records) == r["records"] + 1
        for x in records[1:]:
            h = warc.headers(x[: x.find(b"\r\n\r\n")])
            block = x[x.find(b"\r\n\r\n") + 4 : -4]
            assert h["warc-block-digest"] == "sha1:" + warc.digest(block) and int(h["content-length"]) == len(block) and h["warc-date"] == "2024-05-06T07:08:09Z"
            heads[int(h["page-id"])] = h
    again = heads[1]
    assert again["warc-type"] == "revisit" and again["warc-refers-to"] == heads[2]["warc-record-id"] and again["warc-refers-to-target-uri"] == "http://a/2" and again["warc-refers-to-date"] == heads[2]["warc-date"]
    assert len({h["warc-record-id"] for h in heads.values()}) == 3 and heads[3]["warc-type"] == "response"


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string, sha string")).count() == 0


def test_archives_of_a_lost_attempt_are_not_read(spark, monkeypatch):
    write = warc.write_archives

    def twice(pages, folder):
        write(pages, folder)  # an attempt whose archives stay and whose table is lost
        return write(pages, folder)

    monkeypatch.setattr(warc, "write_archives", twice)
    rows = pages()
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((tuple(x) for x in got), key=str) == by_hand(rows)
