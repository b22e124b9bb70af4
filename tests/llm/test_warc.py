from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json

from cosmolake.llm import warc


def test_records_survive_any_split():
    raw = b"".join(warc.pack(k, f"http://x/{k}", b"p" * k * 7, "D", None, False) for k in range(20))
    for size in (1, 7, 64, 5000):
        pieces = [raw[k : k + size] for k in range(0, len(raw), size)]
        found = list(warc.records(iter(pieces)))
        assert b"".join(r for _, r in found) == raw and len(found) == 20


def test_inflate_reads_one_member_or_many():
    one, many = gzip.compress(b"ab" * 9000), b"".join(gzip.compress(bytes([k]) * 5000) for k in range(5))
    assert b"".join(warc.inflate(io.BytesIO(one), 100)) == b"ab" * 9000
    assert len(b"".join(warc.inflate(io.BytesIO(many), 100))) == 25_000


def test_round_trip_and_edge_cases(spark, tmp_path):
    rows = [(5, "http://a/1", "same"), (2, "http://a/2", "same"), (2, "http://a/2", "same"), (7, None, None), (8, "http://ü/\r\n x ", ""), (9, "u", "long " * 200_000), (11, "u", "🎉\r\n\r\nWARC/1.1"), (None, "u", "same")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, sha1 string")
    manifest = warc.normalise(warc.write(warc.first_payloads(df)))
    got = warc.read(manifest).collect()
    want = []
    for page_id, url, html in rows:
        p = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        revisit = len([1 for _, _, h in rows if (h or "") == (html or "")]) > 1 and page_id != min(ids)
        want.append((page_id, url, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", min(ids) if revisit else None))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for m in manifest.collect():  # every record is a member of its own, at the place the index says
        path, index = (x.removeprefix("file://") for x in (m["path"], m["index"]))
        data = open(path, "rb").read()
        lines = [json.loads(x) for x in open(index)]
        assert sum(x["length"] for x in lines) == len(data) and len(lines) == m["n_records"]
        for x in lines:
            assert gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.normalise(warc.write(warc.first_payloads(df)))).count() == 0
