import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from sparkfolio.llm import warc_zip as w
from sparkfolio.llm.queries import op4_warc


def brute(rows):
    payloads = [(h or "").encode() for _, h in rows]
    first = {}
    for i, (k, _) in enumerate(rows):
        if len(payloads[i]) >= 100:
            first[payloads[i]] = min(first.get(payloads[i], ((True, 0), 10**9)), ((k is None, k or 0), i))
    out = []
    for i, (k, _) in enumerate(rows):
        p = payloads[i]
        revisit = len(p) >= 100 and first[p][1] != i
        refers = rows[first[p][1]][0] if revisit else None
        out.append((k, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", refers))
    return sorted(out, key=str)


def test_query(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op4_warc(spark, sf).collect()), key=str) == brute(rows)


def test_copies_nulls_long_texts(spark):
    hot = "<p>é" * 50
    rows = [(i if i % 7 else None, hot) for i in range(300)] + [(3, hot)] * 3 + [(5, None), (6, ""), (6, ""), (7, "x" * 99), (8, "x" * 99), (9, "y" * 100), (9, "y" * 100), (1, "\r\n\r\n" * 60), (2, "z" * 500_000)]
    pages = spark.createDataFrame([(k, None if i % 5 == 0 else f"http://a/{i}\r\nX: y é", h, "u") for i, (k, h) in enumerate(rows)], "page_id long, url string, html string, digest string")
    packages = w.archive(pages.repartition(3), records=40)
    got = w.read(packages)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)
    assert packages.count() > 5
    stored = {r.payload for r in got.filter("record_type = 'response'").collect()}
    assert stored == {(h or "").encode() for _, h in rows}
    assert w.read(w.archive(pages.limit(0))).count() == 0


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment " * 3])
def test_directories(comment):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"first")
        z.writestr("é/b", b"second" * 1000)
        for i in range(66_000):  # beyond 65,535 members, so ZIP64
            z.writestr(f"m{i}", b"x")
        z.comment = comment
    file = pa.PythonFile(io.BytesIO(raw.getvalue()), "r")
    found = {m.name: m for m in w.members(file)}
    assert len(found) == 66_002
    for name, want in (("a", b"first"), ("é/b", b"second" * 1000), ("m65999", b"x")):
        assert file.read_at(found[name].size, w.start_of(file, found[name])) == want
    with pytest.raises(ValueError):
        w.members(pa.PythonFile(io.BytesIO(b"not a zip" * 10), "r"))


def test_zip64_sizes():
    """A directory entry whose sizes and offset stand in its ZIP64 field."""
    entry = w.CENTRAL + bytes(6) + bytes(10) + b"\xff" * 8 + (1).to_bytes(2, "little") + (32).to_bytes(2, "little") + bytes(10) + b"\xff" * 4 + b"n"
    entry += bytes.fromhex("99000000") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"".join(v.to_bytes(8, "little") for v in (9 << 32, 7 << 32, 5 << 32))
    end = w.END64 + (44).to_bytes(8, "little") + bytes(12) + (1).to_bytes(8, "little") * 2 + len(entry).to_bytes(8, "little") + (0).to_bytes(8, "little")
    locator = w.LOCATOR + bytes(4) + len(entry).to_bytes(8, "little") + bytes(4)
    last = w.END + bytes(4) + b"\xff" * 12 + bytes(2)
    assert w.members(pa.PythonFile(io.BytesIO(entry + end + locator + last), "r")) == [w.Member("n", 0, 7 << 32, 5 << 32)]


def test_records_are_read_in_as_many_tasks_as_blocks(spark):
    """A third of the pages are equal, and their records are small; the tasks follow the bytes, not the places."""
    rows = [(i, f"http://x/{i}", ("same " * 40) if i % 3 == 0 else f"page {i} " * 50) for i in range(300)]
    packages = w.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = w.read(packages, block=10_000)
    assert got.rdd.getNumPartitions() > 5
    back = got.collect()
    assert len(back) == 300 and sum(r.record_type == "revisit" for r in back) == 99
