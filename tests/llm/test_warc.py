import gzip
import hashlib
import io
import random

import pytest

from tidemark.llm import warc
from tidemark.session import scratch


def test_round_trip(spark):
    rng = random.Random(1)
    big = "".join(rng.choices("aé漢\r\n ", k=9000))
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "\r\n\r\nWARC/1.1\r\n" * 30, big, big, "z" * 300_000, "0\r\n\r\n" * 50]
    ids = [5, 7, 1, 2, 9, 8, 3, 20, 19, 4, 6]
    rows = [(i, f"http://h/{i}" if i != 4 else None, h, "x", 1.0) for i, h in zip(ids, html)] + [(None, "http://h/a\nb", "q" * 200, "x", 1.0), (30, "u", "q" * 200, "x", 1.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, first double")
    path = scratch(spark, "archive")
    warc.write(df, path, segment=700)
    records = warc.read(spark, path)
    assert records.filter("problem is not null").count() == 0
    got = {r.page_id: r[1:] for r in warc.resolved(records).collect()}
    want = {}
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        same = [j for j, _, g, *_ in rows if g == h and j is not None]
        first = min(same) if same else None
        again = len(data) >= 100 and i != first
        want[i] = (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)
    assert got == want
    assert {r.url for r in records.filter("page_id = 5").collect()} == {"http://h/5"}


def test_empty_table(spark):
    path = scratch(spark, "archive")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read(spark, path)).collect() == []


def test_chunks():
    for n in (0, 1, 9, 10, 11, 100):
        data = bytes(range(n))
        assert warc.dechunked(warc.chunked(data, 10)) == data
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n", b"3\r\nabc\r\n", b"3\r\nabc\r\n0\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_damage_is_named(spark, tmp_path):
    block = warc.HEAD + warc.chunked(b"hello world" * 20)
    cut = [block[:50], block[50:120], block[120:]]

    def segments(name, numbers, total=len(block)):
        out = []
        for n in numbers:
            f = {"WARC-Type": "response" if n == 1 else "continuation", "WARC-Record-ID": f"<{name}:{n}>" if n > 1 else f"<{name}>", "WARC-Segment-Number": n}
            f |= {"WARC-Segment-Origin-ID": f"<{name}>"} if n > 1 else {}
            out.append(warc.record(f | ({"WARC-Segment-Total-Length": total} if n == 3 else {}), cut[n - 1]))
        return out

    good = segments("good", [3, 1, 2])
    records = good[:2] + segments("gap", [1, 3]) + segments("open", [1, 2]) + segments("long", [1, 2, 3], 5) + segments("orphan", [2, 3]) + segments("twice", [1, 2, 2, 3])
    records.append(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<frame>"}, warc.HEAD + b"9\r\nabc"))
    (tmp_path / "a.warc").write_bytes(b"".join(r + warc.END for r in records))
    two = b"".join(gzip.compress(r + warc.END) for r in good[2:])  # a member for each record, in another file
    (tmp_path / "b.warc.gz").write_bytes(two + gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))
    got = {r.record_id: (r.payload, r.problem) for r in warc.read(spark, str(tmp_path)).collect()}
    assert bytes(got["<good>"][0]) == b"hello world" * 20 and got["<good>"][1] is None
    assert {k: v[1] for k, v in got.items() if k != "<good>"} == {
        "<gap>": "segments are missing or repeated", "<open>": "last segment is missing", "<long>": "total length differs",
        "<orphan>": "segments are missing or repeated", "<twice>": "segments are missing or repeated",
        "<frame>": "chunk is shorter or longer than its size", None: "block is shorter than its length",
    }


def test_parse_skips_blank_lines():
    data = warc.record({"WARC-Type": "x"}, b"abc") + warc.END + warc.record({"WARC-Type": "y"}, b"") + warc.END
    assert [(f["warc-type"], b) for f, b in warc.parse(io.BytesIO(data))] == [("x", b"abc"), ("y", b"")]
