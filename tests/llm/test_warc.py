import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm import warc_zip as W


def pages(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abc é\n") for _ in range(n))
    big, edge = text(3000), "x" * 999
    rows = [(i, f"https://h/{i}", text(rng.randrange(50))) for i in range(20)]
    rows += [(i, "https://h/big\r\nX: y", big) for i in range(30, 60)] + [(70 + i, "u", edge) for i in range(3)] + [(80, "u", edge + "x"), (81, "u", edge + "x")]
    rows += [(90, None, None), (91, "", ""), (None, "n", big), (59, "again", big)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("size", F.lit(1)).withColumn("salt", F.lit(1))


def expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last[h or ""] if i is not None and len(raw) >= 1000 and i < last[h or ""] else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("zip64", "limit", "joined"), [(False, W.PACKAGE_BYTES, True), (True, 2000, True), (False, 5000, False)])
def test_round_trip(spark, tmp_path, monkeypatch, zip64, limit, joined):
    if not joined:
        monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    rows, df = pages(spark)
    out = W.round_trip(df.repartition(3), f"file://{tmp_path}/w", limit, zip64).collect()
    assert sorted(map(tuple, out), key=repr) == expected(rows)
    for f in (tmp_path / "w").glob("*.wacz"):
        with zipfile.ZipFile(f) as z:  # another reader finds the same
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            with store.Reader(str(f)) as r:
                for m in W.directory(r):
                    start, size = W.stored_range(r, m)
                    assert r.read(start, size) == z.read(m["name"])


def test_damage(tmp_path):
    good = W.package(b"abc", b"")
    for name, raw in {"short": good[:-5], "empty": b"", "no": b"x" * 100}.items():
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ValueError), store.Reader(str(tmp_path / name)) as f:
            list(W.directory(f))
    with zipfile.ZipFile(tmp_path / "deflated", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"a" * 100)
        z.comment = b"PK\x05\x06 not the end"
    with store.Reader(str(tmp_path / "deflated")) as f:
        (m,) = W.directory(f)
        with pytest.raises(ValueError):
            W.stored_range(f, m)
    with pytest.raises(ValueError):
        W.parse_record(W.warc_record(1, "u", b"payload", None)[:-9])
    assert W.parse_record(W.warc_record(1, "u", b"pay\r\n\r\nload", None))["payload"] == b"pay\r\n\r\nload"


def test_empty(spark, tmp_path):
    assert W.round_trip(pages(spark)[1].limit(0), f"file://{tmp_path}/w").count() == 0


def test_cut_off_zip64_field():
    import struct

    with pytest.raises(ValueError):
        W._wide(struct.pack("<HHI", 1, 4, 7), [0xFFFFFFFF, 5, 5])
    assert W._wide(struct.pack("<HHQ", 1, 8, 7), [0xFFFFFFFF, 5, 5]) == [7, 5, 5]
