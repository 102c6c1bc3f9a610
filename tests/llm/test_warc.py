import base64
import glob
import gzip
import hashlib

import pytest

from tessera.llm import warc as W


def pages(spark, n=60):
    rows = [(i * 37 % 1000 - 5, f"http://h/{i}\r\nX: y", "same" if i % 4 == 0 else None if i % 9 == 0 else f"<p>page {i} é</p>" * (1 + i % 7)) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, "same"), (3, None, "lone"), (3, None, "lone")], "page_id long, url string, html string")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    docs = pages(spark)
    folder = str(tmp_path / "a")
    m = W.write_archive(docs, folder, shard_bytes=600, roll_bytes=700, min_revisit=least).collect()
    got = W.read_archive(spark, folder, payloads=True).collect()
    rows = docs.collect()
    assert len(got) == len(rows) == sum(r["records"] for r in m)
    first = {}
    for r in rows:
        p = (r["html"] or "").encode()
        first[p] = min(first.get(p, 10**9), 10**9 if r["page_id"] is None else r["page_id"])
    responses = {}
    for r in got:
        if r["record_type"] == "response":
            responses.setdefault(r["payload"], []).append(r["id"])
            assert (r["payload_bytes"], r["payload_digest"]) == (len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode())
        else:
            assert r["payload"] is None and r["refers_to"] in first.values()
    for p, ids in responses.items():
        assert ids == [first[p]] if len(p) >= least else len(ids) >= 1
    assert len(m) > len({r["shard"] for r in m}) > 1 or least


def test_same_bytes_however_partitioned(spark, tmp_path):
    docs = pages(spark)
    files = []
    for i, n in enumerate((1, 7)):
        folder = str(tmp_path / str(n))
        W.write_archive(docs.repartition(n), folder, shard_bytes=600, roll_bytes=900)
        files.append({f.rsplit("/", 1)[1]: open(f, "rb").read() for f in sorted(glob.glob(f"{folder}/part-*"))})
        assert not glob.glob(f"{folder}/_temporary*")
    assert files[0] == files[1] and len(files[0]) > 2
    for raw in files[0].values():
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_shards_are_ranges(spark, tmp_path):
    folder = str(tmp_path / "r")
    m = {r["file"]: r["shard"] for r in W.write_archive(pages(spark), folder, shard_bytes=600).collect()}
    ids = {}
    for f, shard in m.items():
        with open(f"{folder}/{f}", "rb") as x:
            ids.setdefault(shard, []).extend(W.parse(raw)[0] for raw in W.members(iter([x.read()])))
    order = [i for s in sorted(ids) for i in ids[s]]
    known = [i for i in order if i is not None]
    assert known == sorted(known) and order[len(known) :] == [None]


def test_damage_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "d")
    W.write_archive(pages(spark), folder)
    f = glob.glob(f"{folder}/part-*")[0]
    raw = gzip.decompress(open(f, "rb").read()).replace(b"page 1", b"page X")
    first = raw.split(b"WARC/1.1\r\n")[1:]
    with pytest.raises(ValueError):
        for x in first:
            W.parse(b"WARC/1.1\r\n" + x)
    with pytest.raises(ValueError):
        list(W.members(iter([open(f, "rb").read()[:-9]])))


def test_shards_follow_bytes(spark, tmp_path):
    """Shards hold like numbers of bytes, however many there are, whatever ids are null or repeat."""
    rows = [(i, None, "x" * (4000 if i < 20 else 100)) for i in range(600)] + [(None, None, f"no id {i} " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "b")
    W.write_archive(docs, folder, shard_bytes=4000, roll_bytes=10**9)
    held = {}
    for r in W.manifest(spark, folder).collect():
        with open(f"{folder}/{r['file']}", "rb") as f:
            held.setdefault(r["shard"], []).extend(W.parse(raw)[2] for raw in W.members(iter([f.read()])))
    assert len(held) > 30 and max(sum(x) for x in held.values()) < 5 * 4000
    assert sum(map(len, held.values())) == 900


def test_attempts_that_repeat(spark, tmp_path):
    """What lost attempts have left, whole or temporary, is replaced or deleted."""
    folder = tmp_path / "c"
    folder.mkdir()
    for name in ("part-00000-00000.warc.gz", "_temporary.part-00000-00000.warc.gz.dead"):
        (folder / name).write_bytes(b"left")
    W.write_archive(pages(spark), str(folder))
    assert W.read_archive(spark, str(folder)).count() == pages(spark).count() and not glob.glob(f"{folder}/_temporary*")
