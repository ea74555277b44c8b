"""WARC archives: round trips, and salvage of damaged files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from coppice.llm import warc

DATE = "2024-01-01T00:00:00Z"


def record(i, payload=b"<p>text</p>", kind="response"):
    return warc.make_record(kind, warc.page_name(str(i)), f"http://x/{i}", warc.page_name("9") if kind == "revisit" else None, payload, DATE)


def packed(i, payload=b"<p>text</p>"):
    return gzip.compress(record(i, payload), mtime=0)


def read(data):
    """Page ids of the records and (offset, length) of the gaps."""
    found = list(warc.salvage(data))
    return ([warc.page_of(x.fields["warc-record-id"]) for _, _, x in found if not isinstance(x, str)],
            [(a, n) for a, n, x in found if isinstance(x, str)])


def shipped(rows, spark):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def plain(rows):
    """What the archives must give, from the rows."""
    last = {}
    for i, _, h in rows:
        p = (h or "").encode()
        last[p] = max([x for x in (last.get(p), i) if x is not None], default=None)
    return sorted(((i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if i == last[(h or "").encode()] else "revisit",
                    None if i == last[(h or "").encode()] else last[(h or "").encode()]) for i, _, h in rows), key=str)


ODD = [(1, "u", "a"), (2, "u", "a"), (3, None, "a"), (3, "v", "a"), (None, "x\r\ny", ""), (5, "z", None), (6, "", "é\r\n\r\nWARC/1.1\r\n" * 20_000),
       (7, "w", "\x1f\x08\x00 text \x00"), (8, "w", "WARC/1.1\r\n\r\n\r\n"), (-9, "w", " ")]


def test_round_trip(spark):
    df = shipped(ODD, spark).withColumn("key", F.lit("x")).withColumn("payload", F.lit(1))
    assert sorted(map(tuple, warc.archive_pages(df.repartition(3)).collect()), key=str) == plain(ODD)
    assert warc.archive_pages(df.where("false")).collect() == []


def test_many_copies_and_shuffled_lookup(spark, tiny_tables):
    rows = [(i, "u", "hot" if i % 3 else f"text {i // 6}") for i in range(600)]
    assert sorted(map(tuple, warc.archive_pages(shipped(rows, spark).repartition(4)).collect()), key=str) == plain(rows)


def test_short_payloads_are_not_shared(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (5, "u", None), (6, "u", "")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(shipped(rows, spark), least=3).collect()}
    assert got == {i: ("response", None) for i in (1, 2, 4, 5, 6)} | {3: ("revisit", 4)}


def test_ids_of_other_types(spark):
    rows = [("a+b c", "u", "x"), ("a%2F>", "u", "x"), ("", "u", "y"), (None, "u", "z")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    read_back = spark.createDataFrame([], "page_id string").schema["page_id"].dataType
    assert {r["page_id"] for r in warc.archive_pages(df).collect()} == {"a+b c", "a%2F>", "", None} and read_back.simpleString() == "string"


@pytest.mark.parametrize("compressed", [True, False])
def test_files_hold_standard_records_and_payloads(spark, tmp_path, monkeypatch, compressed):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    warc.write_archives(shipped(ODD, spark).coalesce(1), str(tmp_path / "a"), compressed=compressed)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) >= 1
    for f in files:
        data = gzip.decompress(f.read_bytes()) if compressed else f.read_bytes()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    back = warc.read_archives(spark, str(tmp_path / "a"), payloads=True).collect()
    assert not [r for r in back if r["gap"]] and len(back) == len(ODD)
    texts = {(h or "").encode() for _, _, h in ODD}
    assert {bytes(r["payload"]) for r in back if r["warc_type"] == "response"} == texts
    assert all(r["target_uri"] for r in back if r["record_id"] != warc.page_name("6"))


@pytest.mark.parametrize("make", [record, packed])
def test_salvage_between_valid_records(make):
    parts = [make(i, b"payload %d " % i * 50) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0x55
    junk = b"garbage WARC/1.1\r\n\x1f\x8b\x08 more"
    data = parts[0] + junk + parts[1] + bytes(broken) + parts[3] + parts[4][:-9] + parts[5][:-3]
    ids, gaps = read(data)
    first = len(parts[0])
    assert ids == ["0", "1", "3"]
    assert gaps[0] == (first, len(junk))
    assert gaps[1] == (first + len(junk) + len(parts[1]), len(broken))
    assert gaps[2][0] + gaps[2][1] == len(data) and gaps[2][0] == first + len(junk) + len(parts[1]) + len(broken) + len(parts[3])


@pytest.mark.parametrize("make", [record, packed])
def test_every_flipped_byte_costs_one_record(make):
    """Records and gaps always cover the file without overlap, and damage stays where it is."""
    parts = [make(i) for i in range(3)]
    data = b"".join(parts)
    ends = [sum(map(len, parts[: k + 1])) for k in range(3)]
    for at in range(len(parts[0]), ends[1], 3):
        bad = bytearray(data)
        bad[at] ^= 0xFF
        found = list(warc.salvage(bytes(bad)))
        place = 0
        for offset, length, _ in found:
            assert offset == place
            place += length
        assert place == len(data)
        ids, gaps = read(bytes(bad))
        assert {"0", "2"} <= set(ids) and len(ids) + len(gaps) == 3
        assert gaps in ([], [(ends[0], len(parts[1]))])  # a plain header has no digest, and a member's header no checksum


def test_random_cuts_keep_whole_records():
    r = random.Random(8)
    for _ in range(40):
        make = r.choice([record, packed])
        parts = [make(i, bytes(r.randrange(256) for _ in range(r.randrange(300)))) for i in range(5)]
        data = b"".join(parts)
        a = r.randrange(len(data))
        b = min(len(data), a + r.randrange(1, 200))
        starts = [sum(map(len, parts[:k])) for k in range(5)]
        whole = {str(k) for k in range(5) if starts[k] + len(parts[k]) <= a or starts[k] >= b}
        assert whole <= set(read(data[:a] + data[b:])[0])


def test_members_of_several_records_and_foreign_files(spark, tmp_path):
    whole = record(1) + record(2, b"") + b"junk" + record(3, kind="revisit")
    (tmp_path / "a.gz").write_bytes(gzip.compress(whole) + warc.EMPTY_MEMBER)
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(b"no archive at all")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r["archive"][-4:], r["warc_type"] or "", r["gap"]) for r in got) == [
        ("/a.gz"[-4:], "", "no version line"), ("a.gz", "response", None), ("a.gz", "response", None), ("a.gz", "revisit", None),
        (str(tmp_path / "c")[-4:], "", "no version line")]
    revisit = next(r for r in got if r["warc_type"] == "revisit")
    assert revisit["payload_bytes"] == len(b"<p>text</p>") and revisit["refers_to"] == "<urn:page:9>"


@pytest.mark.parametrize("change,reason", [
    ((b"WARC-Date: ", b"WARC-Dote: "), "no warc-date"), ((b"Content-Length: 9", b"Content-Length: x"), "content-length is no number"),
    ((b"<p>text", b"<p>tent"), "block digest differs"), ((b"sha1:", b"md5:_"), None), ((b"\r\n\r\n<p>", b"\r\n\r\n<q>"), "block digest differs"),
    ((b"WARC-Type: response", b"WARC-Type response"), "header line without a colon")])
def test_reasons(change, reason):
    data = record(1).replace(*change)
    (_, _, found), *more = warc.salvage(data)
    assert (found if isinstance(found, str) else None) == reason
    assert not more


def test_long_damaged_file_is_read_in_linear_time():
    bad = record(1, b"x" * 200)
    bad = bad.replace(b"xxxx", b"yyyy", 1)
    data = bad * 20_000 + record(2)
    ids, gaps = read(data)
    assert ids == ["2"] and gaps == [(0, len(bad) * 20_000)]
