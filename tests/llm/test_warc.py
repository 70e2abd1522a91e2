"""Round trip through archives, selected reads, revisits."""

import gzip
import hashlib

from furrow.llm.warc import archive_folder, build_record, parse_record, read_records, write_archives


def expected(rows):
    big = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            big[data] = max(big.get(data, page), page)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        last = big.get(data)
        refers = last if last is not None and (page is None or page < last) else None
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def case():
    long, other = "é<p>x\r\n\r\n</p>" * 200, "y" * 1000
    rows = [(i, f"http://a.example/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(200)]
    rows += [(1000 + i, "http://b.example/\n x", long) for i in range(50)] + [(1049, None, long), (None, "u", long)]
    rows += [(2000, "u", None), (2001, None, ""), (2002, "u", other), (2003, "u", other), (2004, "u", "y" * 999), (2005, "u", "y" * 999), (None, None, None)]
    return rows + [(None, "u", "z" * 2000), (None, "u", "z" * 2000)]


def test_round_trip(spark):
    rows = case()
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    folder = archive_folder(spark)
    index = write_archives(pages, folder)
    got = read_records(index, folder)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
    html = {(p, h or "") for p, _, h in rows}
    assert all((r.page_id, r.payload) in html for r in got.collect() if r.record_type == "response")
    chosen = index.where("page_id % 7 = 3")
    want = sorted(p for p, *_ in rows if p is not None and p % 7 == 3)
    for gap, most in ((0, 1), (64, 200), (1 << 20, 1 << 20)):
        assert sorted(r.page_id for r in read_records(chosen, folder, gap=gap, most=most, stretch=500).collect()) == want


def test_archives_are_plain_gzip_members(spark):
    folder = archive_folder(spark)
    index = write_archives(spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string").coalesce(1), folder)
    rows = sorted(index.collect(), key=lambda r: r.offset)
    with gzip.open(rows[0].file) as file:
        whole = file.read()
    assert whole == b"".join(build_record(r.page_id, r.url, r.digest, b"a" if r.page_id == 1 else b"b", None, "1970-01-01T00:00:00Z") for r in rows)
    assert rows[1].offset == rows[0].length


def test_record_is_verified():
    record = build_record(5, "http://x/é", hashlib.sha1(b"abc").hexdigest(), b"abc", None, "2020-01-01T00:00:00Z")
    assert parse_record(record) == (5, "http://x/é", "response", hashlib.sha1(b"abc").hexdigest(), 3, None, "abc")
    for damaged in (record.replace(b"abc", b"abd"), record[:-1]):
        try:
            parse_record(damaged)
        except ValueError:
            continue
        raise AssertionError("damage not seen")


def test_empty_and_registered(spark, sf_dir):
    from furrow.llm.queries import QUERIES

    folder = archive_folder(spark)
    empty = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_records(empty, folder).collect() == []
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op1_warc"](spark, sf_dir).collect()), key=str) == expected(rows)
