import base64
import hashlib

from corvane.llm import queries, warc


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_query_equals_grouping(spark, sf_dir):
    got = {r.page_id: tuple(r) for r in queries.op9_warc(spark, sf_dir).collect()}
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    for k, t in pages.items():
        again = first[t] != k
        assert got.pop(k) == (k, len(t.encode()), digest(t), "revisit" if again else "response", first[t] if again else None)
    assert not got


def test_round_trip_and_odd_rows(spark):
    rows = [
        (5, "http://a/\r\nX: y", "same"),
        (3, "http://b", "same"),
        (3, "http://b", "same"),
        (None, None, "same"),
        (1, "http://c", None),
        (2, "http://d", ""),
        (4, "http://ü", "WARC/1.1\r\n\r\nü" * 50_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as row_id", "3 as offset")
    folder = warc.archive_folder(spark)
    index = warc.archive(pages, folder)
    back = warc.read_archives(index, folder).collect()
    assert len(back) == 7
    types = sorted((r.page_id if r.page_id is not None else 99, r.record_type, r.refers_to) for r in back)
    assert types == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "revisit", 3), (99, "revisit", 3)]
    by = {(r.page_id, r.record_type): r for r in back}
    assert bytes(by[4, "response"].payload).decode() == rows[6][2]
    assert by[5, "revisit"].payload_bytes == 4 and by[5, "revisit"].payload_digest == digest("same")
    assert by[5, "revisit"].url == "http://a/%0D%0AX: y"
    some = warc.read_archives(index.where("page_id = 4"), folder).collect()
    assert [r.page_id for r in some] == [4]
    plain = warc.archive(pages, warc.archive_folder(spark), least_bytes=5)
    assert plain.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.archive(pages.limit(0), warc.archive_folder(spark)), folder).count() == 0


def test_ranges_join_near_rows():
    step = warc.GAP_BYTES
    rows = [(0, 10), (10, 10), (20 + step, 5), (30 + 3 * step, 5), (40 + 3 * step, 2 * warc.READ_BYTES), (50 + 3 * step + 2 * warc.READ_BYTES, 1)]
    got = list(warc._ranges(rows))
    assert [held for _, _, held in got] == [[0, 1, 2], [3], [4], [5]]
    assert got[0][:2] == (0, 25 + step)
