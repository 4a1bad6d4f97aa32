import gzip
import hashlib
from collections import Counter, defaultdict

from eventskim.llm.warc import op9_warc, parse, read_archives

LONG = "WARC/1.1\r\n\r\n<p>é</p>\r\n" * 60
ROWS = [
    (1, "http://a", LONG), (2, "http://b", LONG), (3, None, LONG), (4, "u\r\nWARC-Type: x", "short"), (5, "u", "short"),
    (6, "u", None), (7, "u", ""), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "y" * 999),
    (11, "u", "y" * 999), (None, "u", LONG), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (12, "u", "\n" * 5000),
]


def want(rows):
    largest = defaultdict(lambda: -1)
    for page, _, html in rows:
        largest[html or ""] = max(largest[html or ""], -1 if page is None else page)
    for page, _, html in rows:
        body = (html or "").encode()
        first = largest[html or ""]
        revisit = len(body) >= 1000 and first >= 0 and first != page
        kind = "revisit" if revisit else "response"
        yield (page, len(body), hashlib.sha1(body).hexdigest(), kind, first if revisit else None)


def test_odd_pages(spark, tmp_path):
    extra = "payload string, record_type int, __digest string"
    rows = [(*r, None, None, None) for r in ROWS]
    pages = spark.createDataFrame(rows, f"page_id long, url string, html string, {extra}").repartition(3)
    out = op9_warc(pages, str(tmp_path / "w"))
    assert Counter(map(tuple, out.collect())) == Counter(want(ROWS))
    read = {(r.page_id, r.payload) for r in read_archives(spark, str(tmp_path / "w")).collect()}
    assert (3, LONG) in read and (1, None) in read and (12, "\n" * 5000) in read
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    records = [h for p in files for h, _ in parse(gzip.decompress(p.read_bytes()))]
    assert len(records) == len(ROWS)
    assert all(h["warc-refers-to"] == "<urn:page:3>" for h in records if h["warc-record-id"] in ("<urn:page:1>", "<urn:page:2>"))


def test_hot_payload(spark):
    rows = [(i, "u", "c" * 1500 if i % 3 == 0 else f"{i}" * 900) for i in range(900)]
    out = op9_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert Counter(map(tuple, out.collect())) == Counter(want(rows))


def test_no_pages(spark):
    assert op9_warc(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
