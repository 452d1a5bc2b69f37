import base64
import hashlib

from quillon.llm import warc

ROWS = [
    (1, "http://a/x y", "same", 1), (2, "http://b/", "same", 1), (3, None, None, 1), (4, "http://c/é", "", 1), (5, "http://d/", "é" * 700_000, 1),
    (6, "u", "only\r\n\r\nWARC/1.1 here", 1), (7, "u", "twice", 1), (7, "u", "twice", 1), (None, "u", "same", 1),
]


def want(least):
    out = []
    for page, _, html, _ in ROWS:
        data = (html or "").encode()
        last = max((p for p, _, h, _ in ROWS if (h or "") == (html or "") and p is not None), default=None)
        back = last if len(data) >= least and page is not None and page < last else None
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if back is None else "revisit", back, True))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, bundle int")
    for least in (0, 5):
        out = warc.archive(pages, f"file://{tmp_path}/{least}", least)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload_ok) for r in out.collect()]
        assert sorted(got, key=str) == want(least)
    assert warc.archive(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_seek_table_and_fetch(spark, tmp_path):
    pages = spark.range(40).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(concat('page ', id, ' '), 100) as html").coalesce(2)
    folder = f"file://{tmp_path}/b"
    index = warc.write_bundles(pages, folder, frame_bytes=2000)
    wanted = [f"urn:page:{k}" for k in (3, 19, 38)]
    got = {r.record_id: bytes(r.payload).decode() for r in warc.fetch(index, folder, wanted).collect()}
    assert got == {f"urn:page:{k}": f"page {k} " * 100 for k in (3, 19, 38)}
    assert index.selectExpr("max(frame)").first()[0] > 3
    bundle = next((tmp_path / "b").glob("*.zst")).read_bytes()
    frames = warc.read_seek_table(bundle)
    # without the table, the frames are an ordinary Zstandard stream
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read()
    assert whole == b"".join(warc.decompressed(bundle[a:b]) for a, b in frames)
