"""Writing PDF files and reading them back."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import pages
from quire.sinks import pdf as sink
from quire.sources import pdf as source


def test_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, 0, 0, "Héllo (w\\rld)", 72.0, 700.0, 12.0, "regular"), (1, 0, 0, 1, "second line", 72.0, 680.0, 12.0, "bold"), (1, 1, 0, 0, "page two", 72.0, 700.0, 9.5, "regular")], "doc_id long, page int, block_no int, line_no int, text string, line_x double, line_y double, size double, slot string")
    rects = lines.filter("line_no = 0").select("doc_id", "page", "block_no", F.lit(1.0).alias("rect_x"), F.lit(2.0).alias("rect_y"), F.lit(3.0).alias("rect_w"), F.lit(4.0).alias("rect_h"))
    sizes = spark.createDataFrame([(1, 0, 612.0, 792.0), (1, 1, 500.0, 400.0), (1, 2, 612.0, 792.0)], "doc_id long, page int, width double, height double")
    doc = sink.merged_files(sink.page_files(sink.content_streams(rects, lines), sizes)).first()
    assert doc.total_pages == 3
    (tmp_path / "a.pdf").write_bytes(doc.pdf)
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    rows = source.read_pdf(spark, f"{tmp_path}/*.pdf").collect()
    got = {r.page_num: r for r in rows if r.page_num}
    assert [r.error for r in rows if r.page_num is None] == ["ValueError: not a PDF file"]
    assert [(got[i].width, got[i].height, got[i].total_pages) for i in (1, 2, 3)] == [(612.0, 792.0, 3), (500.0, 400.0, 3), (612.0, 792.0, 3)]
    assert [s.text for s in got[1].spans] == ["Héllo (w\\rld)", "second line"]
    assert (got[1].spans[0].x, got[1].spans[0].y, got[1].spans[0].font_size) == (72.0, 700.0, 12.0)
    assert got[3].page_text == ""
    spans = spark.createDataFrame(rows, source.PAGES).filter("page_num = 1").select(F.lit(1).alias("doc_id"), F.col("page_num").alias("page"), F.explode("spans").alias("s")).select("doc_id", "page", "s.line_no", "s.span_no", "s.text", "s.x", "s.y", "s.end_x", "s.font", F.col("s.font_size").alias("raw_font_size"))
    assert [(r.text, r.font_size) for r in pages.native_lines(spans).orderBy("line_no").collect()] == [("Héllo (w\\rld)", 12.0), ("second line", 12.0)]


def test_merge_rules():
    one = sink.page_pdf(b"BT /FO0 10 Tf 1 2 Td (a) Tj ET", 100, 100)
    assert sink.merge([one]) == one
    with pytest.raises(ValueError):
        sink.merge([])
    assert len(source.Pdf(sink.merge([one, one])).pages()) == 2


def test_object_streams_arrays_and_encryption():
    body = b"1 0 2 40 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(40) + b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 50 60] >>"
    packed = zlib.compress(body)
    text = b"BT /F1 10 Tf 14 TL 1 0 0 1 5 40 Tm [(ab) -500 (c)] TJ T* (n\\145xt) Tj (q) ' ET"
    data = b"%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >>\nstream\n" + packed + b"\nendstream\nendobj\n"
    data += b"3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>\nendobj\n4 0 obj\n<< /Length 5 0 R >>\nstream\n" + text + b"\nendstream\nendobj\n5 0 obj\n" + str(len(text)).encode() + b"\nendobj\n"
    page = source.read_pages(data + b"trailer\n<< /Root 1 0 R >>\n")[0]
    assert (page["width"], page["height"]) == (50.0, 60.0)
    assert [(s["text"], s["x"], s["y"], s["line_no"]) for s in page["spans"]] == [("ab", 5.0, 40.0, 0), ("c", 20.0, 40.0, 0), ("next", 5.0, 26.0, 1), ("q", 5.0, 12.0, 2)]
    with pytest.raises(source.Encrypted):
        source.read_pages(data + b"trailer\n<< /Root 1 0 R /Encrypt 8 0 R >>\n")


def test_dry_run(spark, tmp_path):
    from quire.__main__ import dry_run

    text = b"BT /FO0 10 Tf 1 2 Td (a page with more than twenty characters) Tj ET"
    (tmp_path / "c.pdf").write_bytes(sink.merge([sink.page_pdf(text, 100, 100), sink.page_pdf(b"", 100, 100)]))
    r = dry_run(spark, f"{tmp_path}/c.pdf").first()
    assert (r.pages, r.native, r.scanned, r.input_tokens) == (2, 1, 1, 9)
    assert dry_run(spark, f"{tmp_path}/c.pdf", "2").first().native == 0
