"""Output pages: the original's strips under the overlay, merged resources and embedded fonts."""

import pytest
from pyspark.sql import functions as F
from test_ttf import font

from quire.operators import fonts
from quire.sinks import pdf as sink
from quire.sources import pdf as source
from quire.sources.ttf import Font

STRIPS = "doc_id long, page int, seg_no int, is_diagram boolean, y_low double, y_high double, render_low double, render_high double, total_height double, out_low double, delta double, formulas array<struct<y:double,h:double>>"
#: A diagram from 100 to 200 above a text strip from 0 to 100, on a page of 200 that becomes 310.
ROWS = [(1, 1, 1, True, 100.0, 200.0, 100.0, 200.0, 310.0, 100.0, 0.0, None), (1, 1, 2, False, 0.0, 100.0, 0.0, 100.0, 310.0, 0.0, 0.0, [(10.0, 20.0)])]


def original(content, extra=None):
    page = {"Type": "/Page", "Parent": source.Ref(2), "MediaBox": [0, 0, 150, 200], "Resources": {"Font": {"F1": {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Courier"}}, **(extra or {})}, "Contents": source.Ref(4)}
    return sink.build([{"Type": "/Catalog", "Pages": source.Ref(2)}, {"Type": "/Pages", "Kids": [source.Ref(3)], "Count": 1}, page, source.Stream({}, content)], 1)


def test_original_and_overlay_are_read_back(spark):
    data = original(b"q BT /F1 10 Tf 20 150 Td (drawn label) Tj ET", {"XObject": {"Im1": source.Ref(4)}})
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no pdf"))], "doc_id long, pdf binary")
    strips = spark.createDataFrame(ROWS + [(1, 2, *ROWS[0][2:]), (2, 1, *ROWS[0][2:])], STRIPS)
    overlays = spark.createDataFrame([(1, 1, bytearray(b"q\nBT 0 0 0 rg /FO0 10.0 Tf 20.00 50.00 Td (new text) Tj ET\nQ\n"))], "doc_id long, page int, content binary")
    got = {(r.doc_id, r.page): r for r in sink.output_pages(files, strips, overlays).collect()}
    assert got[1, 2].error == "page 2 of 1 is out of range" and got[2, 1].error == "ValueError: not a PDF file" and got[1, 2].pdf is None
    page = source.read_pages(bytes(got[1, 1].pdf))[0]
    assert (got[1, 1].error, page["width"], page["height"], page["error"]) == (None, 150.0, 310.0, None)
    # the diagram's original above its second copy; the formula's strip moves with its text strip, clipped to its own height
    assert [(s["text"], s["x"], s["y"]) for s in page["spans"]] == [("drawn label", 20.0, 260.0), ("drawn label", 20.0, 150.0), ("drawn label", 20.0, 150.0), ("new text", 20.0, 50.0)]
    pdf = source.Pdf(bytes(got[1, 1].pdf))
    made = pdf.pages()[0]["Resources"]
    assert set(made["Font"]) == {"F1", "FO0", "FO1"} and "GSO" in made["ExtGState"] and b"drawn" in pdf.get(made["XObject"]["Im1"]).data()


def test_page_without_strips_keeps_its_size(spark):
    files = spark.createDataFrame([(1, bytearray(original(b"")))], "doc_id long, pdf binary")
    overlays = spark.createDataFrame([(1, 1, bytearray(b""))], "doc_id long, page int, content binary")
    page = source.read_pages(bytes(sink.output_pages(files, spark.createDataFrame([], STRIPS), overlays).first().pdf))[0]
    assert (page["width"], page["height"], page["spans"]) == (150.0, 200.0, [])


def test_content_is_balanced():
    assert sink.balanced(b"q q (Q) Tj Q") == b"q q (Q) Tj Q\nQ\n"
    assert sink.balanced(b"Q Q q") == b"q\nq\nQ Q q\nQ\n"
    assert sink.balanced(b"q /q gs Q") == b"q /q gs Q\n"


def test_embedded_font_is_read_back(spark):
    data, text = font(), "AB€?"
    points = spark.createDataFrame([("f", *g) for g in Font.of(data).glyphs.items()], "font string, code_point int, gid int")
    shown = fonts.encoded(spark.createDataFrame([("f", 1, text)], "font string, id long, text string"), points).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), F.lit(text).alias("text"), F.lit(20.0).alias("line_x"), F.lit(50.0).alias("line_y"), F.lit(10.0).alias("size"), F.lit("bold").alias("slot"), "hex")
    rects = spark.createDataFrame([], "doc_id long, page int, block_no int, rect_x double, rect_y double, rect_w double, rect_h double")
    overlays = sink.content_streams(rects, shown)
    files = spark.createDataFrame([(1, bytearray(original(b"")))], "doc_id long, pdf binary")
    strips = spark.createDataFrame(ROWS, STRIPS)
    used = spark.createDataFrame([(1, 1, "f", text)], "doc_id long, page int, font string, text string")
    row = sink.output_pages(files, strips, overlays, used, {"f": data}).first()
    span = source.read_pages(bytes(row.pdf))[0]["spans"][0]
    widths = [Font.of(data).advance(g) * 1000 // 2000 for g in (1, 3, 4, 0)]
    assert span["text"] == "AB€�" and span["end_x"] - span["x"] == pytest.approx(sum(widths) / 100)
    pdf = source.Pdf(bytes(row.pdf))
    inner = pdf.get(pdf.get(pdf.pages()[0]["Resources"]["Font"]["FO1"])["DescendantFonts"][0])
    stored = pdf.get(pdf.get(inner["FontDescriptor"])["FontFile2"]).data()
    assert Font.of(stored).name() == "MyFont" and len(stored) == pdf.get(pdf.get(inner["FontDescriptor"])["FontFile2"]).head["Length1"]
    broken = sink.output_pages(files, strips, overlays, used, {"f": b"none"}).first()
    assert broken.pdf is None and broken.error.startswith("ValueError")


def test_matrices_ranges_and_widths():
    content = b'2 0 0 2 10 0 cm q 1 0 0 1 5 5 cm BT /A 10 Tf 3 0 0 3 1 2 Tm (ab) Tj ET Q BT /W 10 Tf 12 TL <00010002> Tj 0 0 (x) " ET Q Q'
    faces = {"A": source.Face(widths={97: 600.0, 98: 400.0}), "W": source.Face(True, source.unicode_entries(b"1 beginbfrange <0001> <0002> <D83DDE00> endbfrange 1 beginbfrange <0078> <0078> [<0041>] endbfrange"), {}, 1000.0)}
    got = source.spans(content, faces)
    assert [(s["text"], s["x"], s["y"], s["end_x"], s["font_size"]) for s in got] == [("ab", 22.0, 14.0, 82.0, 10.0), ("😀😁", 10.0, 0.0, 50.0, 10.0), ("A", 10.0, -24.0, 30.0, 10.0)]
