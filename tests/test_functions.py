"""Examples of the scalar functions and of the layout operators."""

import pytest
from pyspark.sql import functions as F

from quire.functions import fit, geometry, script, text
from quire.operators import layout, segments, translate
from quire.operators.pages import ranges


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_px_to_pt(spark):
    for px, dpi, want in ((300, 300, 72), (150, 300, 36), (150, 150, 72), (72, 72, 72), (0, 300, 0), (10, 0, 10)):
        assert one(spark, geometry.px_to_pt(F.lit(px), F.lit(dpi)))[0] == pytest.approx(want)


def test_classified(spark):
    for h, size, kind in ((12, 9, "text"), (16, 12, "text"), (22, 16.5, "title"), (40, 30, "title"), (0, 0, "text")):
        assert tuple(one(spark, geometry.classified(F.lit(float(h))))[0]) == (size, kind)


@pytest.mark.parametrize("s, want", [("Hello, world", False), ("مرحبا بالعالم", True), ("שלום עולם", True), ("Hello שלום and more words", False), ("مرحبا بالعالم ok", True), ("", False), ("12345", False)])
def test_rtl(spark, s, want):
    assert one(spark, script.is_rtl(F.lit(s)))[0] is want


@pytest.mark.parametrize("s, want", [("Hello", "latin"), ("مرحبا", "arabic"), ("שלום", "hebrew"), ("Привет", "cyrillic"), ("你好", "cjk"), ("안녕", "korean"), ("สวัสดี", "thai"), ("नमस्ते", "devanagari"), ("かな", "latin"), ("aб", "cyrillic"), (None, "latin")])
def test_script(spark, s, want):
    assert one(spark, script.detect_script(F.lit(s).cast("string")))[0] == want


def fitted(spark, s, w, h, size):
    return one(spark, fit.fit_text(F.lit(s), F.lit(w), F.lit(h), F.lit(size)))[0]


def test_fit(spark):
    long = "Often the quick brown fox jumps over the lazy dog and keeps running through the wood"
    r = fitted(spark, "Hello", 200, 50, 12.0)
    assert (r.lines, r.font_size, r.overflow) == (["Hello"], 12.0, False)
    assert len(fitted(spark, long, 100, 300, 12.0).lines) > 1
    assert fitted(spark, "Some words here", 50, 20, 14.0).font_size < 14
    r = fitted(spark, long, 30, 10, 12.0)
    assert r.overflow and r.lines[-1].endswith("...")
    assert fitted(spark, "a\nb", 200, 50, 12.0).lines == ["a b"]
    assert fitted(spark, "", 200, 50, 0.0).lines == [""]


def plain_fit(words, w, h, s0):
    def wrap(limit):
        lines, cur = [], None
        for x in words:
            if cur is None:
                cur = x
            elif len(cur) + 1 + len(x) <= limit:
                cur += " " + x
            else:
                lines.append(cur)
                cur = x
        return [*lines, cur or ""]

    limit = lambda s: max(1, int(w / (s * 0.5)))
    s, first = s0, True
    while first or s >= s0 * 0.6:
        s = s if first else s - 0.5
        first = False
        if s * 1.35 * len(wrap(limit(s))) <= h:
            return wrap(limit(s)), s
    return None, s0 * 0.6


def test_fit_against_plain_search(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, " ".join("x" * rnd.randint(1, 12) for _ in range(rnd.randint(1, 40))), float(rnd.randint(20, 300)), float(rnd.randint(10, 200)), rnd.choice([8.0, 12.0, 18.5])) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, t string, w double, h double, s double")
    got = {r.i: r.f for r in df.select("i", fit.fit_text(F.col("t"), F.col("w"), F.col("h"), F.col("s")).alias("f")).collect()}
    for i, t, w, h, s in rows:
        lines, size = plain_fit(t.split(), w, h, s)
        assert got[i].font_size == pytest.approx(size)
        assert (not got[i].overflow) == (lines is not None)
        if lines is not None:
            assert got[i].lines == lines


def test_text(spark):
    assert one(spark, text.trim(F.lit("\t" + chr(160) + "a b\n")))[0] == "a b"
    assert one(spark, text.truncate(F.lit("abcdef"), 3))[0] == "abc..."
    assert one(spark, text.translated_name(F.lit("/a.b/c.pdf")))[0] == "/a.b/c_translated.pdf"
    assert bytes.fromhex(one(spark, text.pdf_escape(F.lit("(é€)\\")))[0]) == b"\\(\xe9\x80\\)\\\\"
    assert ranges("1,3-5") == [(1, 1), (3, 5)]
    with pytest.raises(ValueError):
        ranges("5-3")


@pytest.mark.parametrize(
    "content, n, want",
    [('["a","b"]', 2, ["a", "b"]), ('```json\n["a"]\n```', 1, ["a"]), ('Sure: ["a"] done', 1, ["a"]), ('[{"id":1,"text":"x"},{"id":0,"text":"y"}]', 2, ["x", "y"]), ('["a"]', 2, None), ("nope", 1, None), ("[]", 1, None), ('["", " "]', 2, ["", " "])],
)
def test_answers(spark, content, n, want):
    r = translate.parsed(spark.createDataFrame([(content, n)], "content string, expected int")).first()
    assert r.translations == want
    assert (r.error is None) == (want is not None)


REGION = "doc_id int, page int, rid int, x double, y double, w double, h double, block_type string"
LINE = "doc_id int, page int, line_no int, x double, y double, w double, h double, text string, font_size double, font_name string, block_type string"


def test_layout_merge(spark):
    regions = spark.createDataFrame([(1, 0, 0, 0.0, 500.0, 300.0, 30.0, "title"), (1, 0, 1, 0.0, 300.0, 400.0, 150.0, "text"), (1, 0, 2, 320.0, 250.0, 180.0, 180.0, "image")], REGION)
    lines = spark.createDataFrame([(1, 0, 0, 5.0, 505.0, 100.0, 12.0, "Head", 12.0, "F", "text"), (1, 0, 1, 5.0, 400.0, 100.0, 12.0, "first", 10.0, "F", "text"), (1, 0, 2, 5.0, 350.0, 100.0, 12.0, "second", 12.0, "F", "text"), (1, 0, 3, 5.0, 20.0, 50.0, 12.0, "loose", 12.0, "F", "text"), (1, 0, 4, 5.0, 20.0, 50.0, 12.0, "  ", 12.0, "F", "text")], LINE)
    got = [(b.origin, b.text, b.block_type, b.font_size) for b in layout.layout_blocks(lines, regions).orderBy("block_no").collect()]
    assert got == [("region", "Head", "title", 12.0), ("region", "first second", "text", 11.0), ("unmatched", "loose", "text", 12.0), ("image", "", "image", 135.0)]
    none = layout.layout_blocks(lines, regions.limit(0)).collect()
    assert len(none) == 4 and {b.origin for b in none} == {"unmatched"}


BLOCK = "doc_id int, page int, block_no int, x double, y double, w double, h double, text string, block_type string"


def test_segments(spark):
    def strips(rows):
        df = spark.createDataFrame([(1, 0, i, 0.0, float(y), 100.0, float(h), "t", kind) for i, (y, h, kind) in enumerate(rows)], BLOCK)
        return [(s.is_diagram, s.y_low, s.y_high) for s in segments.segments(df).orderBy("seg_no").collect()]

    assert strips([(700, 20, "text"), (600, 20, "text")]) == [(False, 600.0, 720.0)]
    assert strips([(300, 100, "image"), (350, 100, "image"), (700, 20, "text")]) == [(False, 450.0, 792.0), (True, 300.0, 450.0), (False, 0.0, 300.0)]
    assert strips([(500, 100, "image"), (100, 100, "image")]) == [(False, 600.0, 792.0), (True, 500.0, 600.0), (False, 200.0, 500.0), (True, 100.0, 200.0), (False, 0.0, 100.0)]
    assert strips([]) == []


def test_diagram_regions_against_a_loop(spark):
    import random

    rnd = random.Random(2)
    rows, want = [], {}
    for page in range(60):
        boxes = [(float(rnd.randint(0, 300)), float(rnd.randint(1, 90))) for _ in range(rnd.randint(1, 8))]
        rows += [(1, page, i, 0.0, y, 9.0, h, "", "image") for i, (y, h) in enumerate(boxes)]
        merged = []
        for y, h in sorted(boxes, key=lambda b: -(b[0] + b[1])):
            if merged and y < merged[-1][1] and merged[-1][0] < y + h:
                merged[-1] = (min(merged[-1][0], y), max(merged[-1][1], y + h))
            else:
                merged.append((y, y + h))
        want[page] = sorted(merged)
    got = {}
    for r in segments.diagram_regions(spark.createDataFrame(rows, BLOCK)).collect():
        got.setdefault(r.page, []).append((r.y_low, r.y_high))
    assert {p: sorted(x) for p, x in got.items()} == want


def test_long_lines_are_folded_in_linear_time(spark):
    """Words and characters by the ten thousand in one row: running sums, wrapping and glyph numbers against plain Python."""
    import random
    import time

    from quire.functions import arrays, fit
    from quire.operators import fonts

    rnd = random.Random(4)
    for n in (0, 1, 2, 255, 256, 257, 700, 40_000):
        words = [rnd.choice("abc") * rnd.randint(1, 12) for _ in range(n)]
        df = spark.createDataFrame([(words,)], "w array<string>")
        began = time.time()
        row = df.select(arrays.running_sums(F.transform("w", lambda x: F.length(x) + 1)).alias("at"), fit.wrap_words(F.col("w"), F.lit(30)).alias("lines")).first()
        took = time.time() - began
        at, want, line = 0, [], None
        for w, got in zip(words, row.at, strict=True):
            assert got == at
            at += len(w) + 1
            if line is None or len(line) + 1 + len(w) <= 30:
                line = w if line is None else f"{line} {w}"
            else:
                want.append(line)
                line = w
        assert row.lines == [*want, line or ""]
    assert took < 6
    points = [(f, 0x4E00 + i, 1 + (i * k) % 60_000) for f, k in (("a", 1), ("b", 3)) for i in range(20_000)] + [("a", 0x1F600, 9)]
    texts = [("a", 1, "".join(chr(0x4E00 + rnd.randrange(20_500)) for _ in range(80_000))), ("b", 2, "一丁😀x"), ("a", 3, "一😀x"), ("none", 4, "一"), ("a", 5, None), (None, 6, "丁"), ("b", 7, "")]
    glyphs = spark.createDataFrame(points, "font string, code_point int, gid int").repartition(4)
    asked = spark.createDataFrame(texts, "font string, id long, text string")
    began = time.time()
    got = {r.id: r.hex for r in fonts.encoded(asked, glyphs).collect()}
    assert time.time() - began < 25
    table = {(f, c): g for f, c, g in points}
    assert got == {i: "".join("%04X" % table.get((f, ord(c)), 0) for c in t or "") for f, i, t in texts}
