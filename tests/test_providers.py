"""Providers, retries and settings."""

import json

import pytest

from quire.sources import config, providers

BLOCKS = "doc_id long, page int, block_no int, text string, block_type string"


def test_strict_answers():
    assert providers.strict_answers('["a", null]', 2) == ["a", ""]
    assert providers.strict_answers('Sure:\n```json\n["a"]\n```'.removeprefix("Sure:\n"), 1) == ["a"]
    assert providers.strict_answers('[{"id": 1, "text": "x"}, {"id": 0, "text": "y"}]', 2) == ["x", "y"]
    for answer in ('["a"]', "[1, 2]", "nope", '{"a": 1}'):
        with pytest.raises(ValueError):
            providers.strict_answers(answer, 2)


def test_retries_then_single_blocks():
    pauses, calls = [], []

    def flaky(blocks, source, target):
        calls.append(len(blocks))
        if len(blocks) > 1:
            return "broken"
        return json.dumps([blocks[0]["text"].upper()])

    blocks = [{"text": "a  b", "type": "text"}, {"text": "c\nd", "type": "table"}]
    assert providers.translate_page(flaky, blocks, "en", "de", pauses.append) == ["A B", "C\nD"]
    assert calls == [2, 2, 2, 1, 1] and pauses == [2.0, 4.0]


def test_pages_fail_alone(spark):
    def model(blocks, source, target):
        if any("bad" in b["text"] for b in blocks):
            raise ValueError("refused")
        return json.dumps(["[de] " + b["text"] for b in blocks])

    providers_pause, providers.FIRST_PAUSE = providers.FIRST_PAUSE, 0.0
    try:
        df = spark.createDataFrame([(1, 0, 1, "hello", "text"), (1, 0, 2, "  ", "text"), (1, 1, 1, "fine", "title")], BLOCKS)
        got = {(r.page, r.block_no): (r.translated, r.error) for r in providers.translated_pages(df, model, "en", "de").collect()}
    finally:
        providers.FIRST_PAUSE = providers_pause
    assert got == {(0, 1): ("[de] hello", None), (0, 2): ("  ", None), (1, 1): ("[de] fine", None)}


def test_limits():
    assert providers.limited(b"abc", 3) == b"abc"
    with pytest.raises(providers.TooLarge):
        providers.limited(b"abcd", 3)
    body, kind = providers.multipart(b"PNG", "x")
    assert b"PNG\r\n--x--" in body and kind.endswith("boundary=x")


def test_config(tmp_path):
    (tmp_path / ".env").write_text("# note\nQUIRE_DPI=150\nQUIRE_API_KEY='k'\nexport QUIRE_WORKERS=2\n")
    c = config.load(tmp_path / ".env", {"QUIRE_DPI": "72"})
    assert (c.dpi, c.workers, c.api_key, c.ocr_engine) == (72, 2, "k", "paddleocr")
    assert c.violations() == [] and c.data_dir
    assert config.overridden(c, dpi=0, workers=8).workers == 8
    for bad, name in (({"api_key": ""}, "api_key"), ({"ocr_engine": "x"}, "ocr_engine"), ({"workers": 0}, "workers"), ({"dpi": 50}, "dpi")):
        assert config.Config(**{"api_key": "k", **bad}).violations() == [name]


def test_own_fonts_of_scripts_are_resolved(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.operators import fonts

    (tmp_path / ".env").write_text("QUIRE_FONT_THAI=/own/thai.ttf\nQUIRE_FONT_LATIN=\nQUIRE_FONT_KLINGON=/x.ttf\n")
    c = config.load(tmp_path / ".env", {"QUIRE_FONT_ARABIC": "/own/arabic.ttf"})
    assert c.fonts == {"thai": "/own/thai.ttf", "arabic": "/own/arabic.ttf"} and config.Config().fonts == {}
    scripts = spark.createDataFrame([("thai",), ("arabic",), ("latin",), ("cjk",), ("klingon",), (None,)], "script string")
    got = {r.script: r.path for r in fonts.resolved(scripts, c.fonts, F.col("script") == "cjk").collect()}
    assert got == {"thai": "/own/thai.ttf", "arabic": "/own/arabic.ttf", "latin": "fetch:NotoSans-Regular.ttf", "cjk": "/cache/NotoSansSC-Regular.ttf", "klingon": "fetch:NotoSans-Regular.ttf", None: "fetch:NotoSans-Regular.ttf"}
    assert fonts.resolved(scripts, {}, F.lit(False)).filter("path like '/own%'").count() == 0
