"""Queries over whole texts, longer than any prefix, against plain Python."""

import json

import pytest

from quire import plans

TEXTS = ["Ab.é🎉 " * 300 + "end.", "", "(x) \\ y □ €" * 90, "שלום עולם " * 200, "a " * 300 + "你好世界" * 400 + " □"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


def test_encode_hex(spark, docs):
    got = {r.id: r.hex for r in plans.queries()["q_encode_hex"](spark, docs).collect()}
    assert got == {i: "".join("%04X" % (0 if c == "." else 1 + (ord(c) + ord("F")) % 100) for c in t) for i, t in enumerate(TEXTS)}


def test_answers(spark, tmp_path):
    turns = ['He said "no" \\ \n[1] ] ' * 20, "tab\tand ``` fence é🎉 " * 20, "[]", "x" * 5000]
    rows = [(c, k, f"{t} {c}") for c in range(10) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {c: [t for d, _, t in rows if d == c] for c in range(10)}
    for r in plans.queries()["q_extract_json"](spark, str(tmp_path)).collect():
        assert [x["text"] if r.conv_id % 4 == 3 else x for x in json.loads(r.body)] == want[r.conv_id]
    got = {r.conv_id: (r.error, r.translations) for r in plans.queries()["q_parse_response"](spark, str(tmp_path)).collect()}
    assert got == {c: (None, "|".join(t)) for c, t in want.items() if c != 9} | {9: ("expected 5 translations, got 4", None)}


def test_texts(spark, docs):
    found = lambda name: [r[1] for r in sorted(plans.queries()[name](spark, docs).filter("id >= 1000").collect())]
    assert found("q_is_rtl") == [False, False, False, True, False]
    assert found("q_char_ratio") == [0.5, 0.5, 0.5, 0.5, 1.0]
    assert found("q_formula_blocks") == [False, False, True, False, True]
    byte = lambda c: {"€": 128, "□": 63}.get(c, ord(c) if ord(c) < 256 else 63)
    assert found("q_pdf_escape") == ["".join(("5C" if c in "()\\" else "") + "%02X" % byte(c) for c in t) for t in TEXTS]
