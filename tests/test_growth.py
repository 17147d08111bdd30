"""Plans and results of the steps whose cost once grew faster than their input, or whose tables went through the driver."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire import session
from quire.functions import fit, text
from quire.operators import jobs, layout, objects, overlay, pages, sfnt
from quire.sources import virtual

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lines", [overlay.image_mode_lines, lambda b: overlay.overlay_lines(overlay.shown(b))])
def test_texts_are_fitted_once(spark, tmp_path, lines):
    columns = "doc_id long, page int, block_no int, x double, y double, w double, h double, text string, translated string, font_size double, block_type string, delta double"
    spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 90.0, 60.0, "a b", "one two three four five", 12.0, "text", 0.0)], columns).write.parquet(f"{tmp_path}/b")
    df = lines(spark.read.parquet(f"{tmp_path}/b"))
    assert sum("lambda" in line for line in plan(df)[0].splitlines()) == 1
    assert [r.text for r in df.orderBy("line_no").collect()] == ["one two three", "four five"]


def greedy(words, n):
    out = []
    for w in words:
        if out and len(out[-1]) + 1 + len(w) <= n:
            out[-1] += " " + w
        else:
            out.append(w)
    return out or [""]


def test_lines_are_found_by_scans(spark):
    rnd = random.Random(4)
    rows = [(" ".join("".join(rnd.choice("aé你🎉$.\\") for _ in range(rnd.choice([1, 2, 5, 9, 30]))) for _ in range(rnd.randrange(40))), rnd.choice([1, 2, 7, 20, 100])) for _ in range(300)]
    rows += [("a🎉 " * 20_000 + "b", 50_000), ("x" * 99, 10), ("", 5)]
    df = spark.createDataFrame(rows, "t string, n int")
    got = df.select("t", "n", fit.wrap_joined(F.col("t"), F.col("n")).alias("lines"), fit.count_lines(F.col("t"), F.col("n")).alias("count"))
    for r in got.collect():
        assert r.lines == greedy(r.t.split(), r.n) and r["count"] == len(r.lines)


def test_texts_are_escaped_whole(spark):
    rows = [("".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000),) for k in range(1, 0x10000, 64)] + [("(🎉)\\",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string").select("s", text.pdf_escape(F.col("s")).alias("e"))
    one = spark.createDataFrame([(c,) for c in range(0x10000)], "c int").select("c", text.win_ansi(F.col("c")).alias("b")).collect()
    byte = {r.c: r.b for r in one}
    want = lambda s: "".join(("5C" if c in "()\\" else "") + "%02X" % byte.get(ord(c), 0x3F) for c in s)
    assert all(r.e == (None if r.s is None else want(r.s)) for r in df.collect())
    assert "transform(split" not in plan(df)[0]


def test_places_are_not_broadcast(spark):
    lines, regions = virtual.all_lines(spark, DATA), virtual.regions(spark, DATA)
    for df in (layout.leaf_regions(regions), layout.matched_lines(lines, layout.leaf_regions(regions), "left"), layout.layout_blocks(lines, regions)):
        assert "Broadcast" not in plan(df)[1]


def test_leaf_regions_meet_lines_where_they_lie(spark, monkeypatch):
    seen, write = {}, layout.staged

    def noted(df, name):
        seen[name] = plan(df)[1]
        return write(df, name)

    monkeypatch.setattr(layout, "staged", noted)
    lines, regions = virtual.all_lines(spark, DATA), virtual.regions(spark, DATA)
    assert lines.schema["page"].dataType != regions.schema["page"].dataType
    blocks = layout.layout_blocks(lines, regions)
    assert blocks.schema["page"].dataType == lines.schema["page"].dataType
    # lines, regions and the regions that they may hold, but not the leaves once more
    assert seen["matched"].count("Exchange hashpartitioning") == 3
    seen.clear()
    missed = layout.unmatched_lines(lines, regions)
    assert plan(missed)[1].count("Exchange hashpartitioning") == 4


def test_tasks_follow_the_bytes_of_lines(spark, monkeypatch):
    lines, regions = virtual.all_lines(spark, DATA), virtual.regions(spark, DATA)
    rows = lambda df: sorted(map(str, df.collect()))
    dealt = lambda p: set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", p))
    assert session.tasks_for(lines) == 0 and session.tasks_for(lines.limit(0)) == 0
    want, missed = rows(layout.layout_blocks(lines, regions)), rows(layout.unmatched_lines(lines, regions))
    monkeypatch.setattr(session, "TASK_BYTES", 64 << 10, raising=False)
    seen, out, write = {}, {}, layout.staged

    def noted(df, name):
        seen[name], out[name] = plan(df)[1], write(df, name)
        return out[name]

    monkeypatch.setattr(layout, "staged", noted)
    n = session.tasks_for(lines)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = layout.layout_blocks(lines, regions)
    assert dealt(seen["matched"]) == {str(n)}
    # what is joined, merged and numbered afterwards is dealt alike, and texts only once
    after = plan(blocks)[1]
    assert dealt(after) == {str(session.tasks_for(out["matched"]))} and after.count("Exchange") == 4
    assert rows(blocks) == want
    unmatched = layout.unmatched_lines(lines, regions)
    assert dealt(plan(unmatched)[1]) == {str(n)} and rows(unmatched) == missed


def test_tasks_follow_the_rows_of_regions(spark, monkeypatch):
    lines, regions = virtual.all_lines(spark, DATA), virtual.regions(spark, DATA)
    n = regions.count()
    want = sorted(map(str, layout.layout_blocks(lines, regions).collect()))
    monkeypatch.setattr(session, "FILE_ROWS", 100, raising=False)
    # one file fills a task, as many files of few bytes do at size
    open_cost = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for make in (layout.layout_blocks, layout.unmatched_lines):
        before = set(spark.sparkContext.__dict__.get("_quire_staged", ()))
        out = make(lines, regions)
        (at,) = (p for p in spark.sparkContext._quire_staged - before if p.endswith("-regions"))
        per_file = spark.read.parquet(at).groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in per_file) == n and max(r["count"] for r in per_file) <= 100
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
        try:
            assert spark.read.parquet(at).rdd.getNumPartitions() >= n / 100
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
        if make is layout.layout_blocks:
            assert sorted(map(str, out.collect())) == want


def test_references_are_not_broadcast(spark):
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(30)] + [("a", 3, 9), ("b", 0, 1)], "file string, object long, ref long")
    roots = spark.createDataFrame([("a", 0), ("b", 0)], "file string, object long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    seen, write = [], objects.staged

    def noted(df, name):
        seen.append(plan(df)[1])
        return write(df, name)

    objects.staged = noted
    try:
        found = objects.closure(edges, roots)
        _, moved = objects.renumbered(found, edges)
        seen.append(plan(moved)[1])
        assert found.count() == 33 and moved.count() == 32
    finally:
        objects.staged = write
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(seen) > 10 and not any("Broadcast" in p for p in seen)


def test_spans_of_lines_are_not_shuffled(spark):
    whole, parts = pages.native_lines(virtual.line_spans(spark, DATA)), pages.native_lines(virtual.spans(spark, DATA))
    assert "Exchange" not in plan(whole)[1]
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_code_points_are_grouped_only_where_segments_overlap(spark):
    from test_structures import cmap, four, twelve

    end = (0xFFFF, 0xFFFF, 1, 0)
    cases = {"apart": four([(65, 70, 10, 0), (71, 80, 3, 0), end]), "touch": four([(65, 70, 10, 0), (70, 80, 3, 0), end]), "inside": four([(65, 80, 10, 0), (70, 72, 3, 0), (79, 79, 1, 0), end]), "back": four([(70, 80, 1, 0), (65, 69, 2, 0), end])}
    data = [(k, bytearray(cmap((3, 1, v)))) for k, v in cases.items()] + [("long", bytearray(cmap((3, 10, twelve([(1, 5, 9), (4, 6, 70)])))))]
    df = sfnt.glyphs_of(sfnt.chosen_map(spark.createDataFrame(data, "font string, data binary")))
    got = {}
    for r in df.collect():
        assert r.code_point not in got.setdefault(r.font, {})
        got[r.font][r.code_point] = r.gid
    last = {"apart": [(65, 70, 10), (71, 80, 3)], "touch": [(65, 70, 10), (70, 80, 3)], "inside": [(65, 80, 10), (70, 72, 3), (79, 79, 1)], "back": [(70, 80, 1), (65, 69, 2)]}
    assert got == {k: {c: c + d for a, b, d in v for c in range(a, b + 1)} for k, v in last.items()} | {"long": {1: 9, 2: 10, 3: 11, 4: 70, 5: 71, 6: 72}}
    top = plan(df)[0].splitlines()
    assert top[0].startswith("Union") and sum("Aggregate" in line for line in top) == 1


def test_rounds_write_open_pages_only(spark, monkeypatch):
    written, write = [], jobs.staged

    def noted(df, name):
        out = write(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(jobs, "staged", noted)
    rows = [(d, p, s, "", 0) for d in range(20) for p, s in enumerate(("completed", "pending", "pending", "failed", None))]
    start = spark.createDataFrame(rows, "document_id long, page_num int, status string, error_message string, retries int")
    late = lambda df: df.select("document_id", "page_num", F.when(F.col("retries") < F.col("page_num") - 1, "late").alias("error"))
    got = {(r.document_id, r.page_num): (r.status, r.retries) for r in jobs.run_rounds(start, late).collect()}
    assert len(got) == 100 and written == [100, 40, 40, 20, 20]
    assert got == {(d, p): v for d in range(20) for p, v in enumerate((("completed", 0), ("completed", 0), ("completed", 1), ("completed", 2), (None, 0)))}
