"""Object graphs, content streams, images, font tables, payloads, stored jobs, streams and the page source on awkward input."""

import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import images, objects, payloads, sfnt, translate
from quire.sources import jobstore, pagesource
from quire.sources.ttf import checksum
from quire.streaming import results


def reached(edges, roots):
    seen, open_ = set(roots), list(roots)
    while open_:
        f, o = open_.pop()
        for g, a, b in edges:
            if (g, a) == (f, o) and b is not None and (f, b) not in seen:
                seen.add((f, b))
                open_.append((f, b))
    return seen


def test_closure_against_plain_search(spark):
    rnd = random.Random(3)
    edges = [("chain", i, i + 1) for i in range(300)] + [("ring", i, (i + 1) % 17) for i in range(17)] + [("self", 1, 1), ("gone", 0, 99), ("none", 0, None), (None, 0, 1)]
    edges += [("ring", 40, 3), ("both", 0, 1), ("both", 0, 2), ("both", 1, 0), ("both", 2, 7), ("both", 7, 8), ("both", 8, 7)]
    edges += [(f"r{k}", rnd.randrange(40), rnd.randrange(40)) for k in range(6) for _ in range(12 * k)]
    roots = [("chain", 0), ("chain", 250), ("ring", 40), ("self", 1), ("gone", 0), ("none", 0), ("both", 0), ("lonely", 5)] + [(f"r{k}", 0) for k in range(6)]
    e, r = spark.createDataFrame(edges * 2, "file string, object long, ref long"), spark.createDataFrame([*roots, roots[0], (None, 1)], "file string, object long")
    found = objects.closure(e, r)
    rows = [tuple(x) for x in found.collect()]
    want = reached(edges, roots)
    assert len(rows) == len(set(rows)) and set(rows) == want
    numbers, moved = objects.renumbered(found, e)
    number = {(f, o): i + 1 for name in {f for f, _ in want} for i, (f, o) in enumerate(sorted(x for x in want if x[0] == name))}
    assert {(x.file, x.object): x.number for x in numbers.collect()} == number
    assert {tuple(x) for x in moved.collect()} == {(f, number[f, a], number[f, b]) for f, a, b in edges if b is not None and (f, a) in want}
    assert objects.closure(e.limit(0), r.limit(0)).count() == 0 and objects.closure(e, r.limit(0)).count() == 0 and objects.closure(e.limit(0), r).count() == len(roots)


def test_large_files_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(objects, "PART", 10)
    rows = [("a", i * 3) for i in range(95)] + [("b", 4)]
    numbers, _ = objects.renumbered(spark.createDataFrame(rows, "file string, object long"), spark.createDataFrame([], "file string, object long, ref long"))
    assert sorted((r.file, r.object, r.number) for r in numbers.collect()) == [("a", i * 3, i + 1) for i in range(95)] + [("b", 4, 1)]


def test_balance(spark):
    rnd = random.Random(1)
    rows = ["", "q", "Q", "Q\nQ\nq", " q \nBT\n\tQ", "qq\nQ Q"] + ["\n".join(rnd.choice(["q", "Q", "x", " q"]) for _ in range(rnd.randint(0, 60))) for _ in range(30)] + ["q\n" * 20_000]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(99, None)], "id int, t string").select("id", "t", text.balance(F.col("t")).alias("b"), text.balanced(F.col("t")).alias("whole"))
    for r in df.collect():
        depth = low = 0
        for line in (r.t or "").split("\n"):
            depth += {"q": 1, "Q": -1}.get(line.strip(), 0)
            low = min(low, depth)
        assert tuple(r.b) == (depth, low, -low, depth - low)
        if r.t is not None:
            run = 0
            for line in r.whole.split("\n"):
                run += {"q": 1, "Q": -1}.get(line.strip(), 0)
                assert run >= 0
            assert run == 0
        else:
            assert r.whole is None


def test_background_against_each_pixel(spark):
    rnd = random.Random(5)
    sizes = {1: (7, 5), 2: (1, 1), 3: (12, 9)}
    pixels = {(k, x, y): tuple(rnd.randrange(65536) for _ in range(3)) for k, (w, h) in sizes.items() for x in range(w) for y in range(h)}
    boxes = [(k, i, rnd.randint(-3, 13), rnd.randint(-3, 11), rnd.randint(-1, 14), rnd.randint(-1, 12)) for k in (1, 2, 3, 4) for i in range(40)]
    got = images.background(spark.createDataFrame([(*p, *c) for p, c in pixels.items()], "image int, x int, y int, r int, g int, b int"), spark.createDataFrame(boxes, "image int, id int, x int, y int, w int, h int")).collect()
    found = {(r.image, r.id): (r.r, r.g, r.b) for r in got}
    assert len(got) == len(boxes)
    for k, i, x, y, w, h in boxes:
        want = (1.0, 1.0, 1.0)
        if k in sizes and w > 0 and h > 0:
            wide, high = sizes[k]
            x, y = max(0, min(x, wide - 1)), max(0, min(y, high - 1))
            right, low = min(x + w, wide) - 1, min(y + h, high) - 1
            seen = [pixels[k, a, b] for a in range(x, right + 1) for b in (y, low)] + [pixels[k, a, b] for b in range(y, low + 1) for a in (x, right)]
            want = tuple(sum(c[j] for c in seen) // len(seen) / 65535 for j in range(3))
        assert found[k, i] == pytest.approx(want)


def four(segments, lists=(), cut=None):
    n = len(segments)
    column = lambda i: b"".join(struct.pack(">H", s[i] & 0xFFFF) for s in segments)
    data = struct.pack(">HHHHHHH", 4, 0, 0, 2 * n, 0, 0, 0) + column(1) + b"\0\0" + column(0) + column(2) + column(3) + b"".join(struct.pack(">H", g) for g in lists)
    return data[:cut]


def twelve(groups, said=None):
    return struct.pack(">HHIII", 12, 0, 0, 0, len(groups) if said is None else said) + b"".join(struct.pack(">III", *g) for g in groups)


def cmap(*records):
    at, head, body = 4 + 8 * len(records), b"", b""
    for p, e, data in records:
        head += struct.pack(">HHI", p, e, at + len(body))
        body += data
    return struct.pack(">HH", 0, len(records)) + head + body


def test_character_maps(spark):
    end = (0xFFFF, 0xFFFF, 1, 0)
    plain = four([(65, 70, 10, 0), end])
    cases = {
        "plain": (cmap((3, 1, plain)), {c: c + 10 for c in range(65, 71)}), "negative": (cmap((0, 3, four([(100, 102, -100, 0), end]))), {101: 1, 102: 2}), "wraps": (cmap((3, 1, four([(65535 - 5, 65535 - 4, 10, 0), end]))), {65530: 4, 65531: 5}),
        "listed": (cmap((3, 1, four([(65, 68, 5, 4), end], [7, 0, 9, 65531]))), {65: 12, 67: 14}), "past the end": (cmap((3, 1, four([(65, 70, 0, 4), end], [7, 8]))), {65: 7, 66: 8}),
        "overlap": (cmap((3, 1, four([(65, 67, 0, 0), (66, 66, 100, 0), end]))), {65: 65, 66: 166, 67: 67}), "stops": (cmap((3, 1, four([(65, 65, 0, 0), end, (70, 70, 0, 0)]))), {65: 65}), "backwards": (cmap((3, 1, four([(70, 65, 0, 0), end]))), {}),
        "twelve": (cmap((3, 1, plain), (3, 10, twelve([(10, 12, 50), (0xFFFE, 0x1F600, 3), (20, 20, 0)]))), {10: 50, 11: 51, 12: 52, 0xFFFE: 3, 0xFFFF: 4}), "too many": (cmap((3, 10, twelve([(10, 10, 5)], 4_000_000_000))), {10: 5}), "second": (cmap((1, 0, b"\0\0\0\0"), (0, 3, four([(5, 5, 1, 0), end])), (3, 1, plain)), {c: c + 10 for c in range(65, 71)}),
        "short": (b"\0", "too short"), "empty": (b"", "too short"), "none": (cmap(), "no usable map"), "mac": (cmap((1, 0, plain)), "no usable map"), "outside": (struct.pack(">HHHHI", 0, 1, 3, 1, 999), "no usable map"), "cut": (cmap((3, 1, four([(65, 70, 10, 0), end], cut=20))), "truncated"), "cut twelve": (cmap((3, 10, twelve([])[:15])), "truncated"),
    }
    maps = sfnt.chosen_map(spark.createDataFrame([(k, bytearray(d)) for k, (d, _) in cases.items()], "font string, data binary"))
    errors = {r.font: r.error for r in maps.collect()}
    assert errors == {k: w if isinstance(w, str) else None for k, (_, w) in cases.items()}
    got = {}
    for r in sfnt.glyphs_of(maps).collect():
        assert r.code_point not in got.setdefault(r.font, {})
        got[r.font][r.code_point] = r.gid
    assert got == {k: w for k, (_, w) in cases.items() if not isinstance(w, str) and w}


def test_checksums_and_directory(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(f, t, bytearray(rnd.randbytes(rnd.choice([0, 1, 3, 4, 11, 12, 13, 4095, 4096, 4097, 20_000])))) for f in range(5) for t in ("head", "glyf", "OS/2", "cmap", "loca")[: f + 1]] + [(9, "glyf", bytearray(b"\xff" * 40_000))]
    tables = spark.createDataFrame(rows, "font int, tag string, data binary")
    want = {}
    for f, t, d in rows:
        d = bytes(d)
        want[f, t] = (len(d), checksum(d[:8] + b"\0\0\0\0" + d[12:] if t == "head" and len(d) >= 12 else d))
    assert {(r.font, r.tag): (r.length, r.checksum) for r in sfnt.checksums(tables).collect()} == want
    got = {}
    for r in sfnt.directory(tables).collect():
        got.setdefault(r.font, []).append(r)
    for f, entries in got.items():
        entries.sort(key=lambda r: r.tag)
        n, at = len(entries), 12 + 16 * len(entries)
        assert [r.tag for r in entries] == sorted(t for (g, t), (size, _) in want.items() if g == f and size)
        power = 1 << (n.bit_length() - 1)
        for r in entries:
            assert (r.offset, r.checksum, r.tables, r.search_range, r.entry_selector, r.range_shift) == (at, want[f, r.tag][1], n, 16 * power, power.bit_length() - 1, 16 * (n - power))
            at += -(-r.length // 4) * 4


def test_payloads(spark):
    rows = [
        '{"success":true,"regions":[{"label":"table","coordinate":["1","2.5",3,4],"score":"0.5"},{"coordinate":[[1,2],[5],[],[3,0.5,9]],"prob":0.75},{"type":"figure","coordinate":[],"score":0},{"coordinate":null},{"coordinate":[1,2,3]},{"coordinate":{"a":1}},7,null,[1],{"coordinate":[1,null,3,4]},{"coordinate":[true,"x",3,4]}]}',
        '{"success":true,"regions":null}', '{"success":true}', '{"success":true,"regions":[]}', '{"success":false,"regions":[{"coordinate":[1,2,3,4]}]}', '{"regions":[]}', '{"success":"yes please"}', "", None, "null", "7", "[]", '{"success":true,"regions":{"a":1}}', '{"success":true', '"text"',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, payload string")
    got = {}
    for r in payloads.regions(df, ["id"]).collect():
        got.setdefault(r.id, []).append(r)
    assert {k: [r.error for r in v] for k, v in got.items() if k} == {4: ["failed"], 5: ["failed"], 6: ["failed"], 7: ["malformed"], 8: ["malformed"], 9: ["malformed"], 10: ["malformed"], 11: ["malformed"], 12: ["malformed"], 13: ["malformed"], 14: ["malformed"]}
    first = sorted(got[0], key=lambda r: r.pos)
    assert [tuple(r)[2:] for r in first[:2]] == [("table", 0.5, 1.0, 2.5, 3.0, 4.0, None), ("text", 0.75, 1.0, 0.5, 3.0, 2.0, None)]
    assert [r.error for r in first[2:]] == ["no coordinates"] * 4 + ["malformed"] * 3 + ["no coordinates"] * 2
    lines = spark.createDataFrame([(1, '{"success":true,"details":[{"text":"a","confidence":0.9,"bbox":[[1,2],[3,2],[3,4],[1,4]]},{"text":"b","bbox":[[1,2]]},{"text":"","bbox":[[1,2],[3,2],[3,4],[1,4]]},{"bbox":[[1,2],[3,2],[3,4],[1,4]]},{"text":5}]}'), (2, '{"success":false}')], "id int, payload string")
    assert sorted(((r.id, r.text, r.confidence, r.y1, r.error) for r in payloads.lines(lines, "paddle", ["id"]).collect())) == [(1, "a", 0.9, 4.0, None), (2, None, None, None, "failed")]
    boxes = spark.createDataFrame([(1, '{"boxes":[{"text":"a","x":1,"y":2,"w":3,"h":4},{"text":"b","x":1,"y":2,"w":0,"h":4},{"text":"c"}]}')], "id int, payload string")
    assert [(r.text, r.x1, r.y1) for r in payloads.lines(boxes, "tesseract", ["id"]).collect()] == [("a", 4.0, 6.0)]


def test_fallback(spark):
    items = spark.createDataFrame([(k, n, f"{k}{n}", "table" if n == 1 else "text") for k in "abcdefg" for n in range(3)], "id string, n int, text string, block_type string")
    batches = spark.createDataFrame([("a", '["x","y","z"]', 3), ("b", '["x","y"]', 3), ("c", "no JSON", 3), ("d", '```json\n[{"text":"p"},{"text":"q"},{"text":"r"}]\n```', 3), ("e", "", 3), ("f", None, 3)], "id string, content string, expected long")
    asked = []

    def ask(requests):
        asked.append({(r.id, r.n): r.request for r in requests.collect()})
        return requests.filter("id <> 'e' or n <> 2").select("id", "n", F.when(F.col("id") != "c", F.concat(F.lit(" said "), "text", F.lit("\n"))).alias("content"), F.when(F.col("id") == "c", "busy").alias("error"))

    got = {(r.id, r.n): (r.translated, r.via, r.error) for r in translate.with_fallback(batches, items, ask, "id").collect()}
    assert len(got) == 21 and set(asked[0]) == {(k, n) for k in "bcefg" for n in range(3)}
    assert asked[0]["b", 1] == translate.TABLE_HINT + "b1" and asked[0]["b", 0] == "b0"
    assert [got["a", n] for n in range(3)] == [(t, "batch", None) for t in "xyz"] and got["d", 2] == ("r", "batch", None)
    assert got["b", 1] == ("said b1", "single", None) and got["g", 0] == ("said g0", "single", None)
    assert got["c", 0] == (None, "single", "busy") and got["e", 2] == (None, "single", "no answer") and got["e", 1][2] is None


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_updates_leave_other_partitions_alone(spark, tmp_path):
    store = jobstore.JobStore(spark, str(tmp_path / "jobs"), span=100)
    jobs = spark.range(10_000).selectExpr("id", "concat('/in/', id) as input_path", "'pending' as status")
    store.create(jobs)
    before = files(tmp_path / "jobs")
    assert len(before) == 100
    changes = jobs.filter("id between 4200 and 4299").withColumn("status", F.lit("running"))
    store.update(changes)
    after = files(tmp_path / "jobs")
    assert {k: v for k, v in before.items() if "span=42/" not in k} == {k: v for k, v in after.items() if "span=42/" not in k} and before != after
    more = spark.createDataFrame([(4250, "/x", "failed"), (4250, "/a", "failed"), (20_000, "/new", "pending")], "id long, input_path string, status string")
    store.update(more)
    store.update(more.limit(0))
    rows = {r.id: (r.input_path, r.status) for r in store.read().collect()}
    assert store.read().count() == len(rows) == 10_001 and rows[4250] == ("/x", "failed") and rows[4251] == ("/in/4251", "running") and rows[20_000] == ("/new", "pending") and rows[5] == ("/in/5", "pending")
    again = jobstore.JobStore(spark, str(tmp_path / "jobs"), span=100)
    assert again.read().filter("status = 'running'").count() == 99
    with pytest.raises(ValueError):
        store.update(spark.createDataFrame([(None, "/x", "failed")], "id long, input_path string, status string"))


def test_stream_that_stops_and_goes_on(spark, tmp_path):
    schema = "page_id long, url string, html string"
    pages = [(i, f"u{i}", f"<p>{'text ' * (i % 7)}</p>" if i % 5 else None) for i in range(90)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    part = lambda k: spark.createDataFrame(pages[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(folder)
    runs = []

    def work(rows):
        runs.append(rows.count())
        if len(runs) == 2:
            raise RuntimeError("lost while the second file was worked on")
        return results.classified(rows)

    part(0)
    results.gather(spark, folder, schema, work, out, checkpoint, files=1).awaitTermination()
    part(1)
    with pytest.raises(Exception, match="second file"):
        results.gather(spark, folder, schema, work, out, checkpoint, files=1).awaitTermination()
    part(2)
    results.gather(spark, folder, schema, work, out, checkpoint, files=1).awaitTermination()
    results.gather(spark, folder, schema, work, out, checkpoint, files=1).awaitTermination()
    assert runs == [30, 30, 30, 30]
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(results.gathered(spark, out)) == shown(results.classified(spark.createDataFrame(pages, schema)))


def test_filters_cut_the_page_source(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "pages.parquet")
    pq.write_table(pa.table({"page_id": pa.array(range(100), pa.int64()), "url": [f"u{i}" for i in range(100)], "html": [None if i % 9 == 0 else "x" * i for i in range(100)]}), path, row_group_size=10)
    pages = pagesource.registered(spark).read.format("quire_pages").option("path", path).load()
    plain = spark.read.parquet(path)
    assert sorted(map(str, pages.collect())) == sorted(map(str, plain.collect())) and pages.rdd.getNumPartitions() == 10
    for where, parts in (("page_id = 37", 1), ("page_id >= 75", 3), ("page_id > 12 and page_id <= 20", 2), ("page_id in (3, 95)", 2), ("page_id < 0", 1), ("url = 'u5'", 10), ("page_id < 25 and html is not null", 3), ("page_id is null", 10)):
        some = pages.filter(where)
        assert some.rdd.getNumPartitions() == parts, where
        assert sorted(map(str, some.collect())) == sorted(map(str, plain.filter(where).collect())), where


def test_staged_tables_are_released(spark, tmp_path):
    from quire.session import dropped, released, shared_dir, staged

    released(spark)
    one, two = staged(spark.range(5), "one"), staged(spark.range(7), "two")
    dropped(one)
    place = Path(shared_dir(spark).removeprefix("file:"), "quire")
    names = lambda: [p.name.split("-")[-1] for p in place.iterdir()]
    assert two.count() == 7 and "two" in names() and "one" not in names()
    assert released(spark) == 1 and "two" not in names() and released(spark) == 0
