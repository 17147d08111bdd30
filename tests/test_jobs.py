"""The job tables over their rounds, and small parts of page output."""

from pyspark.sql import functions as F

from quire.functions.text import is_image_stream
from quire.operators import fonts, jobs, translate

PAGES = "document_id long, page_num int, status string, error_message string, retries int"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_claim_takes_the_lowest_pending_page_of_each_document(spark):
    pages = spark.createDataFrame([(1, 1, "completed", "", 0), (1, 2, "pending", "", 0), (1, 3, "pending", "", 0), (2, 1, "running", "", 0), (2, 2, "failed", "x", 1)], PAGES)
    got = jobs.claimed(pages)
    assert got.columns == pages.columns
    assert rows(got, "document_id", "page_num", "status") == [(1, 1, "completed"), (1, 2, "running"), (1, 3, "pending"), (2, 1, "running"), (2, 2, "failed")]


def test_rounds_retry_failed_pages_and_stop(spark):
    calls = []

    def work(pages):
        calls.append(rows(pages, "document_id", "page_num"))
        bad = (F.col("page_num") == 3) | ((F.col("page_num") == 2) & (F.col("retries") < 1))
        return pages.select("document_id", "page_num", F.when(bad, "no answer").alias("error"))

    pages = spark.createDataFrame([(1, 1, "pending", "", 0), (1, 2, "pending", "", 0), (1, 3, "pending", "", 0), (2, 1, "completed", "", 0)], PAGES)
    got = jobs.run_rounds(pages, work)
    assert calls == [[(1, 1), (1, 2), (1, 3)], [(1, 2), (1, 3)], [(1, 3)], [(1, 3)]]
    assert rows(got, *got.columns) == [(1, 1, "completed", "", 0), (1, 2, "completed", "", 1), (1, 3, "failed", "no answer", 4), (2, 1, "completed", "", 0)]
    calls.clear()
    jobs.run_rounds(got.filter("page_num < 3"), work)
    assert calls == [[]]  # nothing pending, nothing retried


def test_rounds_of_no_pages(spark):
    assert jobs.run_rounds(spark.createDataFrame([], PAGES), lambda p: p.select("document_id", "page_num", F.lit(None).cast("string").alias("error"))).count() == 0


def test_settled_jobs(spark):
    pages = spark.createDataFrame([(1, 1, "completed", "", 0), (2, 1, "failed", "x", 4), (2, 2, "failed", "x", 4), (3, 1, "completed", "", 0)], PAGES)
    old = spark.createDataFrame([(1, 1, "running"), (2, 2, "running"), (3, 2, "running"), (4, 1, "pending")], "id long, total_pages int, status string")
    assert rows(jobs.settled(old, pages), "id", "status", "error_message") == [(1, "completed", ""), (2, "failed", "2 pages failed"), (3, "failed", "1 of 2 pages are complete"), (4, "failed", "0 of 1 pages are complete")]


def test_unicode_map_reads_back(spark):
    points = [(0x41, 5), (0x61, 5), (0x20AC, 300), (0x1F600, 7), *((0x4E00 + i, 1000 + i) for i in range(250))]
    several = spark.createDataFrame([("Test", *p) for p in points] + [("Other", 0x41, 9)], "font string, code_point int, gid int")
    maps = {r.font: r.cmap for r in fonts.unicode_map(several).collect()}
    text = maps["Test"]
    assert "/CMapName /Quire-Test def" in text and "<0009> <0041>" in maps["Other"] and len(maps) == 2
    sections, found = [], {}
    for part in text.split(" beginbfchar\n")[1:]:
        lines = part.split("endbfchar")[0].splitlines()
        sections.append(len(lines))
        for line in lines:
            gid, char = line.strip("<>").split("> <")
            found[int(gid, 16)] = bytes.fromhex(char).decode("utf-16-be")
    assert sections == [100, 100, 53]
    assert found == {g: chr(min(p for p, h in points if h == g)) for _, g in points}
    assert fonts.unicode_map(several.limit(0)).count() == 0


def test_prompts_and_image_streams(spark):
    got = spark.sql("select 'auto' as s, 'fr' as t").select(translate.system_prompt(F.col("s"), F.col("t")).alias("p"), translate.system_prompt(F.lit("en"), F.col("t"), single=True).alias("q")).first()
    assert translate.UNKNOWN in got["p"] and "into fr" in got["p"] and "{" not in got["p"] + got["q"] and "from en into fr" in got["q"]
    f = spark.createDataFrame([(1, ["FlateDecode", "DCTDecode"]), (2, ["FlateDecode"]), (3, []), (4, None), (5, [None])], "id int, f array<string>")
    assert rows(f.select("id", is_image_stream(F.col("f")).alias("i")), "id", "i") == [(1, True), (2, False), (3, False), (4, False), (5, False)]
