"""The page plan over real files, the commands, and files that fail."""

from pyspark.sql import functions as F

from quire import files
from quire.__main__ import cleanup, main
from quire.sinks import pdf as sink
from quire.sources import pdf as source
from quire.sources.jobstore import JobStore
from quire.sources.providers import stub_model


def page(*lines, width=400, height=500):
    body = b"".join(b"BT /FO0 12 Tf 40 %d Td (%s) Tj ET\n" % (height - 60 - 80 * i, t.encode()) for i, t in enumerate(lines))
    return sink.page_pdf(body, width, height)




def folder(tmp_path):
    (tmp_path / "in").mkdir()
    made = {
        "two.pdf": sink.merge([page("The first line of the page", "Another line of words"), page("A page of another height", height=700)]), "scan.pdf": sink.merge([page("A page with its own text"), page()]),
        "bad.pdf": b"no pdf", "fails.pdf": sink.merge([page("A page that works quite well"), page("This page fails in translation")]), "empty.pdf": page(),
    }
    for name, data in made.items():
        (tmp_path / "in" / name).write_bytes(data)
    return f"{tmp_path}/in/*.pdf"


def test_files_are_translated_in_place(spark, tmp_path):
    path = folder(tmp_path)
    scan = files.documents(spark, path).filter("path like '%scan.pdf'").select("doc_id", F.lit(2).alias("page"), F.lit(0).alias("line_no"), F.lit(40.0).alias("x"), F.lit(300.0).alias("y"), F.lit(250.0).alias("w"), F.lit(14.0).alias("h"), F.lit("words that were recognised").alias("text"), F.lit(11.0).alias("font_size"), F.lit("").alias("font_name"))
    image = files.documents(spark, path).filter("path like '%two.pdf'").selectExpr("doc_id", "1 as page", "0 as rid", "20d as x", "200d as y", "300d as w", "90d as h", "'image' as block_type")
    rows = {r.path.rpartition("/")[2]: r for r in files.translated_files(spark, path, stub_model, regions=image, recognised=scan).collect()}
    assert {k: r.error for k, r in rows.items() if r.error} == {"bad.pdf": "ValueError: not a PDF file"} and rows["bad.pdf"].pdf is None
    read = {k: source.read_pages(bytes(r.pdf)) for k, r in rows.items() if r.pdf}
    # lines are wrapped to their boxes, so words are what is looked for
    shown = lambda name, n: " ".join(read[name][n]["page_text"].split())
    assert "[de] The first line of the page" in shown("two.pdf", 0) and "[de] A page of another height" in shown("two.pdf", 1) and len(read["two.pdf"]) == rows["two.pdf"].total_pages == 2
    assert read["two.pdf"][0]["height"] > 500 + 90 and read["two.pdf"][1]["height"] <= 700  # the picture is shown twice
    assert "[de] words that were recognised" in shown("scan.pdf", 1) and shown("empty.pdf", 0) == ""


def test_pages_that_fail_fail_their_file(spark, tmp_path):
    def broken(blocks, source_, target):
        """Says nothing on some pages; without a pause between attempts."""
        import quire.sources.providers as p

        p.FIRST_PAUSE = 0.0
        return "[]" if any("fails" in b["text"] for b in blocks) else p.stub_model(blocks, source_, target)

    got = files.translated_files(spark, folder(tmp_path).replace("*.pdf", "[fb]*.pdf"), broken)
    rows = {r.path.rpartition("/")[2]: r for r in got.collect()}
    assert rows["fails.pdf"].error == "page 2: ValueError: expected 1 translations, got 0" and rows["fails.pdf"].pdf is None and rows["bad.pdf"].error.startswith("ValueError")
    done = {r.path.rpartition("/")[2]: r for r in files.written_files(got, f"{tmp_path}/out").collect()}
    assert done["fails.pdf"].output is None and not (tmp_path / "out" / "fails_translated.pdf").exists()


def test_commands(spark, tmp_path, capsys):
    path = folder(tmp_path).replace("*.pdf", "two.pdf")
    main(["translate", path, f"{tmp_path}/out", "--target", "fr"])
    assert "[fr]" in source.read_pages((tmp_path / "out" / "two_translated.pdf").read_bytes())[1]["page_text"]
    main(["version"])
    assert capsys.readouterr().out.strip().endswith("0.1")


def test_cleanup_of_a_job_table(spark, tmp_path):
    store = JobStore(spark, f"{tmp_path}/jobs", span=10_000)
    rows = [(1, "running", "2000-12-30 00:00:00", "/tmp/a"), (2, "completed", "2000-12-30 00:00:00", "/tmp/b"), (3, "failed", "2000-12-31 12:00:00", "/tmp/c"), (4, "failed", "2000-12-01 00:00:00", "/tmp/../etc"), (30_001, "pending", "2000-12-01 00:00:00", "/tmp/d"), (50_001, "running", "2001-01-01 00:00:00", "/tmp/e")]
    store.create(spark.createDataFrame(rows, "id long, status string, at string, temp_dir string").withColumn("updated_at", F.to_timestamp("at")).drop("at"))
    gone = cleanup(spark, f"{tmp_path}/jobs", "2001-01-01 00:00:00", "/tmp")
    assert sorted(r.id for r in gone.collect()) == [1, 30_001]
    assert sorted(r.id for r in store.read().collect()) == [2, 3, 4, 50_001]
    assert cleanup(spark, f"{tmp_path}/jobs", "2001-01-01 00:00:00", "/tmp").count() == 0
