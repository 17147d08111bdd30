"""The job tables: finding, resuming, claiming, counting, assembling and cleaning up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import page_file
from quire.session import merged, staged

UNFINISHED = ("failed", "pending", "running")


def resumable(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each request with the smallest unfinished job for the same paths and language, or null."""
    key = ["input_path", "output_path", "target_lang"]
    open_ = jobs.filter(F.col("status") != "completed").groupBy(*key).agg(F.min("id").alias("job_id"))
    return requests.join(open_, key, "left")


def page_rows(jobs: DataFrame, kinds: DataFrame) -> DataFrame:
    """A pending row per page of each job; pages of unknown type count as scanned."""
    pages = jobs.select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page_num"))
    return pages.join(kinds, ["document_id", "page_num"], "left").select("document_id", "page_num", F.coalesce("page_type", F.lit("scanned")).alias("page_type"), F.lit("pending").alias("status"))


def next_pages(pages: DataFrame) -> DataFrame:
    """The lowest pending page of each document."""
    return pages.filter("status = 'pending'").groupBy("document_id").agg(F.min("page_num").alias("page_num"))


def resumed(pages: DataFrame) -> DataFrame:
    """Running and failed pages become pending again; errors go, retries stay."""
    again = F.col("status").isin("running", "failed")
    return pages.withColumns({"error_message": F.when(F.col("status") == "failed", "").otherwise(F.col("error_message")), "status": F.when(again, "pending").otherwise(F.col("status"))})


def finished(pages: DataFrame, outcomes: DataFrame, most: int = 3) -> DataFrame:
    """Pages after a round: outcomes (document_id, page_num, error) complete them or count a retry."""
    rows = pages.join(merged(outcomes.withColumn("_done", F.lit(True))), ["document_id", "page_num"], "left")
    failed = F.col("error").isNotNull()
    status = F.when(F.col("_done").isNull(), F.col("status")).when(failed, "failed").otherwise("completed")
    return rows.withColumns({"status": status, "error_message": F.coalesce("error", "error_message"), "retries": F.col("retries") + failed.cast("int")}).drop("_done", "error")


def claimed(pages: DataFrame) -> DataFrame:
    """The table after each document's lowest pending page has been taken up: it is running."""
    lowest = F.min(F.when(F.col("status") == "pending", F.col("page_num"))).over(W.partitionBy("document_id"))
    taken = (F.col("status") == "pending") & (F.col("page_num") == F.col("_lowest"))
    return pages.withColumn("_lowest", lowest).withColumn("status", F.when(taken, "running").otherwise(F.col("status"))).drop("_lowest")


def run_rounds(pages: DataFrame, work: Callable[[DataFrame], DataFrame], retries: int = 3) -> DataFrame:
    """All pending pages worked on, and those that fail again in up to `retries` more rounds.

    `work` turns pages into outcomes (document_id, page_num, error), one for each page; an error of
    one page doesn't stop others. Each round's pages are written, so a lost executor repeats at
    most that round, and the loop ends as soon as nothing is left to retry. Only pages that are
    still open go into a round; those done stay in the files of their round.
    """
    is_open = F.coalesce(F.col("status").isin("failed", "pending"), F.lit(False))
    pages = staged(pages, "pages")
    done, waiting = pages.filter(~is_open), pages.filter("status = 'pending'")
    for n in range(retries + 1):
        left = staged(finished(waiting, work(waiting)), "pages")
        if not n:
            # pages that had failed before are retried with the first round's
            left = left.unionByName(pages.filter("status = 'failed'"))
        if n == retries or left.filter("status = 'failed'").isEmpty():
            break
        done = done.unionByName(left.filter(~is_open))
        again = F.col("status") == "failed"
        waiting = left.filter(is_open).withColumns({"error_message": F.when(again, "").otherwise(F.col("error_message")), "status": F.lit("pending")})
    return done.unionByName(left)


def settled(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each job's status and error after its rounds: failed pages fail it, and so does a page short of the total."""
    n = pages.groupBy("document_id").agg(F.count_if(F.col("status") == "failed").alias("_failed"), F.count_if(F.col("status") == "completed").alias("_done"))
    failed, done = F.coalesce("_failed", F.lit(0)), F.coalesce("_done", F.lit(0))
    error = F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" pages failed"))).when(done != F.col("total_pages"), F.concat(done.cast("string"), F.lit(" of "), F.col("total_pages").cast("string"), F.lit(" pages are complete"))).otherwise("")
    rows = jobs.join(n, jobs["id"] == n["document_id"], "left").withColumn("error_message", error)
    return rows.withColumn("status", F.when(F.col("error_message") == "", "completed").otherwise("failed")).drop("_failed", "_done", "document_id")


def count_by_status(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id", "status").agg(F.count("*").alias("n"))


def dry_run(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("page_type") == "native").alias("native"), F.count_if(F.col("page_type") == "scanned").alias("scanned"))


def assembly(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents all of whose pages are complete, with their page files in order."""
    done = pages.filter("status = 'completed'").groupBy("document_id").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("page_num")).alias("_p"))
    ready = jobs.join(done, jobs["id"] == done["document_id"]).filter(F.col("_n") == F.col("total_pages"))
    return ready.select("document_id", "output_path", F.array_join(F.transform("_p", page_file), ",").alias("files"))


def normal_path(path: Column) -> Column:
    """An absolute path without empty and `.` segments, each `..` taking the one before it."""
    none = F.expr("cast(array() as array<string>)")
    step = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))


def safe_path(path: Column, *roots: str) -> Column:
    """Whether an absolute path, its `.` and `..` resolved, is a strict descendant of a root; a root itself never is."""
    found = F.lit(False)
    for root in roots:
        found = found | normal_path(path).startswith(root.rstrip("/") + "/")
    return F.coalesce(path.startswith("/") & found, F.lit(False))


def stale(jobs: DataFrame, now: str, roots: tuple[str, ...], hours: int = 24) -> DataFrame:
    """Unfinished jobs not touched for `hours`, whose folder is named and lies in a safe place. Adds `safe`."""
    old = F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")
    return jobs.filter(F.col("status").isin(*UNFINISHED) & old).withColumn("safe", (F.col("temp_dir") != "") & safe_path(F.col("temp_dir"), *roots))


def cleaned(jobs: DataFrame, pages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given jobs, pages first."""
    ids = gone.select(F.col("id").alias("_gone"))
    return jobs.join(ids, F.col("id") == F.col("_gone"), "left_anti"), pages.join(ids, F.col("document_id") == F.col("_gone"), "left_anti")
