"""Command line: `python -m quire version`; `dry-run PATH` for page counts and an estimated cost; `translate PATH
FOLDER` for translated files; `cleanup FOLDER` to drop stale jobs of a job table; `download-fonts URL` for the fonts that are missing."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.files import translated_files, written_files
from quire.operators import pages, translate
from quire.operators.jobs import stale
from quire.operators.pages import in_ranges
from quire.session import staged
from quire.sources.config import load
from quire.sources.fetch import fetch_missing
from quire.sources.jobstore import JobStore
from quire.sources.pdf import read_pdf
from quire.sources.providers import Model, stub_model

VERSION = "0.1"


def dry_run(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """Per file: pages, native and scanned ones, and what a translation of their text would cost."""
    rows = read_pdf(spark, path).filter("error is null and page_num is not null")
    if wanted:
        rows = rows.filter(in_ranges(F.col("page_num"), wanted))
    kinds = pages.classify(rows)
    counts = kinds.groupBy("path").agg(F.count("*").alias("pages"), F.count_if(F.col("page_type") == "native").alias("native"), F.count_if(F.col("page_type") == "scanned").alias("scanned"))
    return counts.join(translate.cost(kinds.select("path", F.col("page_text").alias("text")), "path"), "path")


def translate_to(spark: SparkSession, path: str, folder: str, target: str, model: Model = stub_model) -> DataFrame:
    """Translated files in a folder: path, output, error."""
    return written_files(translated_files(spark, path, model, target=target), folder)


def cleanup(spark: SparkSession, folder: str, now: str, *roots: str) -> DataFrame:
    """Removes unfinished jobs that nobody has touched for a day, and have a temporary folder of ours, from a job table; returns them."""
    store = JobStore(spark, folder)
    jobs_ = store.read()
    gone = staged(stale(jobs_, now, roots).filter("safe").select(*jobs_.columns), "stale-jobs")
    store.remove(gone.select(store.key))
    return gone


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("quire")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    dry = commands.add_parser("dry-run")
    dry.add_argument("path")
    dry.add_argument("--pages")
    work = commands.add_parser("translate")
    work.add_argument("path")
    work.add_argument("folder")
    work.add_argument("--target", default="de")
    old = commands.add_parser("cleanup")
    old.add_argument("folder", help="the job table's")
    old.add_argument("--now", help="by default the current time")
    fonts = commands.add_parser("download-fonts")
    fonts.add_argument("url", help="where the catalogue's files lie")
    fonts.add_argument("--folder", help="by default `fonts` in the data folder")
    chosen = parser.parse_args(args)
    if chosen.command == "version":
        print(VERSION)
    elif chosen.command == "download-fonts":
        done = fetch_missing(chosen.url, chosen.folder or Path(load().data_dir) / "fonts")
        for name, error in done.items():
            print(name, error or "fetched")
        if any(done.values()):
            raise SystemExit(1)
    elif chosen.command == "translate":
        done = translate_to(SparkSession.builder.getOrCreate(), chosen.path, chosen.folder, chosen.target)
        done.show(truncate=False)
        if done.filter("error is not null").limit(1).count():
            raise SystemExit(1)
    elif chosen.command == "cleanup":
        now = chosen.now or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        cleanup(SparkSession.builder.getOrCreate(), chosen.folder, now, "/tmp", load().data_dir).show(truncate=False)
    else:
        dry_run(SparkSession.builder.getOrCreate(), chosen.path, chosen.pages).show(truncate=False)


if __name__ == "__main__":
    main()
