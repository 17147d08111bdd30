"""Object graphs of files as edge tables: what roots reach, and dense new numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import dropped, merged, staged

NODE = ["file", "object"]
#: Objects of a file numbered at once; a larger file is numbered in such parts.
PART = 65_536


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, object) of all objects that a file's roots reach over (file, object, ref), themselves included.

    Objects with a single reference form chains. Pointer doubling makes tables of jumps over 1,
    2, 4, ... of them, and with these the end of each chain: what is left of the graph are the
    branchings, joined by the ends of the chains that leave them. They are searched a step at a
    time from the roots; then the jumps, in order of size, mark all that lies on the chains
    entered. So a chain of n costs log n joins and only branchings on a path cost a round each.
    Cycles end as nothing new is found. References to objects that the file lacks are reached
    all the same; nulls are no references.
    """
    edges = staged(edges.select("file", "object", "ref").dropna().distinct(), "references")
    degrees = edges.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("ref").alias("ref"))
    single = staged(degrees.filter("n = 1").select(*NODE, "ref"), "jumps")
    jumps, ends = [single], single
    longest = single.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    while 1 << (len(jumps) - 1) < longest:
        one, far = jumps[-1], jumps[-1].select("file", F.col("object").alias("ref"), F.col("ref").alias("far"))
        jumps.append(staged(one.join(merged(far), ["file", "ref"]).select(*NODE, F.col("far").alias("ref")), "jumps"))
        # an end is the end of its own end's chain, twice as far each time
        beyond = ends.select("file", F.col("object").alias("ref"), F.col("ref").alias("far"))
        ends = staged(ends.join(merged(beyond), ["file", "ref"], "left").select(*NODE, F.coalesce("far", "ref").alias("ref")), "chain-ends")
        if jumps[-1].isEmpty():
            jumps.pop()
            break
    last = merged(ends.select("file", F.col("object").alias("_o"), F.col("ref").alias("_end")))
    ended = lambda df: df.join(last, (df["file"] == last["file"]) & (df["ref"] == last["_o"]), "left").select(df["file"], *[df[c] for c in df.columns if c not in ("file", "ref")], df["ref"], F.coalesce("_end", "ref").alias("end"))
    forks = staged(ended(edges.join(merged(degrees.filter("n > 1").select(*NODE)), NODE, "left_semi")), "forks")
    start = staged(ended(roots.select("file", F.col("object").alias("ref")).dropna().distinct()), "entries")
    newest = staged(start.select("file", F.col("end").alias("object")).distinct(), "reached")
    held = [newest]
    found = newest
    while not newest.isEmpty():
        step = newest.join(merged(forks), NODE).select("file", F.col("end").alias("object")).distinct()
        newest = staged(step.join(merged(found), NODE, "left_anti"), "reached")
        held.append(newest)
        found = found.unionByName(newest)
    entered = found.join(merged(forks), NODE).select("file", F.col("ref").alias("object"))
    marked = staged(start.select("file", F.col("ref").alias("object")).unionByName(entered).distinct(), "marked")
    for jump in jumps:
        more = staged(marked.unionByName(marked.join(merged(jump), NODE).select("file", F.col("ref").alias("object"))).distinct(), "marked")
        dropped(marked)
        marked = more
    dropped(edges, *jumps, *held, forks, start)
    return marked


def renumbered(reached: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, object, number) with numbers from 1 in order of objects, gapless in each file, and (file, number, ref) by new numbers.

    Objects are numbered within parts of a file, and the parts' counts are summed in order, so
    no task needs a whole file. References from or to objects that weren't reached go.
    """
    parted = reached.select(*NODE).distinct().withColumn("_part", F.floor(F.col("object") / PART))
    counts = parted.groupBy("file", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("file", "_part").orderBy("object"))
    numbers = parted.withColumn("_own", own).join(merged(counts.withColumn("_before", before).drop("_n")), ["file", "_part"])
    numbers = staged(numbers.select(*NODE, (F.col("_own") + F.col("_before")).alias("number")), "numbers")
    targets = numbers.select("file", F.col("object").alias("ref"), F.col("number").alias("to"))
    moved = edges.select(*NODE, "ref").distinct().join(merged(numbers), NODE).join(merged(targets), ["file", "ref"])
    return numbers, moved.select("file", "number", F.col("to").alias("ref"))
