"""Sharding by histogram sort, with built-in functions only."""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, dropped, read, replaced, shared_path, staged

SHARDS = 24
#: How far a splitter may stand from its target: between shards in parts of a shard's bytes,
#: between the partitions that make up a shard in parts of a partition's.
TOLERANCE, INNER_TOLERANCE = 0.005, 0.25
#: Partitions of the exchange at most, unless there are more shards; larger ones spill while they are sorted.
MAX_PARTS = 1024
#: Bits of the key's three parts (the text's hash, doc_id's and source's, the row's own number)
#: and bits that each round of probes adds.
WIDTHS, BITS = (60, 24, 12), 12
#: Cells that are probed in one pass: the driver sees at most this many times 2**BITS sums at once.
OPEN_CELLS = 64
#: Cells by which a row finds its partition.
CELLS = 1 << BITS

Key = tuple[int, int, int]


def _keys(docs: DataFrame) -> dict[str, Column]:
    """The key's parts and the size. The last part only parts rows that are equal in text, doc_id and source."""
    text = column(docs, "text", "string")
    return {
        "_k1": F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << WIDTHS[0]) - 1)),
        "_k2": F.xxhash64(column(docs, "doc_id", "string"), column(docs, "source", "string")).bitwiseAND(F.lit((1 << WIDTHS[1]) - 1)),
        "_k3": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << WIDTHS[2]) - 1)),
        "_size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8,
    }


def splitters(keys: DataFrame, targets: list[tuple[float, float]]) -> list[Key]:
    """Boundaries (k1, k2, k3), one for each of the ascending targets (bytes below it, and how far it may miss them).

    Each round probes 2**BITS evenly spaced boundaries inside every cell that still holds a
    wanted splitter, and counts the bytes below each over all partitions. A splitter settles at
    a probe that is near enough; else its cell is probed in turn, down to single keys. A round
    that has more than OPEN_CELLS cells open takes several passes, so what the driver sees at
    once is bounded, whatever the table's size or the number of targets.
    """
    total = sum(WIDTHS)
    found: dict[int, int] = {}
    # for each open splitter: bytes below its cell and the cell's first key, as one number of all three parts
    open_ = {i: (0, 0) for i in range(len(targets))}
    done = 0
    while open_ and done < total:
        # a round stays inside one part of the key
        part, before = next((p, sum(WIDTHS[:p])) for p in range(3) if done < sum(WIDTHS[: p + 1]))
        shift = WIDTHS[part] - (done - before) - BITS
        rest = total - done - BITS
        cells = sorted({c for _, c in open_.values()})
        again = {}
        for start in range(0, len(cells), OPEN_CELLS):
            some = cells[start : start + OPEN_CELLS]
            parents = _held(part, shift + BITS, some, rest + BITS)
            sums = keys.filter(parents).groupBy(*[F.col(k) for k in ("k1", "k2")[:part]], F.shiftright(("k1", "k2", "k3")[part], shift).alias("probe")).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
            grid = sorted((sum(r[k] << (total - sum(WIDTHS[: j + 1])) for j, k in enumerate(("k1", "k2")[:part])) + (r["probe"] << rest), r["n"], r["rows"]) for r in sums)
            firsts = [g[0] for g in grid]
            for i, (at, cell) in ((i, x) for i, x in open_.items() if some[0] <= x[1] <= some[-1]):
                want, slack = targets[i]
                lo, hi = bisect.bisect_left(firsts, cell), bisect.bisect_left(firsts, cell + (1 << (rest + BITS)))
                for j in range(lo, hi):
                    first, n, rows = grid[j]
                    if at + n >= want or j == hi - 1:
                        below, above = want - at, at + n - want
                        if min(abs(below), abs(above)) <= slack or rows == 1 or rest == 0:
                            found[i] = first if abs(below) <= abs(above) else first + (1 << rest)
                        else:
                            again[i] = (at, first)
                        break
                    at += n
                else:
                    found[i] = cell
        open_, done = again, done + BITS
    out = [found[i] for i in range(len(targets))]
    parts = lambda x: (x >> 36, (x >> 12) & ((1 << 24) - 1), x & ((1 << 12) - 1))
    return [parts(x) for x in out]


def _held(part: int, shift: int, cells: list[int], rest: int) -> Column:
    """Rows that lie in one of the cells (first keys as one number; a cell spans 2**rest keys)."""
    if not cells or rest >= sum(WIDTHS):
        return F.lit(True)
    names, starts = ("k1", "k2", "k3"), (36, 12, 0)
    values = [[(c >> starts[j]) & ((1 << WIDTHS[j]) - 1) for j in range(part)] + [((c >> starts[part]) & ((1 << WIDTHS[part]) - 1)) >> shift] for c in cells]
    key = F.concat_ws(":", *[F.col(n).cast("string") for n in names[:part]], F.shiftright(names[part], shift).cast("string"))
    if part == 0:
        return F.shiftright("k1", shift).isin([v[0] for v in values])
    return F.col("k1").isin(sorted({v[0] for v in values})) & key.isin([":".join(map(str, v)) for v in values])


def _number(bounds: list[Key], k1: Column, k2: Column, k3: Column) -> Column:
    """How many boundaries are at or below a key: its cell knows those of all cells before, so only its own are compared."""
    width = WIDTHS[0] - BITS
    cells: list[list[Key]] = [[] for _ in range(CELLS)]
    for b in bounds:
        cells[min(b[0] >> width, CELLS - 1)].append(b)
    before, rows = 0, []
    for c in cells:
        rows.append({"n": before, "b": [{"x": b[0], "y": b[1], "z": b[2]} for b in c]})
        before += len(c)
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<n:int,b:array<struct<x:bigint,y:bigint,z:bigint>>>>")
    own = F.get(table, F.shiftright(k1, width).cast("int"))
    key = F.struct(k1.alias("x"), k2.alias("y"), k3.alias("z"))
    return own["n"] + F.size(F.filter(own["b"], lambda b: b <= key))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, path: str | None = None) -> DataFrame:
    """Writes documents as sorted shards of near equal bytes; returns the written rows with size, shard and slot.

    The key is a hash of the text, then one of doc_id and source, so rows with equal texts lie
    side by side; rows equal in all three are told apart by their number in the input. A
    splitter stands between two texts wherever such a place lies within tolerance; a text with
    so many copies that none does is split among shards. Size: UTF-8 bytes plus 8, null 8. Slots
    number a shard's rows from 0 in key order, gapless.

    Each shard is made of several partitions, whose bounds are splitters too but may miss their
    targets by more; so a hot text inside a shard is parted as well. The rows are exchanged
    once, straight to the partition that the splitters name, sorted there and written to `path`
    (else to the shared folder); slots follow from each file's count of rows, so no task needs a
    whole shard. Empty tables give none. Input columns named like an added one are replaced.

    The input is read twice, for its keys and for the exchange. Numbers of equal rows may differ
    between the two where the input isn't a table of files; then such rows part at another place
    among their copies, and shards' bytes are less even, but every row is still in one slot.
    """
    spark = docs.sparkSession
    docs = replaced(docs, "size", "shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), *[c.alias(n) for n, c in _keys(docs).items()])
    keys = staged(keyed.select(*[F.col(f"_{k}").alias(k) for k in ("k1", "k2", "k3", "size")]), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    fan = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTS) // shards)
    parts = shards * fan
    bounds = splitters(keys, [(total * i / parts, total / shards * tolerance if i % fan == 0 else total / parts * INNER_TOLERANCE) for i in range(1, parts)]) if total else []
    dropped(keys)
    # inner splitters may overshoot a shard's own
    for i in range(1, len(bounds)):
        bounds[i] = max(bounds[i], bounds[i - 1])
    part = _number(bounds, F.col("_k1"), F.col("_k2"), F.col("_k3"))
    sorted_ = keyed.withColumn("_to", part).repartitionById(parts, "_to").sortWithinPartitions("_k1", "_k2", "_k3")
    out = sorted_.select("_row", "_size", F.floor(F.col("_to") / fan).cast("int").alias("_shard"), F.monotonically_increasing_id().alias("_at"))
    path = path or shared_path(spark, "shards")
    out.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(out.schema).parquet(path).withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = rows.groupBy("_part", "_shard").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.withColumn("_before", before).drop("_n")
    # a row for each partition: at most MAX_PARTS or the number of shards
    placed = rows.join(F.broadcast(starts), ["_part", "_shard"])
    return placed.select("_row.*", F.col("_size").alias("size"), F.col("_shard").alias("shard"), (F.col("_before") + F.col("_at") - F.col("_first")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law `bytes` over whole `documents`; null texts have size 8, rows without a doc_id are placed like others."""
    rows = shard(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
