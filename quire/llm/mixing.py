"""Mixing sources to target weights by capped water-filling, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import ALL, column, dropped, n_words, read, replaced, staged, words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 7
#: Bits of a row's key, and bits by which its boundary is narrowed at once.
KEY_BITS, LEVEL = 60, 12
#: Plans (a row a source, counted as PLAN_BYTES) up to this many bytes are broadcast; beyond, rows are shuffled to them.
BROADCAST_BYTES, PLAN_BYTES = 32 << 20, 256


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target), one row per source.

    Sources by code point, null last, get the weights in turn. The budget is `share` of all
    sizes. A source whose part exceeds max_epochs of its size is clamped there and what it
    leaves goes to the others by weight, until none exceeds. That fixed point has one level:
    with sources sorted by cap / weight, it is the first level that the source it starts at
    can hold; sources before that one are clamped. Reached in one ordered sweep over a table of
    a row per source. Empty tables give no rows; sources of size 0 have target 0.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_i", F.row_number().over(every) - 1).withColumn("weight", F.element_at(cycle, (F.col("_i") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
    whole = W.partitionBy()
    before = W.orderBy("_fill", "_i").rowsBetween(W.unboundedPreceding, -1)
    swept = (
        ranked.withColumn("_fill", F.col("_cap") / F.col("weight"))
        .withColumn("_rest", F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.col("_open"))
        .withColumn("_at", F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_i", "_level")))
    )
    level = F.min("_at").over(whole)
    free = F.struct("_fill", "_i", "_level") >= level
    target = F.when(level.isNull() | ~free, F.col("_cap")).otherwise(F.least(F.col("_cap"), level["_level"] * F.col("weight")))
    return swept.select("source", "source_size", "weight", target.alias("target"))


def boundaries(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, key, size) rows and their targets -> targets with whole, at, rest and same, a row per source.

    Every text of a source is used `whole` times; the rest of the target is met in the order of
    the keys: texts with keys below `at` are used once more, those at it share `rest` words, and
    `same` counts them. The boundary is narrowed by sums over ranges of keys, LEVEL bits at a
    time, then over the keys of one range, so no window sees more than 2**LEVEL ranges of a
    source or the keys of one last range. Equal keys only meet in partial sums.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumn("at", F.lit(0).cast("long"))
    plan = staged(plan, "mix-plan")
    for shift in (KEY_BITS - LEVEL, KEY_BITS - 2 * LEVEL, 0):
        inside = plan.filter("rest > 0").select(F.col("source").alias("_s"), F.col("at").alias("_a"), F.col("rest").alias("_rest"))
        up = LEVEL if shift else KEY_BITS - 2 * LEVEL
        cell = F.shiftright("key", shift)
        some = rows.join(inside, rows["source"].eqNullSafe(inside["_s"]) & (F.shiftright("key", shift + up) == F.col("_a") if shift + up < KEY_BITS else F.lit(True)))
        sums = some.groupBy("source", "_rest", cell.alias("_cell")).agg(F.sum("size").alias("_n"), F.count("*").alias("_same")).filter("_n > 0")
        before = F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("_before", before).filter("_before < _rest and _before + _n >= _rest")
        found = found.select(F.col("source").alias("_s"), F.col("_cell"), F.col("_before"), F.col("_same"))
        joined = plan.join(found, plan["source"].eqNullSafe(found["_s"]), "left")
        narrowed = joined.select("source", "source_size", "target", "whole", F.coalesce("_cell", F.lit(0)).alias("at"), (F.col("rest") - F.coalesce("_before", F.lit(0))).alias("rest"), F.coalesce("_same", F.lit(0)).alias("same"))
        after = staged(narrowed, "mix-plan")
        dropped(plan)
        plan = after
    return plan


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with `_id`, their place among all that share `_source` and `_key` as `_nth`, from 0.

    Partitions count theirs, and only those counts are summed in order, so equal rows, however
    many, are numbered where they lie.
    """
    part = F.shiftrightunsigned("_id", 33)
    counts = rows.withColumn("_part", part).groupBy("_source", "_key", "_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("_source", "_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_source").alias("_s2"), F.col("_key").alias("_k2"), F.col("_part").alias("_p2"), before.alias("_before"))
    own = rows.withColumn("_part", part).withColumn("_own", F.row_number().over(W.partitionBy("_source", "_key", "_part").orderBy("_id")) - 1)
    joined = own.join(starts, own["_source"].eqNullSafe(starts["_s2"]) & (own["_key"] == starts["_k2"]) & (own["_part"] == starts["_p2"]))
    return joined.withColumn("_nth", F.col("_own") + F.col("_before")).drop("_part", "_own", "_s2", "_k2", "_p2", "_before")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: Sequence[str] | None = None) -> DataFrame:
    """Adds size, source_size, target and taken (words to use, repeats counted) to documents.

    A source at e = target / source_size epochs uses each text floor(e) times. The rest of the
    target is met by texts in the order of a seeded hash of doc_id and text, once more each, the
    last one cut; so a source's taken words are its target, rounded down, whatever its ids. No
    global sort is needed, and a hot source only meets in sums (see boundaries). Rows equal in
    doc_id and text are told apart by their numbers and so share a rest among them; which of
    them gets it makes no difference. Null or empty text: size 0, taken 0. Null source: a source
    of its own, last; a null doc_id is hashed as empty. Empty tables give no rows. Input columns
    named like an added one are replaced. `carry` names the columns to return (all).
    """
    docs = replaced(docs, "size", "source_size", "target", "taken")
    names = [c for c in docs.columns if carry is None or c in carry]
    text = column(docs, "text", "string")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(docs, "doc_id", "string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    row = F.struct(*[F.col(f"`{c}`") for c in names], F.lit(True).alias("_read"))
    key = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    sized = docs.select(row.alias("_row"), column(docs, "source", "string").alias("_source"), key.alias("_key"), n_words(text).alias("_size"))
    rows = staged(sized.select(F.col("_source").alias("source"), F.col("_key").alias("key"), F.col("_size").alias("size")), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    plan = boundaries(rows, targets)
    dropped(rows)
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "at", "rest", "same")
    # a row a source
    plan = F.broadcast(plan) if plan.count() * PLAN_BYTES <= BROADCAST_BYTES else plan
    key, size, rest = F.col("_key"), F.col("_size"), F.col("rest")
    shared = (rest > 0) & (key == F.col("at")) & (F.col("same") > 1)
    if plan.filter("rest > 0 and same > 1").limit(1).count():
        held = staged(sized.withColumn("_id", F.monotonically_increasing_id()), "mix-rows")
        out = held.join(plan, held["_source"].eqNullSafe(plan["_s"]))
        alike = _numbered(out.filter(shared))
        out = out.filter(~shared).withColumn("_nth", F.lit(0).cast("long")).unionByName(alike)
    else:
        out = sized.join(plan, sized["_source"].eqNullSafe(plan["_s"])).withColumn("_nth", F.lit(0).cast("long"))
    part = F.greatest(F.lit(0), F.least(size, rest - F.col("_nth") * size))
    more = F.when((rest <= 0) | (key > F.col("at")), F.lit(0)).when(key < F.col("at"), size).otherwise(part).cast("long")
    fields = [F.col(f"_row.`{c}`").alias(c) for c in names]
    return out.select(*fields, size.alias("size"), "source_size", "target", (F.col("whole") * size + more).alias("taken"))


def repeated(mixed: DataFrame, names: Sequence[str]) -> DataFrame:
    """mix()'s rows as the mixture itself: each text as often as it is used, a last part cut after that many words."""
    size, taken = F.col("size"), F.col("taken")
    copies = F.expr("transform(sequence(0, cast((taken - 1) div size as int)), i -> least(size, taken - i * size))")
    rows = mixed.filter((size > 0) & (taken > 0)).withColumn("_use", F.explode(copies))
    cut: Column = F.when(F.col("_use") >= size, F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), 1, F.least(F.col("_use"), F.lit(ALL)).cast("int")), " "))
    rows = rows.withColumn("text", cut)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of whole `documents`; null and empty texts have size 0, a null source is one of its own, repeated rows are alike."""
    return mix(read(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as key, row_number() over () as rid
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as i from s),
w as (select *, [3.0::double, 1.0::double, 2.0::double][(i % 3 + 1)::int] as weight, 2.0::double * source_size as cap from r),
f as (select *, cap / weight as fill from w),
l as (select *,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by fill, i rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by fill, i rows between unbounded preceding and 1 preceding), 0)) as level
  from f),
k as (select fill as k_fill, i as k_i, level as k_level from l where level <= fill order by fill, i limit 1),
t as (select source, source_size,
    case when k_i is null or fill < k_fill or (fill = k_fill and i < k_i) then cap else least(cap, k_level * weight) end as target
  from l left join k on true),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
q as (select d.*, source_size, target, whole, floor(target - whole * source_size)::bigint - coalesce(sum(size) over (partition by d.source order by key, rid rows between unbounded preceding and 1 preceding), 0)::bigint as rest
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest)))::bigint as taken from q
"""
