"""Secret scans with corpus-wide ownership frequency, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, read, replaced, staged

#: Kind, pattern, its value's group, fewest characters of the value, whether it is a base kind.
KINDS = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
    ("vendor", r"(?:gh[pousr]_|glpat-|xox[abpr]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32, False),
    ("url", r"[a-z][a-z0-9+]*://[A-Za-z0-9._-]+:([^\s:/@]{6,})@", 1, 6, False),
)
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your|redacted|xxxx|\*\*\*\*|12345678"
#: A value of several owners is a widely copied example if this share of all owners holds it (the
#: first for values that don't look live, the second for those that do) or, where it doesn't
#: look live, this share of all texts. Shares, so that a corpus of any size is judged alike.
OWNER_SHARE, LIVE_SHARE, TEXT_SHARE = 0.25, 0.5, 0.01
REDACTED = "[secret]"
#: Code points of the blocks by which a text is cut.
BLOCK = 1024
HIT = "array<struct<kind_no:int,i:int,gap:int,hit:int,value:string>>"


def _hits(text: Column, no: int, pattern: str, group: int) -> Column:
    """All matches of one kind in order, as HIT: lengths of the text since the last one and of the match itself, and its value.

    Places are sums of these lengths, so no character is reserved.
    """
    values = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    shaped = F.transform(values, lambda p, i: F.struct(F.lit(no).alias("kind_no"), i.alias("i"), F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), p["value"].alias("value")))
    # split gives one piece more than there are matches
    return F.when(text.rlike(pattern), F.filter(shaped, lambda p: p["hit"].isNotNull())).otherwise(F.expr(f"cast(array() as {HIT})"))


def placed(hits: DataFrame) -> DataFrame:
    """(_rid, kind_no, i, gap, hit, value, ...) with start and stop, of the hits whose value is long enough.

    One running sum over a text's hits of a kind: linear in their number.
    """
    up_to = W.partitionBy("_rid", "kind_no").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = hits.withColumn("stop", F.sum(F.col("gap") + F.col("hit")).over(up_to).cast("int"))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind_no") + 1)
    return out.withColumn("start", F.col("stop") - F.col("hit")).filter(F.length("value") >= least).drop("i", "gap", "hit")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owner, repo) -> hash, repos, owners: the repositories and owners of each candidate.

    Each repository has one vote, which the owners that hold it share, and an owner counts for
    one at most. So a repository copied to many owners is one owner, and `owners` never
    exceeds the number of owners that different repositories could be given to. Repeats fall
    away in partial aggregations, so a value held by a third of all rows reaches one task only
    as one row per repository or owner and map task.
    """
    votes = spans.select("hash", "repo", F.struct("owner").alias("owner")).distinct()
    # a repository's owners are no more than there are sources
    shared = votes.groupBy("hash", "repo").agg(F.collect_set("owner").alias("held")).select("hash", (F.lit(1.0) / F.size("held")).alias("vote"), F.explode("held").alias("owner"))
    each = shared.groupBy("hash", "owner").agg(F.sum("vote").alias("votes"))
    repos = votes.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    # shares such as thirds don't add up to whole numbers in binary
    owners = each.groupBy("hash").agg(F.round(F.sum(F.least(F.col("votes"), F.lit(1.0))), 6).alias("owners"))
    return repos.join(owners, "hash")


def live_looking(value: Column) -> Column:
    """16 or more characters with a digit, a letter and 8 distinct characters, and no placeholder word."""
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~value.rlike(PLACEHOLDER)


def is_example(live: Column, owners: Column, repos: Column, everyone: Column, texts: Column) -> Column:
    """Whether a value with that many owners and repositories, of all owners and texts, is a widely copied example.

    Several owners must hold it: what one owner has in all its texts may be that owner's own.
    """
    held = owners >= F.when(live, LIVE_SHARE).otherwise(OWNER_SHARE) * everyone
    return (owners >= 2) & (held | (~live & (repos >= F.lit(TEXT_SHARE) * texts)))


def scan(docs: DataFrame, owner: str = "source", carry: Sequence[str] | None = None) -> DataFrame:
    """Adds `secrets`: array of (start, kind_no, kind, stop, class, hidden, after) by start, then kind; places in code points, stop exclusive.

    Base kinds (assign, access, hex) always stay. Other kinds stay where they look live and
    aren't examples. class: `example` (see is_example: by the value's shares of owners and
    texts), `live` (looks live, isn't an example) or `weak`. `hidden` marks what a redaction must
    hide: all but examples that read like a placeholder; `after` is where earlier hidden spans
    end. A row's repository is its text, so copies are one; its owner is the given column,
    where null counts as one of its own. Null and empty texts, and tables without rows, have no
    secrets. Rows that repeat are each reported. An input column `secrets` is replaced. `carry`
    names the columns to return (all).

    Every text is searched once: the rows are written with their hits, and only hits' lengths,
    values and row numbers are shuffled, by row. Work is linear in a text and its hits.
    """
    docs = replaced(docs, "secrets")
    names = [c for c in docs.columns if carry is None or c in carry]
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    fields_ = "start:int,kind_no:int,kind:string,stop:int,class:string,hidden:boolean,after:int"
    none = F.expr(f"cast(array() as array<struct<{fields_}>>)")
    row = F.struct(*[F.col(f"`{c}`") for c in names], F.lit(True).alias("_read"))
    hits = F.concat(*[_hits(text, no, pattern, group) for no, (_, pattern, group, _, _) in enumerate(KINDS)])
    # written before the hashes are taken, so that hits are looked for once
    held = staged(docs.select(row.alias("_row"), hits.alias("_hits"), column(docs, owner, "string").alias("_owner"), F.xxhash64(text).alias("_text"), F.xxhash64(F.lit(1), text).alias("_again"), F.monotonically_increasing_id().alias("_rid")), "secret-rows")
    some = F.size("_hits") > 0
    kind_of = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in KINDS]), F.col("kind_no") + 1)
    flat = placed(held.filter(some).select("_rid", F.struct("_text", "_again").alias("repo"), F.col("_owner").alias("owner"), F.inline("_hits")))
    flat = staged(flat.select("_rid", F.sha2("value", 256).alias("hash"), "owner", "repo", live_looking(F.col("value")).alias("live"), F.col("value").rlike(PLACEHOLDER).alias("says"), "start", "kind_no", kind_of(0).alias("kind"), "stop", kind_of(4).alias("base")), "secret-candidates")
    everyone = held.select(F.struct("_owner").alias("o")).distinct().count()
    texts = held.select("_text", "_again").distinct().count()
    counts = ownership(flat).filter(F.col("owners") >= 2).select("hash", "owners", "repos")
    example = F.col("owners").isNotNull() & is_example(F.col("live"), F.col("owners"), F.col("repos"), F.lit(everyone), F.lit(texts))
    kind = F.when(example, "example").when(F.col("live"), "live").otherwise("weak")
    judged = flat.join(counts, "hash", "left").withColumn("class", kind).filter(F.col("base") | (F.col("class") == "live"))
    judged = judged.withColumn("hidden", ~((F.col("class") == "example") & F.col("says")))
    before = W.partitionBy("_rid").orderBy("start", "kind_no").rowsBetween(W.unboundedPreceding, -1)
    judged = judged.withColumn("after", F.coalesce(F.max(F.when(F.col("hidden"), F.col("stop"))).over(before), F.lit(0)))
    by_row = judged.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "stop", "class", "hidden", "after"))).alias("_kept"))
    fields = [F.col(f"_row.`{c}`").alias(c) for c in names]
    plain = held.filter(~some).select(*fields, none.alias("secrets"))
    hit = held.filter(some).select("_rid", "_row").join(by_row, "_rid", "left").select(*fields, F.coalesce(F.col("_kept"), none).alias("secrets"))
    return plain.unionByName(hit)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping hidden spans (of scan's `secrets`) replaced by a marker.

    The text is parted into blocks once, and every cut reads its block alone, so work is linear
    in the text and its spans.
    """
    whole = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def result(x: Column) -> Column:
        blocks, shown = x["blocks"], x["hidden"]

        def head(at: Column) -> Column:
            return F.coalesce(F.substring(F.get(blocks, F.floor(at / BLOCK).cast("int")), F.lit(1), (at % BLOCK).cast("int")), F.lit(""))

        def tail(at: Column) -> Column:
            return F.coalesce(F.substring(F.get(blocks, F.floor(at / BLOCK).cast("int")), (at % BLOCK + 1).cast("int"), F.lit(BLOCK)), F.lit(""))

        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
            inside = F.substring(F.get(blocks, first), (a % BLOCK + 1).cast("int"), (b - a).cast("int"))
            return F.when(first == last, F.coalesce(inside, F.lit(""))).otherwise(F.concat(tail(a), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), head(b)))

        runs = F.filter(shown, lambda s: s["start"] >= s["after"])
        end = F.get(shown, F.size(shown) - 1)
        last = F.greatest(end["stop"], end["after"])
        pieces = F.transform(runs, lambda s: F.concat(between(s["after"], s["start"]), F.lit(REDACTED)))
        return F.concat(F.array_join(pieces, ""), between(last, F.length(text)))

    # transform over a one-element array binds blocks and spans once
    bound = F.struct(whole.alias("blocks"), F.filter(spans, lambda s: s["hidden"]).alias("hidden"))
    return F.when(F.exists(spans, lambda s: s["hidden"]), F.element_at(F.transform(F.array(bound), result), 1)).otherwise(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of each whole text of `documents`; null and empty texts have none, repeated rows are each listed."""
    found = scan(read(spark, sf_dir, "documents"), carry=["doc_id"])
    s = F.col("secrets")
    count = lambda field, value: F.size(F.filter(s, lambda x: x[field] == value)).cast("long")
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.filter(s, lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"),
        listed(s).alias("spans"),
        count("class", "example").alias("n_example"),
        count("class", "live").alias("n_live"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: DuckDB's common table expressions over a table d (rid, doc_id, source, text, repo), up to `kept`: a row per secret kept.
CTES_SQL = (
    "hits as ("
    + " union all ".join(
        f"select rid, doc_id, source, repo, {no} as kind_no, '{k}' as kind, {str(base).lower()} as base, {least} as least, string_split_regex(text, p) as gaps, regexp_extract_all(text, p) as m, regexp_extract_all(text, p, {group}) as v from d, (select {_quoted(pattern.replace('((?i)', '((?i:').replace('api_?key)', 'api_?key))'))} as p) where regexp_matches(text, p)"
        for no, (k, pattern, group, least, base) in enumerate(KINDS)
    )
    + r"""),
nth as (select *, generate_subscripts(m, 1) as i from hits),
piece as (select rid, doc_id, source, repo, kind_no, kind, base, least, i, length(gaps[i]) as gap, length(m[i]) as hit, v[i] as value from nth),
placed as (select *, (sum(gap + hit) over (partition by rid, kind_no order by i))::bigint as stop from piece),
flat as (select *, stop - hit as start, sha256(value) as hash,
    length(value) >= 16 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= 8
    and not regexp_matches(value, """
    + _quoted(PLACEHOLDER)
    + r""") as live from placed where length(value) >= least),
votes as (select distinct hash, repo, coalesce(source, chr(0)) as owner from flat),
texts as (select count(distinct repo) as t from d),
each as (select hash, owner, sum(vote) as votes from (select *, 1.0::double / count(*) over (partition by hash, repo) as vote from votes) group by all),
spread as (select hash, round(sum(least(votes, 1.0::double)), 6) as owners from each group by hash),
owned as (select hash, owners, repos from spread join (select hash, count(distinct repo) as repos from votes group by hash) using (hash)),
everyone as (select count(distinct coalesce(source, chr(0))) as n from d),
classed as (select flat.*, owners >= 2 and (owners >= (case when live then {live} else {owner} end)::double * n or (not live and repos >= {text}::double * t)) as example from flat join owned using (hash), everyone, texts),
kept as (select *, case when example then 'example' when live then 'live' else 'weak' end as class, not (example and regexp_matches(value, {says})) as hidden from classed where base or (live and not example))
""".replace("{live}", str(LIVE_SHARE)).replace("{owner}", str(OWNER_SHARE)).replace("{text}", str(TEXT_SHARE)).replace("{says}", _quoted(PLACEHOLDER))
)
SQL = (
    "with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, sha256(coalesce(text, '')) as repo from documents), "
    + CTES_SQL
    + """, g as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) filter (base) as b,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) as s,
    count(*) filter (class = 'example') as n_example, count(*) filter (class = 'live') as n_live from kept group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256,
  coalesce(s, '') as spans, coalesce(n_example, 0) as n_example, coalesce(n_live, 0) as n_live
from d left join g using (rid)"""
)
