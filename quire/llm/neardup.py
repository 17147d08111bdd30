"""MinHash near-duplicate groups by tensored banding, with verification on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, dropped, read, shipped, staged

SHINGLE = 5
#: Links: 100 * intersection >= LINK * union. The contract of op9 is 85, the pipeline's default 80.
LINK = 85
#: Two collections of COLLECTIONS hashes, each of ROWS minhashes, make COLLECTIONS**2 tables.
COLLECTIONS = 9
ROWS = 3
#: Rows of keys (each counted as KEY_BYTES) up to this many bytes are broadcast; beyond, texts are shuffled to them.
BROADCAST_BYTES = 32 << 20
KEY_BYTES = 64

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of `width` words, A-Z lower-cased.

    Fewer words make one shingle of them all; no words, an empty set. bytes.split() parts at
    exactly the six ASCII blanks.
    """
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(width, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mixed(total ^ (h[i : i + n] * MULTIPLIERS[i % len(MULTIPLIERS)]))
    return np.unique(total)


def seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(s: np.ndarray, collections: int = COLLECTIONS, rows: int = ROWS) -> np.ndarray:
    """2 * collections hashes, each of `rows` minhashes of a set. Only 2 * collections * rows minhashes are computed."""
    n = 2 * collections * rows
    low = np.empty(n, np.uint64)
    for i, m in enumerate(seeds(n)):
        x = s * m
        low[i] = (x ^ (x >> np.uint64(29))).min()
    out = np.zeros(2 * collections, np.uint64)
    for r in range(rows):
        out = mixed(out * MULTIPLIERS[1] ^ low[r :: rows])
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (a text's hashes, which tell rows of one doc_id apart), text as bytes."""
    text = column(docs, "text", "string")
    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.cast("binary").alias("text"))


def sketched(docs: DataFrame, collections: int, rows: int, width: int = SHINGLE) -> DataFrame:
    """doc_id, h1, h2, n (size of the set), print (128 bits that tell sets apart), sig (the sketch; null for empty sets)."""
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, sigs = [], [], []
            for x in b.column(3):
                s = shingles(x.as_py(), width)
                n.append(len(s))
                prints.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sigs.append(sketch(s, collections, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "n", "print", "sig"])

    return keyed(docs).mapInArrow(work, "doc_id long, h1 long, h2 long, n long, print binary, sig array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that each node of an edge reaches, for all but that one itself.

    Alternating large-star and small-star rounds over edges only, each written and compared by
    a count and a sum of hashes. Minima are taken by partial aggregation, so a node with very
    many edges costs one row per map task.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        large = staged(large.unionByName(now.join(low, "a").select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "large-star")
        dropped(now)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = staged(small.filter("a > b").distinct(), "small-star")
        dropped(large)
        state_now = state(now)
        if state_now == seen:
            break
        seen = state_now
    # at the fixed point every node points at its component's smallest
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def verified(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """(a, b) -> (a, b, inter, total) with the exact sizes of intersection and union of their sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inter, total = [], []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum())
                inter.append(both)
                total.append(len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inter, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "inter", "total"])

    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(work, "a long, b long, inter long, total long")


def texts_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, doc_id, h1, h2, again) -> (node, set): the sets of the rows named. Written.

    `again` marks rows that may occur several times; of those one is kept.
    """
    ids = wanted.select("node", "again", F.col("doc_id").alias("_d"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    ids = F.broadcast(ids) if wanted.count() * KEY_BYTES <= BROADCAST_BYTES else ids
    rows = keyed(docs)
    rows = rows.join(ids, rows["doc_id"].eqNullSafe(ids["_d"]) & (rows["h1"] == ids["_h1"]) & (rows["h2"] == ids["_h2"])).select("node", "again", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array([shingles(x.as_py(), width).tobytes() for x in some.column(2)], pa.binary())], ["node", "again", "set"])

    found = staged(rows.mapInArrow(full, "node long, again boolean, set binary"), "sets")
    if not found.filter("again").limit(1).count():
        return found
    one = found.filter("again").groupBy("node").agg(F.first("again").alias("again"), F.first("set").alias("set"))
    out = staged(found.filter("not again").unionByName(one), "sets")
    dropped(found)
    return out


def grouped(docs: DataFrame, link: int, width: int, collections: int, rows: int, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of the rows (see sketched), (print, best) with the first row of each set's group, and the doc_ids of several rows.

    `best` and the order of rows: doc_id, nulls last, then the text's hashes. With by_id rows of
    one doc_id belong together, and rows without one take no part.

    1. Each text becomes a set of shingles; rows of equal sets form a class, a node, so copies
       cost one row from there on.
    2. A class's sketch has two collections of hashes; each pair of one from either names a
       table, in which the two together are the key. Classes that share a key are candidates.
    3. In each bucket every class is compared with the smallest, on whole sets; links are
       joined into components.
    4. Buckets that still hold several components are searched again for every pair of
       different components, except pairs that their sizes or their prefixes (see prefixes)
       prove unlinked. So every candidate pair is linked, verified, or proven apart; none is
       capped.

    Two sets of similarity s share a table with probability (1 - (1 - s^rows)^collections)^2,
    over 0.999 at the threshold.
    """
    shipped(docs.sparkSession)
    prints = staged(sketched(docs, collections, rows, width), "sketches")
    repeated = staged(prints.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    usable = prints.filter("print is not null" + (" and doc_id is not null" if by_id else ""))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    named = usable.groupBy("print").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = staged(named.withColumn("node", F.monotonically_increasing_id()), "classes")

    m = collections
    keys = F.expr(f"transform(sequence(0, {m * m - 1}), t -> xxhash64(t, sig[cast(t div {m} as int)], sig[cast({m} + t % {m} as int)]))")
    # heads are the classes of the smallest doc_id: of a text and its edited copies mostly the text, from which none is far
    doc = F.coalesce("first.doc_id", F.lit((1 << 63) - 1))
    rows_ = classes.select("node", "n", doc.alias("doc"), F.explode(keys).alias("key"))
    # written, so that the join below has plain inputs and hot keys can be dealt anew
    heads = staged(rows_.groupBy("key").agg(F.min(F.struct("doc", "node", "n")).alias("h"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("h.node").alias("head"), F.col("h.n").alias("head_n")), "heads")
    shared = staged(rows_.drop("doc").join(heads, "key"), "buckets")
    fits = "100 * least({0}, {1}) >= {2} * greatest({0}, {1})"
    stars = staged(shared.filter("node <> head").filter(fits.format("n", "head_n", link)).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    several = F.broadcast(repeated) if repeated.count() * KEY_BYTES <= BROADCAST_BYTES else repeated
    searched = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "first.doc_id", "first.h1", "first.h2")
    wanted = staged(searched.join(several, F.col("doc_id").eqNullSafe(F.col("_again")), "left").select("node", "doc_id", "h1", "h2", (F.col("_again").isNotNull() | F.col("doc_id").isNull()).alias("again")), "nodes")
    sets = texts_of(docs, wanted, width)
    judged = staged(verified(stars, sets, link), "verified")
    links = judged.filter(f"100 * inter >= {link} * total").select("a", "b")
    if by_id:
        same = staged(usable.join(several, usable["doc_id"] == several["_again"], "left_semi").select("doc_id", "print").distinct().join(classes.select("print", "node"), "print").select("doc_id", "node"), "same-ids")
        links = links.unionByName(same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"))
    joined = staged(components(links), "components")

    more = residual(shared, sets, judged, joined, link)
    if more.limit(1).count():
        again = verified(more, sets, link).filter(f"100 * inter >= {link} * total").select("a", "b")
        joined = staged(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(again)), "components")
    roots = joined.select(F.col("component").alias("node"), "component").distinct()
    members = joined.unionByName(roots).join(classes.select("node", "first"), "node")
    best = members.join(members.groupBy("component").agg(F.min("first").alias("best")), "component").select("node", "best")
    labels = staged(classes.select("print", "node", "first").join(best, "node", "left").select("print", F.coalesce("best", "first").alias("best")), "labels")
    dropped(heads, shared, stars, wanted, sets, judged, more, joined, classes)
    return prints, labels, repeated


def near_duplicates(docs: DataFrame, link: int = LINK, width: int = SHINGLE, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id it is linked to, itself included), kept.

    See grouped() for the method. Empty and null texts have no set: they stand alone. Rows that
    repeat a doc_id count as one document, whatever their texts: what either is linked to, both
    are, and all have one component_id (a row without a set has that of its doc_id's others). A
    null doc_id takes no part: component_id null, kept true. Columns other than doc_id and text
    are not read.
    """
    prints, labels, repeated = grouped(docs, link, width, collections, rows, True)
    has = F.col("print").isNotNull() & F.col("doc_id").isNotNull()
    full = prints.filter(has).join(labels, "print").select("doc_id", "n", F.col("best.doc_id").alias("component_id"))
    others = prints.filter(has).join(repeated, F.col("doc_id") == F.col("_again"), "left_semi").join(labels, "print").groupBy("doc_id").agg(F.min("best.doc_id").alias("component_id"))
    bare = prints.filter(~has).select("doc_id", "n").join(others, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = full.unionByName(bare).withColumnRenamed("n", "n_shingles")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def prefixes(nodes: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """(node, n, component) -> node, n, component, shingle, left: the part of each set by which it can still be linked.

    Shingles are ordered by how many of these sets hold them, rarest first. Of two linked sets
    each must hold a shingle among the other's first n - ceil(t * n) + 1 (t the threshold). A
    shingle that one set holds alone links nothing, so only shared ones are kept, and sets
    whose own shingles fill that prefix drop out: edited copies of one text with too many edits.
    `left` counts the shared shingles from this one on; where two prefixes first meet, no more
    than the lesser of both counts can be common to the two sets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [np.frombuffer(x.as_py(), np.int64) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets_, pa.list_(pa.int64()))], ["node", "n", "component", "found"])

    held = nodes.join(sets, "node").select("node", "n", "component", "set").mapInArrow(work, "node long, n long, component long, found array<long>")
    each = staged(held, "open-sets").select("node", "n", "component", F.explode("found").alias("shingle"))
    # written, so that the join has plain inputs and frequent shingles can be dealt anew
    common = staged(each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "shingle-counts")
    shared = staged(each.join(common, "shingle"), "open-shingles")
    by_node = W.partitionBy("node")
    keep = F.col("n") - F.ceil(F.lit(link) * F.col("n") / 100) + 1 - (F.col("n") - F.count("*").over(by_node))
    ranked = shared.withColumns({"_keep": keep, "_at": F.row_number().over(by_node.orderBy("df", "shingle")), "_all": F.count("*").over(by_node)})
    return ranked.filter("_at <= _keep").select("node", "n", "component", "shingle", (F.col("_all") - F.col("_at") + 1).alias("left"))


def residual(shared: DataFrame, sets: DataFrame, judged: DataFrame, joined: DataFrame, link: int) -> DataFrame:
    """Candidate pairs that step 3 left open: different components, not proven apart. Written.

    Classes of buckets that still hold several components are paired where their prefixes meet.
    For each shingle, u runs over classes outside the component most seen there and v over
    all, so the many copies of one text are never paired with each other, only with strays. What
    stays quadratic are the strays of one shingle, if very many components share it and it is
    still among the rarest of each: prefixes, sizes and places make that rare, but don't bound it.
    """
    labels = joined.select("node", "component")
    rows = shared.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("key").agg(F.min("component").alias("_l"), F.max("component").alias("_h"), F.count("*").alias("_c")).filter("_l < _h and _c > 2").select("key")
    nodes = staged(rows.join(several, "key", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("component").alias("component")), "open-nodes")
    first = staged(prefixes(nodes, sets, link), "prefixes")
    counts = staged(first.groupBy("shingle", "component").agg(F.count("*").alias("c")), "prefix-counts")
    seen = staged(counts.groupBy("shingle").agg(F.max_by("component", F.col("c")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k"), "prefix-mains")
    sided = staged(first.join(seen, "shingle"), "prefix-rows")
    u, v = sided.filter("component <> main").alias("u"), sided.alias("v")
    fits = f"100 * least(u.n, v.n) >= {link} * greatest(u.n, v.n) and {100 + link} * least(u.left, v.left) >= {link} * (u.n + v.n)"
    pairs = u.join(v, F.expr(f"u.shingle = v.shingle and u.component <> v.component and (v.component = v.main or u.node < v.node) and {fits}"))
    pairs = pairs.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b")).distinct()
    return staged(pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "open-pairs")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of whole `documents` at a similarity of 0.85; see near_duplicates for odd rows."""
    return near_duplicates(read(spark, sf_dir, "documents"))


def kept_documents(docs: DataFrame, link: int = 80, width: int = SHINGLE, collections: int = 11, rows: int = ROWS) -> DataFrame:
    """docs with one row of each group of near duplicates: the one of the smallest doc_id, then by its text's hash.

    Here rows stand for themselves: those that share a doc_id but aren't near duplicates all
    stay, those without a doc_id are compared like others (and yield to rows with one), and of
    rows that repeat doc_id and text one stays. Null and empty texts are no duplicates of
    anything and stay. Other columns, however named, are passed on.
    """
    prints, labels, _ = grouped(docs, link, width, collections, rows, False)
    best = F.col("best")
    own = F.col("doc_id").eqNullSafe(best["doc_id"]) & (F.col("h1") == best["h1"]) & (F.col("h2") == best["h2"])
    each = prints.filter("print is not null").select("print", "doc_id", "h1", "h2").join(labels, "print").groupBy("doc_id", "h1", "h2").agg(F.first(own).alias("stays"), F.count("*").alias("c"))
    verdicts = staged(each.filter("c > 1 or not stays").select(F.col("doc_id").alias("_d"), F.col("h1").alias("_v1"), F.col("h2").alias("_v2"), "stays"), "verdicts")
    dropped(prints, labels)
    small = verdicts.count() * KEY_BYTES <= BROADCAST_BYTES
    text, names = column(docs, "text", "string"), [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(F.struct(*names).alias("_row"), column(docs, "doc_id", "long").alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"))
    on = lambda v: hashed["_id"].eqNullSafe(v["_d"]) & (hashed["_h1"] == v["_v1"]) & (hashed["_h2"] == v["_v2"])
    gone = F.broadcast(verdicts) if small else verdicts
    out = hashed.join(gone, on(gone), "left_anti").select("_row.*")
    if verdicts.filter("stays").limit(1).count():
        once = verdicts.filter("stays")
        once = F.broadcast(once) if small else once
        first = hashed.join(once, on(once), "left_semi").groupBy("_id", "_h1", "_h2").agg(F.first("_row").alias("_row"))
        out = out.unionByName(first.select("_row.*"))
    return out
