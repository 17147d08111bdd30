"""Ranked lexical search: impacts accumulated by sorting packed keys, in integers."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, dropped, read, shipped, staged

#: Documents ranked for each item.
TOP = 10
#: Bytes of the items' distinct terms that travel to the tasks at once; more items are searched in blocks.
BLOCK_BYTES = 16 << 20
#: Item-document-impact triples accumulated at once: it bounds a task's memory.
TRIPLES = 1 << 20
#: Slices into which an item's partial rankings are merged before the last merge.
SLICES = 64
#: Bytes of a text that are parted into terms at once, up to the end of a term.
PIECE = 1 << 20
#: Terms are runs of ASCII letters and digits and of all bytes above ASCII; only A-Z is lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> Counter[bytes]:
    """The terms of a text in UTF-8 with their occurrences; of a long text no more than a piece is parted at once."""
    folded, found, at = text.translate(FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """Places of non-negative keys in ascending order, stable: a radix sort by 16 bits a pass."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    most = int(keys.max()) if len(keys) else 0
    shift = 16
    while most >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct key, ascending, and the sum of its values."""
    if not len(keys):
        return keys, values
    order = sorted_order(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


class Postings:
    """The items that hold each term of a block: term t's are items[at[t]:at[t + 1]]."""

    def __init__(self, held: list[tuple[int, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        pairs = [(self.number.setdefault(t, len(self.number)), i) for i, ts in held for t in ts]
        term, item = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        self.items = item[np.argsort(term, kind="stable")]
        self.count = np.bincount(term, minlength=len(self.number))
        self.at = np.concatenate([[0], np.cumsum(self.count)])

    def matched(self, text: bytes) -> tuple[int, list[int], list[int]]:
        """A text's number of terms, and the numbers of those that items hold, ascending, with their occurrences."""
        found = terms(text)
        own = sorted((self.number[t], n) for t, n in found.items() if t in self.number)
        return sum(found.values()), [t for t, _ in own], [n for _, n in own]

    def triples(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed keys (item, owner) of all items that hold the terms, and the impacts."""
        n = self.count[term]
        each = np.repeat(np.arange(len(term)), n)
        place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + self.at[term][each]
        return self.items[place] * owners + owner[each], impact[each]


class Best:
    """The k best documents of each item seen so far, in a heap an item; ties to the smaller id, ids that are null last."""

    def __init__(self, k: int):
        self.k, self.heaps, self.least = k, {}, {}

    def offer(self, item: int, ids: list[int | None], at: np.ndarray, scores: np.ndarray) -> None:
        """Documents ids[at] with their scores."""
        heap = self.heaps.setdefault(item, [])
        for j in np.flatnonzero(scores >= max(1, self.least.get(item, 0))):
            d = ids[at[j]]
            entry = (int(scores[j]), d is not None, 0 if d is None else -d)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(i, -d if known else None, s) for i, h in sorted(self.heaps.items()) for s, known, d in sorted(h, reverse=True)]


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Each document's m: 10, and 90 parts of its length against the mean, rounded down."""
    if int(n.max(initial=0)) * documents * 90 < 1 << 62:
        return 10 + 90 * n * documents // total
    return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)


def _blocks(items: DataFrame) -> tuple[int, DataFrame]:
    """(how many blocks, items with their block): by hash, doubled until none exceeds BLOCK_BYTES or holds more than one item."""
    blocks = max(1, -(-(items.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "item_id"), F.lit(blocks)))
        over = dealt.groupBy("block").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).filter((F.col("b") > BLOCK_BYTES) & (F.col("n") > 1))
        if over.isEmpty():
            return blocks, dealt
        blocks *= 2


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest scores above 0, equal scores by ascending doc_id.

    A term that df of N documents hold weighs w = floor(1000 ln((2N + 2) / (2 df + 1))). A document
    with tf of it adds w * ((10^9 tf) div (1000 tf + 8m)), where m follows from its length against
    the mean. N and lengths count documents with a term. Scores are exact integers.

    Documents are read once: each leaves its length and its matched terms' numbers and counts,
    which are written. A second pass turns these into (item, document, impact) triples, sorts
    packed keys digit by digit, sums runs and keeps each item's k best of the task in a heap. A
    document's terms lie in one task, so its sums are whole there. The partial rankings are
    range-partitioned by item and slice, merged, and merged again by item, so an item's
    candidates from very many tasks don't meet at once. Items are searched in blocks whose terms
    hold at most BLOCK_BYTES (or one item); blocks beyond the first read the documents again.

    Null texts have no terms; without terms a document isn't counted and an item has no rows.
    Rows are documents by themselves: repeated rows are each ranked, and a null doc_id is last
    among equal scores. Items that share an item_id (null too) are one item with all their terms.
    Empty tables give no rows. Columns other than doc_id and text, item_id and text aren't read.
    """
    spark = shipped(docs.sparkSession)
    schema = "item_id long, rank int, doc_id long, score long"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                found = [sorted(terms(x.as_py())) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    binary = lambda df: F.coalesce(column(df, "text", "string"), F.lit("")).cast("binary").alias("text")
    asked = items.select(column(items, "item_id", "long").alias("item_id"), binary(items)).mapInArrow(split, "item_id long, terms array<binary>")
    merged = asked.select("item_id", F.explode("terms").alias("t")).distinct().groupBy("item_id").agg(F.collect_list("t").alias("terms"))
    merged = merged.withColumn("bytes", F.expr("aggregate(terms, 0L, (s, t) -> s + octet_length(t) + 16)"))
    held = staged(merged.withColumn("item", F.monotonically_increasing_id()), "items")
    blocks, dealt = _blocks(held)
    texts = docs.select(column(docs, "doc_id", "long").alias("doc_id"), binary(docs))
    parts = []
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("item", "terms").collect()  # BLOCK_BYTES at most, or one item
        if rows:
            parts.append(_ranked(spark, texts, sorted((r["item"], sorted(map(bytes, r["terms"]))) for r in rows), k))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.join(held.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _ranked(spark: SparkSession, texts: DataFrame, held: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block's items."""
    names = [i for i, _ in held]
    postings = spark.sparkContext.broadcast(Postings([(n, ts) for n, (_, ts) in enumerate(held)]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = postings.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                found = [p.matched(x.as_py()) for x in some.column(1)]
                n, t, c = zip(*found)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(t, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    matches = staged(texts.mapInArrow(match, "doc_id long, n long, terms array<int>, counts array<long>").filter("n > 0"), "matches")
    whole = matches.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).first()
    documents, total = whole["documents"], whole["total"]
    weights = np.zeros(len(postings.value.number), np.int64)
    for r in matches.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row a term of the block
        weights[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
    shared = spark.sparkContext.broadcast(weights)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, w, best = postings.value, shared.value, Best(k)
        for b in batches:
            ids, m = b.column(0).to_pylist(), lengths(b.column(1).to_numpy(), documents, total)
            ends = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())])
            term, tf = b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(ends))
            impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
            size = np.concatenate([[0], np.cumsum(p.count[term])])[ends]  # triples before each document
            x = 0
            while x < b.num_rows:
                y = max(x + 1, int(np.searchsorted(size, size[x] + TRIPLES, "right")) - 1)
                s = slice(ends[x], ends[y])
                keys, sums = summed(*p.triples(owner[s] - x, term[s], impact[s], y - x))
                item = keys // (y - x)
                cuts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else []
                for u, v in zip(cuts, cuts[1:]):
                    best.offer(int(item[u]), ids, keys[u:v] - item[u] * (y - x) + x, sums[u:v])
                x = y
        if found := best.rows():
            i, d, s = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in i], pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    partial = matches.mapInArrow(rank, "item long, doc_id long, score long").withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)))
    partial = staged(partial, "partial-ranks")
    dropped(matches)
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    apart = partial.repartitionByRange("item", "slice")
    some = apart.withColumn("rank", F.row_number().over(W.partitionBy("item", "slice").orderBy(*order))).filter(F.col("rank") <= k)
    return some.drop("slice").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of whole `documents` for each `benchmark` item; see search for odd rows."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
with folded as (select row_number() over () as rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
d as (select rid, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from folded),
tf as (select rid, doc_id, term, count(*)::bigint as tf from d group by all),
len as (select rid, sum(tf)::bigint as n from tf group by rid),
whole as (select count(*)::bigint as docs, sum(n)::bigint as total from len),
weight as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, whole group by term),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scored as (select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score
  from asked join tf using (term) join len using (rid) join weight using (term), whole group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
