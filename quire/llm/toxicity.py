"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, read, replaced, shipped

#: At most this many labelled documents of each class are learned from, none longer than
#: MAX_TRAIN_BYTES, and no more than CLASS_BYTES together: so the driver gathers at most twice that.
MAX_TRAIN, MAX_TRAIN_BYTES, CLASS_BYTES = 2_000, 1 << 20, 16 << 20
#: Features in fewer training documents than this are left out, as are those not at least LIFT times
#: as frequent in toxic documents as in clean ones: a sentence offends by what it holds.
MIN_DOCS = 4
LIFT = 2.0
#: Lengths of the word beginnings that are features beside whole words; they reach inflected forms.
STEMS = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
#: A worker forgets the weights of words that it has looked up when it holds this many; longer words
#: than LONGEST aren't kept at all, so what it holds is bounded.
CACHE, LONGEST = 300_000, 64


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in STEMS if len(word) >= k)]


class Model:
    """Sentence i of a document offends with probability p_i = sigmoid(bias + its distinct words' weights).

    A word weighs as much as its features together. The document is toxic with probability
    1 - prod(1 - p_i).
    """

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.plain = float(np.logaddexp(0, bias))  # -log(1 - p) of a sentence without any weighted word
        self.words: dict[str, float] = {}

    def word(self, word: str) -> float:
        v = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= LONGEST:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = v
        return v

    def score(self, text: str | None, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, stop, p) of each sentence with p >= least."""
        known, total, spans = self.words, 0.0, []
        for m in SENTENCE.finditer(text or ""):
            words = set(WORD.findall(m.group().lower()))
            if not words:
                continue
            z = 0.0
            for w in words:
                v = known.get(w)
                z += self.word(w) if v is None else v
            if z == 0.0:
                total += self.plain
                continue
            z += self.bias
            total += float(np.logaddexp(0, z))
            p = 1 / (1 + np.exp(-z))
            if p >= least:
                spans.append((m.start(), m.end(), float(p)))
        return float(-np.expm1(-total)), spans


def fit(texts: Sequence[str], labels: Sequence[int], steps: int = 200, rate: float = 0.1, l1: float = 2e-4) -> Model:
    """Full-batch descent on the documents' likelihood, classes balanced, with Adam's steps and an L1 penalty."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the prior of the one class
        return Model(4.0 if len(y) and y[0] == 1 else -12.0, {})
    bags = [[s for s in (set(WORD.findall(x.lower())) for x in SENTENCE.findall(t or "")) if s] for t in texts]
    toxic, clean = Counter(), Counter()
    for bag, label in zip(bags, y):
        (toxic if label else clean).update({f for w in set().union(*bag) for f in features(w)})
    n_toxic, n_clean = y.sum(), len(y) - y.sum()
    chosen = sorted(f for f, n in toxic.items() if n + clean[f] >= MIN_DOCS and n / n_toxic >= LIFT * clean[f] / n_clean)
    number = {f: i for i, f in enumerate(chosen)}
    doc, at, owner, n = [], [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            ids = [number[f] for w in s for f in features(w) if f in number]
            at.extend(ids)
            owner.extend([n] * len(ids))
            doc.append(d)
            n += 1
    at, owner, doc = np.array(at, np.int64), np.array(owner, np.int64), np.array(doc, np.int64)
    weight = np.where(y == 1, 0.5 / n_toxic, 0.5 / n_clean)
    v = np.zeros(len(number) + 1)
    v[-1] = -6.0
    mean, square = np.zeros(len(v)), np.zeros(len(v))
    for k in range(1, steps + 1):
        z = np.bincount(owner, v[at], n) + v[-1]
        none = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)))
        # d(-log P)/dz is -(1 - P) / P * p for toxic documents, p for clean ones
        slope = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
        g_z = slope[doc] / (1 + np.exp(-z))
        g = np.bincount(at, g_z[owner], len(v))
        g[-1] = g_z.sum()
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = rate / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        v -= step * mean / (1 - 0.9**k)
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - np.minimum(step[:-1] * l1, rate), 0)
    return Model(float(v[-1]), {f: float(v[i]) for f, i in number.items() if v[i] != 0})


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> list[tuple[str, int]]:
    """Up to `most` labelled documents of each class outside the held-out third, first by a hash of doc_id.

    They are chosen among the ids whose texts fit, so long texts are replaced by others, not
    missed; the chosen ones are taken as long as they fit CLASS_BYTES together. Ids and lengths
    alone are shuffled for that, and only the chosen texts leave their partitions. Null texts
    count as empty. Of rows that repeat a doc_id one text is taken, of an id with both labels a
    row each.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_id is not null and _toxic in (0, 1)").filter(~held_out(F.col("_id"))).distinct()
    rows = docs.select(column(docs, "doc_id", "long").alias("_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_bytes", F.octet_length("_text").cast("long")).filter(F.col("_bytes") <= MAX_TRAIN_BYTES)
    sized = usable.join(rows.groupBy("_id").agg(F.max("_bytes").alias("_most")), "_id")
    spread = F.xxhash64(F.lit(11), "_id")
    picked = [sized.filter(F.col("_toxic") == y).orderBy(spread, "_id").limit(most) for y in (1, 0)]
    # at most 2 * most rows from here on
    taken = F.sum("_most").over(W.partitionBy("_toxic").orderBy(spread, "_id").rowsBetween(W.unboundedPreceding, 0))
    chosen = picked[0].unionByName(picked[1]).withColumn("_taken", taken).filter(F.col("_taken") <= CLASS_BYTES).select("_id", "_toxic")
    found = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).collect()
    return [(r["_text"], r["_toxic"]) for r in sorted(found, key=lambda r: (r["_id"], r["_toxic"]))]


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Adds toxicity (0 to 1), toxic (1 from the threshold on) and offending (array of start, stop, score in code points).

    Whole texts are read, each alone, without a shuffle. Null and empty texts have no sentences
    and score 0. Input columns named like an added one are replaced.
    """
    shipped(docs.sparkSession)
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])))])
    bias, weights = model.bias, model.weights

    @F.arrow_udf("score double, spans array<struct<start:int,stop:int,score:double>>")
    def judged(texts: pa.Array) -> pa.Array:
        m = Model(bias, weights)
        rows = []
        for x in texts:
            p, spans = m.score(x.as_py())
            rows.append({"score": p, "spans": [{"start": a, "stop": b, "score": s} for a, b, s in spans]})
        return pa.array(rows, kind)

    docs = replaced(docs, "toxicity", "toxic", "offending")
    out = docs.withColumn("_t", judged(column(docs, "text", "string")))
    return out.withColumns({"toxicity": F.col("_t.score"), "toxic": (F.col("_t.score") >= threshold).cast("int"), "offending": F.col("_t.spans")}).drop("_t")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole `documents`, learned from `labels`, and the sentences that offend; null and empty texts score 0, repeated rows alike, null ids aren't held out."""
    docs = read(spark, sf_dir, "documents")
    rows = training_rows(docs, read(spark, sf_dir, "labels"))
    model = fit([t for t, _ in rows], [y for _, y in rows])
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"), "offending")
