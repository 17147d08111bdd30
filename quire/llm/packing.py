"""Mixture-controlled packing: deficit round-robin over source queues into full windows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, read, shipped, staged
from quire.llm.tokens import encoder, vocabulary_path

WINDOW = 4096
#: Target proportions of op10 and of the pipeline: weights of the sources by code point, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of queue heads up to this many bytes are broadcast; beyond, token ids are shuffled to them.
BROADCAST_BYTES, HEAD_BYTES = 32 << 20, 64
#: A source's deficit is paid out in multiples of this many tokens, which keeps pieces long.
QUANTUM = 64
END = 2


class Schedule:
    """Where deficit round-robin puts each token of each source's queue.

    Each round is worth one window. In a round a source's deficit grows by window times its
    share, and as many whole quanta of it as are due are taken from its queue; the remainder is
    carried to the next round. Summed over rounds that has a closed form: after r rounds source
    s has given floor(r * window * size_s / (total * quantum)) * quantum tokens. So a token's
    round, and its place in the stream of all rounds, follow from its place in its queue alone,
    and any partition can place its documents without knowing the others. Windows are cut from
    that stream, so all but the last are full.

    Shares are `targets` (by source), or the sources' parts of all tokens. When a queue runs dry
    before others, a new phase begins in which the rest share its part by their targets.
    """

    def __init__(self, sizes: list[int], targets: list[float] | None, window: int, quantum: int):
        self.window, self.quantum = window, quantum
        #: Of each phase: where it starts in the stream, each source's tokens in it, where they start in the queue.
        self.phases: list[tuple[int, list[int], list[int]]] = []
        start, queue, left = 0, [0] * len(sizes), list(sizes)
        while any(left):
            live = [i for i, n in enumerate(left) if n]
            share = [targets[i] if targets else left[i] for i in range(len(left))]
            if not targets or not any(share[i] > 0 for i in live):
                took = list(left)
            else:
                first = min((i for i in live if share[i] > 0), key=lambda i: left[i] / share[i])
                took = [0] * len(left)
                for i in live:
                    took[i] = left[i] if i == first else min(left[i], int(left[first] * share[i] / share[first]))
            self.phases.append((start, took, list(queue)))
            start += sum(took)
            queue = [q + n for q, n in zip(queue, took)]
            left = [n - t for n, t in zip(left, took)]
        self.rounds: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {}
        #: Of each source: where its part of each phase starts in its queue.
        self.firsts = [[first[i] for _, _, first in self.phases] for i in range(len(sizes))]

    def _round(self, k: int, r: int) -> tuple[list[int], list[int], list[int]]:
        """Of a phase's round: what each source gave before it and up to its end, and where its part starts in the stream."""
        found = self.rounds.get((k, r))
        if found is None:
            start, sizes, _ = self.phases[k]
            total, w, q = sum(sizes), self.window, self.quantum
            last = -(-total // w)
            given = lambda r: [n if r >= last else min(n, r * w * n // (total * q) * q) for n in sizes]
            before, after = given(r), given(r + 1)
            at, places = start + sum(before), []
            for a, b in zip(before, after):
                places.append(at)
                at += b - a
            if len(self.rounds) > 10_000:
                self.rounds.clear()
            found = self.rounds[k, r] = before, after, places
        return found

    def pieces(self, source: int, queue: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset) for n tokens at a place of a source's queue."""
        done = 0
        for k in range(bisect.bisect_right(self.firsts[source], queue) - 1, len(self.phases)):
            if done == n:
                return
            _, sizes, first = self.phases[k]
            size, total = sizes[source], sum(sizes)
            while done < n and first[source] <= queue + done < first[source] + size:
                p = queue + done - first[source]
                last = -(-total // self.window)
                r = min(-(-(p // self.quantum + 1) * total * self.quantum // (self.window * size)), last) - 1
                before, after, places = self._round(k, r)
                at = places[source] + p - before[source]
                take = min(n - done, after[source] - p, self.window - at % self.window)
                yield done, take, at // self.window, at % self.window
                done += take


PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, window: int = WINDOW, targets: Mapping[str | None, float] | Sequence[float] | None = None, quantum: int = QUANTUM, path: str | None = None, end: int = END) -> DataFrame:
    """Packs documents into windows of `window` tokens; returns a row per piece (PIECES), ids as little-endian 32-bit numbers.

    A document's tokens are the library's ids of its whole text, then `end`; null or empty text
    has only `end`. A source's queue holds its documents in the order of input partitions and
    rows (null is a source of its own). `targets` are proportions by source, or weights that the
    sources, by code point and null last, take in turn. See Schedule for the places. Every token lies in exactly
    one piece and every window but the last is full. Texts are encoded once, into a table in the
    shared folder; only counts per partition and source are summed. The driver holds one number
    per source. Empty tables give no pieces; repeated rows are packed each. Columns other than
    doc_id, source and text are not read.
    """
    shipped(docs.sparkSession)
    path = path or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, heads = encoder(path), TaskContext.get().partitionId(), {}
        for b in batches:
            if not b.num_rows:
                continue
            ids = e.ids(b.column(2), end)
            counts = pc.divide(pc.binary_length(ids), np.dtype(e.wide).itemsize).cast(pa.int64())
            at = []
            for s, n in zip(b.column(1).to_pylist(), counts.to_pylist()):
                at.append(heads.get(s, 0))
                heads[s] = at[-1] + n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), counts, ids], ["doc_id", "source", "part", "head", "n", "ids"])

    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "source", "string").alias("source"), column(docs, "text", "string").alias("text"))
    encoded = staged(rows.mapInArrow(encode, "doc_id long, source string, part int, head long, n long, ids binary"), "token-ids")
    heads = staged(encoded.groupBy("source", "part").agg(F.sum("n").alias("tokens")), "queue-heads")
    sizes = {r["source"]: r["tokens"] for r in heads.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(order)}
    if isinstance(targets, Mapping):
        shares = [float(targets.get(s, 0.0)) for s in order]
    else:
        shares = [float(targets[i % len(targets)]) for i in range(len(order))] if targets else None
    amounts = [sizes[s] for s in order]
    wide = "<u4" if encoder(path).wide == "<u4" else "<u2"

    before = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    few = heads.count() * HEAD_BYTES <= BROADCAST_BYTES
    queues = heads.select(F.col("source").alias("_s"), F.col("part").alias("_p"), before.alias("_before"))
    queues = F.broadcast(queues) if few else queues
    placed = encoded.join(queues, encoded["source"].eqNullSafe(queues["_s"]) & (encoded["part"] == queues["_p"])).select("doc_id", "source", (F.col("head") + F.col("_before")).alias("queue"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(amounts, shares, window, quantum)
        names = ("doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
        kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary())
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in names]
                for doc, source, queue, raw in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    ids = np.frombuffer(raw, wide).astype("<u4")
                    for start, n, seq, offset in plan.pieces(number[source], queue, len(ids)):
                        for column_, value in zip(out, (doc, source, start, n, len(ids), seq, offset, ids[start : start + n].tobytes())):
                            column_.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], list(names))

    return placed.mapInArrow(cut, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole `documents` in windows of the proportions WEIGHTS; null and empty texts have only the end, repeated rows are packed each."""
    pieces = pack(read(spark, sf_dir, "documents"), targets=WEIGHTS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")

