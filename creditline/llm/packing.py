"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens.  In each round a queue's credit grows by
its quantum (target share x sequence length); a queue serves whole grains of
tokens as long as its credit covers them and carries the deficit on to the next
round.  After r rounds a queue has served ``grain * floor(r * quantum / grain)``
tokens, so the round, and with it the place, of any token follows from its
position in its queue alone: deficits carry across windows and partitions
without passing state between tasks.  The served tokens, in order of (round,
queue), are cut into sequences of ``length`` tokens.  The last, incomplete
window becomes sequences of lengths that are powers of two, so nothing is padded.

Only per-partition totals by queue are shuffled (beyond MAX_OFFSETS rows of them, the ids too); token ids are written once to
the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditline.llm.common import small_batches, stored, tidy
from creditline.llm.tokens import tokenizer, vocabulary

LENGTH = 1024
GRAIN = 256
END_ID = 0
#: Beyond this many sources, sources without a target and outside the largest half
#: as many share the queues left over by hash (each row still is packed).
MAX_QUEUES = 1024
#: Partition offsets are broadcast up to this many rows (about 40 bytes each).
MAX_OFFSETS = 400_000
ENCODED = "part int, queue string, source string, doc_id bigint, n bigint, place bigint, ids binary"
PIECES = "doc_id bigint, source string, row_source string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint"


def _served(rounds: np.ndarray, quanta: np.ndarray, totals: np.ndarray, grain: int) -> np.ndarray:
    """(rounds x queues) tokens served before each round."""
    full = np.floor(rounds[:, None] * quanta[None, :] / grain).astype(np.int64) * grain
    return np.minimum(full, totals[None, :])


def _round_of(grains: np.ndarray, quanta: np.ndarray, grain: int) -> np.ndarray:
    """Round that serves each grain of a queue: the first whose credit covers it."""
    r = np.maximum(np.ceil((grains + 1) * grain / quanta) - 1, 0)
    for _ in range(2):
        r -= (r > 0) & (np.floor(r * quanta / grain) >= grains + 1)
    for _ in range(3):
        r += np.floor((r + 1) * quanta / grain) < grains + 1
    return r


class Plan:
    """Places of all tokens, from the queues' token totals and target shares."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, length: int, grain: int):
        self.names = sorted(totals)
        self.totals = np.array([totals[q] for q in self.names], np.int64)
        share = self.totals if targets is None else np.array([targets.get(q, 0.0) for q in self.names])
        if not np.isfinite(share).all() or (share < 0).any() or not share.sum() > 0:
            raise ValueError("targets must be shares of 0 or more, and name at least one of the sources")
        share = share / share.sum()
        # a queue without a target is still drained, last and slowly
        self.quanta = np.maximum(share, 1e-9) * length
        self.length, self.grain = length, grain
        self.all = int(self.totals.sum())
        self.tail = self.all - self.all % length
        cuts, at, left = [], self.tail, self.all - self.tail
        while left:
            cuts.append(at)
            step = 1 << (left.bit_length() - 1)
            at, left = at + step, left - step
        self.cuts = np.array(cuts, np.int64)

    def positions(self, queue: np.ndarray, grains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position, in the packed order, of the start of each grain."""
        r = _round_of(grains.astype(np.float64), self.quanta[queue], self.grain)
        out = np.empty(len(grains), np.int64)
        order = np.argsort(r, kind="stable")
        step = max(1, 2_000_000 // max(1, len(self.names)))
        for i in range(0, len(order), step):
            at = order[i : i + step]
            rounds, back = np.unique(r[at], return_inverse=True)
            before = _served(rounds, self.quanta, self.totals, self.grain)
            own = _served(rounds + 1, self.quanta, self.totals, self.grain) - before
            ahead = np.cumsum(own, axis=1) - own
            q = queue[at]
            out[at] = before.sum(axis=1)[back] + ahead[back, q] + grains[at] * self.grain - before[back, q]
        return out

    def cut(self, queue: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in it, length, sequence, offset) of the pieces of documents that
        hold ``n`` tokens from ``place`` of their queue."""
        first, last = place // self.grain, (place + n - 1) // self.grain
        k = last - first + 1
        doc = np.repeat(np.arange(len(n)), k)
        grains = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + first[doc]
        a = np.maximum(grains * self.grain, place[doc])
        b = np.minimum((grains + 1) * self.grain, (place + n)[doc])
        pos = self.positions(queue[doc], grains) + a - grains * self.grain
        start, size = a - place[doc], b - a
        # cut at the ends of sequences, again and again until nothing crosses one
        while True:
            seq, off, room = self.sequence(pos)
            over = size > room
            if not over.any():
                break
            doc = np.concatenate([doc, doc[over]])
            start = np.concatenate([start, (start + room)[over]])
            pos = np.concatenate([pos, (pos + room)[over]])
            rest = (size - room)[over]
            size = np.concatenate([np.minimum(size, room), rest])
        order = np.lexsort((start, doc))
        doc, start, size, seq, off = (x[order] for x in (doc, start, size, seq, off))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (off[1:] != off[:-1] + size[:-1])
        at = np.flatnonzero(new)
        return doc[at], start[at], np.add.reduceat(size, at) if len(at) else size, seq[at], off[at]

    def sequence(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset in it and room left there of each position."""
        seq, off = pos // self.length, pos % self.length
        room = self.length - off
        t = np.flatnonzero(pos >= self.tail)
        if len(t):
            i = np.searchsorted(self.cuts, pos[t], "right") - 1
            ends = np.append(self.cuts[1:], self.all)
            seq[t] = self.tail // self.length + i
            off[t] = pos[t] - self.cuts[i]
            room[t] = ends[i] - pos[t]
        return seq, off, room


def queues(docs: DataFrame, source: Column, max_queues: int, targets: dict[str, float] | None) -> Column:
    """The queue of each row: its source's own, or, with more sources than queues, one shared by hash.

    Every source with a target keeps a queue of its own, and so do the largest (in bytes of text)
    up to half of the queues; the queues that the others share thus have no target."""
    if docs.select(source).distinct().limit(max_queues + 1).count() <= max_queues:
        return source
    own = {q for q, share in (targets or {}).items() if share > 0}
    sizes = docs.groupBy(source.alias("source")).agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("size"))
    room = max(max_queues // 2 - len(own), 0)
    largest = sizes.where(~F.col("source").isin(list(own))).orderBy(F.col("size").desc_nulls_last(), "source").limit(room)
    own |= {r["source"] for r in largest.collect()}
    prefix = "queue "
    while any(q.startswith(prefix) for q in own):
        prefix = "shared " + prefix
    shared = F.pmod(F.xxhash64(source), F.lit(max(max_queues - len(own), 1))).cast("string")
    return F.when(source.isin(list(own)), source).otherwise(F.concat(F.lit(prefix), shared))


def encode(docs: DataFrame, path: str, max_queues: int = MAX_QUEUES, queue_col: str = "source",
           targets: dict[str, float] | None = None) -> DataFrame:
    """The documents' ids and their places in the queue of their partition, in the shared folder."""
    source = F.coalesce(F.col(queue_col).cast("string"), F.lit(""))
    queue = queues(docs, source, max_queues, targets)
    cols = docs.select(queue.alias("queue"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), source.alias("source"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, t = TaskContext.get().partitionId(), tokenizer(path)
        end = np.array([END_ID], np.uint16).tobytes()
        used: dict[str, int] = {}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                queues = b.column(0).slice(i, 500).to_pylist()
                ids = [t.encode(x or "") + end for x in b.column(2).slice(i, 500).to_pylist()]
                places = []
                for q, x in zip(queues, ids, strict=True):
                    places.append(used.get(q, 0))
                    used[q] = places[-1] + len(x) // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(queues, pa.string()), b.column(3).slice(i, 500), b.column(1).slice(i, 500),
                     pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(places, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "queue", "source", "doc_id", "n", "place", "ids"])

    return stored(cols.mapInArrow(run, ENCODED), "ids")


def pack(docs: DataFrame, path: str | None = None, targets: dict[str, float] | None = None,
         length: int = LENGTH, grain: int = GRAIN, max_queues: int = MAX_QUEUES, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, source (the queue), row_source (the row's own), start, length, doc_tokens,
    sequence_id, offset, ids_crc32, ids (the piece's ids, little-endian 32-bit;
    left out by ``with_ids=False``, when only the layout is wanted).

    ``targets`` gives the sources' shares of every sequence; by default each
    source's share of all tokens, with which all queues run dry together.  When
    a queue is empty, the others fill its room.  Targets that are negative, or
    name none of the sources, are an error.  Beyond ``max_queues`` sources
    only those with a target and the largest have a queue of their own.  A null text is empty (its only
    token is the end token); a null source is the queue ''; a null doc_id is
    kept; repeated rows are packed as often as they come.  An empty table gives
    an empty result.  Columns other than doc_id, text and source are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = PIECES + (", ids binary" if with_ids else "")
    table = encode(docs, path or vocabulary(), max_queues, targets=targets)
    sums = table.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    totals = {r["queue"]: r["n"] for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return spark.createDataFrame([], kind)
    plan = Plan(totals, targets, length, grain)
    starts = offsets.select("queue", "part", "before")
    if offsets.count() <= MAX_OFFSETS:
        starts = F.broadcast(starts)
    placed = table.join(starts, ["queue", "part"]).select(
        "queue", "doc_id", "n", (F.col("place") + F.col("before")).alias("place"), "ids", "source")
    shared = spark.sparkContext.broadcast(plan)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer.cache_clear()  # this worker may have encoded before; its cache is not needed any more
        plan = shared.value
        number = {q: i for i, q in enumerate(plan.names)}
        for b in batches:
            for i in range(0, b.num_rows, 200):
                c = b.slice(i, 200)
                queues = c.column(0).to_pylist()
                q = np.array([number[x] for x in queues], np.int64)
                n = c.column(2).to_numpy()
                doc, start, size, seq, off = plan.cut(q, c.column(3).to_numpy(), n)
                ids = [memoryview(np.frombuffer(x, np.uint16).astype("<u4").tobytes()) for x in c.column(4).to_pylist()]
                out = [ids[d][4 * s : 4 * (s + z)] for d, s, z in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [c.column(1).take(at), c.column(0).take(at), c.column(5).take(at), pa.array(start), pa.array(size), c.column(2).take(at),
                     pa.array(seq), pa.array(off), pa.array([zlib.crc32(x) for x in out], pa.int64()),
                     *([pa.array(out, pa.binary())] if with_ids else [])],
                    names=["doc_id", "source", "row_source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", *(["ids"] if with_ids else [])])

    return placed.mapInArrow(run, kind)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces' layout with the CRC-32 of their ids, without the ids; source is the row's own."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("row_source").alias("source"))
