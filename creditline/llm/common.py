"""Helpers shared by the training-data operators: table access, shared-folder
tables, word hashing inside Arrow tasks, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditline.session import ensure_checkpoint_dir

#: Entries a worker keeps in a word cache before starting a new one.
CACHE_WORDS = 400_000


#: Rows of an Arrow batch: whole texts go to the Python workers, so batches are kept small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session hold more than BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` over a task's batches; then the worker, which the next stage uses again, gives free memory back."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and all runs on one machine."""
    from creditline.session import checkpoint_dir

    if checkpoint_dir(spark):
        return ensure_checkpoint_dir(spark, "")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster's executors need a shared folder")
    return ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="creditline-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of an Arrow batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are hashed at once.
HASH_BYTES = 1 << 18


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(n, HASH_BYTES).bit_length()
        for i, base in enumerate((_ODD, _ODD_INVERSE)):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]))
    return _POWERS


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in bytes of the words between ASCII white space."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a piece of text: differences of prefix sums
    of a polynomial in the bytes, modulo 2^64."""
    b = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(data)
    up, down = _powers(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def hash_words(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words (between ASCII white space) of each text, short texts together."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > HASH_BYTES:
            parts, pos, data = [], 0, texts[at]
            while pos < len(data):
                cut = len(data)
                if cut - pos > HASH_BYTES:
                    cut = max(data.rfind(c, pos, pos + HASH_BYTES) for c in (b" ", b"\n"))
                    if cut <= pos:
                        cut = min((x for x in (data.find(c, pos + 1) for c in (b" ", b"\n")) if x > 0), default=len(data))
                parts.append(_hash_block(data[pos:cut])[1])
                pos = cut
            out.append(np.concatenate(parts))
            at += 1
            continue
        group, size = [], 0
        while at < len(texts) and size + len(texts[at]) <= HASH_BYTES:
            group.append(texts[at])
            size += len(texts[at]) + 1
            at += 1
        starts, hashes = _hash_block(b"\n".join(group))
        ends = np.cumsum([len(t) + 1 for t in group])
        out.extend(np.split(hashes, np.searchsorted(starts, ends[:-1])))
    return out


#: Bits of an id filter: 2^26 bits, 8 MB, whatever the number of ids.
FILTER_BITS = 26


class IdFilter:
    """A bitmap of hashed ids of fixed size: tells ids that are surely not in a
    set from ids that may be.  Its use saves shuffles and changes no result."""

    def __init__(self, ids: DataFrame, column: str):
        h = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
        places = ids.select(F.shiftright(h, 16).cast("int").alias("segment"), h.bitwiseAND(0xFFFF).cast("int").alias("place"))
        places = places.distinct()  # an id of many rows collapses before the shuffle

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                segment, place = b.column(0).to_numpy(), b.column(1).to_numpy()
                for s in np.unique(segment).tolist():
                    found.setdefault(s, np.zeros(1 << 16, bool))[place[segment == s]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array([np.packbits(v).tobytes() for v in found.values()], pa.binary())],
                names=["segment", "bits"])

        bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for r in places.repartition("segment").mapInArrow(fill, "segment int, bits binary").toArrow().to_pylist():
            bits[r["segment"] << 13 : (r["segment"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
        self.bits = ids.sparkSession.sparkContext.broadcast(bits)

    def split(self, df: DataFrame, column: str, maybe: bool) -> DataFrame:
        """Rows whose id may be in the set, or those whose id is not (a null id never is)."""
        bits, schema = self.bits, df.schema
        mark = f"mark_{uuid.uuid4().hex}"

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                known = ~np.isnan(h) if h.dtype.kind == "f" else np.ones(len(h), bool)
                h = np.where(known, h, 0).astype(np.int64)
                hit = known & ((bits.value[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1) == 1)
                yield b.drop_columns([mark]).filter(pa.array(hit == maybe))

        h = F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)))
        return df.withColumn(mark, h).mapInArrow(keep, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (of the whole sequence if it is shorter)."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i]
    return mix(h + np.uint64(size))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of words, from differences of prefix sums."""
    up, down = _powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def key_runs(batches: Iterator[pa.RecordBatch], key) -> Iterator[dict[str, np.ndarray]]:
    """From batches sorted by ``key(columns)``, chunks that never cut a key in two."""
    rest: dict[str, np.ndarray] | None = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if rest is not None:
            cols = {n: np.concatenate([rest[n], cols[n]]) for n in cols}
        k = key(cols)
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield {n: c[:cut] for n, c in cols.items()}
        rest = {n: c[cut:] for n, c in cols.items()}
    if rest is not None and len(next(iter(rest.values()))):
        yield rest


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` of BIGINT nodes: rows (node, root),
    root the smallest node of the component.

    Alternating large-star and small-star steps: every node is linked to its
    smallest neighbour, so a group of n nodes converges in O(log n) rounds and
    never needs more rows than it has edges.  Both steps are a partial
    aggregate and a join, which split a hub over tasks.  Each round is written
    to the shared folder.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.union(low.select("a", "m")).where("a <> b").distinct(), "edges")
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
