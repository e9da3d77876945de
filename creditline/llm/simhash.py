"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  Each
segment, zero-padded to 23 bits, is decoded by the perfect binary Golay code
[23, 12, 7].  A segment's *keys* are the codeword indices of all words within
one bit of it: two segments at most two bits apart always share a key, and two
segments at most one bit apart share the decoded index of either one.

Pigeonhole of at most four differing bits over three segments:

* some segment is equal: the other two hold at most four errors, so one of
  them holds at most two -> key (equal segment, Golay key of the other one);
* no segment is equal: the errors are (1,1,1) or (1,1,2), so two segments hold
  one error each -> the decoded indices of one fingerprint are among the key
  pairs of the other.

Every fingerprint is sent to its keys; inside a key, members are verified by
their exact bit distance.  A key does not list its pairs: a breadth-first
search over the members emits a spanning forest only, so a key with n members
yields fewer than n links.  Components of the links give the classes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import components, key_runs, stored, small_batches, tidy

#: Generator polynomial of the binary Golay code, segment sizes.
GOLAY = 0b101011100011
SEGMENTS = (22, 21, 21)
#: The pigeonhole argument above holds up to this many differing bits.
MAX_BITS = 4
XXH_SEED = 42
#: Rows whose shingle hashes are held as bits at once.
BITS_ROWS = 1 << 16


def fingerprint(text: str, size: int = 4) -> int:
    """SimHash of the words between ASCII white space, A-Z lower-cased, in
    shingles of ``size`` words with repeats; a bit is set if more than half of
    the shingle hashes have it.  No words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    if n <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), XXH_SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - size]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], XXH_SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, np.uint64).astype(">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BITS_ROWS):
        part = h[i : i + BITS_ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 information bits, and the error pattern of each of the 2,048 syndromes."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    info = np.array([remainder(i << 11) for i in range(4096)], np.int32)
    errors = np.zeros(2048, np.int32)
    bits = [1 << i for i in range(23)]
    for i, a in enumerate(bits):
        errors[remainder(a)] = a
        for j, b in enumerate(bits[:i]):
            errors[remainder(a | b)] = a | b
            for c in bits[:j]:
                errors[remainder(a | b | c)] = a | b | c
    return info, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0..4095) of the codeword within three bits of each 23-bit word."""
    info, errors = _golay()
    return ((words ^ errors[info[words >> 11] ^ (words & 2047)]) >> 11).astype(np.int64)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 64
    for n in SEGMENTS:
        at -= n
        out.append(((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
    return out


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints.  A key's lowest bit marks
    the decoded (probe) key of the no-equal-segment case; equal-segment keys
    always carry it, for there every member is compared with every other."""
    segs = _segments(fp)
    near, first = [], []
    for seg, n in zip(segs, SEGMENTS, strict=True):
        flips = np.concatenate([[0], 1 << np.arange(n)])
        idx = decode(seg[:, None] ^ flips[None, :])
        first.append(idx[:, 0].copy())
        idx.sort(axis=1)
        idx[:, 1:][idx[:, 1:] == idx[:, :-1]] = -1
        idx = -np.sort(-idx, axis=1)
        near.append(idx[:, : max(1, int((idx >= 0).sum(axis=1).max(initial=1)))])
    rows, keys = [], []
    r = np.arange(len(fp))

    def put(kind: int, value: np.ndarray, ok: np.ndarray, flag) -> None:
        row = np.broadcast_to(r[:, None], value.shape)[ok]
        rows.append(row)
        keys.append(((np.int64(kind) << 38 | value[ok]) << 1) | (flag[ok] if isinstance(flag, np.ndarray) else flag))

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                kind += 1
                put(kind, segs[i][:, None] << 12 | near[j], near[j] >= 0, 1)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        kind += 1
        a, b = near[i][:, :, None], near[j][:, None, :]
        ok = ((a >= 0) & (b >= 0)).reshape(len(fp), -1)
        value = (a << 12 | b).reshape(len(fp), -1)
        main = (first[i] << 12 | first[j])[:, None] == value
        put(kind, value, ok, main.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fp: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the members within ``bits`` of one another: each
    step compares one member with those not yet reached."""
    left = fp
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = np.bitwise_count(left ^ x) <= bits
            if hit.any():
                for y in left[hit]:
                    yield int(x), int(y)
                todo.extend(left[hit])
                left = left[~hit]


def _links(batches: Iterator[pa.RecordBatch], bits: int, small: int = 6) -> Iterator[pa.RecordBatch]:
    for c in key_runs(batches, lambda c: c["key"] >> 1):
        k, flag, fp = c["key"] >> 1, (c["key"] & 1).astype(bool), c["fp"].view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([start, [len(k)]]))
        left, right = [], []
        run = np.repeat(size, size)
        for s in range(1, small):  # small keys: all members s places apart at once
            i = np.flatnonzero((run[:-s] <= small) & (k[:-s] == k[s:]) & (flag[:-s] | flag[s:])) if len(k) > s else []
            if len(i):
                near = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= bits]
                left.extend(fp[near].tolist())
                right.extend(fp[near + s].tolist())
        for a, n in zip(start[size > small].tolist(), size[size > small].tolist(), strict=True):
            if flag[a : a + n].any():
                for x, y in _forest(np.unique(fp[a : a + n]), bits):
                    left.append(x)
                    right.append(y)
        if left:
            pairs = np.unique(np.array([left, right], np.uint64), axis=1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, fp BIGINT) per row, ``same`` a hash of the text; null texts are empty to fp."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or "", size) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "same", "fp"])

    text = F.col(text_col).cast("string")
    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, same bigint, fp bigint")


def simhash_components(docs: DataFrame, size: int = 4, bits: int = MAX_BITS,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other; rows
    that repeat an id or a text appear as often as they come in; a null id
    keeps its row and never is a component's id (a component of null ids only
    has a null id).  An empty table gives an empty result.  Other columns,
    whatever their names, are not read.
    """
    return _classes(docs, size, bits, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(docs: DataFrame, size: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, fp, component_id) per row."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be between 0 and {MAX_BITS}")
    rows = stored(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                fp = b.column(0).slice(i, 2048).to_numpy().view(np.uint64)
                row, key = fuzzy_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["key", "fp"])

    keys = distinct.select("fp").mapInArrow(send, "key bigint, fp bigint")
    keys = keys.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    links = keys.mapInArrow(tidy(lambda it: _links(it, bits)), "a bigint, b bigint")
    roots = components(links)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp")


def near_dedup(docs: DataFrame, size: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """Keep one row of each component: the one with its smallest doc_id.

    Decisions are about rows, not ids: of rows that share an id, each is judged
    by its own text (known by a 64-bit hash beside the id).  Where several rows
    of a component have its smallest id, the text of the smallest hash stays,
    once; rows with a null id are kept."""
    rows = stored(_classes(docs, size, bits).where("doc_id is not null").select("doc_id", "same", "component_id"), "classes")
    first = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("same").alias("stays"))
    gone = rows.join(first, "component_id").where("doc_id <> component_id or same <> stays").select("doc_id", "same").distinct()
    same, own = f"same_{uuid.uuid4().hex}", f"row_{uuid.uuid4().hex}"
    kept = docs.withColumn(same, F.xxhash64(F.col("text").cast("string")))
    kept = kept.join(gone.withColumnRenamed("same", same), ["doc_id", same], "left_anti")
    kept = kept.withColumn(own, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", same, own]).select(docs.columns)
