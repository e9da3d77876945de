"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all documents (from every word that has at least ``min_words`` words
from it on) are split into groups by a prefix of variable length: a prefix of one word
where few suffixes start with that word, and of 2, 4, 8, ... words where more than fit a
group do.  Rarer prefixes share groups, so a group fits a task's memory however
frequent a word is.  A group's subtree holds its suffixes in the order of their
paths; two suffixes meet in an internal node at the depth of their common prefix.  Only
nodes at least ``min_words`` words deep matter, so subtrees are truncated at that depth
and a path below the group's prefix is compared by a 64-bit fingerprint of its words.
Below such a node the leaf that starts first (smallest doc_id, then start) is kept and all
others repeat it.  A longer repeat is a chain of deep nodes at successive suffixes; the
chains of a document are joined to its maximal repeated stretches, which are removed.

Suffixes travel as blocks of sorted fingerprints, not as rows.  Within a block, of
suffixes with the same path only the first goes to its group, as the others are known to
be repeats; so a passage that a third of all documents hold comes once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import hash_words, mix, small_batches, span_hashes, stored, tidy

MIN_WORDS = 20
#: Suffixes that one task sorts at once.
GROUP = 1_000_000
#: Words of a block of documents (a longer document is a block by itself).
BLOCK_WORDS = 1_000_000
#: Prefix lengths are planned on every so many-th suffix; they only say where a suffix is worked on.
SAMPLE = 256
LEVELS = (1, 2, 4, 8, 16)
RESULT = "doc_id bigint, text binary, n_words bigint, n_removed bigint, spans array<struct<start:bigint,words:bigint>>"


class Block:
    """The suffixes of some documents in the order of (doc_id, start)."""

    def __init__(self, ids: list[int], keys: list[int], words: list[np.ndarray], size: int):
        order = np.lexsort((keys, ids))
        self.ids, self.keys = np.array(ids, np.int64)[order], np.array(keys, np.int64)[order]
        n = np.array([len(words[i]) for i in order], np.int64)
        self.words = np.concatenate([words[i] for i in order]) if len(order) else np.empty(0, np.uint64)
        first = np.cumsum(n) - n
        m = np.maximum(n - size + 1, 0)
        self.row = np.repeat(np.arange(len(n)), m)
        self.start = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        self.at = first[self.row] + self.start
        self.size = size

    def paths(self, length: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        at = self.at[which]
        return span_hashes(self.words, at, at + length) if len(at) else np.empty(0, np.uint64)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """Blocks of the documents (doc_id, key, text) of a task; rows without an id or with the id
    and text of another row of the block are left out."""
    ids: list[int] = []
    keys: list[int] = []
    words: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()
    count = 0
    for b in batches:
        for i in range(0, b.num_rows, 200):
            c = b.slice(i, 200)
            new = [(d, k, t) for d, k, t in zip(*(x.to_pylist() for x in c.columns), strict=True) if d is not None and t]
            for (d, k, _), w in zip(new, hash_words([t for *_, t in new]), strict=True):
                if len(w) < size or (d, k) in seen:
                    continue
                seen.add((d, k))
                ids.append(d)
                keys.append(k)
                words.append(w)
                count += len(w)
            if count >= BLOCK_WORDS:
                yield Block(ids, keys, words, size)
                ids, keys, words, count = [], [], [], 0
                seen.clear()
    if ids:
        yield Block(ids, keys, words, size)


def _bytes(x: np.ndarray) -> bytes:
    """The values' lowest bytes, then their next, ...: like bytes compress together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _values(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).reshape(-1).view(kind)


def packed(press: zstandard.ZstdCompressor, path: np.ndarray, ids: np.ndarray, keys: np.ndarray, row: np.ndarray, start: np.ndarray) -> bytes:
    """Leaves sorted by path: (path, document, start); documents are named once.  Paths may be left out."""
    used, row = np.unique(row, return_inverse=True)
    step = np.diff(path, prepend=np.uint64(0))
    head = np.array([len(used), len(row), len(path)], "<i8").tobytes()
    names = [_bytes(np.diff(ids[used], prepend=0)), _bytes(keys[used].astype(np.int32))]
    return press.compress(b"".join([head, *names, _bytes(step), _bytes(row.astype(np.uint32)), _bytes(start.astype(np.uint32))]))


def unpacked(press: zstandard.ZstdDecompressor, data: bytes) -> tuple[np.ndarray, ...]:
    raw = press.decompress(data)
    m, n, paths = np.frombuffer(raw, "<i8", 3).tolist()
    at, out = 24, []
    for size in (8 * m, 4 * m, 8 * paths, 4 * n, 4 * n):
        out.append(raw[at : at + size])
        at += size
    row = _values(out[3], np.uint32)
    ids, keys = np.cumsum(_values(out[0], np.int64)), _values(out[1], np.int32).astype(np.int64)
    return np.cumsum(_values(out[2], np.uint64)), ids, keys, row, _values(out[4], np.uint32)


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def repeats(path: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which leaves, sorted by (path, doc, start), start later than the first leaf below their deep node."""
    if not len(path):
        return np.zeros(0, bool)
    node = np.flatnonzero(~_same(path))
    first = np.repeat(node, np.diff(np.append(node, len(path))))
    return (doc != doc[first]) | (start != start[first])


def _spread(press: zstandard.ZstdCompressor, n_parts: int, ids: np.ndarray, keys: np.ndarray, row: np.ndarray, start: np.ndarray) -> list[tuple]:
    """Starts of repeats, packed by the part of their documents."""
    part = np.mod(keys, n_parts)[row]
    order = np.lexsort((start, row, part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))[1:]
    return [(int(part[x[0]]), True, packed(press, np.empty(0, np.uint64), ids, keys, row[x], start[x])) for x in np.split(order, cuts) if len(x)]


DEALT = "part bigint, known boolean, leaves binary"
_DEALT = [pa.int64(), pa.bool_(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT, strict=True)], names=["part", "known", "leaves"])


class Starts:
    """Starts of repeated windows by document, from packed leaves without paths."""

    def __init__(self, got: list[tuple[np.ndarray, ...]]):
        empty = np.empty(0, np.int64)
        ids = np.concatenate([empty, *[x[1][x[3]] for x in got]])
        keys = np.concatenate([empty, *[x[2][x[3]] for x in got]])
        start = np.concatenate([empty, *[x[4].astype(np.int64) for x in got]])
        order = np.lexsort((start, keys, ids))
        ids, keys, self.start = ids[order], keys[order], start[order]
        first = np.flatnonzero(~_same(ids, keys))
        ends = np.append(first[1:], len(ids))
        self.places = {(d, k): x for d, k, *x in zip(ids[first].tolist(), keys[first].tolist(), first.tolist(), ends.tolist(), strict=False)}

    def of(self, doc: int, key: int) -> np.ndarray:
        a, b = self.places.get((doc, key), (0, 0))
        return self.start[a:b]


def plan(docs: DataFrame, size: int, group: int, sample: int) -> tuple[int, list[np.ndarray]]:
    """(number of groups, for each level the prefixes of that length that more suffixes start with than
    fit a group).  The lists have at most one entry for ``group`` suffixes of a level."""
    levels = [x for x in LEVELS if x < size]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, size):
            took = mix(b.keys.view(np.uint64)[b.row] + b.start.astype(np.uint64)) % np.uint64(sample) == 0
            h = np.concatenate([b.paths(x, took) for x in levels])
            level = np.repeat(np.arange(len(levels)), len(h) // len(levels))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(level, -1), pa.int64()), pa.array(np.append(h.view(np.int64), 0)),
                 pa.array(np.append(np.full(len(h), sample), len(b.row)), pa.int64())], names=["level", "prefix", "n"])

    sums = docs.mapInArrow(run, "level bigint, prefix bigint, n bigint").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    found = sums.where((F.col("n") > group) | (F.col("level") < 0)).toArrow()
    level, prefix, n = (found[c].to_numpy() for c in ("level", "prefix", "n"))
    total = int(n[level < 0].sum())
    return max(1, -(-total // group)), [np.sort(prefix[level == i].view(np.uint64)) for i in range(len(levels))]


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, group: int = GROUP, sample: int = SAMPLE) -> DataFrame:
    """Per row doc_id, text (the words that are kept, joined by one space), n_words, n_removed, spans (the removed
    stretches: start, words).  A word is removed if a window of ``min_words`` words covers it whose words also
    start earlier: in a smaller doc_id, or at a smaller start in the same document.  Windows are judged on
    the input.

    Words lie between ASCII white space; a null text is empty.  Rows with equal doc_ids are one another's "same
    document": of equal windows the one that starts earlier is kept, and both are if they start alike, so
    repeated rows have equal results.  (Rows of one id are told apart by 32 bits of their text's hash.)  Rows with a null id lose nothing and take nothing away.  Texts are
    processed whole; a text with fewer words has no window.  Columns other than doc_id and text are not
    read; an empty table gives an empty result.  ``group`` and ``sample`` only place the work."""
    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.shiftright(F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), 32).alias("key"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    small_batches(docs.sparkSession)
    n_groups, heavy = plan(cols, min_words, group, sample)
    levels = [*[x for x in LEVELS if x < min_words], min_words]
    heavy = [*heavy, np.empty(0, np.uint64)]

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in blocks(batches, min_words):
            path = b.paths(min_words)
            order = np.argsort(path, kind="stable")
            path, row, start = path[order], b.row[order], b.start[order]
            gone = repeats(path, b.ids[row], start)
            out = _spread(press, n_groups, b.ids, b.keys, row[gone], start[gone])
            stay = np.flatnonzero(~gone)
            path, row, start, at = path[stay], row[stay], start[stay], order[stay]
            part, todo = np.empty(len(path), np.int64), np.arange(len(path))
            for length, many in zip(levels, heavy, strict=True):
                prefix = path[todo] if length == min_words else b.paths(length, at[todo])
                part[todo] = (prefix % np.uint64(n_groups)).astype(np.int64)
                todo = todo[np.isin(prefix, many)]
                if not len(todo):
                    break
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            for x in np.split(order, cuts[1:]):
                if len(x):
                    out.append((int(part[x[0]]), False, packed(press, path[x], b.ids, b.keys, row[x], start[x])))
                if sum(len(r[2]) for r in out) > 4_000_000:
                    yield _batch(out)
                    out.clear()
            if out:
                yield _batch(out)

    @tidy
    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their groups: leaves of a group, or starts already known to be repeats of a
        part of the documents; out come such starts."""
        press, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        leaves: list[bytes] = []
        last = None

        def solved() -> Iterator[pa.RecordBatch]:
            if not leaves:
                return
            got = [unpacked(press, x) for x in leaves]
            leaves.clear()
            base = np.cumsum([0, *(len(x[1]) for x in got)])
            path = np.concatenate([x[0] for x in got])
            ids, keys = np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
            row = np.concatenate([x[3].astype(np.int64) + n for x, n in zip(got, base, strict=False)])
            start = np.concatenate([x[4] for x in got])
            del got
            order = np.argsort(path)
            same = _same(path[order])
            order = order[same | np.append(same[1:], False)]  # suffixes that share a deep node with another
            order = order[np.lexsort((start[order], ids[row[order]], path[order]))]
            path, row, start = path[order], row[order], start[order]
            gone = repeats(path, ids[row], start)
            rows = _spread(squeeze, n_groups, ids, keys, row[gone], start[gone])
            for i in range(0, len(rows), 5000):
                yield _batch(rows[i : i + 5000])

        for b in batches:
            part, known, data = (c.to_pylist() for c in b.columns)
            done = []
            for p, k, x in zip(part, known, data, strict=True):
                if p != last:
                    yield from solved()
                    last = p
                if k:
                    done.append((p, True, x))
                else:
                    leaves.append(x)
            if done:
                yield _batch(done)
        yield from solved()

    dealt = cols.mapInArrow(deal, DEALT).repartition("part").sortWithinPartitions("part").mapInArrow(subtrees, DEALT)
    found = stored(dealt.select("part", F.col("leaves").alias("starts")), "repeats")

    @tidy
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [None if t is None else press.compress(t) for t in b.column(3).to_pylist()]
            yield b.set_column(3, "text", pa.array(z, pa.binary()))

    texts = cols.select(F.pmod("key", F.lit(n_groups).cast("bigint")).alias("part"), "doc_id", "key", "text")
    texts = texts.mapInArrow(squeeze, texts.schema)  # shuffled, so compressed
    none = {c: F.lit(None).cast(t) for c, t in (("doc_id", "bigint"), ("key", "bigint"), ("text", "binary"))}
    both = texts.withColumn("starts", F.lit(None).cast("binary")).unionByName(found.withColumns(none))
    both = both.withColumn("last", F.col("starts").isNull())
    both = both.repartition("part").sortWithinPartitions("part", "last")

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of parts, the starts of the part's repeated windows before its documents."""
        press = zstandard.ZstdDecompressor()
        last, packs, starts = None, [], None
        for b in batches:
            part, ids, keys, texts, data, final = b.columns
            part, ids, keys, final = part.to_pylist(), ids.to_pylist(), keys.to_pylist(), final.to_pylist()
            out: list[tuple] = []
            size = 0
            for i, doc in enumerate(ids):
                if part[i] != last:
                    last, packs, starts = part[i], [], None
                if not final[i]:
                    packs.append(data[i].as_py())
                    continue
                if starts is None:
                    starts, packs = Starts([unpacked(press, x) for x in packs]), []
                z = texts[i].as_py()
                words = press.decompress(z).split() if z else []
                spans: list[dict] = []
                kept, n = words, 0
                at = starts.of(doc, keys[i]) if doc is not None else ()
                if len(at):
                    edge = np.flatnonzero(np.diff(at, prepend=-min_words - 1) > min_words)
                    a, z = at[edge], at[np.append(edge[1:], len(at)) - 1] + min_words
                    spans = [{"start": x, "words": y - x} for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                    kept, here = [], 0
                    for x, y in zip(a.tolist(), z.tolist(), strict=True):
                        kept += words[here:x]
                        here, n = y, n + y - x
                    kept += words[here:]
                out.append((doc, b" ".join(kept), len(words), n, spans))
                size += len(out[-1][1])
                if size > 8_000_000 or len(out) >= 1000:
                    yield _results(out)
                    out, size = [], 0
            if out:
                yield _results(out)

    rows = both.mapInArrow(keep, RESULT)
    return rows.withColumn("text", F.col("text").cast("string"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def _results(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), _SPANS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=["doc_id", "text", "n_words", "n_removed", "spans"])
