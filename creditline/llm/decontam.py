"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles into classes
(u/2, u].  Jaccard similarity of a short item and a long document tends to
zero, so a document is compared window by window: for class u, windows of 1.5 u
shingles that start every u/4 shingles, so that any passage of up to 1.25 u
shingles lies inside one window.  An item whose containment is at least 0.8
then has a Jaccard similarity of at least 1/4 with a window (1/3 if the whole
item is there), and is missed by all of the 40 one-row MinHash bands with a
probability of 0.75^40 = 1e-5 (0.67^40 = 1e-7) at most.  Candidates are verified by
exact containment of the item's shingles in the document's.

The items are the query set: they are hashed once into a written table (shingle
set and MinHash values), and broadcast in blocks of a stated size (BLOCK_ITEMS
items of together at most BLOCK_SHINGLES shingles, 32 MB).  Every block is
searched in all documents, so documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import hash_words, shingles, small_batches, stored, tidy

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 40
BLOCK_ITEMS = 65_536
BLOCK_SHINGLES = 4_000_000
#: Documents of a batch are searched together up to this many bytes.
GROUP_BYTES = 2_000_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = "doc_id bigint, item_id bigint, containment double, matched bigint, item_shingles bigint"

_ODD = (np.random.default_rng(20).integers(0, 1 << 62, BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PUNCT = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def plain(text: str) -> bytes:
    """Lower-cased text with ASCII punctuation as white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PUNCT)


def words_of(text: str) -> list[str]:
    """Lower-cased words; ASCII punctuation and white space separate them."""
    return [w.decode("utf-8", "surrogatepass") for w in plain(text).split()]


def hashed(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words per shingle, distinct shingles and their BANDS smallest products, 64-bit each) of the
    items that hold words, in the shared folder."""
    small_batches(items.sparkSession)
    cols = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = hash_words([plain(t.as_py() or "") for t in b.column(1)])
            at = [i for i, w in enumerate(words) if len(w)]
            sets = [np.unique(shingles(words[i], SHINGLE)) for i in at]
            low = [np.array([(s * a).min() for a in _ODD], np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array([min(SHINGLE, len(words[i])) for i in at], pa.int32()),
                 pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())],
                names=["item_id", "size", "grams", "low"])

    return stored(cols.mapInArrow(run, "item_id bigint, size int, grams binary, low binary"), "items")


class Items:
    """A block of hashed items, by shingle length and size class."""

    def __init__(self, items: list[tuple[int | None, int, bytes, bytes]]):
        self.ids, index = [i[0] for i in items], {}
        self.sets = [np.frombuffer(i[2], np.uint64) for i in items]
        for at, (_, size, _, _) in enumerate(items):
            u = 1
            while u < len(self.sets[at]):
                u *= 2
            index.setdefault((size, u), []).append(at)
        self.classes = []
        for (size, u), members in sorted(index.items()):
            sig = np.array([np.frombuffer(items[i][3], np.uint64) for i in members])
            # low bits of the values seen: 16 to 32 places for each member
            mask = np.uint64((1 << max(16, len(members).bit_length() + 4)) - 1)
            bands = []
            for k in range(BANDS):
                order = np.argsort(sig[:, k], kind="stable")
                seen = np.zeros(int(mask) + 1, bool)
                seen[(sig[:, k] & mask).astype(np.int64)] = True
                bands.append((sig[order, k], np.array(members)[order], seen))
            self.classes.append((size, u, bands))

    def candidates(self, docs: list[np.ndarray], size: int, u: int, bands: list) -> set[tuple[int, int]]:
        """(document, item) pairs with a window and an item that share a MinHash value."""
        step, n_blocks = max(1, u // 4), {1: 1, 2: 3}.get(u, 6)
        rows = [i for i, d in enumerate(docs) if len(d)]
        if not rows:
            return set()
        lens = np.array([len(docs[i]) for i in rows])
        blocks = -(-lens // step)
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        # a document's blocks are followed by n_blocks - 1 empty ones, so no window crosses into the next
        place = np.concatenate([[0], np.cumsum(blocks + n_blocks - 1)[:-1]])
        doc = np.repeat(np.arange(len(rows)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        cuts, slots = first[doc] + nth * step, place[doc] + nth
        h = np.concatenate([docs[i] for i in rows])
        low = np.full(int(place[-1] + blocks[-1] + n_blocks - 1), NONE)
        found = set()
        for k, (sig, member, seen) in enumerate(bands):
            low[slots] = np.minimum.reduceat(h * _ODD[k], cuts)
            window = low[: len(low) - n_blocks + 1].copy()
            for s in range(1, n_blocks):
                np.minimum(window, low[s : len(low) - n_blocks + 1 + s], out=window)
            window = window[slots]
            hit = np.flatnonzero(seen[(window & np.uint64(len(seen) - 1)).astype(np.int64)])
            if not len(hit):
                continue
            a = np.searchsorted(sig, window[hit], "left")
            b = np.searchsorted(sig, window[hit], "right")
            for x, lo, hi in zip(hit[b > a], a[b > a], b[b > a], strict=True):
                found.update((rows[doc[x]], int(m)) for m in member[lo:hi])
        return found

    def search(self, words: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, int]]:
        """(document, item, matched shingles) of all pairs that reach the threshold."""
        by_size = {size: [shingles(w, size) if len(w) >= size else w[:0] for w in words] for size, _, _ in self.classes}
        for size, u, bands in self.classes:
            docs = by_size[size]
            sets: dict[int, np.ndarray] = {}
            for d, i in sorted(self.candidates(docs, size, u, bands)):
                if d not in sets:
                    sets = {d: np.unique(docs[d])}
                at = np.searchsorted(sets[d], self.sets[i])
                matched = int((sets[d][np.minimum(at, len(sets[d]) - 1)] == self.sets[i]).sum())
                if matched >= threshold * len(self.sets[i]):
                    yield d, i, matched


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, int, bytes, bytes]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len(row["grams"]) // 8
        if block and (len(block) >= BLOCK_ITEMS or size + n > BLOCK_SHINGLES):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["size"], bytes(row["grams"]), bytes(row["low"])))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
                 doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, containment, matched, item_shingles) of documents
    that hold at least ``threshold`` of an item's distinct five-word shingles.

    An item of fewer words counts as one shingle of all its words; items and
    documents without words (null, empty) match nothing.  Repeated documents
    or items each give rows of their own; null ids stay null.  Long texts are
    searched whole.  Empty tables give an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))

    def searched(block: list[tuple[int | None, int, bytes, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Items(shared.value)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1)
                at = 0
                while at < b.num_rows:
                    group, n = [], 0
                    while at + len(group) < b.num_rows and n < GROUP_BYTES:
                        group.append(plain(texts[at + len(group)].as_py() or ""))
                        n += len(group[-1])
                    words = hash_words(group)
                    rows = [
                        (ids[at + d], found.ids[i], m / len(found.sets[i]), m, len(found.sets[i]))
                        for d, i, m in found.search(words, threshold)
                    ]
                    if rows:
                        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                        names = ["doc_id", "item_id", "containment", "matched", "item_shingles"]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
                        )
                    at += len(words)

        return cols.mapInArrow(run, RESULT)

    parts = [searched(block) for block in _blocks(hashed(items, item_id, item_text))]
    if not parts:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionAll, parts)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text holds an item.

    Rows are judged by their text, known by a 64-bit hash of id and text: of
    rows that share an id only those go that hold an item; rows with a null id
    are kept.  The hashes found are written first, so that Spark knows their
    size and moves the documents only where they are too many to send."""
    row = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    known = docs.where("doc_id is not null").select(row.alias("row"), F.col("text"))
    found = contaminated(known, items, threshold, doc_id="row")
    mark = f"row_{uuid.uuid4().hex}"
    bad = stored(found.select(F.col("doc_id").alias(mark)).distinct(), "contaminated")
    return docs.withColumn(mark, F.when(F.col("doc_id").isNotNull(), row)).join(bad, mark, "left_anti").select(docs.columns)


_MARKS = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDS = rf"list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{_MARKS}', '{' ' * 32}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH items AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT i, item_id, w, least({SHINGLE}, len(w)) AS n FROM items WHERE len(w) > 0),
item_at AS (SELECT i, item_id, n, w, UNNEST(range(1, len(w) - n + 2)) AS k FROM sized),
item_grams AS (SELECT DISTINCT i, item_id, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM item_at),
item_size AS (SELECT i, COUNT(*) AS size FROM item_grams GROUP BY i),
docs AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
doc_at AS (SELECT d, doc_id, n, w, UNNEST(range(1, len(w) - n + 2)) AS k
           FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
doc_grams AS (SELECT DISTINCT d, doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM doc_at),
hits AS (SELECT d, doc_id, i, item_id, COUNT(*) AS matched
         FROM doc_grams JOIN item_grams USING (n, gram) GROUP BY d, doc_id, i, item_id)
SELECT doc_id, item_id, matched / CAST(size AS DOUBLE) AS containment, matched, size AS item_shingles
FROM hits JOIN item_size USING (i) WHERE matched >= {THRESHOLD} * size
"""
