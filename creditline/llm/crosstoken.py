"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE (``tokenizers``), tokenizer B a sentencepiece
model with byte fallback; B puts a space before a text, so A gets that space too.

Both libraries say where a token lies: A by character offsets, B by the spans of
its proto.  These are the coarse cuts: where the characters around a token's end
are whole, its byte offset follows from the character offset.  Tokens that end
inside a character (byte-level tokens of a multibyte character, byte-fallback
tokens) share one character span or have an empty one; the bytes that their ids
stand for, laid end to end from the last sure cut, refine it.

Neither tokenizer ever joins what lies on both sides of a single space between two
non-space characters (A's pre-tokenizer cuts there; no piece of B's vocabulary has
a space after another character, which the constructor checks).  So a text is cut
there, both tokenizers end a token at every such cut, and a piece's alignment holds
wherever it stands: a worker aligns the new pieces of some texts in one go and
remembers them.

Counts of linked id pairs are summed over the corpus.  The COMMON most frequent
pairs are broadcast, so that a pair that is in every document meets no shuffle; the
links of all rarer pairs are joined with their counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.llm.common import stored

#: Pairs whose counts are broadcast (12 bytes each, 12 MB); the rest is joined.
COMMON = 1 << 20
#: Pieces a worker remembers before it starts anew, about 350 bytes each.
CACHE_PIECES = 300_000
#: Pairs a task counts before it hands its counts on.
PAIRS_IN_TASK = 400_000
_PLACES = re.compile(r"(?<=\S)(?= \S)")
_TWO_SPACES = re.compile(r"\s\s")
SPANS = "a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>, group_ends array<int>"


def byte_alphabet() -> dict[str, int]:
    """Characters by which a byte-level vocabulary writes bytes: printable ones of
    Latin-1 as themselves, the others from U+0100 on in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refine(char_ends: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte offsets of tokens' ends.  ``char_ends`` are the coarse cuts (characters before
    each token's end, counted up to the end of the character it touches), ``starts`` the byte
    offset of every character and of the text's end, ``lengths`` the bytes of each token.

    A coarse cut holds if the decoded bytes since the last one that holds reach it exactly;
    else the token ends inside the character, where its bytes end."""
    coarse = starts[char_ends]
    reached = np.cumsum(lengths)
    return np.where(reached == coarse, coarse, reached)


def _ragged(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the rows ``which`` of a ragged array whose row i is flat[at[i]:at[i + 1]]."""
    n = at[which + 1] - at[which]
    return flat[np.repeat(at[which] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


class Aligner:
    """Both tokenizers and the alignments of the pieces met so far; one per worker."""

    def __init__(self, path_a: str, path_b: str, keep_spans: bool = False):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in s) if all(c in alphabet for c in s) else s.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.length_a, self.length_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        #: whether texts may be cut into pieces for B
        self.cuts = not any("▁" in s.lstrip("▁") for s in names)
        #: ids as they stand before each kind of mark
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(max(len(self.bytes_a), len(names)))]
        self.keep_spans = keep_spans
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.texts: list[str] = []
        self.numbers = np.empty((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.flat = {k: np.empty(0, np.uint32) for k in ("links", "a_ids", "a_ends", "b_ids", "b_ends", "group_ends")}
        self.at = {k: np.zeros(1, np.int64) for k in self.flat}
        self.sizes = np.empty(0, np.int64)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, their byte ends, B ids, their byte ends) of a text that begins with the space
        that B adds; None if either tokenizer's bytes are not the text's."""
        raw = text.encode()
        e = self.a.encode(text, add_special_tokens=False)
        pieces = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=False)
        ids_a, ids_b = e.ids, pieces["ids"]
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return None
        starts = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a = np.fromiter((x[1] for x in e.offsets), np.int64, len(ids_a))
        # B's spans count from after the space that it adds
        ends_b = np.fromiter((x[1] for x in pieces["offsets"]), np.int64, len(ids_b)) + 1
        return (ids_a, refine(ends_a, starts, self.length_a[ids_a]), ids_b, refine(np.minimum(ends_b, len(starts) - 1), starts, self.length_b[ids_b]))

    def learn(self, parts: list[str]) -> None:
        """Align new pieces: those that begin with a single space and end with another character in one
        go, as their tokens do not change when they are joined."""
        plain = [p for p in parts if self.cuts and len(p) > 1 and not p[1].isspace() and not p[-1].isspace()]
        done: set[str] = set()
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            t = self.tokens("".join(some))
            if t is not None:
                self.add(some, t)
                done.update(some)
        for p in parts:
            if p not in done:
                t = self.tokens(p)
                if t is None:
                    self.known[p] = -1
                else:
                    self.add([p], t)

    def add(self, parts: list[str], tokens: tuple[np.ndarray, ...]) -> None:
        a, a_ends, b, b_ends = tokens
        sizes = np.array([len(p.encode()) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        piece_of = [np.searchsorted(ends, x) for x in (a_ends, b_ends, cuts)]
        # token i of A overlaps the tokens of B from the first that ends after its start
        # to the first that ends at or after its end
        lo = np.searchsorted(b_ends, np.concatenate([[0], a_ends[:-1]]), "right")
        n = np.searchsorted(b_ends, a_ends) - lo + 1
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        links = (np.repeat(a, n).astype(np.uint32) << np.uint32(15)) | b[at].astype(np.uint32)
        m = len(parts)
        counts = np.stack([np.bincount(piece_of[0], minlength=m), np.bincount(piece_of[1], minlength=m),
                           np.bincount(piece_of[2], minlength=m), np.bincount(np.repeat(piece_of[0], n), minlength=m)], axis=1)
        # the groups' ids as text: a group's tokens of A, then those of B; | and ; after the last of each
        group = np.concatenate([np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)])
        is_b = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + is_b, kind="stable")
        side = (2 * group + is_b)[order]
        last = np.append(side[1:] != side[:-1], True)
        marks = np.where(last, 1 + (side & 1), 0)
        words = list(map(self.shown.__getitem__, (marks * (len(self.shown) // 3) + np.concatenate([a, b])[order]).tolist()))
        length = np.cumsum([len(x) for x in words])
        text = "".join(words)
        stop = length[np.cumsum(counts[:, 0] + counts[:, 1]) - 1].tolist()
        first = len(self.texts)
        self.texts += [text[x : y - 1] for x, y in zip([0, *stop[:-1]], stop, strict=True)]
        self.known.update(zip(parts, range(first, first + m), strict=True))
        self.numbers = np.concatenate([self.numbers, counts])
        self.sizes = np.concatenate([self.sizes, sizes])
        new = {"links": (links, counts[:, 3])}
        if self.keep_spans:
            base = ends - sizes
            new |= {"a_ids": (a, counts[:, 0]), "a_ends": (a_ends - base[piece_of[0]], counts[:, 0]), "b_ids": (b, counts[:, 1]),
                    "b_ends": (b_ends - base[piece_of[1]], counts[:, 1]), "group_ends": (cuts - base[piece_of[2]], counts[:, 2])}
        for k, (x, c) in new.items():
            self.flat[k] = np.concatenate([self.flat[k], x.astype(np.uint32)])
            self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + np.cumsum(c)])

    def parts(self, text: str) -> list[str]:
        """The pieces of space + text."""
        if not self.cuts:
            return [" " + text]
        if text[0] == " " or _TWO_SPACES.search(text):
            return _PLACES.split(" " + text)
        out = [" " + p for p in text.split(" ")]
        if out[-1] == " " and len(out) > 1:  # a space at the end stays with the word before it
            out[-2:] = [out[-2] + " "]
        return out

    def align(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Numbers of the pieces of each text; None if it has no tokens."""
        if len(self.texts) > CACHE_PIECES:
            self.clear()
        parts = [self.parts(t) if t else [] for t in texts]
        new = {p for ps in parts for p in ps if p not in self.known}
        if new:
            self.learn(sorted(new))
        out = []
        for ps in parts:
            ks = np.fromiter(map(self.known.__getitem__, ps), np.int64, len(ps))
            out.append(ks if len(ks) and ks.min() >= 0 else None)
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, keep_spans: bool = False) -> Aligner:
    return Aligner(path_a, path_b, keep_spans)


def paths() -> tuple[str, str]:
    """Paths of the public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row doc_id, a_ids, a_ends, b_ids, b_ends, group_ends: both tokenizers' ids, the byte
    offsets (in space + text) of their ends, and of the ends that both have.

    Texts null, empty, or whose bytes either tokenizer changes have empty arrays.  Every row is
    answered by itself, so repeated ids and rows are answered as often as they come and a null id
    is kept; texts are never cut short; columns other than doc_id and text are not read; an empty
    table gives an empty result."""
    a, b = path_a or paths()[0], path_b or paths()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = aligner(a, b, True)
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                c = batch.slice(i, 50)
                out: list[list] = [[], [], [], [], []]
                for ks in t.align(c.column(1).to_pylist()):
                    ks = np.empty(0, np.int64) if ks is None else ks
                    base = np.cumsum(t.sizes[ks]) - t.sizes[ks]
                    for name, o in zip(("a_ids", "a_ends", "b_ids", "b_ends", "group_ends"), out, strict=True):
                        x, n = _ragged(t.flat[name], t.at[name], ks)
                        o.append((x + np.repeat(base, n) if name.endswith("ends") else x).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), *[pa.array(o, pa.list_(pa.int32())) for o in out]],
                    names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "group_ends"])

    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, f"doc_id bigint, {SPANS}")


ENCODED = ("pair_a int, pair_b int, count bigint, row_key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups_sha256 string, links binary")


def _encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document (pair_a null), its distinct linked pairs with their numbers packed in ``links``;
    and rows (pair_a, pair_b, count) that sum up to the corpus' counts of linked pairs."""
    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("pair_a", pa.int32()), ("pair_b", pa.int32()), ("count", pa.int64()), ("row_key", pa.int64()), ("doc_id", pa.int64()),
                        ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                        ("groups_sha256", pa.string()), ("links", pa.binary())])

    def counted(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array((pairs >> np.uint32(15)).astype(np.int32)), pa.array((pairs & np.uint32(0x7FFF)).astype(np.int32)), pa.array(n),
             none, none, none, none, none, none, pa.nulls(len(pairs), pa.string()), pa.nulls(len(pairs), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        all_pairs, all_n = np.empty(0, np.uint32), np.empty(0, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500)
                found = t.align(c.column(1).to_pylist())
                k = len(found)
                sizes = np.array([0 if ks is None else len(ks) for ks in found])
                pieces = np.concatenate([np.empty(0, np.int64), *[ks for ks in found if ks is not None]])
                doc = np.repeat(np.arange(k), sizes)
                numbers = np.zeros((k, 4), np.int64)
                np.add.at(numbers, doc, t.numbers[pieces])
                links, n = _ragged(t.flat["links"], t.at["links"], pieces)
                both, n = np.unique((np.repeat(doc, n).astype(np.uint64) << np.uint64(32)) | links, return_counts=True)
                cut = np.searchsorted(both, np.arange(1, k).astype(np.uint64) << np.uint64(32))
                links, n = both.astype(np.uint32), n.astype(np.uint32)
                packed = [x.tobytes() + y.tobytes() for x, y in zip(np.split(links, cut), np.split(n, cut), strict=True)]
                sha = ["" if ks is None else hashlib.sha256(";".join(map(t.texts.__getitem__, ks.tolist())).encode()).hexdigest() for ks in found]
                all_pairs, back = np.unique(np.concatenate([all_pairs, links]), return_inverse=True)
                all_n = np.bincount(back, np.concatenate([all_n, n]), len(all_pairs)).astype(np.int64)
                if len(all_pairs) > PAIRS_IN_TASK:
                    yield counted(all_pairs, all_n)
                    all_pairs, all_n = all_pairs[:0], all_n[:0]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(np.arange(row, row + k)), c.column(0),
                     *[pa.array(x) for x in numbers.T.copy()], pa.array(sha, pa.string()), pa.array(packed, pa.binary())], schema=schema)
                row += k
        if len(all_pairs):
            yield counted(all_pairs, all_n)

    return stored(cols.mapInArrow(run, ENCODED), "aligned")


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, common: int = COMMON) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a and n_b (tokens), n_groups, n_links (A-B token occurrences whose
    bytes overlap), n_best (links whose pair's corpus count is the highest of its B id, ties included),
    count_sum (of the corpus counts over the links), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``, the ids of
    the groups in order).

    Texts null, empty, or whose bytes either tokenizer changes have no tokens: zeros and ''.  Rows are
    told apart by a key of their own, so repeated ids and rows are answered as often as they come (each
    row's links count); a null id is kept.  Texts are never cut short.  Columns other than doc_id and
    text are not read; an empty table gives an empty result.  ``common`` only says how many pairs'
    counts are broadcast; all others are joined."""
    a, b = path_a or paths()[0], path_b or paths()[1]
    spark = docs.sparkSession
    table = _encode(docs, a, b)
    counts = table.where("pair_a is not null").groupBy("pair_a", "pair_b").agg(F.sum("count").alias("count"))
    counts = stored(counts, "pairs")
    # one row for each id of B's vocabulary
    best = {r["pair_b"]: r["best"] for r in counts.groupBy("pair_b").agg(F.max("count").alias("best")).collect()}
    frequent = counts.orderBy(F.desc("count"), "pair_a", "pair_b").limit(common).toArrow()
    keys = (frequent["pair_a"].to_numpy().astype(np.uint32) << np.uint32(15)) | frequent["pair_b"].to_numpy().astype(np.uint32)
    order = np.argsort(keys)
    top = np.zeros(1 << 15, np.int64)
    top[list(best)] = list(best.values())
    n_counts = counts.count()
    shared = spark.sparkContext.broadcast((keys[order], frequent["count"].to_numpy()[order], top))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner.cache_clear()  # this worker may have encoded before
        keys, found, top = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                c = batch.slice(i, 500)
                raw = [np.frombuffer(x, np.uint32) for x in c.column("links").to_pylist()]
                sizes = [len(x) // 2 for x in raw]
                row = np.repeat(np.arange(len(raw)), sizes)
                pairs = np.concatenate([x[:s] for x, s in zip(raw, sizes, strict=True)])
                n = np.concatenate([x[s:] for x, s in zip(raw, sizes, strict=True)]).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                count = np.where(hit, found[at] if len(keys) else 0, 0)
                is_best = hit & (count == top[pairs & np.uint32(0x7FFF)])
                sums = np.zeros((2, len(raw)), np.int64)
                np.add.at(sums[0], row, np.where(is_best, n, 0))
                np.add.at(sums[1], row, n * count)
                left = np.split(np.flatnonzero(~hit), np.searchsorted(row[~hit], np.arange(1, len(raw))))
                rest = [[{"pair_a": int(p >> 15), "pair_b": int(p & 0x7FFF), "n": int(m)} for p, m in zip(pairs[x].tolist(), n[x].tolist(), strict=True)]
                        for x in left]
                yield pa.RecordBatch.from_arrays(
                    [*[c.column(k) for k in KEPT], pa.array(sums[0]), pa.array(sums[1]), pa.array(rest, REST)],
                    names=[*KEPT, "n_best", "count_sum", "rest"])

    KEPT = ["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    REST = pa.list_(pa.struct([("pair_a", pa.int32()), ("pair_b", pa.int32()), ("n", pa.int64())]))
    rows = table.where("pair_a is null").select(*KEPT, "links").mapInArrow(
        score, "row_key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
               "n_best bigint, count_sum bigint, rest array<struct<pair_a:int,pair_b:int,n:bigint>>")
    if n_counts > common:
        rows = stored(rows, "scored")
        tops = counts.groupBy("pair_b").agg(F.max("count").alias("best"))
        rare = rows.select("row_key", F.explode("rest").alias("x")).select("row_key", "x.*").join(counts, ["pair_a", "pair_b"]).join(tops, "pair_b")
        more = rare.groupBy("row_key").agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)).alias("more_best"),
                                           F.sum(F.col("n") * F.col("count")).alias("more_sum"))
        rows = rows.join(more, "row_key", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
