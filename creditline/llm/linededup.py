"""Line dedup by pairwise alignment.

Texts differ in where they break lines, and a shared passage may start in the
middle of one.  So documents are re-flowed into content-defined lines: of every
WINDOW successive runs of LINE words the one with the smallest hash starts a
line (winnowing).  Two texts that share LINE + WINDOW - 1 = 49 or more words in
a row thus share a line hash, wherever their own line breaks are.

A line does not yet mean a common block: it may stand in a frequent sentence.  So
holders of a line are told apart by the words around it, as far as a run of
MIN_WORDS words that contains the line can reach.  Documents with the same line
and surroundings are linked to the first of them.  Of lines with more than two
different surroundings, the first document of each gives the hashes of its runs
of MIN_WORDS words whose smallest part is the line, and every holder of a run is
linked to the first one.  So every run that an earlier document holds has a link
to a document that holds it, n holders make n - 1 links, not n * n / 2, and no
common line has to be dropped.  Each linked pair is aligned by patience diff: lines unique in both
texts are matched along their longest increasing sequence, matches are grown
word by word in both directions, and the gaps are aligned the same way.  What the
alignment leaves is compared exactly, run by run.  Common blocks of at least
MIN_WORDS words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditline.llm.common import IdFilter, hash_words, shingles, small_batches, span_hashes, stored, tidy, word_bounds

LINE = 16
WINDOW = 34
MIN_WORDS = 50
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words of partners' texts that a worker keeps hashed (16 bytes each with their lines).
REMEMBERED_WORDS = 1_000_000
#: Bytes of texts that are hashed in one go.
HASHED_BYTES = 1 << 18
RESULT = "doc_id bigint, text string, words_removed bigint, blocks_removed bigint, partners array<bigint>"


def line_starts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the content-defined lines of a text of hashed words."""
    if len(words) < LINE:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = shingles(words, LINE)
    low = np.concatenate([h, np.full(WINDOW - 1, _TOP)])
    low = np.lib.stride_tricks.sliding_window_view(low, WINDOW).min(axis=1) if len(h) < 64 else _slide(low, np.minimum)
    top = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low])
    at = np.flatnonzero(_slide(top, np.maximum) == h)
    return at, h[at]


def _slide(x: np.ndarray, best, window: int = WINDOW) -> np.ndarray:
    """``best`` of every ``window`` successive values, by doubling."""
    n, width = len(x) - window + 1, 1
    while width * 2 <= window:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[:n], x[window - width : window - width + n])


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops, ends, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        m = min(n - at, step)
        differ = np.flatnonzero(a[at : at + m] != b[at : at + m])
        if len(differ):
            return at + int(differ[0])
        at, step = at + m, step * 4
    return n


class Lines:
    """A text's hashed words and its lines."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.at, self.hash = (x.tolist() for x in line_starts(words))
        self.known = set(self.hash)
        self._runs: tuple[int, np.ndarray] | None = None

    def once(self, lo: int, hi: int) -> dict[int, int]:
        """Places of the lines of words lo to hi, in order; -1 for a line that stands there more than once."""
        i, j = bisect_left(self.at, lo), bisect_left(self.at, hi - LINE + 1)
        places: dict[int, int] = {}
        for p, h in zip(self.at[i:j], self.hash[i:j], strict=True):
            places[h] = -1 if h in places else p
        return places

    def runs(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, ascending."""
        if self._runs is None or self._runs[0] != size:
            x = np.arange(max(len(self.words) - size + 1, 0))
            self._runs = size, np.sort(span_hashes(self.words, x, x + size))
        return self._runs[1]


def patience(a: Lines, b: Lines) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, words), in order in both texts."""
    blocks, todo = [], [(0, len(a.words), 0, len(b.words))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 < LINE or b1 - b0 < LINE:
            continue
        in_b = b.once(b0, b1)
        in_a = a.once(a0, a1) if in_b else in_b
        both = [(in_a[h], q) for h, q in in_b.items() if q >= 0 and in_a.get(h, -1) >= 0]
        if not both:
            continue
        at_a, at_b = [p for p, _ in both], [q for _, q in both]
        low_a, low_b, here = a0, b0, []
        for i in _increasing(at_a):
            p, q = at_a[i], at_b[i]
            if p < low_a or q < low_b:
                continue
            back = _run(a.words[low_a:p][::-1], b.words[low_b:q][::-1])
            n = _run(a.words[p:a1], b.words[q:b1])
            if n >= LINE:
                here.append((p - back, q - back, n + back))
                low_a, low_b = p + n, q + n
        low_a, low_b = a0, b0
        for p, q, n in here:
            todo.append((low_a, p, low_b, q))
            low_a, low_b = p + n, q + n
        if here:
            todo.append((low_a, a1, low_b, b1))
        blocks.extend(here)
    return sorted(blocks)


def repeated(a: Lines, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, words) of the parts of ``b`` that its runs of ``size`` words standing in ``a`` cover."""
    if min(len(a.words), len(b)) < size:
        return []
    at, held = np.arange(len(b) - size + 1), a.runs(size)
    run = span_hashes(b, at, at + size)
    at = at[held[np.minimum(np.searchsorted(held, run), len(held) - 1)] == run]
    cover = np.zeros(len(b) + 1, np.int64)
    cover[at] += 1
    cover[at + size] -= 1
    return _covered(np.cumsum(cover) > 0)


def _covered(mark: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the stretches of marked words; the last mark is unset."""
    edges = np.flatnonzero(np.concatenate([mark[:1], mark[1:] != mark[:-1]]))
    return [(i, j - i) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def common_blocks(a: Lines, b: Lines, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Word ranges of ``b`` that blocks of at least ``min_words`` words aligned with ``a`` cover.

    What is left of ``b`` is aligned again as long as a line of it stands in ``a``,
    so that passages in another order than in ``a`` are found as well.  Where the
    alignment finds nothing more (no line is unique in both texts, or the blocks lose
    to shorter ones), what is left is compared exactly, run by run."""
    if np.array_equal(a.words, b.words):
        return [(0, len(b.words))] if len(b.words) >= min_words else []
    gone = np.zeros(len(b.words) + 1, bool)
    shared = np.array([p for p, h in zip(b.at, b.hash, strict=True) if h in a.known], np.int64)
    rest, place = b, np.arange(len(b.words))
    while len(rest.words) >= min_words and not (gone[shared] | gone[shared + LINE - 1]).all():
        found = [(q, n) for _, q, n in patience(a, rest) if n >= min_words]
        aligned = bool(found)
        if not aligned:
            found = repeated(a, rest.words, min_words)
        keep = np.ones(len(rest.words), bool)
        for q, n in found:
            keep[q : q + n] = False
        gone[place[~keep]] = True
        if not aligned:
            break
        # a mark between what was apart keeps new runs from forming across a deleted block
        place = place[keep]
        words = rest.words[keep].copy()
        joint = np.flatnonzero(np.diff(place) > 1)
        if len(joint):
            words = np.insert(words, joint + 1, _TOP - joint.astype(np.uint64))
            place = np.insert(place, joint + 1, place[joint])
        rest = Lines(words)
    return [(i, i + n) for i, n in _covered(gone)]


def delete_ranges(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these ranges of its words; each takes the white space after it along."""
    return _without(text.encode("utf-8", "surrogatepass"), ranges)


def _without(data: bytes, ranges: list[tuple[int, int]]) -> str:
    starts, _ = word_bounds(data)
    out, at = [], 0
    for a, b in ranges:
        out.append(data[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(data)
    out.append(data[at:])
    kept = b"".join(out).decode("utf-8", "surrogatepass")
    return kept.rstrip() if ranges and ranges[-1][1] == len(starts) else kept


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _contexts(texts: list[np.ndarray], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, hash of the words that runs of ``min_words`` words with it hold), distinct, by text.

    All texts at once: their runs of LINE words stand one text after the other, with WINDOW - 1 places
    between them that no window of another text can choose from."""
    n = np.array([len(w) if len(w) >= min_words else 0 for w in texts], np.int64)
    words = np.concatenate([np.empty(0, np.uint64), *[w for w, m in zip(texts, n, strict=True) if m]])
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    used = np.flatnonzero(n)
    runs = n[used] - LINE + 1
    first = np.cumsum(n[used]) - n[used]  # of a text among the words
    place = np.cumsum(runs + WINDOW - 1) - (runs + WINDOW - 1)  # of its runs among the places
    at_word = np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    at_place = np.repeat(place - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    h = np.full(int((runs + WINDOW - 1).sum()), _TOP)
    h[at_place] = shingles(words, LINE)[at_word]
    low = np.zeros(len(h), np.uint64)
    low[at_place] = _slide(np.concatenate([h, np.full(WINDOW - 1, _TOP)]), np.minimum)[at_place]
    best = _slide(np.concatenate([np.zeros(WINDOW - 1, np.uint64), low]), np.maximum)
    hit = np.flatnonzero(best[at_place] == h[at_place])
    text = np.repeat(np.arange(len(used)), runs)[hit]
    at, line = at_word[hit], h[at_place[hit]]
    reach = min_words - LINE
    start, end = np.maximum(at - reach, first[text]), np.minimum(at + LINE + reach, (first + n[used])[text])
    around = span_hashes(words, start, end) + (at - start).astype(np.uint64)
    order = np.lexsort((around, line, text))
    text, line, around = text[order], line[order], around[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1]) | (around[1:] != around[:-1])
    return used[text[new]], line[new].view(np.int64), around[new].view(np.int64)


def _heads(ids: np.ndarray, text: np.ndarray, line: np.ndarray, around: np.ndarray) -> list[pa.Array]:
    """Lists by text: (lines, surroundings) that no smaller id of these texts has, and (surroundings, smallest id) of the others."""
    order = np.lexsort((ids[text], around))
    new = np.ones(len(order), bool)
    new[1:] = np.diff(around[order]) != 0
    head = np.empty(len(order), np.int64)
    head[order] = ids[text[order[new]]][np.cumsum(new) - 1]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    again = ids[text] > head

    def lists(which: np.ndarray, values: np.ndarray) -> pa.Array:
        ends = np.searchsorted(text[which], np.arange(len(ids) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[which], pa.int64()))

    return [lists(first, line), lists(first, around), lists(again, around), lists(again, head)]


def _links(docs: DataFrame, table: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, first): for every run of ``min_words`` words of a document that an earlier one holds, such a one."""
    heads = table.select("doc_id", F.explode(F.arrays_zip("lines", "around")).alias("x"))
    heads = heads.select("doc_id", F.col("x.lines").alias("line"), F.col("x.around").alias("around")).repartition("line")
    # surroundings hold their line, so one shuffle and one sort serve both windows
    by_around, by_line = Window.partitionBy("line", "around").orderBy("doc_id"), Window.partitionBy("line")
    heads = heads.withColumn("first", F.min("doc_id").over(by_around)).withColumn("n", F.row_number().over(by_around))
    context = F.when(F.col("n") == 1, F.col("doc_id"))
    heads = heads.withColumns({"spread": F.count(context).over(by_line), "least": F.min(context).over(by_line), "most": F.max(context).over(by_line)})
    heads = stored(heads.where("(n = 1 and least < most) or doc_id > first").select(
        "doc_id", "line", "around", "first", "spread", "least", "most"), "heads")
    contexts = heads.where("doc_id = first")
    later = heads.where("doc_id > first").select("doc_id", "around", "first")
    # a document that a smaller id of its own block stands for has the links of that one
    again = table.select("doc_id", F.explode(F.arrays_zip("again", "head")).alias("x"))
    again = again.select("doc_id", F.col("x.again").alias("around"), F.col("x.head").alias("head"))
    links = IdFilter(again, "around").split(later, "around", True).groupBy(F.col("doc_id").alias("head"), "around").agg(F.min("first").alias("first"))
    again = again.join(links, ["head", "around"], "left")
    same = later.select("doc_id", "first").unionByName(again.select("doc_id", F.coalesce("first", "head").alias("first")))
    two = contexts.where("spread = 2 and doc_id = most").select("doc_id", F.col("least").alias("first"))
    many = contexts.where("spread > 2")
    many = stored(many.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "many")
    texts = _pressed(IdFilter(many, "doc_id").split(docs.select("doc_id", "text"), "doc_id", True))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500)
                words = hash_words([_text(z, press) or b"" for z in c.column(1).to_pylist()])
                found = [_runs(w, line.values.to_numpy().view(np.uint64), min_words)
                         for w, line in zip(words, c.column(2), strict=True)]
                ids = np.repeat(c.column(0).to_numpy(), [len(r) for r in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found).view(np.int64))],
                                                 names=["doc_id", "run"])

    runs = stored(texts.join(many, "doc_id").mapInArrow(cut, "doc_id bigint, run bigint"), "runs")
    apart = runs.withColumn("first", F.min("doc_id").over(Window.partitionBy("run"))).where("doc_id > first")
    return same.unionByName(two).unionByName(apart.select("doc_id", "first")).distinct()


def _runs(words: np.ndarray, lines: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words whose smallest run of LINE words is one of ``lines``."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    low = _slide(shingles(words, LINE), np.minimum, size - LINE + 1)
    at = np.flatnonzero(np.isin(low, lines))
    return np.unique(span_hashes(words, at, at + size))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
               keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, text (without what earlier documents hold),
    words_removed, blocks_removed, partners (earlier documents that it was aligned
    with and lost words to, ascending), kept (a struct of the columns named in
    ``keep``, c0, c1, ... in their order).

    "Earlier" is a smaller doc_id; rows with equal ids are not compared with
    one another, rows with a null id are returned as they are.  A null text is
    returned as null; an empty text or one of fewer than ``min_words`` words has
    no blocks.  Texts without deletions come back unchanged.  An empty table
    gives an empty result; columns other than id and text are not read.

    Only documents that may have a partner, and texts that may be one, are
    shuffled; bitmaps of a fixed size tell them apart from the rest.  ``docs`` is
    read anew by each of these steps rather than copied, so it has to give the same
    rows every time.
    """
    if min_words < LINE + WINDOW - 1:
        raise ValueError(f"min_words must be at least {LINE + WINDOW - 1}")
    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)] or [F.lit(True).alias("none")]).alias("kept"))
    kept_type = cols.schema["kept"].dataType.simpleString()

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500)
                # a null id has no links
                words = hash_words([t.encode("utf-8", "surrogatepass") if t and known else b""
                                    for t, known in zip(c.column(1).to_pylist(), c.column(0).is_valid().to_pylist(), strict=True)])
                heads = _heads(c.column(0).fill_null(0).to_numpy(), *_contexts(words, min_words))
                yield pa.RecordBatch.from_arrays([c.column(0), *heads], names=["doc_id", "lines", "around", "again", "head"])

    lists = "lines array<bigint>, around array<bigint>, again array<bigint>, head array<bigint>"
    table = stored(cols.select("doc_id", "text").mapInArrow(split, f"doc_id bigint, {lists}"), "lines")
    pairs = stored(_links(cols, table, min_words), "pairs")
    earlier, later = IdFilter(pairs, "first"), IdFilter(pairs, "doc_id")
    holders = _pressed(earlier.split(cols.select("doc_id", "text"), "doc_id", True)).withColumnRenamed("doc_id", "first")
    partners = pairs.join(holders, "first").select(
        "doc_id", "first", "z", F.lit(None).cast(kept_type).alias("kept"))
    own = _pressed(later.split(cols, "doc_id", True)).select("doc_id", F.lit(None).cast("bigint").alias("first"), "z", "kept")
    aligned = own.unionByName(partners)
    aligned = aligned.repartition("doc_id").sortWithinPartitions("doc_id", F.col("first").asc_nulls_first())
    none = F.lit(0).cast("bigint")
    alone = later.split(cols, "doc_id", False).select(
        "doc_id", "text", none.alias("words_removed"), none.alias("blocks_removed"),
        F.array().cast("array<bigint>").alias("partners"), "kept")
    return aligned.mapInArrow(tidy(lambda it: _align(it, min_words)), f"{RESULT}, kept {kept_type}").unionByName(alone)


def _pressed(docs: DataFrame) -> DataFrame:
    """The rows with z, their compressed text, instead of the text."""
    kept = [f for f in docs.schema if f.name not in ("doc_id", "text")]

    @tidy
    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary()), *b.columns[2:]],
                                             names=["doc_id", "z", *[f.name for f in kept]])

    return docs.mapInArrow(press, ", ".join(["doc_id bigint", "z binary", *[f"{f.name} {f.dataType.simpleString()}" for f in kept]]))


def _text(z: bytes | None, press: zstandard.ZstdDecompressor) -> bytes | None:
    return None if z is None else press.decompress(z)


def _align(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc_id, a document's own rows before its partners'."""
    press = zstandard.ZstdDecompressor()
    own: list[dict] = []  # rows of the current id: one, unless rows repeat an id
    out: list[tuple] = []
    seen: dict[bytes, Lines] = {}  # partners that several documents have, by their compressed text
    size = 0

    def done() -> None:
        for d in own:
            ranges = _merged(d["ranges"])
            text = d["text"]
            if text is not None:
                text = _without(text, ranges) if ranges else text.decode("utf-8", "surrogatepass")
            out.append((d["doc_id"], text,
                        sum(b - a for a, b in ranges), len(ranges), d["partners"], d["kept"]))

    kind = pa.null()
    hashed: dict[bytes, np.ndarray] = {}  # words of the texts at hand
    for batch in batches:
        kind = batch.column(3).type
        ids, firsts, zs, kept = (c.to_pylist() for c in batch.columns)
        ready = 0
        for i, doc_id in enumerate(ids):
            if i == ready:
                ready, hashed = _hashed(zs, i, seen, press)
            if firsts[i] is None:
                if own and own[0]["doc_id"] != doc_id:
                    done()
                    own.clear()
                own.append({"doc_id": doc_id, "z": zs[i], "text": _text(zs[i], press), "kept": kept[i], "ranges": [], "partners": [], "lines": None})
                continue
            other = None
            for d in own:
                if d["doc_id"] != doc_id or len(d["text"] or b"") < min_words:
                    continue
                if zs[i] == d["z"]:
                    n = len(d["text"].split())
                    ranges = [(0, n)] if n >= min_words else []
                else:
                    if d["lines"] is None:
                        d["lines"] = seen.get(d["z"]) or Lines(hashed[d["z"]] if d["z"] in hashed else hash_words([d["text"]])[0])
                    other = other or seen.get(zs[i])
                    if other is None:
                        other = Lines(hashed[zs[i]] if zs[i] in hashed else hash_words([_text(zs[i], press) or b""])[0])
                        size += len(other.words)
                        if size > REMEMBERED_WORDS:
                            seen.clear()
                            size = len(other.words)
                        seen[zs[i]] = other
                    ranges = common_blocks(other, d["lines"], min_words)
                if ranges:
                    d["ranges"] += ranges
                    if firsts[i] not in d["partners"]:
                        d["partners"].append(firsts[i])
            if len(out) >= 1000:
                yield _batch(out, kind)
                out.clear()
    done()
    if out:
        yield _batch(out, kind)


def _hashed(zs: list[bytes | None], at: int, seen: dict[bytes, Lines],
            press: zstandard.ZstdDecompressor) -> tuple[int, dict[bytes, np.ndarray]]:
    """Hashed words of the next texts that are not known yet, HASHED_BYTES of them at once, and where these texts end."""
    texts: dict[bytes, bytes] = {}
    size, end = 0, at
    while end < len(zs) and size < HASHED_BYTES:
        z = zs[end]
        if z is not None and z not in texts and z not in seen:
            texts[z] = press.decompress(z)
            size += len(texts[z])
        end += 1
    return end, dict(zip(texts, hash_words(list(texts.values())), strict=True))


def _batch(rows: list[tuple], kept: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), kept)
    names = ["doc_id", "text", "words_removed", "blocks_removed", "partners", "kept"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
