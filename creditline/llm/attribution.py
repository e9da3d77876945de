"""Token counts by offset-mapped attribution.

A record's fields are joined into one text that is encoded once, as it would be
for training.  Every token keeps its span of characters; the spans are interval-
joined to the spans of the fields, and of the lines of one field.  Spans and
sections are both in order, so the join is a binary search per section edge.

A token may cross the edge of a section.  The rule says where it counts:

* ``start``: in the section that holds its first character;
* ``middle``: in the section [a, b) with a < middle <= b, which is the one that
  holds more of it, or, of two equal halves, the first;
* ``proportional``: in every section by the share of its characters there.

Under each rule sections that do not overlap never count a token twice; tokens
in no section (separators) are the section -1, so the counts of a record add up
to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditline.llm.tokens import PieceTokenizer, tokenizer, vocabulary

RULES = ("start", "middle", "proportional")
RESULT = "doc_id bigint, section int, field string, start bigint, end bigint, n_tokens double"


class Spans:
    """Character spans of the tokens of texts.

    The tokens' bytes join to the text's, so their lengths alone give the spans."""

    def __init__(self, t: PieceTokenizer):
        self.t = t
        known = t.bytes_of | {i: x.encode() for i, x in t.special.items()}
        self.size = np.zeros(max(known) + 1, np.int64)
        self.size[list(known)] = [len(v) for v in known.values()]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the text's tokens, leading spaces included."""
        ids = np.frombuffer(self.t.encode(text), np.uint16)
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        if text.isascii():
            return starts, ends
        # the character that holds each byte
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((b & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


def interval_counts(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [a, b) under the rule; spans ascend."""
    if rule == "start":
        return np.searchsorted(starts, b, "left") - np.searchsorted(starts, a, "left")
    if rule == "middle":
        middle = starts + ends  # twice the middle
        return np.searchsorted(middle, 2 * b, "right") - np.searchsorted(middle, 2 * a, "right")

    def before(x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(ends, x, "right")
        at = np.minimum(i, max(len(starts) - 1, 0))
        if not len(starts):
            return np.zeros(len(x))
        cut = (i < len(starts)) & (starts[at] < x)
        return i + np.where(cut, (x - starts[at]) / np.maximum(ends[at] - starts[at], 1), 0.0)

    return np.where(b > a, before(b) - before(a), 0.0)


def record(values: Sequence[str], fields: Sequence[str], separator: str, lines_of: str | None) -> tuple[str, list[tuple[str, int, int]]]:
    """The joined text and its sections (field, start, end) in order."""
    out, at = [], 0
    for name, value in zip(fields, values, strict=True):
        if name != lines_of:
            out.append((name, at, at + len(value)))
        else:
            start = at
            for line in value.split("\n"):
                out.append((name, start, start + len(line)))
                start += len(line) + 1
        at += len(value) + len(separator)
    return separator.join(values), out


def token_counts(docs: DataFrame, fields: Sequence[str] = ("source", "lang", "text"), lines_of: str | None = "text",
                 rule: str = "middle", separator: str = "\n", path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, section, field, start, end, n_tokens): the tokens of each field of each record,
    of the field ``lines_of`` line by line; section numbers from 0 in order, -1 for
    tokens in no section (always there, 0 if there are none).

    start and end count code points of the joined record.  Null fields are
    empty; empty fields and lines are sections of 0 tokens.  Repeated rows each
    give their sections, null ids are kept, an empty table gives an empty
    result; other columns are not read.  Counts are whole numbers unless the
    rule is ``proportional``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, fields = path or vocabulary(), tuple(fields)
    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(tokenizer(path))
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                c = batch.slice(i, 200)
                values = [c.column(j + 1).to_pylist() for j in range(len(fields))]
                rows, section, names, a, b, n = [], [], [], [], [], []
                for r in range(c.num_rows):
                    text, parts = record([v[r] or "" for v in values], fields, separator, lines_of)
                    starts, ends = spans.of(text)
                    lo, hi = (np.array([p[k] for p in parts], np.int64) for k in (1, 2))
                    counts = interval_counts(starts, ends, lo, hi, rule)
                    rows.append(np.full(len(parts) + 1, r))
                    section += [-1, *range(len(parts))]
                    names += ["", *(p[0] for p in parts)]
                    a.append(np.concatenate([[0], lo]))
                    b.append(np.concatenate([[len(text)], hi]))
                    n.append(np.concatenate([[len(starts) - counts.sum()], counts]).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [c.column(0).take(pa.array(np.concatenate(rows))), pa.array(section, pa.int32()), pa.array(names, pa.string()),
                     pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(n))],
                    names=["doc_id", "section", "field", "start", "end", "n_tokens"])

    return cols.mapInArrow(run, RESULT)
