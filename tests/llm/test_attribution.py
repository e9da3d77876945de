import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditline.llm import queries
from creditline.llm.attribution import RULES, Spans, interval_counts, record, token_counts
from creditline.llm.tokens import tokenizer, vocabulary
from tests.conftest import SMALL

FULL = Tokenizer.from_file(f"{vocabulary()}.json")


def slow_counts(spans, sections, rule):
    out = []
    for a, b in sections:
        n = 0.0
        for s, e in spans:
            if rule == "start":
                n += a <= s < b
            elif rule == "middle":
                n += a < (s + e) / 2 <= b
            else:
                n += max(0, min(e, b) - max(s, a)) / (e - s)
        out.append(n)
    return out


@given(st.text(alphabet="aB1é '\n\t.,日ü", max_size=40), st.lists(st.integers(0, 40), min_size=2, max_size=6), st.sampled_from(RULES))
@settings(max_examples=300, deadline=None)
def test_spans_and_interval_join(text, cuts, rule):
    starts, ends = SPANS.of(text)
    whole = FULL.encode(text, add_special_tokens=False)
    assert len(starts) == len(whole.ids)
    if len(starts):
        assert starts[0] == 0 and ends[-1] == len(text) and (ends > starts).all()
        assert (starts[1:] <= ends[:-1]).all()  # bytes of one character share its span
    cuts = sorted(min(c, len(text)) for c in cuts)
    sections = list(zip(cuts, cuts[1:], strict=False))
    a, b = (np.array([s[k] for s in sections], np.int64) for k in (0, 1))
    got = interval_counts(np.asarray(starts), np.asarray(ends), a, b, rule)
    assert np.allclose(got, slow_counts(list(zip(starts.tolist(), ends.tolist(), strict=True)), sections, rule))


SPANS = Spans(tokenizer(vocabulary()))


def test_record_sections():
    assert record(["s", "a\n\nb"], ["source", "text"], "\n", "text") == ("s\na\n\nb", [("source", 0, 1), ("text", 2, 3), ("text", 4, 4), ("text", 5, 6)])


@pytest.mark.parametrize("rule", RULES)
def test_counts_add_up(spark, make, rule):
    rows = [(1, "It's\nline two  \n\nend"), (2, None), (3, ""), (None, "x<|endoftext|> y"), (4, "日本\n" * 3000), (4, "日本\n" * 3000)]
    got = token_counts(make(rows), rule=rule).collect()
    for i, text in rows:
        want = len(FULL.encode("\n".join(("s", "en", text or "")), add_special_tokens=False).ids)
        assert np.isclose(sum(r.n_tokens for r in got if r.doc_id == i), want * sum(r[0] == i for r in rows))
    assert [(r.section, r.field, r.n_tokens) for r in got if r.doc_id == 3 and r.section > 1] == [(2, "text", 0.0)]


def test_query_against_whole_encodings(spark):
    got = {}
    for r in queries.op6_token_counts(spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert set(got) == {d.doc_id for d in docs}
    for d in docs:
        text, parts = record([d.source, d.lang, d.text], ["source", "lang", "text"], "\n", "text")
        rows = sorted(got[d.doc_id], key=lambda r: r.section)
        assert [(r.field, r.start, r.end) for r in rows[1:]] == parts
        assert sum(r.n_tokens for r in rows) == len(FULL.encode(text, add_special_tokens=False).ids)
        spans = list(zip(*(x.tolist() for x in SPANS.of(text)), strict=True))
        if len(text) < 1500:
            assert [r.n_tokens for r in rows[1:]] == slow_counts(spans, [p[1:] for p in parts], "middle")


def test_empty_table(spark, make):
    assert token_counts(make([])).collect() == []
