import numpy as np

from creditline.llm import linededup, queries
from creditline.llm.common import IdFilter, hash_words
from creditline.llm.linededup import LINE, WINDOW, Lines, common_blocks, delete_ranges, line_dedup, line_starts, patience
from tests.conftest import MEDIUM

RNG = np.random.default_rng(3)


def prose(n, seed):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 100_000, n)]


def hashed(words):
    return hash_words([" ".join(words).encode()])[0]


def left_over(before, after, size=50):
    """Ids whose kept text holds ``size`` successive words of an earlier document."""
    seen, out = {}, set()
    for i in sorted(before):
        words = (after[i] or "").split()
        for k in range(len(words) - size + 1):
            if seen.get(hash(tuple(words[k : k + size])), i) < i:
                out.add(i)
        words = (before[i] or "").split()
        for k in range(len(words) - size + 1):
            seen.setdefault(hash(tuple(words[k : k + size])), i)
    return out


def test_lines_meet_in_any_shared_run():
    run = prose(LINE + WINDOW - 1, 1)
    for k in range(40):
        a = line_starts(hashed(prose(k, 2) + run + prose(70, 3)))[1]
        b = line_starts(hashed(prose(90 - k, 4) + run + prose(k, 5)))[1]
        assert set(a) & set(b)


def test_patience_finds_blocks_in_order():
    p, q = prose(80, 1), prose(90, 2)
    a = Lines(hashed(prose(30, 3) + p + prose(20, 4) + q + prose(9, 5)))
    b = Lines(hashed(p + prose(61, 6) + q))
    assert patience(a, b) == [(30, 0, 80), (130, 141, 90)]
    crossed = Lines(hashed(q + prose(10, 7) + p))
    assert common_blocks(a, crossed) == [(0, 90), (100, 180)]
    assert common_blocks(a, Lines(hashed(prose(10, 8) + p[:49] + prose(10, 9)))) == []
    assert common_blocks(a, Lines(hashed(prose(10, 8) + p[:50] + prose(10, 9)))) == [(10, 60)]


def test_passages_that_stand_twice_or_are_crossed_by_short_phrases():
    for seed in range(30):
        p = prose(60, 1000 + seed)
        once = prose(20, 2000 + seed) + p + prose(30, 3000 + seed)
        twice = prose(25, 4000 + seed) + p + prose(15, 5000 + seed) + p + prose(5, 6000 + seed)
        assert common_blocks(Lines(hashed(once)), Lines(hashed(twice))) == [(25, 85), (100, 160)]
        assert common_blocks(Lines(hashed(twice)), Lines(hashed(once))) == [(20, 80)]
        short = [prose(40, 7000 + 10 * seed + i) for i in range(6)]
        a = p + [w for i, x in enumerate(short) for w in [*x, f"a{i}"]]
        b = [w for i, x in enumerate(short) for w in [*x, f"b{i}"]] + p
        assert common_blocks(Lines(hashed(a)), Lines(hashed(b))) == [(246, 306)]


def test_delete_ranges_keeps_the_rest():
    assert delete_ranges("a  b\nc d", [(1, 3)]) == "a  d"
    assert delete_ranges("a b c\n", [(1, 3)]) == "a"
    assert delete_ranges(" a b", [(0, 1)]) == " b"


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op3_line_dedup(spark, MEDIUM).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    assert left_over(texts, {i: r.text for i, r in rows.items()}) == set()
    earlier = {}
    for i in sorted(texts):
        words = texts[i].split()
        runs = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        if rows[i].words_removed == 0:
            assert rows[i].text == texts[i] and rows[i].partners == []
        else:
            assert any(r in earlier for r in runs)
            assert len(rows[i].text.split()) + rows[i].words_removed == len(words)
        for r in runs:
            earlier.setdefault(r, i)
    assert sum(r.words_removed > 0 for r in rows.values()) > 50


def test_frequent_sentence_inside_shared_passages(spark, make):
    common = prose(30, 1)
    texts = {i: prose(60, 100 + i) + common + prose(60, 300 + i) for i in range(100)}
    for t in range(20):
        p = prose(10, 500 + t) + common + prose(10, 600 + t)
        for i in (200 + t, 300 + t):
            texts[i] = prose(40, 1000 + i) + p + prose(40, 2000 + i)
    got = {r.doc_id: r for r in line_dedup(make([(i, " ".join(w)) for i, w in texts.items()])).collect()}
    for i, r in got.items():
        assert r.partners == ([i - 100] if i >= 300 else []) and r.words_removed == (50 if i >= 300 else 0)


def test_hot_passage_copies_nulls_and_repeats(spark, make):
    passage = " ".join(prose(60, 1))
    rows = [(10, None), (11, ""), (None, passage), (12, "short text")]
    rows += [(100 + i, " ".join(prose(20 + i, 500 + i)) + " " + passage + "\n" + " ".join(prose(30, 900 + i))) for i in range(60)]
    rows += [(300 + i, " ".join(prose(200, 7))) for i in range(20)] + [(300, " ".join(prose(200, 7)))]
    got = line_dedup(make(rows), keep=["source", "part"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 300}
    assert by[10].text is None and by[11].text == "" and by[12].text == "short text" and by[None].text == passage
    assert by[100].words_removed == 0 and passage in by[100].text
    for i in range(1, 60):
        assert by[100 + i].partners == [100] and by[100 + i].words_removed == 60
        assert by[100 + i].text.split() == prose(20 + i, 500 + i) + prose(30, 900 + i)
    assert [r.words_removed for r in got if r.doc_id == 300] == [0, 0]
    assert all(by[300 + i].text == "" for i in range(1, 20))
    assert by[12].kept.c0 == "s" and by[12].kept.c1 == "x"


def test_empty_table(spark, make):
    assert line_dedup(make([])).collect() == []


def test_word_hashes_do_not_depend_on_the_grouping():
    texts = [b"", b" a bc\x0ba ", "é\u2003x\ty".encode(), b"word " * 300_000, b"x" * 2_500_000 + b" tail", b"a"]
    together = hash_words(texts)
    for t, h in zip(texts, together, strict=True):
        assert len(h) == len(t.split()) and (hash_words([t])[0] == h).all()
    first = {w: h for t, hs in zip(texts, together, strict=True) for w, h in zip(t.split(), hs.tolist(), strict=True)}
    assert len(set(first.values())) == len(first)
    assert all(first[w] == h for t, hs in zip(texts, together, strict=True) for w, h in zip(t.split(), hs.tolist(), strict=True))


def test_id_filter_never_loses_an_id(spark):
    ids = spark.createDataFrame([(i * 7919,) for i in range(5000)] + [(None,)], "x bigint")
    rows = spark.createDataFrame([(i, "t") for i in range(40_000)] + [(None, "t")], "doc_id bigint, t string")
    f = IdFilter(ids.where("x is not null"), "x")
    hit = {r.doc_id for r in f.split(rows, "doc_id", True).collect()}
    assert {i * 7919 for i in range(5000) if i * 7919 < 40_000} <= hit and len(hit) < 20
    assert f.split(rows, "doc_id", False).count() == 40_001 - len(hit)
    assert f.split(rows.where("doc_id is not null"), "doc_id", True).count() == len(hit)


def test_no_text_is_written_and_lines_are_shuffled_once(spark, make, monkeypatch):
    written, real = {}, linededup.stored

    def stored(df, name):
        written[name] = df.schema, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        return real(df, name)

    monkeypatch.setattr(linededup, "stored", stored)
    p = prose(60, 1)
    texts = [" ".join(prose(40, 10 + i) + p + prose(40 + i, 50 + i)) for i in range(4)] + [" ".join(prose(90, 99)), None]
    got = {r.doc_id: r for r in line_dedup(make(list(enumerate(texts)))).collect()}
    assert [got[i].words_removed for i in range(6)] == [0, 60, 60, 60, 0, 0] and got[4].text == texts[4] and got[5].text is None
    for schema, _ in written.values():
        assert not {"string", "binary"} & {f.dataType.simpleString() for f in schema}
    by_line = [n for n, (_, plan) in written.items() if "Exchange hashpartitioning(line" in plan or "Exchange hashpartitioning(around" in plan]
    assert by_line == ["heads"] and written["heads"][1].count("Exchange hashpartitioning") == 1
