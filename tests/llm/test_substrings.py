import random
import re
from collections import Counter

import pytest

from creditline.llm import substrings
from creditline.llm.substrings import plan, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=20):
    """(doc_id, kept text, n_words, n_removed) of each row, windows compared as tuples of words."""
    texts = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, texts):
        if d is None:
            continue
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - size + 1) if d is not None else ():
            if first[tuple(w[i : i + size])] < (d, i):
                gone |= set(range(i, i + size))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(15, 70))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            words += p[a : a + rng.randint(5, 70)] + [f"own{rng.random()}" for _ in range(rng.randint(0, 15))]
        rows.append((rng.randint(-5, n), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [rows[3], rows[3], (None, rows[4][1]), (n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "x " * 400), (n + 4, "x " * 400), (n + 5, "é ü " * 60)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("group,block", [(1_000_000, 1_000_000), (40, 300)])
def test_equals_brute_force(spark, make, monkeypatch, seed, group, block):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    rows = made(seed)
    got = substring_dedup(make(rows, parts=5), group=group, sample=1)
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(brute(rows))
    for r in got.collect():
        assert sum(s["words"] for s in r["spans"]) == r["n_removed"]


def test_frequent_prefixes_are_extended(spark, make):
    rows = [(i, "the same start " + " ".join(f"{i}w{j}" for j in range(30))) for i in range(50)]
    cols = make(rows).selectExpr("doc_id", "xxhash64(doc_id, text) as key", "cast(text as binary) as text")
    n, heavy = plan(cols, 20, 30, 1)
    assert n == -(-50 * 14 // 30)
    assert [len(x) for x in heavy] == [3, 2, 0, 0, 0]  # 'the', 'same', 'start'; then 'the same', 'same start'


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(w[3] > 0 for w in want)
    assert Counter(tuple(r)[:4] for r in substring_dedup(df, group=5000, sample=4).collect()) == Counter(want)


def test_other_sizes_empty_and_long(spark, make):
    rows = made(4, 30)
    assert Counter(tuple(r)[:4] for r in substring_dedup(make(rows), min_words=5).collect()) == Counter(brute(rows, 5))
    assert substring_dedup(make([], parts=1)).count() == 0
    long = " ".join(f"w{i % 700_000}" for i in range(1_400_000))
    r = substring_dedup(make([(1, long)])).first()
    assert (r["n_words"], r["n_removed"], [tuple(s) for s in r["spans"]]) == (1_400_000, 700_000, [(700_000, 700_000)])
