import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from creditline.llm import queries
from creditline.llm.simhash import decode, fingerprint, fuzzy_keys, near_dedup, simhash_components
from tests.conftest import MEDIUM, SMALL


def slow_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [words] if len(words) < size else [words[i : i + size] for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, bits):
    """Smallest id reachable over pairs within ``bits``, for (id, fingerprint) rows."""
    ids, fp = [i for i, _ in fps], np.array([f for _, f in fps], np.uint64)
    group = list(range(len(ids)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            group[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(ids))]


@given(st.text(alphabet="aB éÄ\n\t\x0b\x1c.b", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_follows_the_definition(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_long_text_fingerprint():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(text) == slow_fingerprint(text)


def test_decoding_is_perfect():
    # 4,096 spheres of 2,048 words fill the space
    assert (np.bincount(decode(np.arange(1 << 23))) == 2048).all()


def test_keys_meet_for_every_pattern_of_four_errors():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1500).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for bits in (1, 2, 3, 4):
        other = base.copy()
        for i in range(len(base)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        met = []
        sides = []
        for fp in (base, other):
            keys = {}
            for r, k in zip(*(x.tolist() for x in fuzzy_keys(fp)), strict=True):
                keys.setdefault(r, {}).setdefault(k >> 1, 0)
                keys[r][k >> 1] |= k & 1
            sides.append(keys)
        for i in range(len(base)):
            a, b = sides[0][i], sides[1][i]
            met.append(any(a[k] | b[k] for k in a.keys() & b.keys()))
        assert all(met)


def test_query_against_brute_force(spark):
    for sf in (SMALL, MEDIUM):
        rows = queries.op4_simhash(spark, sf).collect()
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert len(rows) == len(texts)
        fps = sorted((r.doc_id, int(r.fingerprint, 16)) for r in rows)
        assert [r.fingerprint for r in rows] == [f"{int(r.fingerprint, 16):016x}" for r in rows]
        assert all(f == slow_fingerprint(texts[i]) for i, f in fps[:60])
        want = dict(zip([i for i, _ in fps], slow_components(fps, 4), strict=True))
        assert {r.doc_id: r.component_id for r in rows} == want


def test_chain_hot_group_nulls_and_repeats(spark, make):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "alone in its class here"), (7, None), (3, ""), (9, " \t"), (50, "one two"), (50, "one two"), (None, None)]
    base = rng.choice(words, 300).tolist()
    for i in range(120):  # a chain of near copies: each differs from the one before by a word
        base[rng.integers(300)] = str(rng.choice(words))
        rows.append((1000 + i, " ".join(base)))
    rows += [(2000 + i, "the very same text of a copy") for i in range(300)]
    got = simhash_components(make(rows)).collect()
    fps = sorted(((r[0], slow_fingerprint(r[1] or "")) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = sorted(zip([i for i, _ in fps], [f"{f:016x}" for _, f in fps], slow_components(fps, 4), strict=True), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_one_document_of_a_group_stays(spark, make):
    docs = make([(5, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (8, "quite another text of words"), (None, "a b c d e"), (4, None)])
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 8, None, 4], key=repr)


def test_empty_table(spark, make):
    assert simhash_components(make([])).collect() == []
    assert near_dedup(make([])).collect() == []


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, make):
    a, b, c = "the first text of all words here", "something else entirely, kept for good", "a third one that nobody repeats at all"
    docs = make([(1, a), (2, a), (2, b), (2, b), (3, c), (3, b), (None, a), (None, a)])
    kept = sorted(((r.doc_id, r.text) for r in near_dedup(docs).collect()), key=repr)
    assert kept == sorted([(1, a), (2, b), (3, c), (None, a), (None, a)], key=repr)
