import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditline.llm import queries
from creditline.llm.packing import digest, encode, pack
from creditline.llm.tokens import pieces, tokenizer, vocabulary
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(f"{vocabulary()}.json")


@given(st.text(alphabet="aB1é '\n\t.,<|endoftxt> 日s", max_size=50))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_like_the_whole_text(text):
    full = Tokenizer.from_file(f"{vocabulary()}.json") if not hasattr(test_pieces_encode_like_the_whole_text, "t") else test_pieces_encode_like_the_whole_text.t
    test_pieces_encode_like_the_whole_text.t = full
    assert "".join(pieces(text)) == text
    assert np.frombuffer(tokenizer(vocabulary()).encode(text), np.uint16).tolist() == full.encode(text, add_special_tokens=False).ids


def check(rows, docs, full, length=1024):
    """Exact round trip: every id in one piece, sequences gapless and full, but for powers of two."""
    ids = {i: np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in docs.items()}
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for i, e in ids.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(e) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(e[at : at + r.length].tobytes())
            at += r.length
        assert at == len(e)
    sizes = {}
    for k, ps in seqs.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes[k] = at
    assert sorted(sizes) == list(range(len(sizes)))
    short = [n for n in sizes.values() if n != length]
    assert all(n < length and n & (n - 1) == 0 for n in short) and len(short) == len(set(short))
    return seqs


def test_special_strings_split_a_text():
    import random

    import tokenizers

    full = tokenizers.Tokenizer.from_file(f"{vocabulary()}.json")
    rng, parts = random.Random(4), ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "a word", "é😀", " x", "<|endoftext|><|endoftext|>", "<", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    want = [full.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = tokenizer(vocabulary())
    assert [np.frombuffer(encoder.encode(t), np.uint16).tolist() for t in texts] == want


def test_query_round_trip(spark, full):
    rows = queries.op9_packing(spark, SMALL).collect()
    check(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}, full)


def test_targets_deficits_partitions_and_edge_rows(spark, make, full):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma.", "x\n\ny", "  z"], rng.integers(0, 400))) for _ in range(150)]
    rows = [(i, t, ("big", "big", "small", None)[i % 4]) for i, t in enumerate(texts)] + [(900, None, "small"), (901, "", "x"), (902, "word " * 9000, "big")]
    docs = make(rows, parts=7)
    whole = pack(docs, length=64, grain=16)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in whole.limit(200).collect())
    seqs = check(digest(whole).collect(), {r[0]: r[1] for r in rows}, full, 64)
    # every window keeps to the sources' shares of all tokens, but for carried deficits of a grain
    total = Counter()
    for ps in seqs.values():
        for r in ps:
            total[r.source] += r.length
    served, share = Counter(), {s: n / sum(total.values()) for s, n in total.items()}
    for k in range(len(seqs) * 9 // 10):
        for r in seqs[k]:
            served[r.source] += r.length
        for s, p in share.items():
            assert abs(served[s] - p * 64 * (k + 1)) <= 16 * (len(share) + 1)
    targets = {"big": 0.25, "small": 0.75}
    seqs = check(digest(pack(docs, length=64, grain=16, targets=targets)).collect(), {r[0]: r[1] for r in rows}, full, 64)
    first = Counter()
    for k in range(20):
        for r in seqs[k]:
            first[r.source] += r.length
    assert abs(first["small"] / sum(first.values()) - 0.75) < 0.05


def test_many_sources_share_queues(spark, make, full):
    rows = [(i, f"text number {i}", f"host{i}") for i in range(60)]
    got = pack(make(rows), max_queues=8, length=32, grain=8)
    assert len({r.source for r in got.select("source").collect()}) <= 8
    check(digest(got).collect(), {r[0]: r[1] for r in rows}, full, 32)


def test_targets_and_sources_hold_with_many_sources(spark, make, full):
    rows = [(i, f"text number {i}", f"host{i}") for i in range(60)]
    rows += [(100 + i, "word " * 40, ("big", "small")[i % 2]) for i in range(80)]
    docs = make(rows)
    got = pack(docs, max_queues=8, length=64, grain=16, targets={"big": 0.25, "small": 0.75})
    seqs = check(digest(got).collect(), {r[0]: r[1] for r in rows}, full, 64)
    source = {r[0]: r[2] for r in rows}
    assert all(r.source == source[r.doc_id] for ps in seqs.values() for r in ps)
    first = Counter()
    for k in range(20):
        for r in seqs[k]:
            first[r.source] += r.length
    assert abs(first["small"] / sum(first.values()) - 0.75) < 0.05
    # without targets the large sources keep queues of their own
    assert {"big", "small"} <= {r.source for r in pack(docs, max_queues=8, length=64, grain=16).select("source").collect()}


def test_repeated_rows_null_ids_and_empty_table(spark, make):
    got = digest(pack(make([(1, "a b"), (1, "a b"), (None, "c")]))).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.doc_id) == [(1, 3), (1, 3)]
    assert sum(r.length for r in got if r.doc_id is None) == 2
    assert pack(make([])).collect() == []


def test_encoded_places_are_gapless(spark, make):
    rows = encode(make([(i, "w " * i, f"s{i % 3}") for i in range(30)], parts=4), vocabulary()).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.part, r.queue].append((r.place, r.n))
    for spans in by.values():
        at = 0
        for place, n in sorted(spans):
            assert place == at
            at += n


def test_targets_must_name_a_source(spark, make):
    docs = make([(1, "a b c", "web"), (2, "d e f", "code")])
    for targets in ({"wbe": 1.0}, {"web": 0.0}, {"web": -1.0, "code": 2.0}, {}):
        with pytest.raises(ValueError):
            pack(docs, targets=targets)
    assert pack(docs, targets={"web": 1.0, "absent": 1.0}).count() > 0
