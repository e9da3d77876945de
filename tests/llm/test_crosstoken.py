import hashlib
from collections import Counter

import pytest

from creditline.llm import crosstoken
from creditline.llm.crosstoken import Aligner, alignments, byte_alphabet, paths, spans

TEXTS = [
    "Hello world, hello wörld  twice", "", None, "x", " leading", "trailing ", "  ", " ", "\n\n tabs\tand\nlines \n", "naïve café 😀😀 emoji 日本語のテキスト",
    "<|endoftext|> is <s> plain </s> text <0x41> <unk>", "a▁b has the mark", "é combining ​ zero", "　wide space nbsp", "The the THE " * 50,
    "ÿ\u0000\u0001 control", "word" * 3000, "Hello world, hello wörld  twice", "a  b   c", "a \n b", "قال 12345 ١٢٣ №",
]


def brute(texts):
    """Whole texts through both libraries; ends from decoded bytes; all pairs compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    pa, pb = paths()
    a, b = Tokenizer.from_file(pa), sentencepiece.SentencePieceProcessor(model_file=pb)
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        xa = [(i, bytes(alphabet[c] for c in s)) for i, s in zip(e.ids, e.tokens)]
        xb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        raw = (" " + t).encode()
        if b"".join(s for _, s in xa) != raw or b"".join(s for _, s in xb) != raw:
            docs.append(None)
            continue

        def placed(tokens):
            out, at = [], 0
            for i, s in tokens:
                out.append((i, at, at + len(s)))
                at += len(s)
            return out

        docs.append((placed(xa), placed(xb)))
    links = [[(i, j) for i, s, e in d[0] for j, p, q in d[1] if s < q and p < e] if d else [] for d in docs]
    count = Counter(x for ls in links for x in ls)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for d, ls in zip(docs, links):
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for *_, e in d[0]} & {e for *_, e in d[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in d[0] if lo < e <= c) + "|" + ",".join(str(i) for i, s, e in d[1] if lo < e <= c))
            lo = c
        out.append((len(d[0]), len(d[1]), len(cuts), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def expected():
    texts = [t[:600] if t else t for t in TEXTS]
    return texts, brute(texts)


@pytest.mark.parametrize("common", [1 << 20, 20, 0])
def test_alignments_equal_brute_force(spark, make, expected, common):
    texts, want = expected
    docs = make([(i % 18, t) for i, t in enumerate(texts)])
    got = alignments(docs, common=common).collect()
    key = lambda r: tuple(r)[1:]
    assert sorted(map(key, got)) == sorted(want)
    by_id = Counter(tuple(r) for r in got)
    assert by_id == Counter((i % 18, *w) for i, w in enumerate(want))


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 1500").limit(60)
    rows = docs.collect()
    fixed = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute([r["text"] for r in rows])
    assert Counter(tuple(r) for r in alignments(fixed).collect()) == Counter((r["doc_id"], *w) for r, w in zip(rows, want))


def test_spans_are_the_tokens_of_whole_texts(spark, make, expected):
    texts, want = expected
    rows = {r["doc_id"]: r for r in spans(make(list(enumerate(texts)))).collect()}
    for i, (t, w) in enumerate(zip(texts, want)):
        r = rows[i]
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["group_ends"])) == w[:3]
        if w[0]:
            assert r["a_ends"][-1] == r["b_ends"][-1] == r["group_ends"][-1] == len((" " + t).encode())
            assert sorted(set(r["a_ends"]) & set(r["b_ends"])) == r["group_ends"]


def test_pieces_are_independent_of_their_place():
    t = Aligner(*paths(), keep_spans=True)
    assert t.cuts
    whole = "A sentence of some wörds,  with spaces\nand 😀 lines."
    ks = t.align([whole])[0]
    assert len(ks) > 5
    ids = [[t.flat[x][i] for k in ks for i in range(t.at[x][k], t.at[x][k + 1])] for x in ("a_ids", "b_ids")]
    assert ids == [t.a.encode(" " + whole, add_special_tokens=False).ids, t.b.encode(whole)]


def test_caches_start_anew(monkeypatch, expected):
    texts, want = expected
    t = Aligner(*paths())
    monkeypatch.setattr(crosstoken, "CACHE_PIECES", 3)
    for x, w in zip(texts, want):
        ks = t.align([x])[0]
        assert (0 if ks is None else t.numbers[ks, 0].sum()) == w[0]


def test_empty_table_and_null_ids(spark, make):
    assert alignments(make([], parts=1)).count() == 0
    assert [tuple(r)[:2] for r in alignments(make([(None, "x")])).collect()] == [(None, 1)]
