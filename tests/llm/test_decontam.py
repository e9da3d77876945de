import numpy as np

from creditline.llm import decontam, queries
from creditline.llm.decontam import contaminated, decontaminate, words_of
from tests.conftest import MEDIUM

ITEMS = "item_id bigint, text string, doc_id string"


def grams(text):
    w = words_of(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, items, threshold=0.8):
    out = []
    for d, text in docs:
        for i, item in items:
            q = grams(item or "")
            n = len(next(iter(q), ()))
            w = words_of(text or "")
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            if q and len(q & have) >= threshold * len(q):
                out.append((d, i, len(q & have) / len(q)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.item_id, r.containment) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    got = rows_of(queries.op10_decontamination(spark, MEDIUM))
    assert got == brute(docs, items) and len(got) > 10


def test_sizes_edits_ties_and_edge_rows(spark, make):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate((1, 2, 3, 4, 5, 6, 7, 9, 12, 17, 25, 40, 61, 90, 200))]
    items += [(100, None), (101, " ... "), (None, items[7][1]), (7, items[7][1])]
    docs = [(1, None), (2, ""), (3, "w1"), (None, items[8][1])]
    for k, (_, text) in enumerate(items[:15]):
        w = text.split()
        long = rng.choice(words, 6000).tolist()
        at = int(rng.integers(6000))
        docs.append((10 + k, " ".join(long[:at] + w + long[at:])))
        docs.append((40 + k, text.upper().replace(" ", ", ")))
        if len(w) > 30:  # a word changed: five shingles of many
            w[len(w) // 2] = "changed"
            docs.append((70 + k, " ".join(long[:50] + w + long[50:90])))
    docs += [docs[-1], (500, " ".join(rng.choice(words, 3)))]
    frame = make(docs).withColumnRenamed("kind", "item_id")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = rows_of(contaminated(frame, bench))
    assert got == brute(docs, items) and len(got) > 40
    kept = {r.doc_id for r in decontaminate(frame, bench).collect()}
    assert kept == {d for d, _ in docs if d is None or d not in {g[0] for g in got}}


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, make):
    bench = spark.createDataFrame([(1, "a b c d e f", "x")], ITEMS)
    docs = make([(1, "a b c d e f and more"), (1, "a clean text"), (1, None), (2, "a clean text"), (None, "a b c d e f")])
    kept = sorted(((r.doc_id, r.text) for r in decontaminate(docs, bench).collect()), key=repr)
    assert kept == sorted([(1, "a clean text"), (1, None), (2, "a clean text"), (None, "a b c d e f")], key=repr)
    assert decontaminate(docs, bench).columns == docs.columns


def test_blocks_change_nothing(spark, make, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9)))) for i in range(60)]
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), 300))) for i in range(12)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    want = rows_of(contaminated(make(docs), bench))
    assert want == brute(docs, items) and len(want) > 60
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 25)
    assert rows_of(contaminated(make(docs), bench)) == want
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 40)
    assert rows_of(contaminated(make(docs), bench)) == want


def test_empty_tables(spark, make):
    bench = spark.createDataFrame([(1, "a b c d e f", "x")], ITEMS)
    assert contaminated(make([]), bench).collect() == []
    assert contaminated(make([(1, "a b c d e f")]), bench.limit(0)).collect() == []


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MEDIUM}/{t}.parquet')")
    want = con.execute(queries.ORACLE["op10_decontamination"]).fetchall()
    assert sorted(tuple(r) for r in queries.op10_decontamination(spark, MEDIUM).collect()) == sorted(want)
