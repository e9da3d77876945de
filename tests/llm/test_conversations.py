import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from creditline.llm.conversations import damage, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
VALID = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if h == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif solid[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """Least (cost, audit, lines) by Dijkstra over (row, automaton state), least audits first."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}
    todo = [(0, "", 0, "", ())]
    import heapq

    while todo:
        cost, audit, i, q, lines = heapq.heappop(todo)
        if (i, q) in best and best[(i, q)] <= (cost, audit):
            continue
        best[(i, q)] = (cost, audit)
        if i == len(rows) and q in ("", "a"):
            return cost, audit, lines
        for role in ("user", "assistant"):
            if (q, role[0]) in step:
                heapq.heappush(todo, (cost + 2, audit + "I", i, step[q, role[0]], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        _, _, role, text = rows[i]
        heapq.heappush(todo, (cost + 3, audit + "D", i + 1, q, lines))
        if bad[i] in ("blank", "duplicate"):
            continue
        extra = bad[i] == "truncated"
        if (q, role[:1]) in step:
            heapq.heappush(todo, (cost + extra, audit + "K", i + 1, step[q, role[:1]], (*lines, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if (q, new[0]) in step:
                heapq.heappush(todo, (cost + 2 + extra, audit + "R", i + 1, step[q, new[0]], (*lines, f"{new}:{text}")))


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = [r for r in damaged(rows) if r[0] == c]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        bad = faults(mine)
        n = Counter(bad)
        cost, audit, lines = cheapest(mine, bad)
        illegal = sum(f"{a[2][:1]}{b[2][:1]}" not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal,
                  cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, convs, turns, repeats=0.2):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, turns)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"])
            text = rng.choice(["Hi.", "Yes?", "cut off", " ", "", None, "ok! \n"]) if rng.random() < repeats else f"line {rng.random()}{rng.choice(['.', '', '! ', '?'])}"
            rows.append((None if c == 0 else c, None if rng.random() < 0.05 else rng.randint(0, turns), role, text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


def result(df):
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:9] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed, 60, 9)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as part", "1 as chunk", "2 as place")
    assert result(repair(damage(df))) == brute(rows)


@pytest.mark.parametrize("chunk_rows", [1, 3, 10])
@pytest.mark.parametrize("repeats", [0.2, 0.95])
def test_chunked_conversations_equal_whole_ones(spark, chunk_rows, repeats):
    rows = made(5, 4, 150, repeats)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert result(repair(damage(df), chunk_rows=chunk_rows)) == want


def test_all_rows_of_a_long_conversation_alike(spark):
    rows = [(1, t, "user", "Same.") for t in range(3000)] + [(2, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(1000)]
    got = result(repair(damage(spark.createDataFrame(rows, SCHEMA)), chunk_rows=50))
    assert got == brute(rows)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert result(repair(damage(df))) == brute(rows)


def test_lines_and_edges(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "user", "Hi."), (7, 3, "user", "Again.")]
    plain = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as copies")
    r = repair(plain, with_lines=True).first()
    assert (r["audit"], r["gaps"], r["illegal"], r["cost"]) == ("KKR", 1, 1, 2)
    assert r["repaired"] == ["system:Be kind.", "user:Hi.", "assistant:Again."]
    none = repair(plain.selectExpr("conv_id", "turn", "role", "text", "0 as copies")).collect()
    assert [tuple(x) for x in none] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair(plain.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "x" * 5_000_000 + "."), (1, 1, "assistant", "y" * 3_000_000)], SCHEMA)
    assert repair(long.selectExpr("*", "1 as copies")).first()["audit"] == "KK"
