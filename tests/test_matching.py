"""Multivariate market matching against exhaustive search."""

import random

import pytest

from creditline.operators.matching import assign_controls, nearest_controls, zscored

SCHEMA = "key string, dma_code string, arm string, a double, b double, c double"


def _markets(spark, seed, keys=3, n=40):
    rng, rows = random.Random(seed), []
    for k in range(keys):
        for i in range(rng.randint(2, n)):
            f = [rng.choice([0.0, 1.0, 2.0]) if rng.random() < 0.4 else rng.gauss(0, 3) for _ in range(2)]
            rows.append((None if k == 0 else f"k{k}", f"m{i:02d}", rng.choice(["control", "treatment", "treatment"]), *f, None if rng.random() < 0.05 else 5.0))
    return rows, spark.createDataFrame(rows, SCHEMA)


def _z(rows):
    out = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k and r[5] is not None]
        cols = list(zip(*[r[3:] for r in mine]))
        for r in mine:
            z = []
            for x, col in zip(r[3:], cols):
                m = sum(col) / len(col)
                s = (sum((v - m) ** 2 for v in col) / len(col)) ** 0.5
                z.append((x - m) / s if s > 0 else 0.0)
            out[k, r[1]] = (r[2], z)
    return out


def _pairs(rows):
    z = _z(rows)
    return sorted((round(sum((x - y) ** 2 for x, y in zip(zt, zc)) ** 0.5, 9), t, c, k)
                  for (k, t), (at, zt) in z.items() if at == "treatment" for (kc, c), (ac, zc) in z.items() if kc == k and ac == "control")


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 3), (3, 50)])
def test_nearest_controls_equal_brute_force(spark, seed, k):
    rows, df = _markets(spark, seed)
    want = {}
    for d, t, c, key in sorted(_pairs(rows), key=lambda p: (p[0], p[2])):
        want.setdefault((key, t), []).append((c, d))
    got = {}
    for r in sorted(nearest_controls(zscored(df, ["a", "b", "c"], ["key"]), k, ["key"]).collect(), key=lambda r: r.place):
        got.setdefault((r.key, r.treatment_dma), []).append((r.control_dma, r.distance))
    assert {m: [c for c, _ in v[:k]] for m, v in want.items()} == {m: [c for c, _ in v] for m, v in got.items()}
    assert all(d == pytest.approx(want[m][i][1], abs=2e-9) for m, v in got.items() for i, (_, d) in enumerate(v))


def test_assignment_is_that_of_a_scan_of_all_pairs(spark):
    rows, df = _markets(spark, 5, n=14)
    want, used = set(), set()
    for d, t, c, k in sorted(_pairs(rows), key=lambda p: p[:3]):
        if ("t", k, t) not in used and ("c", k, c) not in used:
            used |= {("t", k, t), ("c", k, c)}
            want.add((k, t, c))
    got = assign_controls(zscored(df, ["a", "b", "c"], ["key"]), ["key"]).collect()
    assert {(r.key, r.treatment_dma, r.control_dma) for r in got} == want and len(got) == len(want)


def test_without_markets_or_controls(spark):
    _, df = _markets(spark, 1)
    assert nearest_controls(zscored(df.limit(0), ["a", "b"]), 3).count() == 0
    none = zscored(df.where("arm = 'treatment'"), ["a", "b"])
    assert nearest_controls(none, 3).count() == 0 and assign_controls(none).count() == 0
