"""The nightly pass against a greedy loop over all pairs."""

import random

import pytest

from wattline.operators.fusion import COMPARED
from wattline.operators.maintenance import close_pairs, matching, nightly_merge

FLAT = [c for c in COMPARED if c not in ("n_substates", "heating", "motor", "curve")]
SCHEMA = "site long, number long, status string, name string, seen long, first_s double, last_s double, quality double, " + ", ".join(f"{c} double" for c in FLAT) + ", n_substates int, heating int, motor int, curve array<double>"


def greedy(pairs):
    used, out = set(), []
    for site, a, b, _ in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if (site, a) not in used and (site, b) not in used:
            out.append((site, a, b))
            used |= {(site, a), (site, b)}
    return sorted(out)


def test_matching_equals_the_greedy_loop(spark):
    rnd = random.Random(12)
    nodes = [(s, k) for s in range(4) for k in range(25)]
    pairs = [(s, a, b, round(rnd.random(), 2)) for s, a in nodes for b in range(a + 1, 25) if rnd.random() < 0.3]
    # a chain whose every pair waits for the one before it
    pairs += [(9, k, k + 1, 0.001 * k) for k in range(12)]
    got = matching(spark.createDataFrame(pairs, "site long, a long, b long, distance double"))
    assert sorted(tuple(r) for r in got.collect()) == greedy(pairs)
    assert matching(spark.createDataFrame([], "site long, a long, b long, distance double")).collect() == []


def patterns(seed):
    rnd = random.Random(seed)
    kinds = [[rnd.uniform(5, 500) for _ in FLAT] + [[rnd.uniform(1, 9) for _ in range(16)]] for _ in range(5)]
    rows = []
    for site in (1, 2, None):
        for k in range(14):
            *flat, curve = rnd.choice(kinds)
            noise = lambda x: x * rnd.uniform(0.93, 1.07)
            rows.append((site, k, rnd.choice(["active"] * 5 + ["weak_pattern"]), rnd.choice(["tv", "pump", "unknown", None]), rnd.randrange(1, 20), rnd.uniform(0, 9), rnd.uniform(10, 99), rnd.random(), *map(noise, flat), 2, 0, 1, list(map(noise, curve))))
    return rows


def test_merged_rows(spark):
    rows = patterns(5)
    df = spark.createDataFrame(rows, SCHEMA)
    held = {(r.site, r.number): r for r in df.collect() if r.status == "active"}
    pairs = [tuple(r) for r in close_pairs(df.where("status = 'active'")).collect()]
    chosen = {(s, b): a for s, a, b in greedy(pairs)}
    assert len(chosen) > 5
    groups = {}
    for (s, k), r in held.items():
        groups.setdefault((s, chosen.get((s, k), k)), []).append(r)
    got = {(r.site, r.number): r for r in nightly_merge(df).collect()}
    assert set(got) == set(groups)
    for key, members in groups.items():
        r, seen = got[key], sum(m.seen for m in members)
        members.sort(key=lambda m: m.number)
        assert (r.seen, r.merged) == (seen, len(members) - 1)
        assert r.name == next((m.name for m in members if m.name not in (None, "", "unknown")), "unknown")
        for c in ("avg_w", "peak_w", "duration_s", "energy_wh", "quality"):
            assert r[c] == pytest.approx(sum(m[c] * m.seen for m in members) / seen)
        assert (r.first_s, r.last_s) == (min(m.first_s for m in members), max(m.last_s for m in members))
