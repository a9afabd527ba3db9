from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

from searchloom.operators import sensorhmm, timegrid

SCHEMA = "mess_id long, geraet string, zeitpunkt timestamp_ntz, temperatur_c double, takt_s string, value int"
T0 = datetime(2024, 1, 1)


def readings(spark, rows):
    return spark.createDataFrame([(i, g, t, v, "clash", 1) for i, (g, t, v) in enumerate(rows)], SCHEMA)


def sources(spark, rows):
    return spark.createDataFrame(rows, "geraet string, takt_s int, value double")


def at(s):
    return T0 + timedelta(seconds=s)


def brute_grid(rows, step, hold=2.0):
    """Second by second."""
    pts = {}
    for _, t, v in rows:
        pts.setdefault(int((t - datetime(1970, 1, 1)).total_seconds()), []).append(v)
    pts = sorted((t, sum(v) / len(v)) for t, v in pts.items())
    cells = {}
    first, last = pts[0][0] // step, pts[-1][0] // step
    for c in range(first, last + 1):
        n = sum(c * step <= t < (c + 1) * step for t, _ in pts)
        tot = w = 0
        for s in range(c * step, (c + 1) * step):
            prev = [p for p in pts if p[0] <= s]
            if prev and s < prev[-1][0] + hold * step:
                tot, w = tot + prev[-1][1], w + 1
        cells[c * step] = (n, tot / w if w else None, w / step)
    return cells


def test_grid_equals_second_by_second(spark, monkeypatch):
    monkeypatch.setattr(timegrid, "CHUNK_CELLS", 4)
    monkeypatch.setattr(timegrid, "SPAN_CHUNKS", 2)
    rng = np.random.default_rng(2)
    times = sorted(set(rng.integers(0, 900, 40).tolist()) | {2000, 2001, 2600})
    rows = [("a", at(t), float(rng.integers(0, 50))) for t in times]
    rows += [("a", at(times[3]), 7.0)]
    got = {r["slot_start"]: r for r in timegrid.regular_grid(readings(spark, rows), sources(spark, [("a", 20, 1.0)])).collect()}
    want = brute_grid(rows, 20)
    assert set(got) == set(want)
    for k, (n, v, c) in want.items():
        assert got[k]["n_readings"] == n and abs(got[k]["coverage"] - c) < 1e-9
        assert (v is None) == (got[k]["value"] is None) and (v is None or abs(got[k]["value"] - v) < 1e-9)
        assert got[k]["mark"] == ("measured" if n else "held" if c else "missing") and got[k]["filled"] is not None


def test_grid_edge_cases(spark):
    rows = [("a", at(5), 1.0), ("a", at(5), 1.0), (None, at(1), 1.0), ("a", None, 1.0), ("a", at(100), None), ("a", at(100), float("nan")), ("b", at(3), 2.0), ("c", at(3), 2.0), ("d", at(1), 1.0)]
    g = timegrid.regular_grid(readings(spark, rows), sources(spark, [("a", 10, 1.0), ("a", 20, 1.0), ("b", None, 1.0), ("c", 0, 1.0), (None, 5, 1.0)]))
    out = g.collect()
    assert len(out) == 1 and out[0]["geraet"] == "a" and out[0]["n_readings"] == 1 and out[0]["coverage"] == 0.5
    assert timegrid.regular_grid(readings(spark, rows).limit(0), sources(spark, [("a", 10, 1.0)])).count() == 0


def test_empty_slots_before_1970(spark):
    rows = [("a", datetime(1969, 12, 31, 23, 59, 35), 1.0), ("a", datetime(1970, 1, 1, 0, 0, 5), 1.0)]
    e = timegrid.empty_slots(timegrid.regular_grid(readings(spark, rows), sources(spark, [("a", 10, 1.0)]))).collect()
    assert sorted(r["slot_start"] for r in e) == [-20, -10]


def series(spark, v, start=0, step=60, name="a"):
    return [(name, at(start + i * step), None if x is None else float(x)) for i, x in enumerate(v)]


def flagged(spark, rows):
    return {r["mess_id"] for r in sensorhmm.flag_readings(readings(spark, rows)).collect()}


def base(n, seed=0):
    rng = np.random.default_rng(seed)
    return 20 + 3 * np.sin(np.arange(n) / 80) + 0.3 * rng.normal(size=n).round(2)


def test_planted_cases(spark):
    v = base(3000)
    want = set()
    for i, k in ((200, 1), (700, 2), (1500, 3)):
        v[i : i + k] += 15
        want |= set(range(i, i + k))
    v[1000:1030] = v[1000]
    want |= set(range(1000, 1030))
    v[2000], v[2100] = -999.0, 1e6
    want |= {2000, 2100}
    v[2500:] += 8  # a lasting change of level
    got = flagged(spark, series(spark, v))
    assert got == want


def test_chunks_do_not_matter(spark, monkeypatch):
    v = base(2000, 3)
    v[495:530] = v[495]
    v[1000:1002] += 20
    rows = series(spark, v)
    whole = flagged(spark, rows)
    monkeypatch.setattr(sensorhmm, "CHUNK", 100)
    assert flagged(spark, rows) == whole == set(range(495, 530)) | {1000, 1001}


def test_not_cases(spark):
    slow = 20 + 10 * np.exp(-((np.arange(1500) - 700) ** 2) / 20000) + 0.2 * np.random.default_rng(1).normal(size=1500)
    assert flagged(spark, series(spark, slow)) == set()
    switching = np.where(np.arange(1500) // 10 % 2, 25.0, 20.0) + 0.2 * np.random.default_rng(2).normal(size=1500)
    assert flagged(spark, series(spark, switching)) == set()
    v = base(600, 5)
    gap = series(spark, v[:300]) + series(spark, v[300:] + 12, start=300 * 60 + 90_000)
    assert flagged(spark, gap) == set()


def test_nulls_repeats_and_small_sources(spark):
    v = base(400, 6)
    v[100] += 30
    rows = series(spark, v)
    rows += [rows[100], (None, at(5), 5000.0), ("a", None, 5000.0), ("a", at(7), None), ("a", at(8), float("nan")), ("b", at(1), 5.0), ("b", at(2), -400.0), ("c", at(1), 1.0)]
    got = flagged(spark, rows)
    assert got == {100, 400, 406}
    assert flagged(spark, rows[:0]) == set()


def test_posterior_is_exact():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(301, 4)), sensorhmm.transitions()
    p = np.exp(e - e.max(1, keepdims=True))
    f, a = [], np.array([1.0, 0, 0, 0])
    for i in range(301):
        a = (a @ t) * p[i]
        a /= a.sum()
        f.append(a)
    b, out = np.ones(4), [None] * 301
    for i in range(300, -1, -1):
        g = f[i] * b
        out[i] = g / g.sum()
        b = t @ (p[i] * b)
        b /= b.sum()
    start = np.array([1.0, 0, 0, 0])
    assert np.abs(sensorhmm.posterior(e, start, np.ones(4)) - np.array(out)).max() < 1e-12
    assert np.abs(sensorhmm.posterior(e[:130], start, sensorhmm.transfer(e[130:]) @ np.ones(4)) - np.array(out)[:130]).max() < 1e-12


def chunk_sizes(spark, monkeypatch, rows):
    """The readings of each chunk that the detector writes."""
    seen = []
    keep = sensorhmm.materialize

    def watch(df, label):
        out = keep(df, label)
        if label == "hmm-chunks":
            seen.append(out)
        return out

    monkeypatch.setattr(sensorhmm, "materialize", watch)
    found = flagged(spark, rows)
    return [len(r["us"]) for r in seen[0].collect()], found


def test_a_stray_time_and_a_burst_leave_chunks_small(spark, monkeypatch):
    monkeypatch.setattr(sensorhmm, "CHUNK", 256)
    v = base(3000)
    v[1500] += 60.0
    rows = series(spark, v, start=1_600_000_000, step=1)
    rows += series(spark, [20.0], start=0)  # 1970
    rows += series(spark, base(500, 1), start=1_700_000_000, step=3600)
    sizes, found = chunk_sizes(spark, monkeypatch, rows)
    assert max(sizes) <= 256 and sum(sizes) == len(rows)
    assert 1500 in found and len(found) < 20


def test_copies_of_one_reading_are_spread_and_flagged_together(spark, monkeypatch):
    monkeypatch.setattr(sensorhmm, "CHUNK", 64)
    v = base(600)
    v[300] += 60.0
    rows = series(spark, v)
    plain = flagged(spark, rows)
    hot = rows + [rows[300]] * 2000 + [rows[100]] * 2000
    sizes, found = chunk_sizes(spark, monkeypatch, hot)
    assert max(sizes) <= 64
    assert found == plain | {600 + i for i in range(2000)}


def test_messages_reach_over_any_number_of_chunks(spark, monkeypatch):
    """A stuck run over more chunks than any fixed reach: chunks of twelve readings, and the same result as in one chunk."""
    v = base(400)
    v[150:250] = [21.5] * 100
    rows = series(spark, v)
    whole = flagged(spark, rows)
    assert set(range(150, 250)) <= whole
    monkeypatch.setattr(sensorhmm, "CHUNK", 12)
    assert flagged(spark, rows) == whole


def test_borders_of_partitions():
    """Readings beside a border come from as many partitions as needed, and copies across one count once."""
    a, b, c = [(1, 1.0), (2, 2.0)], [(2, 2.0)], [(2, 2.0), (3, 3.0)]
    edges = [{"pid": p, "idx": 0, "edge": 7, "__s": "s", "length": len(x), "us_head": [t for t, _ in x], "v_head": [y for _, y in x], "us_tail": [t for t, _ in x], "v_tail": [y for _, y in x]} for p, x in enumerate((a, b, c))]
    out = sensorhmm._borders(edges)
    assert out[0] == ([], [(3, 3.0)], False)
    assert out[1] == (a, [(3, 3.0)], True)
    assert out[2] == (a, [], True)
