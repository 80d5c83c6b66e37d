"""Circles of payments: half their legs are followed from a start, and what lies on no circle is followed from nowhere."""

import datetime
import itertools
import random

from tracewell.operators import anomaly
from tracewell.operators.anomaly import CONF

SCHEMA = "src long, dst long, amount double, ts timestamp_ntz, channel string"


def paid(src, dst, amount, hour):
    return src, dst, float(amount), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour), "IMPS"


def followed(rows, low=3, high=6, tolerance=0.15):
    """The same rule, path by path."""
    txns = {}
    for src, dst, amount, ts, _ in rows:
        if src != dst:
            txns.setdefault((src, dst), set()).add((ts, amount))
    nodes = sorted({x for e in txns for x in e})
    best = {}
    for size in range(low, high + 1):
        for path in itertools.permutations(nodes, size):
            legs = []
            for e in zip(path, path[1:] + path[:1], strict=True):
                leg = next((x for x in sorted(txns.get(e, ())) if not legs or x[0] >= legs[-1][0]), None)
                if leg is None:
                    break
                legs.append(leg)
            else:
                if abs(legs[-1][1] - legs[0][1]) / legs[0][1] <= tolerance:
                    key, mine = tuple(sorted(path)), (legs[0][0], path, legs)
                    best[key] = min(best.get(key, mine), mine)
    return {(">".join(map(str, path)), legs[0][1], legs[-1][1], ts, legs[-1][0]) for ts, path, legs in best.values()}


def test_circles_of_each_length(spark):
    dice = random.Random(5)
    rows = [paid(dice.randrange(7), dice.randrange(7), dice.choice([90, 100, 110, 150]), dice.randrange(30)) for _ in range(60)]
    got = anomaly.round_trips(spark.createDataFrame(rows, SCHEMA), CONF.__class__(cycle_quantile=0.0)).collect()
    expect = followed(rows)
    assert {len(x[0].split(">")) for x in expect} == {3, 4, 5, 6}
    assert {(r["path"], r["out_amount"], r["back_amount"], r["window_start"], r["window_end"]) for r in got} == expect
    assert len(got) == len(expect)


def test_ways_that_lead_nowhere_are_not_followed(spark, monkeypatch):
    # six layers of eight accounts, each paying all of the next: 8 ** 6 ways through, and one circle beside them
    rows = [paid(100 * k + i, 100 * (k + 1) + j, 100, 10 * k) for k in range(5) for i in range(8) for j in range(8)]
    rows += [paid(1, 2, 100, 1), paid(2, 3, 100, 2), paid(3, 1, 100, 3), paid(3, 100, 100, 3)]
    stored, write = [], anomaly.materialise

    def counted(df, name):
        out = write(df, name)
        stored.append(out.count())
        return out

    monkeypatch.setattr(anomaly, "materialise", counted)
    got = anomaly.round_trips(spark.createDataFrame(rows, SCHEMA), CONF.__class__(cycle_quantile=0.0)).collect()
    assert [r["path"] for r in got] == ["1>2>3"]
    assert max(stored) <= len(rows)


def test_only_accounts_with_large_receipts_are_sliced(spark, monkeypatch):
    rows = [paid(9, 1, 2_000_000, 0), paid(1, 2, 1_900_000, 5)] + [paid(50 + i, 80 + i, 10, i) for i in range(20)]
    seen, cut = [], anomaly.sliced
    monkeypatch.setattr(anomaly, "sliced", lambda df, length: seen.append(df.count()) or cut(df, length))
    got = anomaly.dormant(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["account"], r["inflow"], r["outflow"], r["dormant_days"]) for r in got] == [(1, 2_000_000.0, 1_900_000.0, 0)]
    assert seen == [1]


def test_calls_of_all_times_meet_only_incidents_with_calls_just_before(spark, monkeypatch):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    incidents = spark.createDataFrame([(f"i{n}", day(10 * n)) for n in range(1, 30)], "incident string, ts timestamp_ntz")
    accused = spark.createDataFrame([(f"i{n}", p) for n in range(1, 30) for p in (1, 2, 3)], "incident string, person long")
    calls = spark.createDataFrame([(1, 2, day(50) - datetime.timedelta(hours=h)) for h in range(49)] + [(2, 3, day(3))] * 2, "caller long, callee long, ts timestamp_ntz")
    met, write = {}, anomaly.materialise
    monkeypatch.setattr(anomaly, "materialise", lambda df, name: met.setdefault(name, write(df, name)))
    got = anomaly.call_bursts(calls, incidents, accused, CONF.__class__(burst_calls=2, burst_ratio=0.0)).collect()
    assert [(r["incident"], r["calls_in_window"], r["group_size"], r["baseline_expected"]) for r in got] == [("i5", 49, 3, round(51 * 2 / CONF.burst_span_days, 2))]
    assert [r["incident"] for r in met["bursts"].collect()] == ["i5"]
