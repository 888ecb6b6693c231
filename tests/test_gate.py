"""The parallel gate against a plain row-by-row statement of the rule."""

import datetime as dt
import random
import zlib

import pytest

from skygauge.operators.gate import send_gate, signature_changes

SCHEMA = (
    "region string, offset bigint, clock timestamp, signature string, core_missing boolean, delivered boolean, enabled boolean"
)
T0 = dt.datetime(2026, 7, 1)


def sequential(rows, silence, state=None):
    known = dict(state or {})
    out = {}
    for region, offset, clock, sig, core, ok, enabled in sorted(rows, key=lambda r: (r[0], r[1])):
        told, sent = known.get(region, (None, None))
        due = bool(silence) and sent is not None and (clock - sent).total_seconds() >= silence
        send = not core and (told is None or told != sig or due)
        recorded = not send or not enabled or ok
        out[region, offset] = (send, recorded)
        known[region] = (sig if recorded else told, clock if send and ok else sent)
    return out, known


def decided(spark, rows, silence, state=None, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    seed = None
    if state:
        seed = spark.createDataFrame(
            [(r, s, t) for r, (s, t) in state.items()], "region string, signature string, last_sent timestamp"
        )
    got = send_gate(df, silence, seed, **options).collect()
    assert len(got) == len(rows)
    return {(r.region, r.offset): (r.send, r.recorded) for r in got}


def random_rows(rng, n, regions, signatures, jump, fail, core=0.1, disabled=0.05):
    clock = {r: T0 for r in regions}
    rows = []
    for offset in range(n):
        region = rng.choice(regions)
        clock[region] += dt.timedelta(seconds=rng.choice(jump))
        rows.append(
            (
                region,
                offset,
                clock[region],
                rng.choice(signatures),
                rng.random() < core,
                rng.random() >= fail,
                rng.random() >= disabled,
            )
        )
    return rows


CASES = {
    "stable": dict(signatures=["a"] * 9 + ["b"], jump=(60, 600, 3600), fail=0.2),
    "one_signature": dict(signatures=["a"], jump=(1, 700, 1800), fail=0.3, core=0.0),
    "clock_runs_back": dict(signatures=["a"] * 6 + ["b"], jump=(-5000, -100, 900, 4000), fail=0.2),
    "busy": dict(signatures=["a", "b", "c"], jump=(60, 9000), fail=0.5, core=0.3),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("fold_rows", [20_000, 3])
def test_equals_sequential_rule(spark, name, fold_rows):
    rng = random.Random(zlib.crc32(name.encode()))
    rows = random_rows(rng, 500, ["hot", "hot", "hot", "r1", "r2"], **CASES[name])
    want, _ = sequential(rows, 7200)
    assert decided(spark, rows, 7200, chunk_rows=16, fold_rows=fold_rows) == want


def test_state_carries_over_batches(spark):
    rng = random.Random(3)
    rows = random_rows(rng, 240, ["a", "b"], ["x"] * 5 + ["y"], (300, 4000), 0.3)
    want, _ = sequential(rows, 7200)
    first, second = rows[:120], rows[120:]
    _, state = sequential(first, 7200)
    got = decided(spark, second, 7200, state, chunk_rows=8)
    assert got == {k: v for k, v in want.items() if k in got}


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def row(offset, hours, sig="a", core=False, ok=True, enabled=True):
    return ("r", offset, at(hours), sig, core, ok, enabled)


def sends(spark, rows, silence=12 * 3600, state=None):
    got = decided(spark, rows, silence, state)
    return [got["r", r[1]][0] for r in rows]


def test_silence_limit_is_inclusive(spark):
    assert sends(spark, [row(0, 0), row(1, 3), row(2, 12), row(3, 23.9), row(4, 25)]) == [True, False, True, False, True]


def test_silence_off_never_repeats(spark):
    assert sends(spark, [row(0, 0), row(1, 30 * 24)], silence=0) == [True, False]


def test_missing_last_send_is_not_overdue(spark):
    assert sends(spark, [row(5, 100)], state={"r": ("a", None)}) == [False]


def test_all_failed_then_success_then_same(spark):
    assert sends(spark, [row(0, 0, ok=False), row(1, 1), row(2, 2)]) == [True, True, False]


def test_core_missing_is_recorded_but_not_sent(spark):
    rows = [row(0, 0), row(1, 1, sig="u", core=True), row(2, 2, sig="u"), row(3, 3)]
    assert sends(spark, rows) == [True, False, False, True]


def test_no_channel_records_without_delivery(spark):
    rows = [row(0, 0, ok=False, enabled=False), row(1, 1, ok=False, enabled=False), row(2, 20, ok=False, enabled=False)]
    assert sends(spark, rows) == [True, False, False]


def test_signature_changes(spark):
    df = spark.createDataFrame(
        [("r", i, s) for i, s in enumerate("aabba")], "region string, offset bigint, signature string"
    )
    got = sorted(signature_changes(df, chunk_rows=2).collect(), key=lambda r: r.offset)
    assert [r.changed for r in got] == [True, False, True, False, True]
    assert [r.previous for r in got] == [None, "a", "a", "b", "b"]
