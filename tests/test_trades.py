"""Overlap-free trades and drawdown against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest
from tickloom.session import in_utc

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def signals(seed, days, holds, every, horizons=1):
    rng, rows = random.Random(seed), []
    for name in ("I", "J"):
        m = rng.randrange(50)
        while m < days * 1440:
            for h in rng.sample(range(1, 50), horizons):
                rows.append((name, rng.choice("ab"), T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 1), T0 + timedelta(minutes=m + 1 + rng.choice(holds)), h, rng.choice(["signal"] * 4 + ["no_signal_neutral"]), float(len(rows))))
            m += rng.choice(every)
    return [r for k, r in enumerate(rows) if (r[0], r[2], r[5], r[1]) not in {(q[0], q[2], q[5], q[1]) for q in rows[max(0, k - 4) : k]}]


def plain(rows):
    until, taken = {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[5], r[1])):
        if r[6] == "signal" and (r[0] not in until or r[3] >= until[r[0]]):
            until[r[0]] = r[4]
            taken.add(r[7])
    return taken


COLUMNS = "instrument string, source string, prediction_time_utc timestamp, entry_time_utc timestamp, label_end_time_utc timestamp, horizon_minutes int, decision_status string, id double"


@pytest.mark.parametrize(("seed", "days", "holds", "every", "horizons"), [(1, 6, (15,), (3,), 1), (2, 6, (3, 15, 180), (3, 6, 40), 2), (3, 12, (700, 2000, 4500, 5), (60, 200), 1), (4, 9, (1440, 1441), (480, 3000), 1), (5, 3, (0, 15), (1, 2), 1)])
def test_trades_are_those_of_a_loop(spark, seed, days, holds, every, horizons):
    rows = signals(seed, days, holds, every, horizons)
    done = backtest.without_overlap(in_utc(spark).createDataFrame(rows, COLUMNS)).select("id", "decision_status").collect()
    assert len(done) == len(rows)
    assert {r.id for r in done if r.decision_status == "executed"} == plain(rows)
    assert {r.id for r in done if r.decision_status.startswith("no_")} == {r[7] for r in rows if r[6] != "signal"}


def test_trades_read_their_rows_once_and_keep_no_list_of_an_instrument(spark):
    frame = in_utc(spark).createDataFrame(signals(7, 3, (15,), (5,)), COLUMNS)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = frame.mapInArrow(count, frame.schema)
    n = backtest.without_overlap(counted).count()
    assert seen.value == n


def test_no_signals_and_no_rows(spark):
    rows = signals(8, 2, (15,), (30,))
    frame = in_utc(spark).createDataFrame(rows, COLUMNS)
    none = frame.withColumn("decision_status", F.lit("no_signal_neutral"))
    assert backtest.without_overlap(none).filter("decision_status = 'no_signal_neutral'").count() == len(rows)
    assert backtest.without_overlap(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_drawdown_is_that_of_a_loop_by_group(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("gh"), T0 + timedelta(hours=rng.randrange(24 * 150)), rng.choice(["executed"] * 5 + ["x"]), rng.gauss(0.2 * seed - 0.2, 3)) for _ in range(400)]
    frame = in_utc(spark).createDataFrame(rows, "g string, label_end_time_utc timestamp, decision_status string, net_return_bps double")

    def loop(mine):
        per = {}
        for _, t, s, x in mine:
            if s == "executed":
                per[t] = per.get(t, 0) + x
        total = peak = worst = 0.0
        for t in sorted(per):
            total += per[t]
            peak = max(peak, total)
            worst = max(worst, peak - total)
        return worst

    assert backtest.max_drawdown(frame).first()[0] == pytest.approx(loop(rows))
    assert {r.g: r.max_drawdown_bps for r in backtest.max_drawdown(frame, ["g"]).collect()} == pytest.approx({g: loop([r for r in rows if r[0] == g]) for g in "gh"})
    assert backtest.max_drawdown(frame.limit(0)).first()[0] == 0
