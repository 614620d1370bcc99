"""Cost-aware backtests whose positions of an instrument never overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.bars import BPS, session_bucket
from tickloom.operators.metrics import confidence, predicted
from tickloom.scratch import written


@dataclass(frozen=True)
class Costs:
    spread_bps: float = 3.0
    slippage_bps: float = 0.5
    commission_bps: float = 0.0

    @property
    def round_trip(self) -> float:
        return self.spread_bps + 2 * (self.slippage_bps + self.commission_bps)


@dataclass(frozen=True)
class Policy:
    min_confidence: float = 0.5
    min_edge_bps: float = 0.0


def direction() -> Column:
    return F.when(F.col("predicted_class") == "up", 1.0).when(F.col("predicted_class") == "down", -1.0).otherwise(0.0)


def with_decisions(rows: DataFrame, costs: Costs, policy: Policy) -> DataFrame:
    """predicted_class, side_sign, confidence, expected edge, and the first reason not to trade, else signal."""
    out = rows.withColumn("predicted_class", predicted()).withColumns({"side_sign": direction(), "confidence": confidence()})
    edge = F.col("side_sign") * F.col("expected_return_bps")
    reason = (  # fixed values: the names of the reasons
        F.when(F.col("predicted_class") == "neutral", "no_signal_neutral")
        .when(F.col("confidence") < policy.min_confidence, "no_signal_low_confidence")
        .when(edge <= 0, "no_signal_incompatible_expected_return")
        .when(edge - costs.round_trip <= policy.min_edge_bps, "no_signal_insufficient_edge")
        .otherwise("signal")
    )
    return out.withColumns({"expected_directional_bps": edge, "decision_status": reason})


def without_overlap(decisions: DataFrame) -> DataFrame:
    """Signals become executed or suppressed_overlap: in the order of prediction, instrument and horizon, one that enters
    before the last executed one of its instrument has ended is suppressed; entering just then is allowed.

    The decisions are written once and read from there. A trade reaches from its day into a later one only by the time it ends at, so a day
    is a function of that time: for each end that can reach into it, the end that leaves it. A day's signals give this table on their own;
    a row a day is carried through the instrument, and each day is then decided from the time that enters it. No task holds more than the
    signals of an instrument's day or an instrument's days; trades that last many days cost more, with the ends that reach into a day.
    """
    decisions = written(decisions)
    order = ["prediction_time_utc", "horizon_minutes", "source"]
    signals = decisions.filter("decision_status = 'signal'").select("instrument", *order, "entry_time_utc", "label_end_time_utc", F.to_date("prediction_time_utc").alias("_day"))
    days = signals.groupBy("instrument", "_day").agg(F.array_sort(F.collect_list(F.struct(*order, "entry_time_utc", "label_end_time_utc"))).alias("_s"), F.min("entry_time_utc").alias("_first"))
    later_days = F.explode(F.sequence(F.date_add("_day", 1), F.to_date("label_end_time_utc"))).alias("_day")
    ends = signals.filter(F.to_date("label_end_time_utc") > F.col("_day")).select("instrument", "label_end_time_utc", later_days).groupBy("instrument", "_day").agg(F.collect_set("label_end_time_utc").alias("_ends"))
    none = F.lit(None).cast("timestamp")
    free = lambda x, until: until.isNull() | (x["entry_time_utc"] >= until)

    def leaves(until: Column) -> Column:
        return F.aggregate("_s", until, lambda acc, x: F.when(free(x, acc), x["label_end_time_utc"]).otherwise(acc))

    reaching = F.concat(F.array(none), F.coalesce(F.filter("_ends", lambda e: e > F.col("_first")), F.array().cast("array<timestamp>")))
    tables = days.join(ends, ["instrument", "_day"], "left").select("instrument", "_day", "_first", F.transform(reaching, lambda e: F.struct(e.alias("enters"), leaves(e).alias("leaves"))).alias("_table"))

    def through(acc: Column, day: Column) -> Column:
        enters = F.when(acc["until"] > day["_first"], acc["until"])
        until = F.filter(day["_table"], lambda r: r["enters"].eqNullSafe(enters))[0]["leaves"]
        return F.struct(until.alias("until"), F.concat(acc["days"], F.array(F.struct(day["_day"].alias("_day"), enters.alias("_enters")))).alias("days"))

    start = F.struct(none.alias("until"), F.array().cast("array<struct<_day:date,_enters:timestamp>>").alias("days"))
    carried = tables.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("_day", "_first", "_table"))).alias("_d"))
    entering = carried.select("instrument", F.inline(F.aggregate("_d", start, through, lambda acc: acc["days"])))

    def step(acc: Column, x: Column) -> Column:
        taken = free(x, acc["until"])
        return F.struct(F.when(taken, x["label_end_time_utc"]).otherwise(acc["until"]).alias("until"), F.concat(acc["taken"], F.array(taken)).alias("taken"))

    begin = F.struct(F.col("_enters").alias("until"), F.array().cast("array<boolean>").alias("taken"))
    decided = days.join(entering, ["instrument", "_day"]).withColumn("_t", F.aggregate("_s", begin, step, lambda acc: acc["taken"])).select("instrument", F.inline(F.arrays_zip("_s", "_t"))).select("instrument", *[F.col(f"_s.{c}").alias(c) for c in order], F.col("_t").alias("_taken"))
    out = decisions.join(decided, ["instrument", *order], "left")
    status = F.when(F.col("decision_status") != "signal", F.col("decision_status")).when(F.col("_taken"), "executed").otherwise("suppressed_overlap")
    return out.withColumn("decision_status", status).drop("_taken")


def with_pnl(decisions: DataFrame, costs: Costs) -> DataFrame:
    """Fills, costs and returns of executed trades, in bps of the entry bid; asks are observed, or the bid plus the spread."""
    spread, slip, commission = costs.spread_bps / BPS, costs.slippage_bps / BPS, 2 * costs.commission_bps
    d, long = F.col("side_sign"), F.col("side_sign") > 0
    bid_in, bid_out = F.col("entry_bid_open"), F.col("exit_bid_open")
    ask_in = F.col("entry_ask_open") if "entry_ask_open" in decisions.columns else bid_in * (1 + spread)
    ask_out = F.col("exit_ask_open") if "exit_ask_open" in decisions.columns else bid_out * (1 + spread)
    side_in, side_out = F.when(long, ask_in).otherwise(bid_in), F.when(long, bid_out).otherwise(ask_out)
    fill_in, fill_out = side_in * (1 + d * slip), side_out * (1 - d * slip)
    done = lambda x: F.when(F.col("decision_status") == "executed", x)
    spread_cost = F.when(long, ask_in - bid_in).otherwise(ask_out - bid_out) / bid_in * BPS
    slip_cost = (side_in + side_out) * slip / bid_in * BPS
    return decisions.withColumns({
        "entry_fill_price": done(fill_in), "exit_fill_price": done(fill_out), "gross_return_bps": done(d * (bid_out - bid_in) / bid_in * BPS), "spread_cost_bps": done(spread_cost),
        "slippage_cost_bps": done(slip_cost), "commission_cost_bps": done(F.lit(commission)), "cost_bps": done(spread_cost + slip_cost + commission),
        "net_return_bps": done(d * (fill_out - fill_in) / bid_in * BPS - commission), "utc_hour": F.hour("entry_time_utc"), "utc_session": session_bucket(F.col("entry_time_utc")),
    })


def run_backtest(rows: DataFrame, costs: Costs = Costs(), policy: Policy = Policy()) -> DataFrame:
    return with_pnl(without_overlap(with_decisions(rows, costs, policy)), costs)


def log_pnl(decisions: DataFrame, flat_cost_bps: float) -> DataFrame:
    """The older convention: the signed log return less a flat cost."""
    return decisions.filter("decision_status = 'executed'").withColumn("net_log_bps", F.col("side_sign") * F.col("future_return_bps") - flat_cost_bps)


SUMMARY = ["n_trades", "gross_bps", "cost_total_bps", "net_bps", "hit_rate", "average_net_bps", "profit_factor", "turnover"]


def summary_columns() -> list[Column]:
    net = F.col("net_return_bps")
    losses = -F.sum(F.when(net < 0, net).otherwise(0.0))
    return [
        F.count("*").alias("n_trades"), F.coalesce(F.sum("gross_return_bps"), F.lit(0.0)).alias("gross_bps"), F.coalesce(F.sum("cost_bps"), F.lit(0.0)).alias("cost_total_bps"), F.coalesce(F.sum(net), F.lit(0.0)).alias("net_bps"),
        F.avg((net > 0).cast("double")).alias("hit_rate"), F.avg(net).alias("average_net_bps"), F.try_divide(F.sum(F.when(net > 0, net).otherwise(0.0)), losses).alias("profit_factor"), (2 * F.count("*")).alias("turnover"),
    ]


def trade_summary(decisions: DataFrame) -> DataFrame:
    return decisions.filter("decision_status = 'executed'").agg(*summary_columns())


def grouped_summaries(decisions: DataFrame, dims: tuple[str, ...] = ("utc_session", "utc_hour", "horizon_minutes", "instrument")) -> DataFrame:
    """Summaries by each dimension alone and over all, in one pass over the trades (grouping sets)."""
    trades = decisions.filter("decision_status = 'executed'")
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = trades.groupingSets(sets, *[F.col(d) for d in dims]).agg(*summary_columns(), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    named, value = F.lit("all"), F.lit("all")
    for d in dims:
        named, value = F.when(F.col(f"_g_{d}") == 0, d).otherwise(named), F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return grouped.select(named.alias("dimension"), value.alias("level"), *SUMMARY)


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision_status").agg(F.count("*").alias("n"))


def exposure(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observed minutes (each instrument from first prediction to last label end), minutes in a trade, and their share; by group if asked."""
    by = by or []
    minutes = lambda a, b: (F.unix_seconds(b) - F.unix_seconds(a)) / 60.0
    held = F.when(F.col("decision_status") == "executed", minutes("entry_time_utc", "label_end_time_utc")).otherwise(0.0)
    per = decisions.groupBy(*by, "instrument").agg(minutes(F.min("prediction_time_utc"), F.max("label_end_time_utc")).alias("m"), F.sum(held).alias("held"))
    return per.groupBy(*by).agg(F.sum("m").alias("observation_minutes"), F.sum("held").alias("held_minutes"), F.try_divide(F.sum("held"), F.sum("m")).alias("exposure"))


def max_drawdown(decisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest fall of realized net from its peak so far, which starts at 0; by group if asked. Exits at one time net out first; running sums
    are within months, with a row a month carried on."""
    by = by or []
    exits = decisions.filter("decision_status = 'executed'").groupBy(*by, "label_end_time_utc").agg(F.sum("net_return_bps").alias("net")).withColumn("_m", F.date_trunc("month", "label_end_time_utc"))
    w = Window.partitionBy(*by, "_m").orderBy("label_end_time_utc").rowsBetween(Window.unboundedPreceding, 0)
    run = exits.withColumn("_c", F.sum("net").over(w)).withColumn("_p", F.max("_c").over(w))
    # of a month: where it ends, its peak, and its largest falls from a peak within it and, by the lowest point, from one before it
    whole = run.groupBy(*by, "_m").agg(F.max("_p").alias("_peak"), F.max_by("_c", "label_end_time_utc").alias("_sum"), F.max(F.col("_p") - F.col("_c")).alias("_own"), F.min("_c").alias("_low"))
    before = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = whole.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    top = F.greatest(F.coalesce(F.max(F.col("_base") + F.col("_peak")).over(before), F.lit(0.0)), F.lit(0.0))
    fall = F.greatest("_own", top - (F.col("_base") + F.col("_low")))
    return months.withColumn("_fall", fall).groupBy(*by).agg(F.coalesce(F.max("_fall"), F.lit(0.0)).alias("max_drawdown_bps"))


POLICIES = (Policy(0.5, 0.0), Policy(0.6, 2.0), Policy(0.7, 4.0))


def select_policy(results: DataFrame, minimum_trades: int = 20) -> DataFrame:
    """results: policy (its place), fold, n_trades, net_bps. The policy of best mean net among those with enough trades in
    every fold and a positive mean, the earlier on ties; no row where cash is best."""
    per = results.groupBy("policy").agg(F.min("n_trades").alias("least_trades"), F.avg("net_bps").alias("mean_net_bps")).filter((F.col("least_trades") >= minimum_trades) & (F.col("mean_net_bps") > 0))
    return per.orderBy(F.col("mean_net_bps").desc(), "policy").limit(1)
