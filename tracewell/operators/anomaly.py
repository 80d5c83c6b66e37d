"""Detectors over payments and calls. Every finding asks for a person's review and carries its evidence.

Payments: src, dst, amount, ts, channel. Calls: caller, callee, ts. Sliding windows are cut to time slices of the window's
length (a row also goes to the slice before its own), so an account's whole history never has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.conf import Anomaly
from tracewell.operators.ordering import quantile
from tracewell.operators.pairing import paired
from tracewell.sources.storage import materialise, release

CONF = Anomaly()
HOUR = 3_600_000_000


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def prepared(tx: DataFrame) -> DataFrame:
    """Payments with unreadable times dropped, unreadable amounts as 0, and _t in microseconds."""
    ts = F.col("ts") if dict(tx.dtypes)["ts"].startswith("timestamp") else F.col("ts").cast("string").try_cast("timestamp_ntz")
    out = tx.withColumns({"ts": ts, "amount": F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0))}).where("ts is not null")
    return out.withColumn("_t", micros("ts"))


def sliced(df: DataFrame, length: int) -> DataFrame:
    """df twice over: in its own slice (_own) and as a follower in the slice before."""
    return df.withColumn("_s", F.explode(F.array(F.lit(0), F.lit(-1)))).withColumns({"_own": F.col("_s") == 0, "_slice": F.floor(F.col("_t") / length) + F.col("_s")}).drop("_s")


def finding(pattern: str, kind: str, ids: Column, score: Column, start: Column, end: Column, description: Column, evidence: Column, persons: Column | None = None, incident: Column | None = None) -> list[Column]:
    return [
        F.lit(pattern).alias("pattern"), F.lit(kind).alias("entity_type"), ids.cast("array<string>").alias("entity_ids"), (persons if persons is not None else F.array()).cast("array<string>").alias("person_ids"),
        F.round(F.least(F.lit(1.0), score), 4).alias("risk_score"), start.alias("window_start"), end.alias("window_end"), description.alias("description"), F.to_json(evidence).alias("evidence"),
        (incident if incident is not None else F.lit("")).cast("string").alias("linked_incident_id"), F.lit(True).alias("requires_human_review"),
    ]


def structuring(tx: DataFrame, conf: Anomaly = CONF, channels: tuple[str, ...] = ("CASH_DEPOSIT", "CASH_WITHDRAWAL")) -> DataFrame:
    """threshold, account: the densest window of cash amounts just below a threshold; the first of equally dense ones."""
    t = prepared(tx).where(F.col("channel").isin(*channels)).withColumn("threshold", F.explode(F.array(*map(F.lit, conf.thresholds))))
    t = t.where((F.col("amount") >= F.col("threshold") * (1 - conf.band)) & (F.col("amount") < F.col("threshold")))
    length = conf.structuring_days * 24 * HOUR
    w = Window.partitionBy("threshold", "dst", "_slice").orderBy("_t").rangeBetween(0, length)
    starts = sliced(t, length).select(
        "threshold", "dst", "ts", "_t", "_own", F.count("*").over(w).alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).over(w).cast("double").alias("total"),
        F.size(F.collect_set("src").over(w)).alias("depositors"), F.max("ts").over(w).alias("end"),
    ).where(F.col("_own") & (F.col("n") >= conf.structuring_count))
    best = starts.groupBy("threshold", "dst").agg(F.max_by(F.struct("n", "total", "depositors", "ts", "end"), F.struct("n", -F.col("_t"))).alias("w")).select("threshold", F.col("dst").alias("account"), "w.*")
    return best.select(
        "threshold", "account", "n", "total", "depositors", F.col("ts").alias("window_start"), F.col("end").alias("window_end"),
        F.round(F.least(F.lit(1.0), 0.35 + 0.05 * F.col("n") + F.when(F.col("depositors") > 3, 0.15).otherwise(0.0)), 4).alias("risk_score"),
    )


def layering(tx: DataFrame, conf: Anomaly = CONF) -> DataFrame:
    """Maximal chains of large payments that keep most of the amount: path, hops, first and last payment.

    A chain is maximal if no payment goes on from it; of equal paths the one with the earliest payments stays.
    """
    t = prepared(tx)
    cut = quantile(t, "amount", conf.layering_quantile, "cut")
    big = materialise(t.crossJoin(F.broadcast(cut)).where("amount >= cut").select("src", "dst", "ts", "_t", "amount"), "payments")
    e = big.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("ts").alias("_ts"), F.col("_t").alias("_t2"), F.col("amount").alias("_amount"))
    chains = big.select(F.array("src", "dst").alias("path"), F.array(F.struct("ts", "amount")).alias("txns"), F.col("dst").alias("last"), F.col("_t").alias("t"), F.col("amount").alias("a"))
    done = None
    for size in range(2, conf.layering_accounts + 1):
        if size == conf.layering_accounts:
            ended = chains.select("path", "txns")
        else:
            low, high = conf.retention
            fits = (F.col("last") == F.col("_src")) & F.col("_t2").between(F.col("t"), F.col("t") + conf.layering_hours * HOUR) & F.expr(f"_amount / a between {low} and {high}") & ~F.array_contains("path", F.col("_dst"))
            grown = materialise(chains.join(e, fits, "left"), "chains")  # what ends here and what goes on both read it
            ended = grown.where("_src is null").select("path", "txns")
            chains = grown.where("_src is not null").select(
                F.array_append("path", F.col("_dst")).alias("path"), F.array_append("txns", F.struct(F.col("_ts").alias("ts"), F.col("_amount").alias("amount"))).alias("txns"),
                F.col("_dst").alias("last"), F.col("_t2").alias("t"), F.col("_amount").alias("a"),
            )
        if size > conf.layering_hops:
            done = ended if done is None else done.unionByName(ended)
    best = done.groupBy("path").agg(F.min("txns").alias("txns"))
    first, last, hops = F.col("txns")[0], F.element_at("txns", -1), F.size("path") - 1
    span = F.expr("timestampdiff(SECOND, txns[0].ts, element_at(txns, -1).ts)") / 3600
    return best.select(
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), hops.alias("hops"), first.amount.alias("initial"), last.amount.alias("final"), F.round(last.amount / first.amount, 4).alias("retention"),
        F.round(span, 2).alias("span_hours"), first.ts.alias("window_start"), last.ts.alias("window_end"), F.round(F.least(F.lit(1.0), 0.4 + 0.08 * hops + F.when(span < 48, 0.2).otherwise(0.0)), 4).alias("risk_score"),
    )


def cash_out_count(targets: DataFrame, tx: DataFrame, hours: int = CONF.cash_out_hours) -> DataFrame:
    """Of targets hub, account, _from (microseconds): hub, cashed = accounts that withdraw cash within hours."""
    out = prepared(tx).where(F.col("channel") == "CASH_WITHDRAWAL").select(F.col("src").alias("account"), "_t")
    hit = targets.join(out, "account").where(F.col("_t").between(F.col("_from"), F.col("_from") + hours * HOUR))
    return hit.groupBy("hub").agg(F.count_distinct("account").alias("cashed"))


def fanout(tx: DataFrame, conf: Anomaly = CONF) -> DataFrame:
    """hub: the first window in which an account pays many others; with how many of them soon withdrew cash."""
    t = prepared(tx).where((F.col("amount") <= conf.fanout_amount) & F.col("channel").isin(*conf.fanout_channels))
    length = conf.fanout_hours * HOUR
    w = Window.partitionBy("src", "_slice").orderBy("_t").rangeBetween(0, length)
    starts = sliced(t, length).select(
        "src", "ts", "_t", "_own", F.sort_array(F.collect_set("dst").over(w)).alias("targets"), F.sum(F.col("amount").cast("decimal(18,2)")).over(w).cast("double").alias("total"), F.max("ts").over(w).alias("end")
    ).where(F.col("_own") & (F.size("targets") >= conf.fanout_targets))
    first = starts.groupBy(F.col("src").alias("hub")).agg(F.min_by(F.struct("targets", "total", "ts", "end", "_t"), F.struct("_t", "total")).alias("w")).select("hub", "w.*")
    first = materialise(first, "hubs")  # read twice
    cashed = cash_out_count(first.select("hub", F.explode("targets").alias("account"), F.col("_t").alias("_from")), tx, conf.cash_out_hours)
    n = F.size("targets")
    return first.join(cashed, "hub", "left").select(
        "hub", n.alias("target_count"), "total", F.coalesce("cashed", F.lit(0)).alias("cash_out_recipients"), F.array_join(F.slice("targets", 1, 30).cast("array<string>"), "|").alias("target_accounts"),
        F.col("ts").alias("window_start"), F.col("end").alias("window_end"), F.round(F.least(F.lit(1.0), 0.35 + 0.03 * n + F.when(F.coalesce("cashed", F.lit(0)) > 2, 0.25).otherwise(0.0)), 4).alias("risk_score"),
    )


def _in_circles(e: DataFrame) -> DataFrame:
    """Pairs e (_src, _dst) without those that lie on no circle since nothing comes to _src or nothing goes on from _dst.

    Again while a round drops a tenth or more: what is left afterwards costs time and changes no result.
    """
    e = materialise(e, "legs")
    left = e.count()
    while left:
        fewer = e.join(e.select(F.col("_dst").alias("_src")).distinct(), "_src", "left_semi").join(e.select(F.col("_src").alias("_dst")).distinct(), "_dst", "left_semi")
        fewer = materialise(fewer.select(*e.columns), "legs")
        now = fewer.count()
        release(e)
        if now > 0.9 * left:
            return fewer
        e, left = fewer, now
    return e


def round_trips(tx: DataFrame, conf: Anomaly = CONF) -> DataFrame:
    """Sets of accounts that money passes in a circle and comes back to its start nearly whole.

    From each start, the first leg is the pair's earliest payment and each later one the earliest not before the leg before
    it. Of a set's circles within the tolerance the one that starts first stays (ties: the least path).

    A circle is a way out and a way back that meet at both their ends, so only half its legs are followed from a start. A way
    back has the latest time at which money may set out on it: it fits a way out that arrives by then.
    """
    t = prepared(tx)
    cut = quantile(t, "amount", conf.cycle_quantile, "cut")
    big = t.crossJoin(F.broadcast(cut)).where("amount >= cut and src <> dst")
    e = big.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("ts", "amount"))).alias("txns")).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("txns").alias("_txns"))
    e = _in_circles(e)
    low, high = conf.cycle_hops
    next_leg = F.try_element_at(F.filter("_txns", lambda x: x.ts >= F.element_at("legs", -1).ts), F.lit(1))
    out = {1: e.select(F.array("_src", "_dst").alias("path"), F.array(F.col("_txns")[0]).alias("legs"))}
    back = {1: e.select(F.array("_src", "_dst").alias("tail"), F.element_at("_txns", -1).ts.alias("until"))}
    for size in range(2, (high + 1) // 2 + 1):
        grown = out[size - 1].join(e, (F.element_at("path", -1) == F.col("_src")) & ~F.array_contains("path", F.col("_dst"))).withColumn("_leg", next_leg).where("_leg is not null")
        out[size] = materialise(grown.select(F.array_append("path", F.col("_dst")).alias("path"), F.array_append("legs", F.col("_leg")).alias("legs")), "ways_out")
    for size in range(2, high // 2 + 1):
        grown = back[size - 1].join(e, (F.col("tail")[0] == F.col("_dst")) & ~F.array_contains("tail", F.col("_src")))
        grown = grown.withColumn("_leg", F.try_element_at(F.filter("_txns", lambda x: x.ts <= F.col("until")), F.lit(-1))).where("_leg is not null")
        back[size] = materialise(grown.select(F.array_prepend("tail", F.col("_src")).alias("tail"), F.col("_leg.ts").alias("until")), "ways_back")
    found = None
    for size in range(max(low, 2), high + 1):
        between = F.slice("tail", 2, F.size("tail") - 2)
        meets = (F.element_at("path", -1) == F.col("tail")[0]) & (F.col("path")[0] == F.element_at("tail", -1)) & (F.element_at("legs", -1).ts <= F.col("until")) & ~F.arrays_overlap("path", between)
        closed = out[(size + 1) // 2].join(back[size // 2], meets).select(F.concat("path", between).alias("path"), "legs", "tail")
        found = closed if found is None else found.unionByName(closed)
    for i in range(high // 2):
        pair = (F.get("tail", F.lit(i)) == F.col("_src")) & (F.get("tail", F.lit(i + 1)) == F.col("_dst"))
        found = found.join(e, pair, "left").select("path", F.when(F.col("_src").isNull(), F.col("legs")).otherwise(F.array_append("legs", next_leg)).alias("legs"), "tail")
    start, end = F.col("legs")[0], F.element_at("legs", -1)
    near = found.where(F.abs(end.amount - start.amount) / start.amount <= conf.cycle_tolerance)
    best = near.groupBy(F.sort_array("path").alias("accounts")).agg(F.min(F.struct(start.ts.alias("ts"), F.col("path"), F.col("legs"))).alias("b")).select("b.path", "b.legs")
    return best.select(
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.size("path").alias("hops"), start.amount.alias("out_amount"), end.amount.alias("back_amount"), F.round(1 - end.amount / start.amount, 4).alias("attrition"),
        start.ts.alias("window_start"), end.ts.alias("window_end"), F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.size("path")), 4).alias("risk_score"),
    )


def dormant(tx: DataFrame, conf: Anomaly = CONF) -> DataFrame:
    """Large receipts of an account that mostly leave again soon after; with the days that it was idle before."""
    t = prepared(tx)
    # large receipts in their own slice meet what leaves the same account in it and in the next: other moves decide nothing
    large = t.where(F.col("amount") >= conf.dormant_amount).select(F.col("dst").alias("account"), "ts", "_t", "amount", F.lit(True).alias("_own"))
    # stored, so that their size is known and payments are not shuffled to meet a few accounts
    receivers = materialise(large.select(F.col("account").alias("src")).distinct(), "accounts")
    paid = t.join(receivers, "src", "left_semi").select(F.col("src").alias("account"), "ts", "_t", "amount")
    length = conf.dormant_hours * HOUR
    w = Window.partitionBy("account", "_slice").orderBy("_t").rangeBetween(1, length)
    out = ~F.col("_own")
    both = large.withColumn("_slice", F.floor(F.col("_t") / length)).unionByName(sliced(paid, length).withColumn("_own", F.lit(False)))
    after = both.select(
        "account", "ts", "_t", "amount", "_own", F.sum(F.when(out, F.col("amount").cast("decimal(18,2)"))).over(w).cast("double").alias("passed"), F.max(F.when(out, F.col("ts"))).over(w).alias("end")
    ).where(F.col("_own") & F.col("passed").isNotNull())
    ratio = F.col("passed") / F.col("amount")
    kept = materialise(after.where(ratio >= conf.dormant_ratio).drop("_own"), "receipts")  # read twice
    # idle time before: a move at the same moment means none. The move before is in the slice, or the last of the slice before.
    # Receipts lie among the moves (_n 0 and 1), so that all rows are shuffled once; stored are receipts and the last row of each slice
    accounts = kept.select("account").distinct()
    rows = kept.select("account", "_t", F.lit(0).alias("_n"), F.struct("ts", "amount", "passed", "end").alias("_receipt"))
    for end in ("src", "dst"):
        own = t.select(F.col(end).alias("account"), "_t").join(accounts, "account", "left_semi")
        rows = rows.unionByName(own.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    w2, slices = Window.partitionBy("account", "_slice").orderBy("_t"), Window.partitionBy("account").orderBy("_slice")
    moments = rows.withColumn("_slice", F.floor(F.col("_t") / length)).select(
        "account", "_slice", "_t", "_receipt", F.sum("_n").over(w2.rangeBetween(0, 0)).alias("at_once"), F.max("_t").over(w2.rangeBetween(Window.unboundedPreceding, -1)).alias("_near"),
        F.lead("_t").over(w2).isNull().alias("_ends"),
    )
    moments = materialise(moments.where("_ends or _receipt is not null"), "moments")
    ends = moments.where("_ends").select("account", "_slice", F.lag("_t").over(slices).alias("_earlier"))
    found = moments.where("_receipt is not null").join(ends, ["account", "_slice"]).select("account", "_t", "_receipt.*", "at_once", F.coalesce("_near", "_earlier").alias("before"))
    idle = F.when(F.col("at_once") > 1, 0).otherwise(F.coalesce(F.floor((F.col("_t") - F.col("before")) / (24 * HOUR)), F.lit(0))).cast("int")
    return found.select(
        "account", idle.alias("dormant_days"), (idle >= conf.dormant_days).alias("was_dormant"), F.col("amount").alias("inflow"), F.col("passed").alias("outflow"), F.round(ratio, 4).alias("passthrough_ratio"),
        F.col("ts").alias("window_start"), F.col("end").alias("window_end"),
        F.round(F.least(F.lit(1.0), 0.35 + F.when(ratio > 0.9, 0.2).otherwise(0.0) + F.when(idle >= conf.dormant_days, 0.25).otherwise(0.0)), 4).alias("risk_score"),
    )


def call_bursts(calls: DataFrame, incidents: DataFrame, accused: DataFrame, conf: Anomaly = CONF) -> DataFrame:
    """Incidents (incident, ts) whose accused (incident, person) called each other unusually often just before."""
    a = accused.where("person is not null").select("incident", "person").distinct()
    size = a.groupBy("incident").agg(F.count("*").alias("group_size")).where("group_size >= 2")
    when = incidents.where("ts is not null").groupBy("incident", F.col("ts").alias("window_end")).agg(F.count("*").alias("_m")).join(size, "incident").withColumn("_i", micros("window_end"))
    members = a.join(when, "incident", "left_semi")
    c = calls.where("caller is not null and callee is not null and ts is not null").select("caller", "callee", micros("ts").alias("_t"))
    # calls just before meet the incidents of their own time alone, by slices of the window's length
    length = conf.burst_hours * HOUR
    at = F.floor(F.col("_i") / length)
    mine = members.join(when, "incident").select(F.col("person").alias("caller"), "incident", "window_end", "_i", F.explode(F.array(at, at - 1)).alias("_slice"))
    moments = c.groupBy("caller", "callee", "_t").agg(F.count("*").alias("k")).withColumn("_slice", F.floor(F.col("_t") / length))
    near = moments.join(mine, ["caller", "_slice"]).where(F.col("_t").between(F.col("_i") - length, F.col("_i"))).join(members.withColumnRenamed("person", "callee"), ["callee", "incident"])
    soon = when.join(near.groupBy("incident", "window_end").agg(F.sum("k").alias("k")), ["incident", "window_end"], "left").withColumn("calls_in_window", F.coalesce("k", F.lit(0)) * F.col("_m"))
    soon = materialise(soon.where(F.col("calls_in_window") >= conf.burst_calls).drop("k", "_i"), "bursts")
    # calls of all times are one row a pair, and meet the incidents that may still be reported
    members = members.join(soon, "incident", "left_semi")
    pairs = c.groupBy("caller", "callee").agg(F.count("*").alias("k"))
    inside = pairs.join(members.withColumnRenamed("person", "caller"), "caller").groupBy("callee", "incident").agg(F.sum("k").alias("k"))  # before they meet the members called
    inside = inside.join(members.withColumnRenamed("person", "callee"), ["callee", "incident"])
    n = soon.join(inside.groupBy("incident").agg(F.sum("k").alias("k")), "incident").withColumn("total", F.col("k") * F.col("_m"))
    expected = F.col("total") * (conf.burst_hours / 24) / conf.burst_span_days
    return n.where(F.col("calls_in_window") / expected >= conf.burst_ratio).select(
        "incident", "calls_in_window", "group_size", F.round(expected, 2).alias("baseline_expected"), F.round(F.col("calls_in_window") / expected, 1).alias("ratio_to_baseline"), "window_end",
        F.round(F.least(F.lit(1.0), 0.4 + 0.02 * F.col("calls_in_window")), 4).alias("risk_score"),
    )


def burners(sims: DataFrame, calls: DataFrame, owners: DataFrame, conf: Anomaly = CONF) -> DataFrame:
    """Pairs of SIMs (imei, phone, _row) in one handset whose contacts (calls: phone, contact, ts) overlap; owners: phone, owner.

    One owner: a rotation, if they were active at different times. Two owners: a shared handset.
    """
    contacts = calls.where("phone is not null").groupBy("phone", "contact").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    active = contacts.groupBy("phone").agg(F.count("*").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    s = sims.where("imei is not null").groupBy("imei", "phone").agg(F.min("_row").alias("_row"))
    pairs = paired(s, ["imei"], "_row", ["phone"]).withColumnsRenamed({"a_phone": "p1", "b_phone": "p2"})
    common = pairs.select("p1", "p2").distinct().join(contacts.select(F.col("phone").alias("p1"), F.col("contact")), "p1").join(contacts.select(F.col("phone").alias("p2"), F.col("contact").alias("other")), "p2")
    common = common.where(F.col("contact").eqNullSafe(F.col("other"))).groupBy("p1", "p2").agg(F.count("*").alias("shared"))
    one = owners.groupBy("phone").agg(F.min("owner").alias("owner"))
    df = pairs.join(common, ["p1", "p2"])
    for i in ("1", "2"):
        df = df.join(active.select(F.col("phone").alias(f"p{i}"), F.col("n").alias(f"n{i}"), F.col("first").alias(f"s{i}"), F.col("last").alias(f"e{i}")), f"p{i}")
        df = df.join(one.select(F.col("phone").alias(f"p{i}"), F.coalesce(F.col("owner").cast("string"), F.lit("")).alias(f"o{i}")), f"p{i}", "left").na.fill("", [f"o{i}"])
    seconds = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / 1_000_000
    jaccard = F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))
    overlap, span = seconds("greatest(s1, s2)", "least(e1, e2)"), seconds("least(s1, s2)", "greatest(e1, e2)")
    part = F.when(span > 0, F.greatest(F.lit(0.0), overlap) / span).otherwise(1.0)
    same = F.col("o1") == F.col("o2")
    return df.where((jaccard >= conf.burner_jaccard) & (~same | (part <= conf.burner_overlap))).select(
        F.when(same, "BURNER_SIM_ROTATION").otherwise("SHARED_HANDSET").alias("pattern"), "imei", "p1", "p2", F.col("o1").alias("subscriber_a"), F.col("o2").alias("subscriber_b"), F.col("shared").alias("shared_contacts"),
        F.round(jaccard, 4).alias("contact_jaccard"), F.round(part, 4).alias("active_overlap_fraction"), F.least("s1", "s2").alias("window_start"), F.greatest("e1", "e2").alias("window_end"),
        F.round(F.least(F.lit(1.0), 0.45 + jaccard), 4).alias("risk_score"),
    )


def gathered(structured=None, layered=None, fanned=None, tripped=None, slept=None, burst=None, rotated=None) -> DataFrame:
    """Detector outputs as one stored table of findings, without numbers."""
    ids = lambda c, sep: F.split(c, sep)
    ev = lambda df, *c: F.struct(*[F.col(x) for x in c])
    s, e, r = F.col("window_start"), F.col("window_end"), F.col("risk_score")
    parts = []
    if structured is not None:
        text = F.format_string("%d cash payments just below %d into one account, %.2f in all, from %d depositors.", "n", F.col("threshold").cast("long"), "total", "depositors")
        parts.append(structured.select(*finding("STRUCTURING_SMURFING", "ACCOUNT", F.array("account"), r, s, e, text, ev(structured, "n", "total", "threshold", "depositors"))))
    if layered is not None:
        text = F.format_string("%d-hop pass-through of %.2f within %.1f hours.", "hops", "initial", "span_hours")
        parts.append(layered.select(*finding("LAYERING_CHAIN", "ACCOUNT_PATH", ids("path", ">"), r, s, e, text, ev(layered, "hops", "initial", "final", "retention", "span_hours"))))
    if fanned is not None:
        text = F.format_string("One account paid %.2f to %d others; %d of them soon withdrew cash.", "total", "target_count", "cash_out_recipients")
        parts.append(fanned.select(*finding("MULE_FANOUT", "ACCOUNT", F.array("hub"), r, s, e, text, ev(fanned, "target_count", "total", "cash_out_recipients", "target_accounts"))))
    if tripped is not None:
        text = F.format_string("%.2f left one account and %.2f came back after %d hops.", "out_amount", "back_amount", "hops")
        parts.append(tripped.select(*finding("ROUND_TRIPPING", "ACCOUNT_CYCLE", ids("path", ">"), r, s, e, text, ev(tripped, "hops", "out_amount", "back_amount", "attrition"))))
    if slept is not None:
        text = F.format_string("Account received %.2f after %d idle days and passed %.2f on.", "inflow", "dormant_days", "outflow")
        parts.append(slept.select(*finding("DORMANT_REACTIVATION", "ACCOUNT", F.array("account"), r, s, e, text, ev(slept, "dormant_days", "was_dormant", "inflow", "outflow", "passthrough_ratio"))))
    if burst is not None:
        text = F.format_string("%d calls among %d accused before the incident, %.1f times their usual rate.", "calls_in_window", "group_size", "ratio_to_baseline")
        parts.append(burst.select(*finding("PRE_INCIDENT_CALL_BURST", "PERSON_SET", F.array("incident"), r, e, e, text, ev(burst, "calls_in_window", "group_size", "baseline_expected", "ratio_to_baseline"), incident=F.col("incident"))))
    if rotated is not None:
        text = F.format_string("Two SIMs in one handset share %.4f of their contacts.", "contact_jaccard")
        cols = finding("X", "DEVICE", F.array("imei"), r, s, e, text, ev(rotated, "p1", "p2", "contact_jaccard", "active_overlap_fraction", "shared_contacts"), persons=F.array_distinct(F.filter(F.array("subscriber_a", "subscriber_b"), lambda x: x != "")))
        parts.append(rotated.select(F.col("pattern"), *cols[1:]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialise(out.withColumn("_key", F.concat_ws("|", "pattern", F.array_join("entity_ids", ","), F.col("window_start").cast("string"), "evidence")), "findings")


def as_findings(structured=None, layered=None, fanned=None, tripped=None, slept=None, burst=None, rotated=None) -> DataFrame:
    """Detector outputs as one table of findings, numbered by risk."""
    from tracewell.operators.ordering import numbered

    return numbered(gathered(structured, layered, fanned, tripped, slept, burst, rotated), "risk_score", "_key", "_n").withColumn("finding_id", F.format_string("AN%05d", "_n")).drop("_key", "_n")


def evaluate(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """pattern, planted, detected, recall, findings_raised (and a row _overall) against truth pattern, entity_ids (joined by |)."""
    f = findings
    ids = f.select("pattern", F.explode(F.array_union("entity_ids", "person_ids")).alias("id"))
    shared = ids.where("pattern = 'SHARED_HANDSET'").withColumn("pattern", F.lit("BURNER_SIM_ROTATION"))
    ids = ids.unionByName(shared).distinct()
    rows = truth.groupBy("pattern", "entity_ids").agg(F.count("*").alias("n"))  # repeated truths count as often as they are there
    want = rows.withColumn("id", F.explode_outer(F.filter(F.split(F.coalesce("entity_ids", F.lit("")), "\\|"), lambda x: x != "")))
    hit = want.join(ids.withColumn("_hit", F.lit(1)), ["pattern", "id"], "left").groupBy("pattern", "entity_ids", "n").agg(F.max("_hit").alias("hit"))
    raised = f.select(F.when(F.col("pattern") == "SHARED_HANDSET", F.lit("BURNER_SIM_ROTATION")).otherwise(F.col("pattern")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("findings_raised"))
    per = hit.groupBy("pattern").agg(F.sum("n").alias("planted"), F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("n"))), F.lit(0)).alias("detected")).join(raised, "pattern", "left").na.fill(0, ["findings_raised"])
    whole = per.agg(F.lit("_overall").alias("pattern"), F.sum("planted").alias("planted"), F.sum("detected").alias("detected")).crossJoin(f.agg(F.count("*").alias("findings_raised")))
    return per.unionByName(whole).select("pattern", "planted", "detected", F.round(F.coalesce(F.try_divide("detected", "planted"), F.lit(0.0)), 4).alias("recall"), "findings_raised")
