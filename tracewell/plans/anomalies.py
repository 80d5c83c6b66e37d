"""Queries over the detectors. The driver's dates are whole days and its amounts small, so thresholds differ from the defaults."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import anomaly as A
from tracewell.plans import views as V
from tracewell.sources.storage import materialise

CONF = replace(A.CONF, thresholds=(20_000, 50_000), structuring_days=240, layering_hops=2, layering_hours=720, dormant_days=20, dormant_amount=45_000, dormant_hours=720)
CALLS = replace(A.CONF, burst_calls=2, burst_ratio=3.0)
SIMS = replace(A.CONF, burner_jaccard=0.06, burner_overlap=0.9)


def v_case(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Incidents: days of one kind of event, at the day's end; accused: users with that event on the day."""
    e = V.table(s, d, "events").where("event_type = 'purchase' or event_type = 'error'").select(F.date_trunc("day", "ts").alias("day"), "event_type", F.col("user_id").alias("person"))
    key = F.concat("event_type", F.lit(" "), F.date_format("day", "yyyy-MM-dd"))
    accused = e.select(key.alias("incident"), "person").distinct()
    return e.select(key.alias("incident"), F.expr("cast(day as timestamp_ntz) + interval 1 day").alias("ts")).distinct(), accused


def v_sims(s: SparkSession, d: str):
    e = V.v_comm(s, d)
    phone = F.concat(F.col("caller").cast("string"), F.lit("-"), "kind")
    calls = e.select(phone.alias("phone"), F.col("callee").alias("contact"), "ts")
    base = e.select(F.col("caller").alias("imei"), phone.alias("phone"), "kind").distinct()
    sims = base.select("imei", "phone", F.col("phone").alias("_row"))
    owners = base.select("phone", F.when(F.col("kind") == "click", F.lit("other")).otherwise(F.col("imei").cast("string")).alias("owner"))
    return sims, calls, owners


def detected(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """What each detector finds. Payments are joined from lines and orders once, and stored: the detectors read them a dozen times."""
    tx = materialise(V.v_tx(s, d), "payments")
    incidents, accused = v_case(s, d)
    return (A.structuring(tx, CONF), A.layering(tx, CONF), A.fanout(tx), A.round_trips(tx, CONF), A.dormant(tx, CONF), A.call_bursts(V.v_comm(s, d), incidents, accused, CALLS), A.burners(*v_sims(s, d), SIMS))


def findings(s: SparkSession, d: str) -> DataFrame:
    return A.as_findings(*detected(s, d))


def recall(s: SparkSession, d: str) -> DataFrame:
    """Against findings as they are stored: their numbers, for which all of them are put in order, decide nothing."""
    return A.evaluate(A.gathered(*detected(s, d)), planted(s, d))


def planted(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as truth: every tenth account for structuring, every seventh for fan-out."""
    a = V.table(s, d, "supplier").select("s_suppkey")
    one = a.where("s_suppkey % 10 = 0").select(F.lit("STRUCTURING_SMURFING").alias("pattern"), F.concat("s_suppkey", F.lit("|"), F.col("s_suppkey") + 1000000).alias("entity_ids"))
    return one.unionByName(a.where("s_suppkey % 7 = 0").select(F.lit("MULE_FANOUT").alias("pattern"), F.col("s_suppkey").cast("string").alias("entity_ids")))


QUERIES = {
    "structuring": lambda s, d: A.structuring(V.v_tx(s, d), CONF),
    "layering_chains": lambda s, d: A.layering(V.v_tx(s, d), CONF),
    "mule_fanout": lambda s, d: A.fanout(V.v_tx(s, d)),
    "cash_out": lambda s, d: A.cash_out_count(V.v_tx(s, d).where("channel = 'IMPS'").groupBy(F.col("src").alias("hub"), F.col("dst").alias("account")).agg(F.min(A.micros("ts")).alias("_from")), V.v_tx(s, d), 240),
    "round_trips": lambda s, d: A.round_trips(V.v_tx(s, d), CONF),
    "dormant_passthrough": lambda s, d: A.dormant(V.v_tx(s, d), CONF),
    "call_burst": lambda s, d: A.call_bursts(V.v_comm(s, d), *v_case(s, d), CALLS),
    "burner_jaccard": lambda s, d: A.burners(*v_sims(s, d), SIMS),
    "anomaly_findings": findings,
    "anomaly_recall": recall,
}

STRUCTURING = """band as (select thr, t.* from v_tx t, (values (20000), (50000)) as x(thr) where channel in ('CASH_DEPOSIT', 'CASH_WITHDRAWAL') and amount >= thr * 0.88 and amount < thr),
starts as (select distinct thr, dst, ts from band), wins as (select s.thr, s.dst, s.ts, count(*) as n, cast(sum(cast(amount as decimal(18,2))) as double) as total, count(distinct src) as depositors, max(b.ts) as e
  from starts s join band b on b.thr = s.thr and b.dst = s.dst and b.ts between s.ts and s.ts + interval 240 day group by 1, 2, 3 having count(*) >= 5),
structuring as (select thr as threshold, dst as account, n, total, cast(depositors as int) as depositors, ts as window_start, e as window_end, round(least(1.0, 0.35 + 0.05 * n + case when depositors > 3 then 0.15 else 0 end), 4) as risk_score
  from wins qualify row_number() over (partition by thr, dst order by n desc, ts) = 1)"""
BIG = """big as (select src, dst, ts, amount from v_tx where amount >= (select quantile_cont(amount, {q}) from v_tx){more})"""
LAYERING = BIG.format(q=0.9, more="") + """, chains as (select [src, dst] as path, [{'ts': ts, 'amount': amount}] as txns, dst as last, ts as t, amount as a from big
  union all select list_append(path, b.dst), list_append(txns, {'ts': b.ts, 'amount': b.amount}), b.dst, b.ts, b.amount from chains join big b on b.src = last and b.ts between t and t + interval 720 hour
    and b.amount / a between 0.8 and 1.02 and not list_contains(path, b.dst) where len(path) < 8),
ended as (select path, txns from chains where len(path) > 2 and (len(path) = 8 or not exists (select 1 from big b where b.src = last and b.ts between t and t + interval 720 hour and b.amount / a between 0.8 and 1.02 and not list_contains(path, b.dst)))),
best as (select path, min(txns) as txns from ended group by 1)"""
FANOUT = """small as (select * from v_tx where amount <= 50000 and channel = 'IMPS'), starts as (select distinct src, ts from small),
wins as (select s.src, s.ts, count(distinct dst) as n, cast(sum(cast(amount as decimal(18,2))) as double) as total, list_sort(list(distinct dst)) as targets, max(b.ts) as e from starts s join small b on b.src = s.src and b.ts between s.ts and s.ts + interval 6 hour group by 1, 2 having count(distinct dst) >= 5),
hubs as (select * from wins qualify row_number() over (partition by src order by ts, total) = 1),
targets as (select src, ts, unnest(targets) as account from hubs),
cashed as (select g.src, count(distinct g.account) as cashed from targets g join v_tx w on w.src = g.account and w.channel = 'CASH_WITHDRAWAL' and w.ts between g.ts and g.ts + interval 24 hour group by 1)"""
TRIPS = BIG.format(q=0.85, more=" and src <> dst") + """, e as (select src, dst, list_sort(list({'ts': ts, 'amount': amount})) as txns from big group by 1, 2),
paths as (select [src, dst] as path, [txns[1]] as legs, false as closed from e
  union all select case when dst = path[1] then path else list_append(path, dst) end, list_append(legs, list_filter(txns, lambda x: x.ts >= legs[-1].ts)[1]), dst = path[1]
    from paths join e on src = path[-1] where not closed and len(path) <= 6 and len(list_filter(txns, lambda x: x.ts >= legs[-1].ts)) > 0 and ((dst = path[1] and len(path) >= 3) or (not list_contains(path, dst) and len(path) < 6))),
near as (select path, legs from paths where closed and abs(legs[-1].amount - legs[1].amount) / legs[1].amount <= 0.15),
best as (select path, legs from near qualify row_number() over (partition by list_sort(path) order by legs[1].ts, path, legs) = 1)"""
DORMANT = """moves as (select src as account, ts, amount, 'OUT' as dir from v_tx union all select dst, ts, amount, 'IN' from v_tx),
moments as (select account, ts, count(*) as at_once, lag(ts) over (partition by account order by ts) as before from moves group by 1, 2),
ins as (select account, ts, amount from moves where dir = 'IN' and amount >= 45000),
passed as (select i.account, i.ts, i.amount, o.s as passed, o.e from ins i, lateral (select cast(sum(cast(amount as decimal(18,2))) as double) as s, max(ts) as e from moves m where m.account = i.account and m.dir = 'OUT' and m.ts > i.ts and m.ts <= i.ts + interval 720 hour) o where o.s / i.amount >= 0.7),
idle as (select p.*, cast(case when at_once > 1 then 0 else coalesce(floor((epoch_us(p.ts) - epoch_us(before)) / 86400000000), 0) end as int) as days from passed p join moments m on m.account = p.account and m.ts = p.ts)"""
CASES = """days as (select event_type || ' ' || strftime(date_trunc('day', ts), '%Y-%m-%d') as incident, date_trunc('day', ts) as day, user_id as person from events where event_type in ('purchase', 'error')),
incidents as (select distinct incident, day::timestamp + interval 1 day as i from days), accused as (select distinct incident, person from days),
groups as (select incident, count(*) as group_size from accused group by 1 having count(*) >= 2),
n as (select incident, group_size, i as window_end, count(*) filter (c.ts between i - interval 48 hour and i) as k, count(*) as total from groups join incidents using (incident) join accused a using (incident) join accused b using (incident)
  join v_comm c on c.caller = a.person and c.callee = b.person group by 1, 2, 3)"""
SIM = """sims as (select distinct caller as imei, caller || '-' || kind as phone, kind from v_comm), contacts as (select caller || '-' || kind as phone, callee as contact, min(ts) as lo, max(ts) as hi from v_comm group by 1, 2),
active as (select phone, count(*) as n, min(lo) as f, max(hi) as l from contacts group by 1), owner as (select phone, case when kind = 'click' then 'other' else imei::varchar end as o from sims),
pairs as (select x.imei, x.phone as p1, y.phone as p2 from sims x join sims y on x.imei = y.imei and x.phone < y.phone),
common as (select p1, p2, count(*) as shared from pairs join contacts a on a.phone = p1 join contacts b on b.phone = p2 and b.contact = a.contact group by 1, 2),
j as (select imei, p1, p2, o1.o as o1, o2.o as o2, shared, shared / (a1.n + a2.n - shared) as jac, least(a1.f, a2.f) as s, greatest(a1.l, a2.l) as e,
  greatest(0.0, (epoch_us(least(a1.l, a2.l)) - epoch_us(greatest(a1.f, a2.f))) / 1e6) / ((epoch_us(greatest(a1.l, a2.l)) - epoch_us(least(a1.f, a2.f))) / 1e6) as part
  from pairs join common using (p1, p2) join active a1 on a1.phone = p1 join active a2 on a2.phone = p2 join owner o1 on o1.phone = p1 join owner o2 on o2.phone = p2)"""

ORACLES = {
    "structuring": V.sql("v_tx", STRUCTURING, "select * from structuring"),
    "layering_chains": V.sql("v_tx", LAYERING, """select array_to_string(path, '>') as path, cast(len(path) - 1 as int) as hops, txns[1].amount as initial, txns[-1].amount as final, round(txns[-1].amount / txns[1].amount, 4) as retention,
      round((epoch(txns[-1].ts) - epoch(txns[1].ts)) / 3600, 2) as span_hours, txns[1].ts as window_start, txns[-1].ts as window_end,
      round(least(1.0, 0.4 + 0.08 * (len(path) - 1) + case when epoch(txns[-1].ts) - epoch(txns[1].ts) < 48 * 3600 then 0.2 else 0 end), 4) as risk_score from best""").replace("with v_tx", "with recursive v_tx", 1),
    "mule_fanout": V.sql("v_tx", FANOUT, """select h.src as hub, cast(n as int) as target_count, total, coalesce(cashed, 0) as cash_out_recipients, array_to_string(list_slice(targets, 1, 30), '|') as target_accounts, ts as window_start, e as window_end,
      round(least(1.0, 0.35 + 0.03 * n + case when coalesce(cashed, 0) > 2 then 0.25 else 0 end), 4) as risk_score from hubs h left join cashed using (src)"""),
    "cash_out": V.sql("v_tx", """t as (select src as hub, dst as account, min(ts) as f from v_tx where channel = 'IMPS' group by 1, 2)""", "select hub, count(distinct account) as cashed from t join v_tx w on w.src = account and w.channel = 'CASH_WITHDRAWAL' and w.ts between f and f + interval 240 hour group by 1"),
    "round_trips": V.sql("v_tx", TRIPS, """select array_to_string(path, '>') as path, cast(len(path) as int) as hops, legs[1].amount as out_amount, legs[-1].amount as back_amount, round(1 - legs[-1].amount / legs[1].amount, 4) as attrition,
      legs[1].ts as window_start, legs[-1].ts as window_end, round(least(1.0, 0.5 + 0.1 * len(path)), 4) as risk_score from best""").replace("with v_tx", "with recursive v_tx", 1),
    "dormant_passthrough": V.sql("v_tx", DORMANT, """select account, days as dormant_days, days >= 20 as was_dormant, amount as inflow, passed as outflow, round(passed / amount, 4) as passthrough_ratio, ts as window_start, e as window_end,
      round(least(1.0, 0.35 + case when passed / amount > 0.9 then 0.2 else 0 end + case when days >= 20 then 0.25 else 0 end), 4) as risk_score from idle"""),
    "call_burst": V.sql("v_comm", CASES, """select incident, k as calls_in_window, group_size, round(total * 2.0 / 2920, 2) as baseline_expected, round(k / (total * 2.0::double / 2920), 1) as ratio_to_baseline, window_end, round(least(1.0, 0.4 + 0.02 * k), 4) as risk_score
      from n where k >= 2 and k / (total * 2.0::double / 2920) >= 3"""),
    "burner_jaccard": V.sql("v_comm", SIM, """select case when o1 = o2 then 'BURNER_SIM_ROTATION' else 'SHARED_HANDSET' end as pattern, imei, p1, p2, o1 as subscriber_a, o2 as subscriber_b, shared as shared_contacts, round(jac, 4) as contact_jaccard,
      round(part, 4) as active_overlap_fraction, s as window_start, e as window_end, round(least(1.0, 0.45 + jac), 4) as risk_score from j where jac >= 0.06 and (o1 <> o2 or part <= 0.9)"""),
}
