"""Queries over the evidence layers and the keyed lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import graph, indices
from tracewell.plans import views as V
from tracewell.sources.artefacts import Store
from tracewell.sources.storage import shared_dir


def all_layers(s: SparkSession, d: str) -> DataFrame:
    return graph.layer_rows({
        "intel": graph.intel_layer(V.v_rel(s, d)), "comm": graph.comm_layer(V.v_comm(s, d)), "money": graph.undirected_money(graph.money_layer(V.v_tx(s, d))),
        "co_event": graph.co_event_layer(V.v_joint(s, d)), "co_place": graph.co_place_layer(V.v_presence(s, d)),
    })


def published(s: SparkSession, d: str) -> DataFrame:
    """The comm layer as a reader of the artefact store has it: its second version, after a run that was given up."""
    store = Store(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}")
    layer = graph.comm_layer(V.v_comm(s, d))
    store.stage("comm", layer.limit(0))
    store.publish()
    store.stage("comm", layer)
    store.publish()
    store.stage("comm", layer.where("a % 2 = 0"))
    store.discard()
    return store.read("comm")


def _owners(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("_row"), F.col("o_orderpriority").alias("v"))


def _hetero(s: SparkSession, d: str):
    c, o, n = V.table(s, d, "customer"), V.table(s, d, "orders"), V.table(s, d, "nation")
    nodes = {
        "PERSON": c.select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.col("c_name").alias("label")),
        "INCIDENT": o.select(F.concat(F.lit("I"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label")),
        "LOCATION": n.where("n_nationkey < 20").select(F.concat(F.lit("L"), "n_nationkey").alias("id"), F.col("n_name").alias("label")),
    }
    edges = {
        "INVOLVED_IN": o.select(F.concat(F.lit("P"), "o_custkey").alias("src"), F.concat(F.lit("I"), "o_orderkey").alias("dst")),
        "PRESENT_AT": c.select(F.concat(F.lit("P"), "c_custkey").alias("src"), F.concat(F.lit("L"), "c_nationkey").alias("dst")),
    }
    return graph.hetero(nodes, edges)


QUERIES = {
    "layer_money_materiality": lambda s, d: graph.money_layer(V.v_tx(s, d)),
    "layer_money_undirected": lambda s, d: graph.undirected_money(graph.money_layer(V.v_tx(s, d))),
    "layer_comm_published": published,
    "layer_comm": lambda s, d: graph.comm_layer(V.v_comm(s, d)),
    "layer_intel_merge": lambda s, d: graph.intel_layer(V.v_rel(s, d)),
    "layer_co_event": lambda s, d: graph.co_event_layer(V.v_incident(s, d)),
    "layer_co_place": lambda s, d: graph.co_place_layer(V.v_presence(s, d)),
    "fused_graph": lambda s, d: graph.fuse(all_layers(s, d))[0],
    "fusion_leads": lambda s, d: graph.fuse(all_layers(s, d))[1],
    "corroboration_histogram": lambda s, d: graph.corroboration_histogram(graph.fuse(all_layers(s, d))[0]),
    "vertex_attributes": lambda s, d: graph.with_vertex_attributes(
        graph.intel_layer(V.v_rel(s, d)).select(F.explode(F.array("a", "b")).alias("id")).distinct(),
        V.table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("risk")), ["name", "segment", "risk"]),
    "hetero_nodes": lambda s, d: _hetero(s, d)[0],
    "hetero_edges": lambda s, d: _hetero(s, d)[1],
    "graph_projection": lambda s, d: graph.projection(V.v_comm(s, d), V.v_tx(s, d)),
    "index_first_owner": lambda s, d: indices.first_owner(_owners(s, d), "k", "v"),
    "index_last_wins": lambda s, d: indices.last_wins(_owners(s, d), "k", "v"),
    "index_lists": lambda s, d: indices.listed(_owners(s, d), "k", "v"),
    "index_neighbours": lambda s, d: indices.neighbours(graph.comm_layer(V.v_comm(s, d))),
    "index_accused": lambda s, d: indices.accused_of_incident(V.lines(s, d).select(
        F.col("l_orderkey").alias("incident_id"), F.col("l_suppkey").alias("person_id"), F.when(F.col("l_linestatus") == "F", "ACCUSED").otherwise("VICTIM").alias("role_in_incident")
    )).select("incident_id", F.array_join(F.col("person_ids").cast("array<string>"), "|").alias("person_ids")),
}

MONEY = """pairs as (select src, dst, cast(sum(cast(amount as decimal(18,2))) as double) as total, count(*) as n from v_tx where src <> dst group by 1, 2),
kept as (select * from pairs where n >= 2 or total >= (select quantile_cont(total, 0.9) from pairs)),
money as (select src, dst, total, n, round(ln(1 + total) / ln(1 + (select max(total) from kept)), 4) as weight from kept)"""
MONEY_U = """money_u as (select least(src, dst) as a, greatest(src, dst) as b, arg_max(weight, (total, src < dst)) as weight, max(total) as total, arg_max(n, (total, src < dst)) as n from money group by 1, 2)"""
COMM = """kept_calls as (select least(caller, callee) as a, greatest(caller, callee) as b, count(*) as calls, round(sum(dur), 2) as total_dur from v_comm where caller <> callee group by 1, 2 having count(*) >= 2),
comm as (select a, b, calls, total_dur, round(ln(1 + calls) / ln(1 + (select max(calls) from kept_calls)), 4) as weight from kept_calls)"""
INTEL = """intel as (select least(src, dst) as a, greatest(src, dst) as b, round(max(strength * confidence), 4) as weight, string_agg(distinct relation, '|' order by relation) as relations, count(*) as n_records, max(verified) as verified from v_rel where src <> dst group by 1, 2)"""


def co_event(view: str) -> str:
    return f"""part as (select distinct incident, person from {view}),
co_pairs as (select x.person as a, y.person as b, x.incident from part x join part y on x.incident = y.incident and x.person < y.person),
co_event as (select a, b, count(*) as n_incidents, array_to_string(list_slice(list_sort(list(distinct incident)), 1, 10), '|') as incident_ids, round(least(1.0, count(*) / 3), 4) as weight from co_pairs group by 1, 2)"""


CO_PLACE = """seen as (select distinct place, bucket, person from v_presence), few as (select place, bucket from seen group by 1, 2 having count(*) between 2 and 8),
met as (select x.person as a, y.person as b, place from seen x join few using (place, bucket) join seen y using (place, bucket) where x.person < y.person),
co_place as (select a, b, count(*) as n_observations, array_to_string(list_slice(list_sort(list(distinct place)), 1, 10), '|') as location_ids, round(least(1.0, 0.35 + 0.12 * (count(*) - 1)), 4) as weight from met group by 1, 2)"""
FUSED = """rows as (select a, b, 'intel' as layer, cast(weight as double) as weight, 0 as n from intel union all select a, b, 'comm', weight, 0 from comm union all select a, b, 'money', weight, 0 from money_u
  union all select a, b, 'co_event', cast(weight as double), n_incidents from co_event union all select a, b, 'co_place', cast(weight as double), 0 from co_place),
pairs_all as (select a, b, bool_or(layer in ('intel', 'comm', 'money') or (layer = 'co_event' and n >= 2)) as asserted,
  sum(cast(weight * case layer when 'intel' then 1.0::double when 'comm' then 0.75 when 'money' then 0.8 when 'co_event' then 0.65 else 0.4 end as decimal(20,8))) as raw,
  string_agg(distinct layer, '|' order by layer) as layers, count(*) as corroboration from rows group by 1, 2),
fused as (select a, b, cast(round(raw, 4) as double) as raw_weight, round(cast(raw as double) / cast((select max(raw) from pairs_all where asserted) as double), 4) as weight, layers, corroboration from pairs_all where asserted)"""
GRAPH = ["v_rel", "v_comm", "v_tx", "v_joint", "v_presence", INTEL, COMM, MONEY, MONEY_U, co_event("v_joint"), CO_PLACE, FUSED]
OWNERS = "owners as (select o_custkey as k, o_orderkey as r, o_orderpriority as v from orders)"
HETERO = """nodes as (select 'P' || c_custkey as id, 'PERSON' as node_type, c_name as label from customer union all select 'I' || o_orderkey, 'INCIDENT', o_orderpriority from orders
  union all select 'L' || n_nationkey, 'LOCATION', n_name from nation where n_nationkey < 20)"""

ORACLES = {
    "layer_money_materiality": V.sql("v_tx", MONEY, "select * from money"),
    "layer_money_undirected": V.sql("v_tx", MONEY, MONEY_U, "select * from money_u"),
    "layer_comm_published": V.sql("v_comm", COMM, "select * from comm"),
    "layer_comm": V.sql("v_comm", COMM, "select * from comm"),
    "layer_intel_merge": V.sql("v_rel", INTEL, "select * from intel"),
    "layer_co_event": V.sql("v_incident", co_event("v_incident"), "select * from co_event"),
    "layer_co_place": V.sql("v_presence", CO_PLACE, "select * from co_place"),
    "fused_graph": V.sql(*GRAPH, "select * from fused"),
    "fusion_leads": V.sql(*GRAPH, "select a, b, layer, weight from rows join pairs_all using (a, b) where not asserted"),
    "corroboration_histogram": V.sql(*GRAPH, "select corroboration, count(*) as n_edges from fused group by 1"),
    "vertex_attributes": V.sql("v_rel", INTEL, """select id, coalesce(c_name, '') as name, coalesce(c_mktsegment, '') as segment, coalesce(c_acctbal, 0) as risk
      from (select a as id from intel union select b from intel) left join (select * from customer where c_custkey % 5 <> 0) on id = c_custkey"""),
    "hetero_nodes": V.sql(HETERO, "select * from nodes"),
    "hetero_edges": V.sql(HETERO, """edges as (select 'P' || o_custkey as src, 'I' || o_orderkey as dst, 'INVOLVED_IN' as edge_type from orders
      union select 'P' || c_custkey, 'L' || c_nationkey, 'PRESENT_AT' from customer)""", "select * from edges where src in (select id from nodes) and dst in (select id from nodes)"),
    "graph_projection": V.sql("v_comm", "v_tx", """select caller as src, callee as dst, 'COMMUNICATES_WITH' as edge_type, count(*) as n, round(ln(1 + count(*)), 4) as weight from v_comm group by 1, 2
      union all select src, dst, 'TRANSFERS_TO', count(*), round(ln(1 + cast(sum(cast(amount as decimal(18,2))) as double) / 1000), 4) from v_tx group by 1, 2"""),
    "index_first_owner": V.sql(OWNERS, "select k, arg_min(v, r) as v from owners group by 1"),
    "index_last_wins": V.sql(OWNERS, "select k, arg_max(v, r) as v from owners group by 1"),
    "index_lists": V.sql(OWNERS, "select k, string_agg(v, '|' order by r) as v, count(*) as n from owners group by 1"),
    "index_neighbours": V.sql("v_comm", COMM, "select a as id, b as other from comm union select b, a from comm"),
    "index_accused": "select l_orderkey as incident_id, array_to_string(list_sort(list(distinct l_suppkey)), '|') as person_ids from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'F' group by 1",
}
