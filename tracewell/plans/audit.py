"""Queries that check a whole dataset by rules, and that score results on one card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import checks, graph, links, scorecard
from tracewell.operators.checks import Holds, Measured, Resolves, Unique
from tracewell.operators.evaluate import ari_nmi
from tracewell.operators.centrality import modularity
from tracewell.operators.iterate import components
from tracewell.operators.ordering import numbered
from tracewell.plans import network as N
from tracewell.plans import views as V
from tracewell.sources.storage import materialise

RULES = [
    Resolves("relations: src", "relations", "src", "customer", "c_custkey"), Resolves("relations: dst", "relations", "dst", "supplier", "s_suppkey"), Resolves("calls: callee", "calls", "callee", "customer", "c_custkey"),
    Resolves("lines: order", "lineitem", "l_orderkey", "orders", "o_orderkey"), Resolves("lines: part", "lineitem", "l_partkey", "part", "p_partkey"), Resolves("lines: supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Resolves("lines: part that was ordered in bulk", "lineitem", "l_partkey", "bulk", "part"), Resolves("orders: customer", "orders", "o_custkey", "customer", "c_custkey"), Resolves("orders: customer with a line", "orders", "o_custkey", "relations", "src"),
    Resolves("customers: nation", "customer", "c_nationkey", "nation", "n_nationkey"), Resolves("nations: region", "nation", "n_regionkey", "region", "r_regionkey"),
    Holds("no relation to oneself", "relations", "src <> dst"), Holds("no call to oneself", "calls", "caller <> callee"), Holds("customers owe nothing", "customer", "c_acctbal >= 0"),
    Unique("one line a key", "lineitem", ("l_orderkey", "l_linenumber")), Unique("one part an order", "lineitem", ("l_orderkey", "l_partkey")), Unique("one customer a name", "customer", ("c_name",)),
    Holds("spans are in range", "spans", "in_range"), Holds("spans are as in their texts", "spans", "as_in_text"), Holds("spans don't overlap", "spans", "apart"),
    Measured("labels of spans", "spans", "count(distinct label)", ">=", 12), Measured("spans a document", "per_document", "round(avg(spans), 6)", ">=", 2),
    Measured("most people in one component", "topology", "round(max(giant_share), 6)", ">", 0.75), Measured("average degree is not too low", "topology", "round(max(average_degree), 6)", ">=", 3), Measured("components", "topology", "max(components)", "<=", 10),
    Measured("groups agree", "agreement", "max(ari)", ">", 0.45), Measured("modularity shows communities", "agreement", "max(modularity)", ">", 0.4),
    Measured("machinery surfaces by balance", "surfacing", "round(max(share) filter (where target = 'MACHINERY'), 6)", ">=", 0.05), Measured("declared relations are calls", "leaked", "count(*)", "=", 0), Measured("shared handsets are seen", "handsets", "count_if(subscribers > 1)", ">=", 20),
    Measured("kinds of calls", "calls", "count(distinct kind)", ">=", 5), Measured("balance follows the segment", "customer", "round(avg(c_acctbal) filter (where c_mktsegment = 'BUILDING') - avg(c_acctbal) filter (where c_mktsegment = 'MACHINERY'), 4)", ">", 25), Measured("years of orders", "orders", "count(distinct year(o_orderdate))", ">=", 7),
]


def balances(s: SparkSession, d: str) -> DataFrame:
    return numbered(V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "c_acctbal", "id", "rank").select("id", "rank")


def segments(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "customer").select(F.col("c_mktsegment").alias("target"), F.col("c_custkey").alias("id"))


def parity(s: SparkSession, d: str) -> DataFrame:
    return parity_in(N.calls_graph(s, d))


def parity_in(g: DataFrame) -> DataFrame:
    return g.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", (F.col("id") % 5).alias("community"))


def spans(s: SparkSession, d: str) -> DataFrame:
    """The first two words of each text, and its first five letters: they overlap, and are short of a text at times."""
    docs = V.table(s, d, "documents").select("doc_id", "text", "lang", "source", F.split("text", " ", 3).alias("w"))
    word = lambda i, at: F.struct(at.cast("int").alias("start"), (at + F.length(F.col("w")[i])).cast("int").alias("end"), F.col("w")[i].alias("text"), F.concat_ws("-", F.lit(f"w{i}"), "lang", "source").alias("label"))
    head = F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.substring("text", 1, 5).alias("text"), F.lit("head").alias("label"))
    own = docs.where("size(w) > 2").select("doc_id", F.inline(F.array(head, word(0, F.lit(0)), word(1, F.length(F.col("w")[0]) + 1))))
    return own


def tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    found = {t: V.table(s, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")}
    # several rules and derived tables read these: lines meet orders once, and calls and spans are worked out once
    relations, calls = materialise(V.v_rel(s, d), "relations"), materialise(V.v_comm(s, d), "calls")
    pairs = lambda least: materialise(graph.comm_layer(calls, least).select("a", "b", "weight"), "pairs")
    g, every = pairs(4), pairs(graph.CONF.min_calls)
    people = found["customer"].select(F.col("c_custkey").alias("id"))
    own = materialise(checks.spans_in_texts(spans(s, d), found["documents"]), "spans")
    customers = found["customer"].select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("t"), F.col("c_nationkey").alias("f"))
    return found | {
        "relations": relations, "calls": calls, "spans": own, "per_document": found["documents"].select("doc_id").join(own, "doc_id", "left").groupBy("doc_id").agg(F.count("start").alias("spans")),
        "bulk": found["lineitem"].where("l_quantity >= 45").select(F.col("l_partkey").alias("part")), "topology": checks.topology(g, people, components(g)),
        "agreement": ari_nmi(customers, "t", "f").crossJoin(modularity(every, parity_in(every))), "surfacing": checks.surfacing(balances(s, d), segments(s, d)),
        "leaked": links.known_pairs(relations).join(links.known_pairs(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))), ["person_a", "person_b"], "left_semi"), "handsets": found["lineitem"].groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("subscribers")),
    }


def rankings(s: SparkSession, d: str) -> DataFrame:
    orders = V.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return balances(s, d).withColumn("ranking", F.lit("balance")).unionByName(numbered(orders, "n", "id", "rank").select("id", "rank", F.lit("orders").alias("ranking")))


GRID = [("balance", "BUILDING"), ("balance", "MACHINERY"), ("orders", "BUILDING"), ("orders", "HOUSEHOLD"), ("orders", "nobody")]


def grid(s: SparkSession, d: str) -> DataFrame:
    return scorecard.ranking_grid(rankings(s, d), segments(s, d), GRID, (10, 25, 50, 100, 1000))


def communities(s: SparkSession, d: str) -> DataFrame:
    return scorecard.community_card(parity(s, d), segments(s, d).withColumnRenamed("target", "label"), N.calls_graph(s, d), "BUILDING")


QUERIES = {
    "dataset_audit": lambda s, d: checks.run(tables(s, d), RULES),
    "ranking_grid": grid,
    "community_card": communities,
    "scorecard": lambda s, d: scorecard.card(rankings=grid(s, d), communities=communities(s, d)),
}

_FOUND = """r as (select 'balance' as ranking, c_custkey as id, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer
    union all select 'orders', id, row_number() over (order by n desc, id) from (select o_custkey as id, count(*) as n from orders group by 1)),
  pairs(ranking, target) as (values ('balance', 'BUILDING'), ('balance', 'MACHINERY'), ('orders', 'BUILDING'), ('orders', 'HOUSEHOLD'), ('orders', 'nobody')),
  h as (select ranking, target, rank, row_number() over (partition by ranking, target order by rank) as found from pairs join r using (ranking) join customer on c_custkey = r.id and c_mktsegment = target),
  tot as (select c_mktsegment as target, count(*) as total from customer group by 1), last as (select ranking, max(rank) as last from r group by 1), ks as (select unnest([10, 25, 50, 100, 1000])::bigint as k),
  grid as (select p.ranking, p.target, k, round(count(h.rank) / k, 4) as precision, coalesce(round(count(h.rank) / any_value(total), 4), 0) as recall,
    coalesce(round((select sum(x.found / x.rank) from h x where x.ranking = p.ranking and x.target = p.target) / any_value(total), 4), 0) as average_precision
    from pairs p join last using (ranking) cross join ks left join tot using (target) left join h on h.ranking = p.ranking and h.target = p.target and h.rank <= k where k <= last group by p.ranking, p.target, k)"""
_Q = """m as (select sum(weight) as m from comm), i as (select a % 5 as c, sum(weight) as l from comm where a % 5 = b % 5 group by 1), dd as (select src % 5 as c, sum(weight) as d from both_g group by 1),
  q as (select round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 6) as modularity from dd left join i using (c), m)"""


def _ari(cells: str, tag: str) -> str:
    """CTEs ending in <tag> with ari, nmi of cells (t, f, n double)."""
    c = f"{tag}c"
    return f"""{c} as ({cells}), {tag}a as (select sum(n * (n - 1) / 2) as p, sum(n * ln(n)) as l from (select sum(n) as n from {c} group by t)), {tag}b as (select sum(n * (n - 1) / 2) as p, sum(n * ln(n)) as l from (select sum(n) as n from {c} group by f)),
      {tag}x as (select sum(n * (n - 1) / 2) as p, sum(n) as n, sum(n * ln(n)) as l from {c}),
      {tag} as (select round((x.p - a.p * b.p / (n * (n - 1) / 2)) / ((a.p + b.p) / 2 - a.p * b.p / (n * (n - 1) / 2)), 6) as ari, round(2 * (ln(n) + (x.l - a.l - b.l) / n) / ((ln(n) - a.l / n) + (ln(n) - b.l / n)), 6) as nmi from {tag}a a, {tag}b b, {tag}x x)"""


_CARD = """card as (select ari, nmi, modularity, (select count(distinct src % 5) from both_g) as communities_found, (select count(distinct t) from ac) as groups_planted from a, q)"""
_CELLS = "select c_mktsegment as t, src % 5 as f, count(*)::double as n from (select distinct src from both_g) join customer on c_custkey = src where c_mktsegment <> 'BUILDING' group by 1, 2"
_MEASURES = [("ari", "ari"), ("nmi", "nmi"), ("modularity", "modularity"), ("communities_found", "communities_found"), ("groups_planted", "groups_planted")]


def _row(check: str, kind: str, n: str, source: str, value: str = "null", bound: str = "null") -> str:
    return f"""select '{check.replace("'", "''")}' as "check", '{kind}' as kind, ({n})::bigint as n, ({value})::double as value, {bound} as bound from {source}"""


def _audit() -> str:
    """The rules as SQL of their own, a query a rule."""
    names = {"relations": "v_rel", "calls": "v_comm"}
    rows = []
    for r in RULES:
        t = names.get(r.table, r.table)
        if isinstance(r, Resolves):
            rows.append(_row(r.check, "resolves", "count(*)", f"(select 1 from {t} where {r.key} is not null and {r.key} not in (select {r.parent_key} from {names.get(r.parent, r.parent)}))"))
        elif isinstance(r, Holds):
            rows.append(_row(r.check, "holds", "count(*)", f"(select 1 from {t} where ({r.condition}) is not true)"))
        elif isinstance(r, Unique):
            rows.append(_row(r.check, "unique", "coalesce(sum(n - 1), 0)", f"(select count(*) as n from {t} group by {', '.join(r.keys)})"))
        else:
            rows.append(_row(r.check, "measured", f"case when ({r.value}) {r.must} {r.bound} then 0 else 1 end", t, r.value, f"'{r.must} {r.bound:g}'"))
    return f"select *, n = 0 as passed from ({' union all '.join(rows)})"


_TABLES = """bulk as (select l_partkey as part from lineitem where l_quantity >= 45),
  w as (select doc_id, text, lang, source, string_split(text, ' ') as w from documents),
  s as (select doc_id, 0 as "start", 5 as "end", left(text, 5) as text, 'head' as label from w where len(w) > 2
    union all select doc_id, 0, length(w[1]), w[1], concat_ws('-', 'w0', lang, source) from w where len(w) > 2
    union all select doc_id, length(w[1]) + 1, length(w[1]) + 1 + length(w[2]), w[2], concat_ws('-', 'w1', lang, source) from w where len(w) > 2),
  spans as (select doc_id, label, "start" < "end" and "end" <= length(d.text) as in_range, substr(d.text, "start" + 1, "end" - "start") = s.text as as_in_text,
    coalesce(lag("end") over (partition by doc_id order by "start", "end") <= "start", true) as apart from s join documents d using (doc_id)),
  per_document as (select d.doc_id, count(label) as spans from documents d left join spans using (doc_id) group by 1),
  sizes as (select coalesce(component, c_custkey) as c, count(*) as n from customer left join comps on id = c_custkey group by 1),
  topology as (select max(n) / sum(n) as giant_share, count(*) as components, 2 * (select count(*) from sparse where a in (select c_custkey from customer) and b in (select c_custkey from customer)) / sum(n) as average_degree from sizes),
  agreement as (select g.ari, q.modularity from g, q),
  surfacing as (select c_mktsegment as target, avg((rank <= greatest(1, n // 10))::int) as share from (select c_mktsegment, row_number() over (order by c_acctbal desc, c_custkey) as rank, count(*) over () as n from customer) group by 1),
  leaked as (select distinct least(src, dst), greatest(src, dst) from v_rel where exists (select 1 from v_comm where (caller = src and callee = dst) or (caller = dst and callee = src))),
  handsets as (select l_partkey, count(distinct l_suppkey) as subscribers from lineitem group by 1)"""
ORACLES = {
    "dataset_audit": V.sql("v_rel", *N.G, N.SPARSE, N.BOTH, _Q, _ari("select c_mktsegment as t, c_nationkey as f, count(*)::double as n from customer group by 1, 2", "g"), _TABLES, _audit()).replace("with", "with recursive", 1),
    "ranking_grid": V.sql(_FOUND, "select * from grid"),
    "community_card": V.sql(*N.G, N.BOTH, _Q, _ari(_CELLS, "a"), _CARD, "select * from card"),
    "scorecard": V.sql(*N.G, N.BOTH, _Q, _ari(_CELLS, "a"), _CARD, _FOUND, """select 'rankings' as section, ranking || ' against ' || target as item, 'average_precision' as measure, max(average_precision) as value from grid group by 1, 2
      union all select 'rankings', ranking || ' against ' || target, 'precision@' || k, precision from grid union all select 'rankings', ranking || ' against ' || target, 'recall@' || k, recall from grid
      union all """ + " union all ".join(f"select 'communities', 'found against planted', '{m}', {c}::double from card" for m, c in _MEASURES)),
}
