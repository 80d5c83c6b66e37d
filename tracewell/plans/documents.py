"""Queries over documents, the application's requests and streaming counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import evaluate, graph, ner, serve, wordlists
from tracewell.plans import layers as L
from tracewell.plans import views as V
from tracewell.sources.storage import materialise
from tracewell.streaming import detectors


def regex_entities(s: SparkSession, d: str) -> DataFrame:
    return ner.extract(V.table(s, d, "documents"))


def linked(s: SparkSession, d: str) -> DataFrame:
    """Entities against an index of the documents' account numbers, by document."""
    found = materialise(regex_entities(s, d), "entities")  # texts are read once
    index = found.where("label = 'ACCOUNT'").select(F.lit("ORG").alias("kind"), F.col("text").alias("name"), F.col("doc_id").alias("id"))
    return ner.link(found.withColumn("label", F.when(F.col("label") == "ACCOUNT", "ORG").otherwise(F.col("label"))), index)


def prf(s: SparkSession, d: str) -> DataFrame:
    """Entities against those of even documents, and of the others without their last kind, as truth."""
    found = materialise(regex_entities(s, d), "entities")  # texts are read once
    return evaluate.entity_prf(found.where("doc_id % 2 = 0 or label <> 'ACCOUNT'"), found)


def mentions(s: SparkSession, d: str) -> DataFrame:
    """As linked persons: five-letter words of documents that begin with a."""
    words = V.table(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("w")).where("length(w) = 5")
    return words.where("w < 'b'").select("doc_id", F.lit("PERSON").alias("label"), F.col("w").alias("entity_id"))


def listed(s: SparkSession, d: str) -> DataFrame:
    """As word lists: every run of five words of a benchmark passage (ORG), and its second word alone (GPE)."""
    w = V.table(s, d, "benchmark").select(F.split("text", " ").alias("w"))
    runs = w.select(F.explode(F.expr("transform(sequence(1, greatest(size(w) - 4, 1)), i -> array_join(slice(w, i, 5), ' '))")).alias("value"))
    return runs.select(F.lit("ORG").alias("label"), "value").union(w.select(F.lit("GPE"), F.expr("get(w, 1)")))


def listed_entities(s: SparkSession, d: str) -> DataFrame:
    """Entities by those lists; first words of passages are persons' names."""
    names = V.table(s, d, "benchmark").select(F.expr("split(text, ' ')[0]").alias("full_name"))
    return wordlists.extract(V.table(s, d, "documents"), listed(s, d), names)


def listed_places(s: SparkSession, d: str) -> DataFrame:
    """In how many documents each listed value stands."""
    return wordlists.places(V.table(s, d, "documents"), listed(s, d)).groupBy("label", "value").agg(F.count_distinct("doc_id").alias("n"))


def ego(s: SparkSession, d: str) -> DataFrame:
    return serve.ego(graph.comm_layer(V.v_comm(s, d)).select("a", "b", "weight"), 120, 2, limit=None)


def search(s: SparkSession, d: str) -> DataFrame:
    c = V.table(s, d, "customer")
    return serve.search(
        "Customer#12", c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("").alias("alias")),
        phones=c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")), vehicles=V.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")), orgs=c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")), limit=100_000)


def dossier(s: SparkSession, d: str) -> DataFrame:
    o = V.table(s, d, "orders")
    return serve.dossier(
        7, V.table(s, d, "customer").select(F.col("c_custkey").alias("person_id"), "c_name"), V.v_comm(s, d).select(F.col("caller").alias("person_id"), F.col("kind").alias("id")),
        V.v_rel(s, d).select(F.col("src").alias("person_id"), F.col("dst").alias("id")), o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("incident"), F.col("o_orderdate").alias("ts")), V.v_rel(s, d).where("relation = 'REPORTS_TO'"))


def stream_of(s: SparkSession, d: str) -> DataFrame:
    return V.v_comm(s, d).select("ts", "kind", F.col("dur").alias("value"), F.col("caller").alias("actor"))


QUERIES = {
    "ner_regex_entities": lambda s, d: regex_entities(s, d).groupBy("doc_id", "label").agg(F.count("*").alias("n")),
    "ner_listed_entities": lambda s, d: listed_entities(s, d).groupBy("doc_id", "label").agg(F.count("*").alias("n")),
    "listed_places": listed_places,
    "ner_link": linked,
    "ner_prf": prf,
    "relation_matches": lambda s, d: ner.matches(V.table(s, d, "documents")).groupBy("relation").agg(F.count("*").alias("n")),
    "co_mentions": lambda s, d: ner.co_mentions(mentions(s, d)),
    "search": search,
    "ego_network": ego,
    "facets": lambda s, d: serve.facet(graph.fuse(L.all_layers(s, d))[0], "layers", "\\|"),
    "dossier": dossier,
    "window_counts": lambda s, d: detectors.event_counts(stream_of(s, d)),
    "sliding_counts": lambda s, d: detectors.event_counts(stream_of(s, d), "6 hours", "2 hours"),
    "session_counts": lambda s, d: detectors.sessions(stream_of(s, d)),
}
ORACLES = {
    "listed_places": r"""with b as (select string_split(text, ' ') as w from benchmark), v as (select distinct label, trim(value) as value from (
        select 'ORG' as label, array_to_string(list_slice(w, i, i + 4), ' ') as value from (select w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from b) union all select 'GPE', w[2] from b) where trim(value) not in ('', '-')),
      marked as (select label, value, chr(1) || regexp_replace(value, '([^\pL\pN_])', chr(1) || '\1' || chr(1), 'g') || chr(1) as m from v),
      texts as (select doc_id, chr(1) || regexp_replace(text, '([^\pL\pN_])', chr(1) || '\1' || chr(1), 'g') || chr(1) as t from documents)
      select label, value, count(distinct doc_id) as n from marked join texts on contains(t, m) group by 1, 2""",
    "co_mentions": """with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents), p as (select * from w where length(w) = 5 and w < 'b')
      select x.w as src, y.w as dst, 'CO_MENTIONED_WITH' as relation, true as symmetric, x.doc_id, 0.25::double as confidence from p x join p y on x.doc_id = y.doc_id and x.w < y.w""",
    "search": """with h as (select 'person' as kind, c_custkey::varchar as id, c_name as label, 0.95::double as score from customer where contains(regexp_replace(lower(c_name), '[^a-z]', '', 'g'), 'customer')
      union all select 'phone' as kind, c_custkey::varchar as id, c_name as label, 0.9::double as score from customer where contains(c_name, '12')
      union all select 'vehicle', s_suppkey::varchar, s_name, 0.9 from supplier where contains(replace(upper(s_name), ' ', ''), 'CUSTOMER#12') union all select 'organization', c_custkey::varchar, c_name, 0.85 from customer where contains(lower(c_name), 'customer#12'))
      select * from h order by score desc, kind, id limit 100000""",
    "ego_network": V.sql("v_comm", L.COMM, "g as (select a as s, b as t from comm union select b, a from comm), one as (select t as id from g where s = 120), two as (select distinct t as id from one join g on s = id)",
        "select 120 as id, 0 as hop union all select id, 1 from one union all select id, 2 from two where id <> 120 and id not in (select id from one)"),
    "facets": V.sql(*L.GRAPH, "select value, count(*) as n from (select unnest(string_split(layers, '|')) as value from fused) group by 1"),
    "dossier": V.sql("v_comm", "v_rel", """newest as (select o_orderkey, o_orderdate from orders where o_custkey = 7 order by o_orderdate desc, o_orderkey desc limit 40),
      rels as (select '-> ' || relation || ' ' || dst as r from v_rel where src = 7 and relation = 'REPORTS_TO' union select '<- ' || relation || ' ' || src from v_rel where dst = 7 and relation = 'REPORTS_TO')""",
        """select 7::bigint as person_id, (select c_name from customer where c_custkey = 7) as c_name, coalesce((select string_agg(distinct kind, '|' order by kind) from v_comm where caller = 7), '') as phones,
        coalesce((select string_agg(distinct dst::varchar, '|' order by dst::varchar) from v_rel where src = 7), '') as accounts, coalesce((select string_agg(o_orderkey::varchar, '|' order by o_orderdate desc, o_orderkey desc) from newest), '') as incidents,
        coalesce((select string_agg(r, '|' order by r) from rels), '') as relations"""),
    "window_counts": V.sql("v_comm", "select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", kind, count(*) as n, sum(dur) as total from v_comm group by 1, 2, 3"),
    "sliding_counts": V.sql("v_comm", "o as (select unnest([0, 2, 4]) as h)", "select time_bucket(interval 2 hour, ts, timestamp '1970-01-01') - to_hours(h) as start, time_bucket(interval 2 hour, ts, timestamp '1970-01-01') - to_hours(h) + interval 6 hour as \"end\", kind, count(*) as n, sum(dur) as total from v_comm, o group by 1, 2, 3"),
    "session_counts": V.sql("v_comm", "m as (select caller as actor, ts, case when ts <= lag(ts) over w + interval 30 minute then 0 else 1 end as new from v_comm window w as (partition by caller order by ts)), g as (select actor, ts, sum(new) over (partition by actor order by ts rows unbounded preceding) as k from m)",
        "select min(ts) as start, max(ts) + interval 30 minute as \"end\", actor, count(*) as n from g group by actor, k"),
}
