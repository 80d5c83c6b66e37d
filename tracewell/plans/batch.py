"""The whole batch: from a catalog's feeds to the tables that an application serves. Each stage's time is kept."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import anomaly, centrality, command, graph, indices, links, ner, resolve, wordlists
from tracewell.sources.artefacts import Store
from tracewell.sources.catalog import Catalog
from tracewell.sources.storage import materialise


class Batch:
    """run() publishes one table an artefact as a new version of the store at folder and returns {name: path}; a run that fails
    leaves the last version. timings has seconds by stage. word_lists="joined" looks names up by joins instead of in every worker's
    memory, for lists beyond what ner.gazetteer takes."""

    def __init__(self, catalog: Catalog, folder: str, word_lists: str = "memory"):
        if word_lists not in ("memory", "joined"):
            raise ValueError("word_lists is memory or joined")
        self.c, self.store, self.word_lists = catalog, Store(catalog.spark, folder), word_lists
        self.timings: dict[str, float] = {}

    def _stage(self, name: str, make) -> DataFrame:
        began = time.time()
        out = materialise(make(), name)
        self.timings[name] = time.time() - began
        return out

    def _numbered(self, name: str) -> DataFrame:
        """A feed with its rows' order, which its files have."""
        return self.c.ordered(name)

    def _entities(self, documents: DataFrame) -> DataFrame:
        c = self.c
        lists = {"GPE": ("cities", "locations", "city"), "LOC": ("areas", "locations", "area"), "ORG": ("orgs", "organizations", "name"), "AGENCY": ("agencies", "incidents", "investigating_agency")}
        if self.word_lists == "memory":
            return ner.extract(documents, ner.gazetteer({name: [(c[feed], column)] for name, feed, column in lists.values()}, c["persons"]))
        words = [c[feed].select(F.lit(label).alias("label"), F.col(column).alias("value")) for label, (_, feed, column) in lists.items()]
        return wordlists.extract(documents, reduce(DataFrame.union, words), c["persons"])

    def run(self) -> dict[str, str]:
        c = self.c
        declared = c["person_person"].select(F.col("src_person_id").alias("src"), F.col("dst_person_id").alias("dst"), "relation", "strength", "confidence", F.col("is_verified").alias("verified"))
        accused = c["person_incident"].where(F.col("role_in_incident").isin(*indices.ACCUSED_ROLES)).select(F.col("incident_id").alias("incident"), F.col("person_id").alias("person"))
        calls = c["cdr"].select(F.col("caller_person_id").alias("caller"), F.col("callee_person_id").alias("callee"), F.col("duration_sec").alias("dur"), F.col("timestamp").alias("ts"))
        paid = c["transactions"].select(F.col("src_account_id").alias("src"), F.col("dst_account_id").alias("dst"), F.col("amount_inr").alias("amount"), F.col("timestamp").alias("ts"), "channel")
        between_people = c["transactions"].select(F.col("src_person_id").alias("src"), F.col("dst_person_id").alias("dst"), F.col("amount_inr").alias("amount"))
        seen = self._numbered("colocation_observations").select("person_a", "person_b", "confidence", F.col("location_id").alias("place"), F.col("observed_on").alias("day"), "_row")

        documents = c.documents()
        index = c["persons"].select(F.lit("PERSON").alias("kind"), F.col("full_name").alias("name"), F.col("person_id").alias("id"))
        entities = self._stage("entities", lambda: ner.link(self._entities(documents), index))
        said = self._stage("relations", lambda: ner.relations(documents, entities, index))

        layers = graph.layer_rows({
            "intel": graph.intel_layer(declared), "comm": graph.comm_layer(calls), "money": graph.undirected_money(graph.money_layer(between_people)), "co_event": graph.co_event_layer(accused),
            "co_place": graph.co_place_layer(c["person_location"].select(F.col("person_id").alias("person"), F.col("location_id").alias("place"), F.col("observed_on").alias("bucket")), seen),
        })
        layers = self._stage("layers", lambda: layers)
        edges, leads = graph.fuse(layers, c["persons"])
        edges = self._stage("fused", lambda: edges)
        community = self._stage("communities", lambda: centrality.communities(edges))
        inner = centrality.inside(edges, centrality.giant(edges))
        metrics = centrality.degrees(edges).select("id", "degree").join(centrality.pagerank(edges), "id").join(centrality.kcore(edges), "id").join(centrality.betweenness(inner), "id", "left").join(centrality.eigenvector(inner), "id", "left")
        metrics = self._stage("metrics", lambda: metrics)
        authority = self._stage("authority", lambda: command.authority_edges(declared, said))
        players = self._stage("key_players", lambda: centrality.key_players(edges, metrics, community, centrality.articulation_points(edges), command.scores(authority)))

        sims = self._numbered("person_phone")
        owner = indices.first_owner(sims, "phone_id", "person_id")
        devices = self._numbered("phone_device").select("imei", F.col("phone_id").alias("phone"), "_row")
        phones = c["person_phone"].join(c["phones"].select("phone_id", "msisdn"), "phone_id").select("person_id", "msisdn")
        proposals = self._stage("resolution", lambda: resolve.resolve(c["persons"], phones, indices.neighbours(declared, "src", "dst").select(F.col("id").alias("person_id"), "other")))
        found = self._stage("anomalies", lambda: anomaly.as_findings(
            anomaly.structuring(paid), anomaly.layering(paid), anomaly.fanout(paid), anomaly.round_trips(paid), anomaly.dormant(paid),
            anomaly.call_bursts(calls, c["incidents"].select(F.col("incident_id").alias("incident"), F.col("incident_datetime").alias("ts")), accused),
            anomaly.burners(devices, c["cdr"].select(F.col("caller_phone_id").alias("phone"), F.col("callee_person_id").alias("contact"), F.col("timestamp").alias("ts")), owner.select(F.col("phone_id").alias("phone"), F.col("person_id").alias("owner")))))
        known = links.known_pairs(declared)
        hidden = (
            links.shared_handset(devices.join(owner, devices.phone == owner.phone_id).select("imei", F.col("person_id").alias("person")), known)
            .unionByName(links.shared_account(c["person_account"].select(F.col("account_id").alias("account"), F.col("person_id").alias("person")), known))
            .unionByName(links.shared_vehicle(c["incident_vehicle"].select(F.col("vehicle_id").alias("vehicle"), F.col("incident_id").alias("incident")), accused, c["incidents"].select(F.col("incident_id").alias("incident"), "state"), known))
            .unionByName(links.co_location(seen, known)).unionByName(links.common_associates(edges, known))
        )
        people = c["persons"].select(F.col("person_id").alias("person"), F.col("full_name").alias("name"), F.col("syndicate_code").alias("syndicate"))
        hidden = self._stage("links", lambda: links.merged(hidden, people))

        results = {
            "entities": entities, "extracted_relations": said, "proposed_relations": command.split_extracted(said, declared)[1], "fused_edges": edges, "leads": leads, "communities": community, "key_players": players,
            "resolution_proposals": proposals, "anomalies": found, "hidden_links": hidden, "feeds": c.summary(),
        }
        with self.store.run():
            for name, df in results.items():
                self.store.stage(name, df)
        return self.store.paths()
