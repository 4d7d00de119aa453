"""Graph queries over the claims graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.tiers import format_amount, risk_tier
from riskloom.operators import graph as gr
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.plans.sql_base import SCORED_W, SPLIT_W, with_, CLAIMS
from riskloom.sources.tables import doctors_view, hospitals_view, patients_view

def _edges_cte(patients: str, doctors: str, hospitals: str) -> str:
    return f"""
edges AS (
  SELECT 'patient' AS src_type, patient_id AS src, 'filed_claim' AS relation, 'claim' AS dst_type, claim_id AS dst FROM claims
  WHERE patient_id IN (SELECT c_custkey FROM {patients})
  UNION ALL SELECT 'claim', claim_id, 'treated_by', 'doctor', doctor_id FROM claims WHERE doctor_id IN (SELECT s_suppkey FROM {doctors})
  UNION ALL SELECT 'doctor', s_suppkey, 'works_at', 'hospital', CAST(s_nationkey AS BIGINT) FROM {doctors}
  WHERE s_nationkey IN (SELECT n_nationkey FROM {hospitals})
  UNION ALL SELECT DISTINCT 'patient', patient_id, 'visited', 'doctor', doctor_id FROM claims
  WHERE patient_id IN (SELECT c_custkey FROM {patients}) AND doctor_id IN (SELECT s_suppkey FROM {doctors}))"""


EDGES_CTE = _edges_cte("customer", "supplier", "nation")


def edges(spark, d):
    return gr.build_edges(base.claims(spark, d), doctors_view(spark, d), patients_view(spark, d), hospitals_view(spark, d))


@query("graph_edges_unknown_ends", with_(CLAIMS, _edges_cte("(SELECT * FROM customer WHERE c_custkey % 7 <> 0)", "(SELECT * FROM supplier WHERE s_suppkey % 5 <> 0)",
                                                            "(SELECT * FROM nation WHERE n_nationkey % 3 <> 0)")) + """
SELECT relation, count(*) AS n_edges, CAST(sum(src) AS BIGINT) AS src_sum, CAST(sum(dst) AS BIGINT) AS dst_sum FROM edges GROUP BY relation""")
def graph_edges_unknown_ends(spark, d):
    """JN-5: node tables that lack some ids; edges to them do not exist."""
    e = gr.build_edges(base.claims(spark, d), doctors_view(spark, d).where("doctor_id % 5 <> 0"),
                       patients_view(spark, d).where("patient_id % 7 <> 0"), hospitals_view(spark, d).where("hospital_id % 3 <> 0"))
    return e.groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


def edges_view(spark, d):
    return base.view(spark, d, "edges", lambda: edges(spark, d))


@query("graph_edges", with_(CLAIMS, EDGES_CTE) + """
SELECT relation, src_type, dst_type, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst
FROM edges GROUP BY ALL""")
def graph_edges(spark, d):
    """GR-2 + ST-5: the four typed edge lists (summarised per relation)."""
    e = edges_view(spark, d)
    return e.groupBy("relation", "src_type", "dst_type").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


@query("visited_pairs", with_(CLAIMS) + "SELECT DISTINCT patient_id, doctor_id FROM claims")
def visited_pairs(spark, d):
    """ST-5."""
    return base.claims(spark, d).select("patient_id", "doctor_id").distinct()


@query("claim_node_features", with_(CLAIMS) + """
SELECT claim_id,
       coalesce((claim_amount - avg(claim_amount) OVER ()) / (coalesce(stddev_pop(claim_amount) OVER (), 0) + 1e-8), 0)
         AS claim_amount,
       coalesce((num_procedures - avg(num_procedures) OVER ()) / (coalesce(stddev_pop(num_procedures) OVER (), 0) + 1e-8), 0)
         AS num_procedures,
       coalesce((days_in_hospital - avg(days_in_hospital) OVER ()) / (coalesce(stddev_pop(days_in_hospital) OVER (), 0) + 1e-8), 0)
         AS days_in_hospital
FROM claims""")
def claim_node_features(spark, d):
    """GR-1 + EN-4: z-scored claim node features (population std + 1e-8)."""
    c = base.claims(spark, d).select("claim_id", "claim_amount", "num_procedures", "days_in_hospital")
    return gr.zscore_columns(c, ["claim_amount", "num_procedures", "days_in_hospital"])


NODE_KEYS = {"claim": "claim_id", "patient": "patient_id", "doctor": "doctor_id", "hospital": "hospital_id"}


@query("node_id_map", with_(CLAIMS) + " UNION ALL ".join(f"""
SELECT '{t}' AS node_type, CAST({k} AS BIGINT) AS id, row_number() OVER (ORDER BY {k}) - 1 AS idx
FROM (SELECT DISTINCT {k} FROM claims WHERE {k} IS NOT NULL)""" for t, k in NODE_KEYS.items()))
def node_id_map(spark, d):
    """WN-12 / SO-14: contiguous ids of all four node types in id order."""
    out = None
    for t, k in NODE_KEYS.items():
        m = gr.build_id_map(base.claims(spark, d).where(F.col(k).isNotNull()), t, k).withColumn("id", F.col("id").cast("long"))
        out = m if out is None else out.unionByName(m)
    return out


SEEDS_SQL = """
seeds AS (SELECT claim_id AS seed FROM scored WHERE split = 'test' ORDER BY fraud_score DESC, claim_id LIMIT 20)"""


def seeds(spark, d):
    """The 20 riskiest test claims (a top-k report) as (seed, node_type, node)."""
    s = base.scored(spark, d).where("split = 'test'").orderBy(F.col("fraud_score").desc(), "claim_id").limit(20)
    return s.select(F.col("claim_id").alias("seed"), F.lit("claim").alias("node_type"), F.col("claim_id").alias("node"))


@query("khop_claims", SCORED_W.rstrip("\n") + "," + SEEDS_SQL + """,
h1 AS (SELECT DISTINCT s.seed, 'doctor' AS node_type, c.doctor_id AS node FROM seeds s JOIN claims c ON c.claim_id = s.seed),
h2 AS (SELECT DISTINCT h1.seed, 'claim' AS node_type, c.claim_id AS node FROM h1 JOIN claims c ON c.doctor_id = h1.node
       WHERE c.claim_id NOT IN (SELECT seed FROM seeds x WHERE x.seed = h1.seed))
SELECT seed, 'claim' AS node_type, seed AS node, 0 AS hop FROM seeds
UNION ALL SELECT seed, node_type, node, 1 FROM h1
UNION ALL SELECT seed, node_type, node, 2 FROM h2""")
def khop_claims(spark, d):
    """GR-4: 2-hop treated_by neighbourhoods of the 20 riskiest test claims (all seeds at once)."""
    return gr.k_hop(edges_view(spark, d), seeds(spark, d), ["treated_by"], 2)


NBR_SQL = SPLIT_W.rstrip("\n") + """,
tr AS (SELECT * FROM split WHERE split = 'train'),
dv AS (SELECT doctor_id, count(*) AS n, avg(claim_amount) AS a, max(claim_amount) AS m, sum(claim_amount) AS s
       FROM tr GROUP BY doctor_id),
pv AS (SELECT patient_id, count(*) AS n, avg(claim_amount) AS a FROM tr GROUP BY patient_id),
d2 AS (SELECT doctor_id, avg(pv.a) AS r2 FROM (SELECT DISTINCT patient_id, doctor_id FROM tr) v JOIN pv USING (patient_id)
       GROUP BY doctor_id)
"""


@query("neighbor_features", NBR_SQL + """
SELECT c.claim_id, dv.n AS doc_n, dv.a AS doc_avg_claim_amount, dv.m AS doc_max_claim_amount, dv.s AS doc_sum_claim_amount,
       d2.r2 AS doc_patient_avg_amount
FROM split c LEFT JOIN dv USING (doctor_id) LEFT JOIN d2 USING (doctor_id)""")
def neighbor_features(spark, d):
    """GR-6 re-aimed: two rounds of neighbour aggregation (train claims only, no
    labels).  Round 1: a doctor's claims; round 2: the mean over a doctor's
    patients of their own average claim."""
    s = base.claims_split(spark, d)
    tr = base.train_rows(s)
    doc = tr.groupBy("doctor_id").agg(F.count(F.lit(1)).alias("doc_n"),
                                      F.avg("claim_amount").alias("doc_avg_claim_amount"),
                                      F.max("claim_amount").alias("doc_max_claim_amount"),
                                      F.sum("claim_amount").alias("doc_sum_claim_amount"))
    pat = tr.groupBy("patient_id").agg(F.avg("claim_amount").alias("pa"))
    e = gr.build_edges(tr, tr.select("doctor_id", "hospital_id").distinct(), tr.select("patient_id").distinct(), tr.select("hospital_id").distinct())
    r2 = gr.neighbor_aggregates(e.where("relation = 'visited'").select(
        F.col("dst").alias("src"), F.lit("visited_by").alias("relation"), F.col("src").alias("dst")),
        pat.withColumnRenamed("patient_id", "p"), "visited_by", "p", ["pa"], "r2") \
        .select(F.col("node").alias("doctor_id"), F.col("r2_avg_pa").alias("doc_patient_avg_amount"))
    return s.select("claim_id", "doctor_id").join(doc, "doctor_id", "left").join(r2, "doctor_id", "left").drop("doctor_id")


@query("neighbor_sample", SCORED_W.rstrip("\n") + "," + SEEDS_SQL + """,
sd AS (SELECT DISTINCT c.doctor_id AS node FROM seeds s JOIN claims c ON c.claim_id = s.seed)
SELECT node, nbr, rank FROM (
  SELECT sd.node, c.claim_id AS nbr, CAST(row_number() OVER (PARTITION BY sd.node ORDER BY md5(concat_ws(':', CAST(sd.node AS VARCHAR), CAST(c.claim_id AS VARCHAR), '0')), c.claim_id) AS INTEGER) AS rank
  FROM sd JOIN claims c ON c.doctor_id = sd.node) WHERE rank <= 10""")
def neighbor_sample(spark, d):
    """GR-5: fan-out 10 doctors' claims per seed doctor (hash order, salted two-level top-f)."""
    sd = seeds(spark, d).join(base.claims(spark, d).select(F.col("claim_id").alias("node"), "doctor_id"), "node") \
        .select(F.col("doctor_id").alias("node"))
    e = edges_view(spark, d)
    rev = e.where("relation = 'treated_by'").select(F.col("dst").alias("src"), F.lit("treats").alias("relation"),
                                                    F.col("src").alias("dst"))
    return gr.sample_neighbors(rev, sd, "treats", 10)


def _hop_sql(hop: int, seeds: str, fanout: int) -> str:
    return f"""
h{hop} AS (SELECT {hop} AS hop, node_type, node, relation, nbr_type, nbr, rank FROM (
  SELECT s.node_type, s.node, e.relation, e.dst_type AS nbr_type, e.dst AS nbr, CAST(row_number() OVER (PARTITION BY e.relation, s.node
    ORDER BY md5(concat_ws(':', CAST(s.node AS VARCHAR), CAST(e.dst AS VARCHAR), '0')), e.dst) AS INTEGER) AS rank
  FROM ({seeds}) s JOIN both_ways e ON e.src_type = s.node_type AND e.src = s.node) WHERE rank <= {fanout})"""


@query("neighbor_sample_hops", SPLIT_W.rstrip("\n") + "," + EDGES_CTE + """,
both_ways AS (SELECT src_type, src, relation, dst_type, dst FROM edges
  UNION ALL SELECT dst_type, dst, 'rev_' || relation, src_type, src FROM edges),"""
       + _hop_sql(1, "SELECT 'claim' AS node_type, claim_id AS node FROM split WHERE split IN ('train', 'val', 'test')", 10) + ","
       + _hop_sql(2, "SELECT DISTINCT nbr_type AS node_type, nbr AS node FROM h1", 5) + """
SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def neighbor_sample_hops(spark, d):
    """GR-5 for every claim of the three masks: fan-out 10, then 5, over all
    relations in both directions (``neighbor_sample`` is the report on 20 claims)."""
    claims = base.claims_split(spark, d).where(F.col("split").isin("train", "val", "test"))
    return gr.sample_hops(edges_view(spark, d), claims.select(F.lit("claim").alias("node_type"), F.col("claim_id").alias("node")), [10, 5])


@query("entity_degree", with_(CLAIMS, EDGES_CTE) + """
SELECT dst_type, dst, relation, count(*) AS degree FROM edges GROUP BY ALL""")
def entity_degree(spark, d):
    """GR-9: degree of every node per relation."""
    return gr.entity_degree(edges_view(spark, d))


@query("co_visit_incidence", with_(CLAIMS) + """,
v AS (SELECT DISTINCT patient_id, doctor_id FROM claims),
dg AS (SELECT doctor_id, count(*) AS deg FROM v GROUP BY doctor_id)
SELECT patient_id AS patient, count(*) AS n_doctors, CAST(sum(deg - 1) AS BIGINT) AS co_visit_incidence
FROM v JOIN dg USING (doctor_id) GROUP BY patient_id""")
def co_visit_incidence(spark, d):
    """GR-9: shared-doctor incidences per patient, computed from degrees (no pair list)."""
    return gr.co_visit_incidence(edges_view(spark, d))


@query("ring_members", SPLIT_W + "SELECT ring_id, claim_id FROM claims WHERE ring_id > 0")
def ring_members(spark, d):
    """AG-21 as rows (ring, claim)."""
    return gr.ring_members(base.claims(spark, d))


@query("ring_sizes", with_(CLAIMS) + """
SELECT ring_id, count(*) AS n_claims, min(claim_id) AS first_claim, max(claim_id) AS last_claim
FROM claims WHERE ring_id > 0 GROUP BY ring_id""")
def ring_sizes(spark, d):
    """AG-21 summary per ring."""
    return base.claims(spark, d).where("ring_id > 0").groupBy("ring_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.min("claim_id").alias("first_claim"), F.max("claim_id").alias("last_claim"))


@query("risk_breakdown", SCORED_W.rstrip("\n") + "," + SEEDS_SQL + """
SELECT claim_id, fraud_score, CASE WHEN fraud_score > 0.7 THEN 'HIGH' WHEN fraud_score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END
       AS risk_level, rule_score, ml_score, '$' || format('{:,.0f}', claim_amount) AS amount_label
FROM scored WHERE claim_id IN (SELECT seed FROM seeds)""")
def risk_breakdown(spark, d):
    """GR-8 + JN-6 + FN-12: per-claim breakdown for an id list (semi join)."""
    ids = seeds(spark, d).select(F.col("seed").alias("claim_id"))
    s = base.scored(spark, d).join(ids, "claim_id", "left_semi")
    return s.select("claim_id", "fraud_score", risk_tier(F.col("fraud_score")).alias("risk_level"), "rule_score",
                    "ml_score", format_amount(F.col("claim_amount")).alias("amount_label"))


@query("graph_view_stats", with_(CLAIMS, EDGES_CTE) + """,
nodes AS (SELECT DISTINCT src_type AS t, src AS n FROM edges UNION SELECT DISTINCT dst_type, dst FROM edges)
SELECT 'nodes:' || t AS stat, count(*) AS n FROM nodes GROUP BY t
UNION ALL SELECT 'edges:' || relation, count(*) FROM edges GROUP BY relation
UNION ALL SELECT 'flagged_claims', count(*) FROM claims WHERE fraud_label = 1""")
def graph_view_stats(spark, d):
    """GR-7 statistics (nodes, edges, flagged claims) over the whole graph."""
    flagged = base.claims(spark, d).where("fraud_label = 1")
    return gr.graph_stats(edges_view(spark, d), flagged)


NODE_SQL = with_(CLAIMS) + """,
pat AS (SELECT c_custkey AS node, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS flag_a,
               CAST(c_mktsegment <> 'HOUSEHOLD' AS DOUBLE) AS flag_b,
               coalesce((c_acctbal - avg(c_acctbal) OVER ()) / (coalesce(stddev_pop(c_acctbal) OVER (), 0) + 1e-8), 0) AS num_a,
               'patient' AS node_type FROM customer),
doc AS (SELECT s_suppkey AS node, CAST(s_acctbal > 0 AS DOUBLE) AS flag_a, CAST(NULL AS DOUBLE) AS flag_b,
               coalesce((s_acctbal - avg(s_acctbal) OVER ()) / (coalesce(stddev_pop(s_acctbal) OVER (), 0) + 1e-8), 0) AS num_a,
               'doctor' AS node_type FROM supplier),
hos AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_regionkey = 0 AS DOUBLE) AS flag_a, CAST(NULL AS DOUBLE) AS flag_b,
               coalesce((n_regionkey - avg(n_regionkey) OVER ()) / (coalesce(stddev_pop(n_regionkey) OVER (), 0) + 1e-8), 0)
                 AS num_a, 'hospital' AS node_type FROM nation)
"""


@query("graph_node_features", NODE_SQL + """
SELECT * FROM pat UNION ALL SELECT * FROM doc UNION ALL SELECT * FROM hos""")
def graph_node_features(spark, d):
    """GR-1 + PR-19: patient, doctor and hospital node tables with boolean
    flags as 0/1 and z-scored numbers (claim nodes: ``claim_node_features``).
    Patient flags: segment == 'MACHINERY' (the reference's gender == 'M'),
    segment != 'HOUSEHOLD' (its chronic condition != 'None')."""
    cu = base.read(spark, d, "customer")
    su = base.read(spark, d, "supplier")
    na = base.read(spark, d, "nation")
    p = gr.node_features(cu.withColumnRenamed("c_acctbal", "num_a"), "c_custkey", "patient",
                         {"flag_a": F.col("c_mktsegment") == "MACHINERY", "flag_b": F.col("c_mktsegment") != "HOUSEHOLD"},
                         ["num_a"])
    dd = gr.node_features(su.withColumnRenamed("s_acctbal", "num_a"), "s_suppkey", "doctor",
                          {"flag_a": F.col("num_a") > 0}, ["num_a"]).withColumn("flag_b", F.lit(None).cast("double"))
    h = gr.node_features(na.withColumnRenamed("n_regionkey", "num_a"), "n_nationkey", "hospital",
                         {"flag_a": F.col("num_a") == 0}, ["num_a"]).withColumn("flag_b", F.lit(None).cast("double"))
    cols = ["node", "flag_a", "flag_b", "num_a", "node_type"]
    return p.select(*cols).unionByName(dd.select(*cols)).unionByName(h.select(*cols))
