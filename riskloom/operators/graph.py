"""Claim-provider graph as DataFrames (GR-1 .. GR-9, AG-21, EN-4, WN-12).

One edge table ``(src_type, src, relation, dst_type, dst)``; node tables per
type.  Multi-hop work is a loop of frontier joins whose state is checkpointed
every round (lineage stays flat and survives executor loss).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import global_index, materialize, top_k_per_group

EDGE_COLS = ["src_type", "src", "relation", "dst_type", "dst"]


def _edge(df: DataFrame, src_type: str, src: str, rel: str, dst_type: str, dst: str) -> DataFrame:
    return df.select(F.lit(src_type).alias("src_type"), F.col(src).cast("long").alias("src"), F.lit(rel).alias("relation"),
                     F.lit(dst_type).alias("dst_type"), F.col(dst).cast("long").alias("dst"))


def build_edges(claims: DataFrame, doctors: DataFrame, patients: DataFrame, hospitals: DataFrame) -> DataFrame:
    """GR-2 + JN-5 + ST-5: filed_claim (patient->claim), treated_by (claim->doctor),
    works_at (doctor->hospital), visited (distinct patient->doctor).  An edge
    needs both ends: ids that are in no node table have none.  Patients grow
    with the claims: one shuffle by patient serves the filed claims and the
    distinct visits.  Ids of doctors and hospitals are few beside the claims, and broadcast."""
    def known(df: DataFrame, nodes: DataFrame, key: str, few: bool = True) -> DataFrame:
        ids = nodes.select(key).where(F.col(key).isNotNull())
        return df.join(F.broadcast(ids) if few else ids, key, "left_semi")
    own = claims.select("claim_id", "patient_id", "doctor_id")
    of_patients = known(own, patients, "patient_id", few=False)
    filed = _edge(of_patients, "patient", "patient_id", "filed_claim", "claim", "claim_id")
    treated = _edge(known(own, doctors, "doctor_id"), "claim", "claim_id", "treated_by", "doctor", "doctor_id")
    works = _edge(known(doctors.where("doctor_id IS NOT NULL"), hospitals, "hospital_id"), "doctor", "doctor_id", "works_at", "hospital", "hospital_id")
    pairs = known(of_patients.select("patient_id", "doctor_id"), doctors, "doctor_id").distinct()
    visited = _edge(pairs, "patient", "patient_id", "visited", "doctor", "doctor_id")
    return filed.unionByName(treated).unionByName(works).unionByName(visited)


def zscore_columns(df: DataFrame, cols: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """EN-4: ``(x - mean) / (population std + eps)``, nulls -> 0 (one-row stats, broadcast)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        z = (F.col(c).cast("double") - F.col(f"_m_{c}")) / (F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) + F.lit(eps))
        out = out.withColumn(c, F.coalesce(z, F.lit(0.0)))
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def build_id_map(nodes: DataFrame, node_type: str, key: str) -> DataFrame:
    """WN-12: contiguous 0-based ids in key order (balanced range-partitioned index)."""
    return global_index(nodes.select(F.col(key).alias("id")).distinct(), ["id"], "idx") \
        .select(F.lit(node_type).alias("node_type"), "id", "idx")


def k_hop(edges: DataFrame, seeds: DataFrame, relations: Sequence[str], k: int = 2) -> DataFrame:
    """GR-4: nodes within ``k`` undirected hops of each seed over ``relations``.

    ``seeds``: (seed, node_type, node).  Output (seed, node_type, node, hop),
    hop = the first round that reached the node.  Each round joins the new
    frontier with the edge list (both directions), removes nodes already seen
    (anti join) and checkpoints the visited set.
    """
    e = edges.where(F.col("relation").isin(*relations))
    und = e.select(F.col("src_type").alias("a_type"), F.col("src").alias("a"), F.col("dst_type").alias("b_type"),
                   F.col("dst").alias("b")) \
        .unionByName(e.select(F.col("dst_type").alias("a_type"), F.col("dst").alias("a"),
                              F.col("src_type").alias("b_type"), F.col("src").alias("b")))
    visited = materialize(seeds.select("seed", "node_type", "node", F.lit(0).alias("hop")).distinct())
    frontier = visited
    for h in range(1, k + 1):
        nxt = frontier.join(und, (frontier.node_type == und.a_type) & (frontier.node == und.a)) \
                      .select("seed", F.col("b_type").alias("node_type"), F.col("b").alias("node")).distinct()
        new = nxt.join(visited.select("seed", "node_type", "node"), ["seed", "node_type", "node"], "left_anti") \
                 .withColumn("hop", F.lit(h))
        new = materialize(new)
        visited = materialize(visited.unionByName(new))
        frontier = new
    return visited


def neighbor_aggregates(edges: DataFrame, values: DataFrame, relation: str, node_col: str, value_cols: Sequence[str],
                        prefix: str) -> DataFrame:
    """GR-6 (one relation): for every source node, avg/max/sum/count of the
    destination nodes' values (join + partial aggregate; no pairs kept)."""
    e = edges.where(F.col("relation") == relation).select(F.col("src").alias("node"), F.col("dst").alias(node_col))
    j = e.join(values, node_col)
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_n")]
    for c in value_cols:
        aggs += [F.avg(c).alias(f"{prefix}_avg_{c}"), F.max(c).alias(f"{prefix}_max_{c}"),
                 F.sum(c).alias(f"{prefix}_sum_{c}")]
    return j.groupBy("node").agg(*aggs)


def sample_neighbors(edges: DataFrame, seeds: DataFrame, relation: str, fanout: int, seed_salt: int = 0,
                     salts: int = 16) -> DataFrame:
    """GR-5: up to ``fanout`` neighbours per (seed node) chosen by a hash order.

    A hot node would make a single window partition; a salted two-level top-f
    keeps every window bounded: top-f per (node, salt), then top-f per node on
    at most ``salts * fanout`` rows.
    """
    e = edges.where(F.col("relation") == relation).select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    j = seeds.select("node").distinct().join(e, "node") \
             .withColumn("_h", F.md5(F.concat_ws(":", F.col("node").cast("string"), F.col("nbr").cast("string"), F.lit(str(seed_salt)))))
    return top_k_per_group(j, ["node"], ["_h", "nbr"], fanout, salts).select("node", "nbr", "rank")


def sample_hops(edges: DataFrame, seeds: DataFrame, fanouts: Sequence[int], seed_salt: int = 0) -> DataFrame:
    """GR-5 for any number of seeds (node_type, node): up to ``fanouts[h]``
    neighbours per node and relation, both directions, then the same from the
    nodes sampled.  A node has one sample per hop, whichever seeds reach it."""
    both = edges.select("src_type", "src", "relation", "dst_type", "dst").unionByName(edges.select(
        F.col("dst_type").alias("src_type"), F.col("dst").alias("src"), F.concat(F.lit("rev_"), "relation").alias("relation"),
        F.col("src_type").alias("dst_type"), F.col("src").alias("dst")))
    both = both.select(F.col("src_type").alias("node_type"), F.col("src").alias("node"), "relation", F.col("dst_type").alias("nbr_type"), F.col("dst").alias("nbr"))
    out, frontier = None, seeds.select("node_type", "node").distinct()
    for hop, fanout in enumerate(fanouts, 1):
        j = frontier.join(both, ["node_type", "node"]) \
                    .withColumn("_h", F.md5(F.concat_ws(":", F.col("node").cast("string"), F.col("nbr").cast("string"), F.lit(str(seed_salt)))))
        top = top_k_per_group(j, ["node_type", "node", "relation"], ["_h", "nbr"], fanout, 16)
        found = materialize(top.select(F.lit(hop).alias("hop"), "node_type", "node", "relation", "nbr_type", "nbr", "rank"))
        out = found if out is None else out.unionByName(found)
        frontier = found.select(F.col("nbr_type").alias("node_type"), F.col("nbr").alias("node")).distinct()
    return out


def entity_degree(edges: DataFrame) -> DataFrame:
    """GR-9: degree of every destination node per relation."""
    return edges.groupBy("dst_type", "dst", "relation").agg(F.count(F.lit(1)).alias("degree"))


def co_visit_incidence(edges: DataFrame) -> DataFrame:
    """GR-9 without pairs: per patient, sum over visited doctors of (doctor
    degree - 1) = number of (other patient, shared doctor) incidences."""
    v = edges.where(F.col("relation") == "visited").select(F.col("src").alias("patient"), F.col("dst").alias("doctor"))
    deg = v.groupBy("doctor").agg(F.count(F.lit(1)).alias("deg"))
    return v.join(deg, "doctor").groupBy("patient").agg(
        F.count(F.lit(1)).alias("n_doctors"), F.sum(F.col("deg") - 1).alias("co_visit_incidence"))


def ring_members(claims: DataFrame, key: str = "claim_id", ring: str = "ring_id") -> DataFrame:
    """AG-21: sorted claim lists per ring id > 0.  The list of one ring is
    returned as rows (ring, claim) plus the count: no single group is collected."""
    r = claims.where(F.col(ring) > 0)
    return r.select(ring, key)


def graph_stats(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """GR-7 statistics: nodes and edges per type/relation and flagged claims."""
    nodes = edges.select(F.col("src_type").alias("t"), F.col("src").alias("n")) \
                 .unionByName(edges.select(F.col("dst_type").alias("t"), F.col("dst").alias("n"))).distinct()
    nn = nodes.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("nodes:"), "t").alias("stat"), "n")
    ne = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")) \
              .select(F.concat(F.lit("edges:"), "relation").alias("stat"), "n")
    fl = flagged.agg(F.count(F.lit(1)).alias("n")).select(F.lit("flagged_claims").alias("stat"), "n")
    return nn.unionByName(ne).unionByName(fl)


def node_features(nodes: DataFrame, key: str, node_type: str, flags: dict, numeric: Sequence[str]) -> DataFrame:
    """GR-1 + PR-19: numeric node features -- boolean flags as 0/1 doubles
    (e.g. gender == 'M', chronic condition != 'None') plus z-scored numbers."""
    out = nodes.select(F.col(key).cast("long").alias("node"),
                       *[F.coalesce(pred, F.lit(False)).cast("double").alias(name) for name, pred in flags.items()],
                       *[F.col(c).cast("double").alias(c) for c in numeric])
    out = zscore_columns(out, list(numeric)) if numeric else out
    return out.withColumn("node_type", F.lit(node_type))
