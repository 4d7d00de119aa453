from hashlib import md5

from pyspark.sql import functions as F

from riskloom.operators import graph as gr
from riskloom.plans import base, q_graph
from tests.conftest import SF001


def test_two_hops_equal_plain_python(spark):
    rows = [("claim", c, "treated_by", "doctor", c % 2) for c in range(40)] + [("patient", c % 3, "filed_claim", "claim", c) for c in range(40)]
    rows += [("patient", p, "visited", "doctor", x) for p in range(3) for x in range(2)] + [("doctor", x, "works_at", "hospital", 0) for x in range(2)]
    edges = spark.createDataFrame(rows, "src_type string, src long, relation string, dst_type string, dst long")
    seeds = edges.where("relation = 'treated_by'").select(F.lit("claim").alias("node_type"), F.col("src").alias("node"))
    got = sorted(tuple(r) for r in gr.sample_hops(edges, seeds, [10, 5]).collect())
    both = rows + [(t, x, f"rev_{r}", s, a) for s, a, r, t, x in rows]
    want, frontier = [], {("claim", c) for c in range(40)}
    for hop, f in ((1, 10), (2, 5)):
        new = set()
        for kind, node in frontier:
            for rel, to in {(r, t) for s, _, r, t, _ in both if s == kind}:
                nbrs = sorted((x for s, a, r, _, x in both if (s, a, r) == (kind, node, rel)), key=lambda x: (md5(f"{node}:{x}:0".encode()).hexdigest(), x))
                want += [(hop, kind, node, rel, to, x, i) for i, x in enumerate(nbrs[:f], 1)]
                new |= {(to, x) for x in nbrs[:f]}
        frontier = new
    assert got == sorted(want)


def test_every_claim_is_a_seed(spark):
    out = q_graph.neighbor_sample_hops(spark, SF001)
    assert out.where("hop = 1").select("node").distinct().count() == base.claims_split(spark, SF001).select("claim_id").distinct().count()
    assert {r.relation for r in out.where("hop = 2").select("relation").distinct().collect()} == {"filed_claim", "visited", "rev_treated_by", "rev_visited", "works_at"}
