"""Chains longer than block ** levels: one head per section, the same for appended and whole logs."""
from pyspark.sql import functions as F

from riskloom.operators import auditstore as st
from riskloom.operators import compliance as cp
from riskloom.session import derived_path

BLOCK, LEVELS = 2, 2         # a section has 4 entries


def test_long_chains_have_a_head_per_section(spark):
    rows = [(c, i, f"{c}-{i}") for c, n in {"a": 11, "b": 4, "c": 8, "d": 1}.items() for i in range(n)]
    df, folder = spark.createDataFrame(rows, "chain_key string, at int, what string"), derived_path(spark)
    entry = F.concat_ws("|", "seq", "what")
    for k, own in enumerate(("at < 3", "at BETWEEN 3 AND 8", "at > 8", "at > 8")):
        st.append_batch(df.where(own), folder, min(k, 2), "chain_key", ["at"], entry, BLOCK, LEVELS, sections=True)
    heads = st.edge_heads(st.read_edge(spark, folder, 3), "chain_key", BLOCK, LEVELS, sections=True)
    log = cp.sequence_entries(df, ["chain_key"], ["at"]).withColumn("entry", entry)
    sealed, whole = cp.seal(log, "chain_key", block=BLOCK, levels=LEVELS)
    key = lambda t: sorted((r.chain_key, r.n_entries, r.head) for r in t.collect())
    assert key(heads) == key(whole) and heads.count() == 3 + 1 + 2 + 1
    own = spark.read.parquet(f"{folder}/log")
    assert sorted((r.chain_key, r.seq, r.hash) for r in own.collect()) == sorted((r.chain_key, r.seq, r.hash) for r in sealed.collect())
    assert all(r.intact and r.expected == r.found for r in cp.verify_chain(own, heads, "chain_key", block=BLOCK).collect())
    forged = own.withColumn("entry", F.when((F.col("chain_key") == "a") & (F.col("seq") == 5), "forged").otherwise(F.col("entry")))
    bad = {(r.chain_key, r.head_ok) for r in cp.verify_chain(forged, heads, "chain_key", block=BLOCK).collect() if not r.intact}
    assert ("a", False) in bad and {c for c, _ in bad} == {"a"}
