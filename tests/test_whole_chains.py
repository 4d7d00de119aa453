"""One head per chain, however many entries it has."""
import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import compliance as cp
from riskloom.plans import q_compliance

BLOCK, LEVELS = 2, 2         # a part has 4 entries


def test_parts_of_long_chains_are_linked(spark):
    rows = [(c, i, f"{c}-{i}") for c, n in {"a": 37, "b": 4, "c": 8, "d": 1, None: 5}.items() for i in range(n)]
    log = spark.createDataFrame(rows, "chain_key string, seq long, entry string")
    parts = cp.seal(log, "chain_key", block=BLOCK, levels=LEVELS)[1]
    assert parts.count() == 10 + 1 + 2 + 1
    whole = cp.whole_heads(parts, "chain_key", BLOCK)
    own = cp.seal(log, "chain_key", block=BLOCK)[1]
    key = lambda t: sorted((r.chain_key, r.n_entries, r.head) for r in t.collect())
    assert key(whole) == key(own) and len(key(whole)) == 4
    other = log.replace("a-9", "forged", "entry")
    assert {a for a, b in zip(key(whole), key(cp.whole_heads(cp.seal(other, "chain_key", block=BLOCK, levels=LEVELS)[1], "chain_key", BLOCK))) if a != b} == {key(whole)[0]}
    assert cp.whole_heads(parts.where("false"), "chain_key", BLOCK).isEmpty()


@pytest.mark.parametrize("n", [40, 5000])
def test_heads_query_equals_its_sql(spark, tmp_path, n):
    d = tmp_path / f"n{n}"
    d.mkdir()
    spark.range(n).selectExpr("id event_id", "timestampadd(SECOND, int(id % 977), TIMESTAMP'2024-01-02 00:00:00') ts", "id % 7 user_id",
                              "if(id % 50 = 0, 'view', 'click') event_type", "double(id % 13) / 4 value", "concat('p', id % 3) props").coalesce(1).write.parquet(f"{d}/events.parquet")
    found = sorted(tuple(r) for r in q_compliance.audit_chain_heads(spark, str(d)).collect())
    assert len(found) == 2                                          # before, with 5000 entries: 3, two of them of one chain
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
        assert sorted(db.sql(q_compliance.CHAIN_SQL.rstrip("\n") + ",\n" + q_compliance.WHOLE_SQL.strip()).fetchall()) == found


def test_long_chains_are_verified_once(spark, tmp_path):
    """An entry of a chain of several parts is held against one head: before, it was read once for each part and no such chain was intact."""
    d = tmp_path / "verify"
    d.mkdir()
    spark.range(9000).selectExpr("id event_id", "timestampadd(SECOND, int(id % 977), TIMESTAMP'2024-01-02 00:00:00') ts", "id % 7 user_id",
                                 "if(id % 50 = 0, 'view', if(id % 97 = 0, 'purchase', 'other')) event_type", "double(id % 13) / 4 value", "concat('p', id % 3) props").write.parquet(f"{d}/events.parquet")
    rows = {r.chain_key.split(":")[1]: r for r in q_compliance.audit_chain_verify(spark, str(d)).collect()}
    n = {"view": 180, "purchase": 91, "other": 9000 - 180 - 91}
    assert {k: (r.expected, r.repeated, r.intact) for k, r in rows.items()} == {k: (v, 0, k == "other") for k, v in n.items()}
    assert (rows["view"].missing, rows["view"].mismatched, rows["purchase"].mismatched, rows["purchase"].missing) == (5, 0, 91, 0)


def test_a_log_is_dealt_to_its_blocks_once(spark):
    log = spark.range(100).selectExpr("concat('c', id % 3) chain_key", "id div 3 seq", "concat('e', id) entry", "map('k', id) details", "if(id % 2 = 0, id, null) user")
    sealed, heads = cp.seal(log, "chain_key", block=4)
    assert sealed.columns == [*log.columns, "hash"] and dict(sealed.dtypes)["details"] == "map<string,bigint>"
    plan = sealed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan                  # before: the log was joined with its hashes
    assert sorted((r.chain_key, r.seq, r.entry, r.details["k"], r.user) for r in sealed.collect()) == sorted((r.chain_key, r.seq, r.entry, r.details["k"], r.user) for r in log.collect())
    odd = sealed.withColumn("hash", F.when((F.col("chain_key") != "c1") | (F.col("seq") != 6), F.col("hash")))
    odd = odd.unionByName(sealed.where("chain_key = 'c2' AND seq < 2")).unionByName(sealed.limit(1).withColumn("seq", F.lit(None).cast("long")).withColumn("chain_key", F.lit("c0")))
    got = {r.chain_key: (r.found, r.missing, r.repeated, r.mismatched, r.head_ok) for r in cp.verify_chain(odd, heads, "chain_key", block=4).collect()}
    assert got["c1"] == (33, 0, 0, 2, True)                               # the entry without a hash, and the one after it
    assert got["c2"][:3] == (35, 0, 2) and got["c0"][:4] == (35, 0, 1, 1) and not got["c2"][4] and not got["c0"][4]
