"""Shared steps shuffle claims as few times as they must, with the same rows."""
import re

from riskloom.operators import features as ft
from riskloom.operators import graph as gr
from riskloom.operators.split import temporal_split
from riskloom.sources import tables


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_claims_are_dealt_once(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(tables.__dict__, "read_table", lambda s, d, n: {
        "lineitem": s.range(40).selectExpr("id % 10 l_orderkey", "id % 2 l_linenumber", "DATE'2024-01-01' l_shipdate", "id l_partkey", "id % 3 l_suppkey",
                                           "double(id) l_extendedprice", "1D l_quantity", "'R' l_returnflag", "'F' l_linestatus"),
        "orders": s.range(8).selectExpr("id o_orderkey", "id o_custkey", "'1' o_orderpriority"),
        "supplier": s.range(2).selectExpr("id s_suppkey", "id s_nationkey")}[n])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tables.claims_view(spark, "x")
        assert shuffles(out) == 2                       # lines, orders
        first = {}
        for i in range(40):
            first.setdefault((i % 10, i % 2), i)
        assert sorted(r.claim_amount for r in out.collect()) == sorted(float(i) for (o, _), i in first.items() if o < 8 and i % 3 < 2)
        claims = spark.range(30).selectExpr("id claim_id", "id % 4 patient_id", "id % 3 doctor_id", "id % 2 hospital_id", "double(id) claim_amount", "1 num_procedures",
                                            "date_add(DATE'2024-01-01', int(id)) claim_date")
        split = temporal_split(claims, "claim_date", "claim_id")
        assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 18, "val": 6, "test": 6}
        stored = spark.createDataFrame(split.collect(), split.schema)
        wide = ft.apply_entity_stats(stored, stored.where("split = 'train'"))
        assert "hashpartitioning(doctor_id" not in re.sub(r"HashAggregate.*", "", re.split("BroadcastExchange", wide._jdf.queryExecution().executedPlan().toString())[0])
        assert {r.claim_id: r.doctor_total_claims for r in wide.collect()} == {i: 6 for i in range(30)}
        edges = gr.build_edges(claims, claims.select("doctor_id", "hospital_id").distinct(), claims.select("patient_id").where("patient_id < 3").distinct(), claims.select("hospital_id").distinct())
        n = {r.relation: r["count"] for r in edges.groupBy("relation").count().collect()}
        assert n["visited"] == 9 and n["filed_claim"] == 23 and n["treated_by"] == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
