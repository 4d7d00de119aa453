"""Steps that sort lines or claims get tasks by the number of rows, not by their compressed size."""
from riskloom.plans import base, q_explain
from riskloom.sources import tables

from tests.conftest import SF001


def folder(tmp_path, name):
    """The smallest data under a path of its own, for which nothing is stored yet."""
    (tmp_path / name).symlink_to(SF001)
    return str(tmp_path / name)


def tasks(df):
    """Tasks that the result is computed by."""
    return df.rdd.getNumPartitions()


def test_a_task_sorts_a_bounded_number_of_lines(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    whole = sorted(tables.claims_view(spark, SF001).collect())
    lines = tables.read_table(spark, SF001, "lineitem").count()
    monkeypatch.setattr(tables, "TASK_ROWS", -(-lines // (3 * cores)))
    claims = tables.claims_view(spark, SF001)
    assert tasks(claims) > 2 * cores                      # before: merged to the session's parallelism
    assert sorted(claims.collect()) == whole


def test_few_rows_are_left_as_they_are(spark):
    df, cores = spark.range(10), spark.sparkContext.defaultParallelism
    assert tables.deal(df, "id", tables.TASK_ROWS) is df
    assert tasks(tables.deal(df, "id", tables.TASK_ROWS * (cores + 1))) == cores + 1


def test_a_task_joins_a_bounded_number_of_claims(spark, tmp_path, monkeypatch):
    few, many = folder(tmp_path, "few"), folder(tmp_path, "many")
    cores = spark.sparkContext.defaultParallelism
    order = lambda rows: sorted(rows, key=lambda r: r.claim_id)
    features, what_if = order(base.features(spark, few).collect()), order(q_explain.what_if(spark, few).collect())
    monkeypatch.setattr(tables, "TASK_ROWS", -(-len(features) // (2 * cores)))
    assert tasks(base.scores(spark, many)) > cores        # before: left to the scan
    again = order(base.features(spark, many).collect())
    assert [(r.claim_id, r.split, r.patient_total_claims, r.patient_max_amount) for r in again] == \
        [(r.claim_id, r.split, r.patient_total_claims, r.patient_max_amount) for r in features]
    own = order(q_explain.what_if(spark, many).collect())
    assert [r.claim_id for r in own] == [r.claim_id for r in what_if]
    assert all(abs(a.modified_prediction - b.modified_prediction) < 1e-9 for a, b in zip(own, what_if))
