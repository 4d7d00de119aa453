"""Queries store what several steps read, not copies of it."""
from riskloom.operators import compliance as cp
from riskloom.operators.ordering import materialize
from riskloom.operators.split import temporal_split
from riskloom.plans import base, q_compliance, q_core, q_explain, q_extra

from tests.conftest import SF001


def stored(spark, d):
    """Names of the tables that were built for a data folder."""
    return {name for app, folder, name in base._VIEWS if (app, folder) == (spark.sparkContext.applicationId, d)}


def folder(tmp_path, name):
    """The smallest data under a path of its own, for which nothing is stored yet."""
    (tmp_path / name).symlink_to(SF001)
    return str(tmp_path / name)


def test_heads_need_no_stored_log(spark, tmp_path, monkeypatch):
    seal, calls = cp.seal, []
    monkeypatch.setattr(cp, "seal", lambda *a, **k: calls.append(1) or seal(*a, **k))
    d = folder(tmp_path, "audit")
    heads = sorted(q_compliance.audit_chain_heads(spark, d).collect())
    assert "audit_sealed" not in stored(spark, d) and len(heads) > 1      # before: the log was stored with its hashes
    log, again = q_compliance.sealed(spark, d)
    assert len(calls) == 1                                                # before: 2
    assert sorted(again.select(*heads[0].__fields__).collect()) == heads
    assert log.count() == sum(h.n_entries for h in heads)
    checked = cp.verify_chain(log, again, "chain_key", block=q_compliance.CHAIN_BLOCK)
    assert checked.where("NOT intact").isEmpty()


def test_split_and_scores_are_read_from_the_stored_claims(spark, tmp_path):
    d = folder(tmp_path, "claims")
    claims = set(base.claims(spark, d).inputFiles())
    assert claims <= set(base.claims_split(spark, d).inputFiles())         # before: files of a copy
    assert claims <= set(base.scored(spark, d).inputFiles())
    n = base.claims(spark, d).count()
    sizes = {r.split: r["count"] for r in base.claims_split(spark, d).groupBy("split").count().collect()}
    assert sizes == {"train": int(n * 0.6), "val": int(n * 0.8) - int(n * 0.6), "test": n - int(n * 0.8)}
    assert base.scored(spark, d).count() == n


def test_one_pass_over_features_stores_none(spark, tmp_path):
    d = folder(tmp_path, "features")
    one = sorted(q_core.calendar_and_ratio_features(spark, d).collect())
    corr = {r[:2]: r["corr"] for r in q_extra.correlation_matrix(spark, d).collect()}
    assert "features" not in stored(spark, d)                             # before: stored for one reader
    base.features(spark, d)
    assert sorted(q_core.calendar_and_ratio_features(spark, d).collect()) == one
    again = {r[:2]: r["corr"] for r in q_extra.correlation_matrix(spark, d).collect()}
    assert again.keys() == corr.keys() and all(a is b or abs(a - b) < 1e-9 for a, b in ((again[k], corr[k]) for k in corr))


def test_attributions_need_no_scores(spark, tmp_path):
    d = folder(tmp_path, "attributions")
    found = q_explain.attributions(spark, d)
    assert not {"scored", "profile"} & stored(spark, d)                   # before: both were built
    assert found.count() == base.claims_split(spark, d).where("split = 'test'").count()


def test_days_that_hold_a_cut_are_split_by_key(spark):
    rows = materialize(spark.range(20).selectExpr("id", "date_add(DATE'2024-01-01', int(id / 7)) day"))
    split = {r.id: r.split for r in temporal_split(rows, "day", "id").collect()}
    assert split == {i: "train" if i < 12 else "val" if i < 16 else "test" for i in range(20)}


def test_only_the_compared_claims_are_explained(spark, tmp_path):
    d = folder(tmp_path, "compare")
    one = q_explain.explanation_compare(spark, d).collect()
    assert "attributions" not in stored(spark, d) and len(one) == 1       # before: every test claim was explained and ranked
    q_explain.attributions(spark, d)
    assert q_explain.explanation_compare(spark, d).collect() == one
