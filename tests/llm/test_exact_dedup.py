import hashlib
import re

from riskloom.llm.exactdedup import exact_dedup, keep_first
from tests.llm.conftest import documents

ROWS = [(5, "a  b"), (3, "a\t\nb"), (9, " a b"), (4, None), (2, ""), (7, "x" * 200_000), (8, "x" * 200_000 + "y"), (3, "a b"), (None, "z"), (None, "z"), (6, "z"),
        (11, "é b"), (12, "é\xa0b")]


def expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        low = min((j for j in ids if j is not None), default=None)
        out.append((i, low, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)


def test_groups_nulls_ties_and_clashing_columns(spark):
    out = exact_dedup(documents(spark, ROWS, extra=True)).collect()
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out]
    assert sorted(got, key=key) == sorted(expected(ROWS), key=key)
    # exactly one row of each group stays, and it has the group's id
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_hot_group_is_salted_and_whole(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(200)]
    out = {r.doc_id: r for r in exact_dedup(documents(spark, rows)).collect()}
    assert {r.keep_id for i, r in out.items() if i < 500} == {0}
    assert {r.group_size for i, r in out.items() if i < 500} == {500}
    assert sum(r.kept for r in out.values()) == 201


def test_keep_first_keeps_rows_with_all_columns(spark):
    docs = documents(spark, ROWS + [(20 + i, "hot") for i in range(300)])
    out = keep_first(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0) for r in out.collect()))
    kept = sorted(((r.doc_id is None, r.doc_id or 0) for r in exact_dedup(docs).where("kept").collect()))
    assert got == kept


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).collect() == []
    assert keep_first(documents(spark, [])).collect() == []
