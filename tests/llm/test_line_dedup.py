import random
from collections import defaultdict

from riskloom.llm import linededup
from tests.llm.conftest import documents


def expected(rows, min_chars=20, min_docs=3):
    ids = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := linededup.line_key(line)) >= min_chars:
                ids[k].add(i)
    stays = {k: max((i for i in v if i is not None), default=None) for k, v in ids.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not ((k := linededup.line_key(x)) in stays and stays[k] != i)]
        out.append((i is None, i or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows, **kw):
    out = linededup.line_dedup(documents(spark, rows, extra=True), **kw).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in out)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [f"This is a common line number {i} " for i in range(30)] + ["short", "", "  ", "É" * 19 + " ", "é" * 20, " padded but not stripped "]
    rows = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < .3 else rng.choice(pool) + (f" {i}" if rng.random() < .4 else "") for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "a line that is very common here\t\r\n" * 9000), (504, "A LINE that is very common here"), (505, "a line that is very common here"),
             (505, "a line that is very common here"), (None, "a line that is very common here"), (None, None), (506, "x" * 200_000), (507, "x" * 200_000), (508, "x" * 200_000)]
    assert run(spark, rows) == expected(rows)


def test_hot_line_and_empty_table(spark):
    rows = [(i, f"own line of document {i} alone\nthe one line that all documents have") for i in range(400)]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_full_filter_only_adds_suspects(spark, monkeypatch):
    """Filters that are much too small suspect more lines; the result stays exact."""
    monkeypatch.setattr(linededup, "TWICE_BITS", 1 << 10)
    monkeypatch.setattr(linededup, "ONCE_BITS", 1)
    rows = [(i, f"line that only document {i} has\nthe one line that all documents have") for i in range(100)]
    assert run(spark, rows) == expected(rows)
