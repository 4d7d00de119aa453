import random

from pyspark.sql import functions as F

from riskloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, seq long, kind string, message_id long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n", "### User:\nhi", "\\b\\l\\h", "\\", "a\\", "", None, "\n\n", "é🙂<#>", "x" * 100_000]


def test_fold_events_brute_force(spark):
    rng = random.Random(6)
    events = []
    for conv in range(8):
        for seq in range(60):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete", "other", None])
            events.append((conv, seq, kind, rng.randrange(6), rng.choice(["user", "assistant", None]), rng.choice([*NASTY[:8], "word "])))
    state = {}
    for conv, seq, kind, mid, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        m = state.setdefault((conv, mid), {"place": seq, "text": "", "role": "", "gone": False})
        m["role"] = role or m["role"]
        if kind in ("message", "edit", None):
            m["text"], m["gone"] = text or "", False
        elif kind == "delta":
            m["text"] += text or ""
        elif kind in ("regenerate", "delete"):
            m["text"], m["gone"] = "", kind == "delete"
    want = sorted((c, m["place"], i, m["role"], m["text"]) for (c, i), m in state.items() if not m["gone"])
    rng.shuffle(events)
    got = chat.fold_events(spark.createDataFrame(events, EVENTS)).collect()
    assert sorted((r.conv_id, r.place, r.message_id, r.role, r.text) for r in got) == want


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, r, t) for i, t in enumerate(NASTY) for r in ("user",)] + [(2, i, "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(3, 0, None, "no role"), (3, None, "a:b\n</turn>\n### x", "odd role"), (3, 1, "assistant", None), (None, 0, "assistant", "no id"), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, 0, "user", "tie")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("clash")).withColumn("formatted", F.lit("clash"))
    out = chat.render(chat.fold_events(chat.as_events(df)))
    back = out.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("segments")).alias("loss"), "formatted",
                      F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined")).collect()
    for r in back:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.joined == r.formatted
    assert len(back) == 5


def test_empty_table(spark):
    assert chat.render(chat.fold_events(chat.as_events(spark.createDataFrame([], SCHEMA)))).collect() == []
