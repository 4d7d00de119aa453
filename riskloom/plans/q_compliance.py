"""Compliance queries: PII detection/masking, audit hash chain, consent, retention, erasure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions.masking import PII_PATTERNS, SPAN_TOKENS, mask_frame, mask_spans, mask_value, pii_counts
from riskloom.operators import compliance as cp
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.sources.tables import spread

AS_OF = dt.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _q(s: str) -> str:
    return s.replace("'", "''")


# ------------------------------------------------------------------ PII
@query("pii_counts_documents", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS pii_type, CAST(sum(len(regexp_extract_all(text, '{_q(p)}'))) AS BIGINT) AS n_matches, "
    f"count(*) FILTER (WHERE len(regexp_extract_all(text, '{_q(p)}')) > 0) AS n_documents FROM documents"
    for k, p in PII_PATTERNS.items()) + ")")
def pii_counts_documents(spark, d):
    """CP-1: matches and matching documents per PII type over every document."""
    docs = spread(base.read(spark, d, "documents").select("text"), base.SPREAD)
    c = docs.select(*pii_counts(F.col("text")))
    one = c.agg(*[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).cast("long").alias(f"m_{k}") for k in PII_PATTERNS],
                *[F.count_if(F.col(f"n_{k}") > 0).alias(f"d_{k}") for k in PII_PATTERNS])
    rows = F.array(*[F.struct(F.lit(k).alias("pii_type"), F.col(f"m_{k}").alias("n_matches"),
                              F.col(f"d_{k}").alias("n_documents")) for k in PII_PATTERNS])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _stars_sql(n: str) -> str:
    return f"repeat('*', greatest({n}, 0))"


def _mask_email_sql(s: str) -> str:
    at = f"(length({s}) - instr(reverse({s}), '@') + 1)"
    local = f"substr({s}, 1, {at} - 1)"
    n = f"length({local})"
    masked = (f"CASE WHEN {n} > 2 THEN substr({local}, 1, 1) || {_stars_sql(n + ' - 2')} || substr({local}, {n}, 1) "
              f"ELSE {_stars_sql(n)} END")
    return (f"CASE WHEN instr({s}, '@') = 0 THEN {_stars_sql(f'length({s})')} "
            f"ELSE {masked} || '@' || substr({s}, {at} + 1) END")


def _mask_tail_sql(s: str) -> str:
    return (f"CASE WHEN length({s}) < 4 THEN {_stars_sql(f'length({s})')} "
            f"ELSE {_stars_sql(f'length({s}) - 4')} || substr({s}, length({s}) - 3, 4) END")


def _mask_value_sql(s: str) -> str:
    parts = [f"WHEN {s} IS NULL THEN NULL"]
    for k, p in PII_PATTERNS.items():
        hit = f"regexp_matches({s}, '{_q(p)}')"
        if k == "email":
            parts.append(f"WHEN {hit} THEN {_mask_email_sql(s)}")
        elif k in ("phone", "ssn", "credit_card"):
            parts.append(f"WHEN {hit} THEN {_mask_tail_sql(s)}")
        else:
            parts.append(f"WHEN {hit} THEN {_stars_sql(f'length({s})')}")
    return "CASE " + " ".join(parts) + f" ELSE {s} END"


@query("pii_mask_fields", f"""
SELECT conv_id, turn, {_mask_value_sql('role')} AS role, {_mask_value_sql('text')} AS text FROM conversations""")
def pii_mask_fields(spark, d):
    """FN-1..FN-5: every string field of the conversations masked as a whole value."""
    conv = spread(base.read(spark, d, "conversations"), base.SPREAD)
    return mask_frame(conv, skip=("conv_id", "turn"))


def _spans_sql(s: str) -> str:
    out = s
    for k, p in PII_PATTERNS.items():
        out = f"regexp_replace({out}, '{_q(p)}', '{SPAN_TOKENS[k]}', 'g')"
    return out


@query("pii_mask_spans", f"SELECT doc_id, {_spans_sql('text')} AS text FROM documents")
def pii_mask_spans(spark, d):
    """Free-text masking: PII spans of every document replaced by type tokens."""
    docs = spread(base.read(spark, d, "documents").select("doc_id", "text"), base.SPREAD)
    return docs.select("doc_id", mask_spans(F.col("text")).alias("text"))


@query("pii_mask_sensitive_field", f"""
SELECT event_id, CASE WHEN props IS NULL THEN NULL
  WHEN regexp_matches(props, '^(?:{_q(PII_PATTERNS['email'])})') THEN {_mask_email_sql('props')}
  WHEN regexp_matches(props, '^(?:{_q(PII_PATTERNS['phone'])})') THEN {_mask_tail_sql('props')}
  ELSE {_stars_sql('length(props)')} END AS api_token FROM events""")
def pii_mask_sensitive_field(spark, d):
    """FN-3/FN-4: a field whose name is sensitive is masked whatever its content."""
    e = base.read(spark, d, "events")
    return e.select("event_id", mask_value(F.col("props"), "api_token").alias("api_token"))


# ------------------------------------------------------------------ audit chain
CHAIN_BLOCK, CHAIN_LEVELS = 16, 3        # a part of a chain has up to 16^3 entries; audit_chain_heads links the parts
KIND_OF = {"click": cp.PREDICTION, "signup": cp.PREDICTION, "view": cp.ACCESS, "purchase": cp.EXPORT, "error": cp.DELETE}


def audit_log(spark, d):
    """CP-3: audit entries of all four kinds derived from the events (one chain per day and event type)."""
    e = base.read(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])[F.col("event_type")]
    eid, val = F.col("event_id").cast("string"), F.col("value").cast("string")
    details = F.when(kind == cp.PREDICTION, cp.details_map({"claim_id": eid, "fraud_score": val, "model_version": F.col("event_type")})) \
        .when(kind == cp.ACCESS, cp.details_map({"record_count": F.col("user_id"), "filter_criteria": F.col("props")})) \
        .when(kind == cp.EXPORT, cp.details_map({"format": F.lit("csv"), "record_count": F.col("user_id"), "destination": F.col("props")})) \
        .otherwise(cp.details_map({"reason": F.col("props")}))
    resource = F.when(kind == cp.PREDICTION, F.concat(F.lit("prediction:"), eid)).when(kind == cp.ACCESS, F.concat(F.lit("data:"), "event_type")) \
        .when(kind == cp.EXPORT, F.lit("data:export")).otherwise(F.concat(F.lit("data:events:"), eid))
    log = e.select("event_id", "ts", kind.alias("action"), F.col("user_id").alias("user"), resource.alias("resource"), F.lit("success").alias("status"),
                   details.alias("details"), F.concat(F.to_date("ts").cast("string"), F.lit(":"), F.col("event_type")).alias("chain_key"))
    return cp.sequence_entries(log, ["chain_key"], ["ts", "event_id"])


def entry_of():
    return cp.entry_string(F.col("chain_key"), F.col("seq"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("action"), F.col("user"),
                           F.col("resource"), F.col("status"), cp.details_text(F.col("details")))


def sequenced(spark, d):
    return audit_log(spark, d).withColumn("entry", entry_of())


def seal_log(spark, d):
    """The log with its hashes and the heads of its parts, from one sealing; ``cp.seal`` reads the log once and stores
    its hashed blocks, from which both follow."""
    return base.derived(spark, d, "audit_seal", lambda: cp.seal(base.once(spark, d, "audit_log", sequenced), "chain_key", block=CHAIN_BLOCK, levels=CHAIN_LEVELS))


def heads(spark, d):
    """One head per chain, stored: they follow from the hashed blocks."""
    return base.view(spark, d, "audit_heads", lambda: cp.whole_heads(seal_log(spark, d)[1], "chain_key", CHAIN_BLOCK))


def sealed(spark, d):
    """The sealed log, read from its hashed blocks, and its heads."""
    return seal_log(spark, d)[0], heads(spark, d)


KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_OF.items()) + " END"
ENTRY_SQL = """concat_ws('|', chain_key, CAST(seq AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR), action, CAST(user_id AS VARCHAR), resource, 'success', details)"""
LOG_ENTRIES_SQL = f"""
a0 AS (SELECT *, {KIND_SQL} AS action, CAST(CAST(ts AS DATE) AS VARCHAR) || ':' || event_type AS chain_key FROM events),
a1 AS (SELECT *, row_number() OVER (PARTITION BY chain_key ORDER BY ts, event_id) - 1 AS seq,
  CASE action WHEN '{cp.PREDICTION}' THEN 'prediction:' || event_id WHEN '{cp.ACCESS}' THEN 'data:' || event_type
       WHEN '{cp.EXPORT}' THEN 'data:export' ELSE 'data:events:' || event_id END AS resource,
  CASE action WHEN '{cp.PREDICTION}' THEN 'claim_id=' || event_id || ';fraud_score=' || CAST(value AS VARCHAR) || ';model_version=' || event_type
       WHEN '{cp.ACCESS}' THEN 'filter_criteria=' || coalesce(props, '') || ';record_count=' || user_id
       WHEN '{cp.EXPORT}' THEN 'destination=' || coalesce(props, '') || ';format=csv;record_count=' || user_id
       ELSE 'reason=' || coalesce(props, '') END AS details FROM a0),
entries AS (SELECT chain_key, seq, event_id, event_type, action, ts, user_id, resource, details, {ENTRY_SQL} AS text FROM a1)"""


def chain_sql(src: str, p: str) -> str:
    """CTEs that hash the table ``src`` (chain_key, seq, text): ``{p}h0`` has the
    entries' hashes, ``{p}head`` the heads."""
    out, b = [], CHAIN_BLOCK
    for level in range(CHAIN_LEVELS):
        source = src if level == 0 else f"{p}e{level}"
        out.append(f"""{p}r{level} AS (SELECT chain_key, seq, seq // {b} AS block, text, row_number() OVER (PARTITION BY chain_key, seq // {b} ORDER BY seq) AS r FROM {source}),
{p}h{level} AS (SELECT chain_key, block, seq, r, sha256(sha256(concat_ws('#', chain_key, '{level}', CAST(block AS VARCHAR))) || text) AS hash FROM {p}r{level} WHERE r = 1
  UNION ALL SELECT x.chain_key, x.block, x.seq, x.r, sha256(h.hash || x.text) FROM {p}h{level} h JOIN {p}r{level} x
    ON x.chain_key = h.chain_key AND x.block = h.block AND x.r = h.r + 1),
{p}e{level + 1} AS (SELECT chain_key, block AS seq, arg_max(hash, r) AS text FROM {p}h{level} GROUP BY chain_key, block)""")
    out.append(f"""{p}head AS (SELECT e.chain_key, n AS n_entries, sha256(concat_ws('#', CAST(n AS VARCHAR), e.text)) AS head
  FROM {p}e{CHAIN_LEVELS} e JOIN (SELECT chain_key, count(*) AS n FROM {src} GROUP BY chain_key) USING (chain_key))""")
    return ",\n".join(out)


CHAIN_SQL = "WITH RECURSIVE " + LOG_ENTRIES_SQL.strip() + ",\n" + chain_sql("entries", "s") + "\n"


@query("audit_chain_build", CHAIN_SQL + "SELECT chain_key, seq, hash FROM sh0")
def audit_chain_build(spark, d):
    """CP-3 + CP-4: the hash of every entry."""
    return sealed(spark, d)[0].select("chain_key", "seq", "hash")


#: The parts' digests hashed on until every chain is one block; ``up`` has the levels from CHAIN_LEVELS on.
WHOLE_SQL = f"""
up AS (SELECT {CHAIN_LEVELS} AS level, chain_key, CAST(seq AS BIGINT) AS seq, text FROM se{CHAIN_LEVELS}
  UNION ALL SELECT level + 1, chain_key, block, list_reduce(list_prepend(sha256(concat_ws('#', chain_key, CAST(level AS VARCHAR), CAST(block AS VARCHAR))),
    list(text ORDER BY seq)), lambda a, x: sha256(a || x))
  FROM (SELECT *, seq // {CHAIN_BLOCK} AS block, max(seq) OVER () AS top FROM up) WHERE top > 0 GROUP BY level, chain_key, block)
SELECT chain_key, n AS n_entries, sha256(concat_ws('#', CAST(n AS VARCHAR), text)) AS head
FROM up JOIN (SELECT chain_key, count(*) AS n FROM entries GROUP BY chain_key) USING (chain_key) WHERE level = (SELECT max(level) FROM up)"""


@query("audit_chain_heads", CHAIN_SQL.rstrip("\n") + ",\n" + WHOLE_SQL.strip())
def audit_chain_heads(spark, d):
    """CP-4: count and head of every chain, linked over all blocks."""
    return heads(spark, d).select("chain_key", "n_entries", "head")


VERIFY_SQL = """
v AS (SELECT *, coalesce(sha256(CASE WHEN seq % {b} = 0 THEN sha256(concat_ws('#', chain_key, '0', CAST(seq // {b} AS VARCHAR)))
        WHEN lag(seq) OVER w = seq - 1 THEN lag(hash) OVER w END || text) = hash, false) AS ok
  FROM tampered WINDOW w AS (PARTITION BY chain_key, seq // {b} ORDER BY seq)),
c AS (SELECT chain_key, count(*) AS found, count(*) FILTER (WHERE NOT ok) AS mismatched FROM v GROUP BY chain_key)
SELECT chain_key, s.n_entries AS expected, coalesce(found, 0) AS found, s.n_entries - coalesce(found, 0) AS missing, CAST(0 AS BIGINT) AS repeated,
       coalesce(mismatched, 0) AS mismatched, coalesce(t.head = s.head, false) AS head_ok,
       coalesce(t.head = s.head AND mismatched = 0 AND found = s.n_entries, false) AS intact
FROM shead s LEFT JOIN c USING (chain_key) LEFT JOIN thead t USING (chain_key)""".replace("{b}", str(CHAIN_BLOCK))
#: What an attacker does to each kind of chain: forged details, a block, the tail or one entry removed, a whole day removed.
TAMPER_SQL = f"""
tampered AS (SELECT chain_key, seq, hash, CASE WHEN event_id % 97 = 0 AND event_type = 'purchase' THEN {ENTRY_SQL.replace("details)", "details || ';forged=1')")} ELSE text END AS text
  FROM entries JOIN sh0 USING (chain_key, seq) JOIN shead USING (chain_key)
  WHERE NOT (event_type = 'click' AND seq // {CHAIN_BLOCK} = 1) AND NOT (event_type = 'view' AND seq >= n_entries - 5)
    AND NOT (event_type = 'signup' AND seq = 3) AND chain_key <> '2024-01-15:error')"""


@query("audit_chain_verify", CHAIN_SQL.rstrip("\n") + ",\n" + TAMPER_SQL.strip() + ",\n" + chain_sql("tampered", "t") + ",\n" + VERIFY_SQL.strip())
def audit_chain_verify(spark, d):
    """CP-5 / WN-11: forged details, a missing block, a cut tail, a missing entry and a
    missing chain are all reported; the other chains are intact."""
    log, heads = sealed(spark, d)
    kind = F.substring_index("chain_key", ":", -1)
    forged = F.map_concat(F.col("details"), F.create_map(F.lit("forged"), F.lit("1")))
    t = log.withColumn("details", F.when((F.pmod("event_id", F.lit(97)) == 0) & (kind == "purchase"), forged).otherwise(F.col("details")))
    t = t.withColumn("entry", F.when((F.pmod("event_id", F.lit(97)) == 0) & (kind == "purchase"), F.concat(F.col("entry"), F.lit(";forged=1"))).otherwise(F.col("entry")))
    t = t.join(heads.select("chain_key", "n_entries"), "chain_key")
    t = t.where(~((kind == "click") & (F.floor(F.col("seq") / CHAIN_BLOCK) == 1)) & ~((kind == "view") & (F.col("seq") >= F.col("n_entries") - 5))
                & ~((kind == "signup") & (F.col("seq") == 3)) & (F.col("chain_key") != "2024-01-15:error"))
    return cp.verify_chain(t, heads, "chain_key", block=CHAIN_BLOCK)


AUDIT_WINDOW = f"(SELECT event_id, ts, event_type AS action, user_id AS \"user\" FROM events " \
               f"WHERE ts > {AS_OF_SQL} - INTERVAL 30 DAY AND ts <= {AS_OF_SQL})"


AUDIT_REPORT_SQL = f"""
SELECT count(*) AS total_actions, count(DISTINCT "user") AS unique_users,
       (SELECT list(action || '=' || n ORDER BY n DESC, action) FROM (SELECT action, count(*) AS n FROM {AUDIT_WINDOW} GROUP BY action)) AS by_action,
       (SELECT list("user" ORDER BY n DESC, "user") FROM (SELECT "user", count(*) AS n FROM {AUDIT_WINDOW}
        GROUP BY "user" ORDER BY n DESC, "user" LIMIT 5)) AS top_users, CAST(0 AS BIGINT) AS other_actions
FROM {AUDIT_WINDOW}"""


@query("audit_report", AUDIT_REPORT_SQL)
def audit_report(spark, d):
    """CP-6: last 30 days -- totals, distinct users, counts by action, top-5 users."""
    log = base.read(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("action"),
                                               F.col("user_id").alias("user"))
    by = F.transform("by_action", lambda x: F.concat_ws("=", x["action"], x["n"].cast("string")))
    return cp.audit_report(log, AS_OF).withColumn("by_action", by)


@query("audit_actions", f"""SELECT action, count(*) AS n FROM {AUDIT_WINDOW} GROUP BY action""")
def audit_actions(spark, d):
    """CP-6 counts by action."""
    log = base.read(spark, d, "events").select("ts", F.col("event_type").alias("action"))
    w = log.where((F.col("ts") > F.lit(AS_OF - dt.timedelta(days=30))) & (F.col("ts") <= F.lit(AS_OF)))
    return w.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ consent / retention / requests
# Consent type of each event kind, and the retention policy table.
CONSENT_OF = {"click": "marketing", "signup": "data_processing", "view": "analytics", "purchase": "data_sharing"}
POLICIES = [("signup", 365), ("purchase", 730), ("click", 30), ("view", 14)]
CONSENT_SQL_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONSENT_OF.items()) + " END"
POLICIES_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in POLICIES) + ") p(data_type, retention_days)"


def consent_events(spark, d):
    e = base.read(spark, d, "events").where(F.col("event_type").isin(*CONSENT_OF))
    m = F.create_map(*[x for k, v in CONSENT_OF.items() for x in (F.lit(k), F.lit(v))])
    return e.select("event_id", "user_id", m[F.col("event_type")].alias("consent_type"),
                    (F.pmod("event_id", F.lit(3)) != 0).alias("granted"), "ts")


CONSENT_CTE = f"""
ce AS (SELECT event_id, user_id, {CONSENT_SQL_CASE} AS consent_type, event_id % 3 <> 0 AS granted, ts
       FROM events WHERE event_type IN ({", ".join(f"'{k}'" for k in CONSENT_OF)})),
cur AS (SELECT user_id, consent_type, arg_max(granted, (ts, event_id)) AS granted, max(ts) AS ts
        FROM ce GROUP BY user_id, consent_type)"""


@query("consent_state", "WITH " + CONSENT_CTE + """,
req AS (SELECT u.user_id, t.consent_type FROM (SELECT DISTINCT user_id FROM events) u
        CROSS JOIN (SELECT DISTINCT consent_type FROM ce) t)
SELECT req.user_id, req.consent_type, coalesce(cur.granted, false) AS has_consent
FROM req LEFT JOIN cur USING (user_id, consent_type)""")
def consent_state(spark, d):
    """WN-13 + CP-7: latest consent per user and type; unknown pairs -> false."""
    ce = consent_events(spark, d)
    cur = cp.current_consent(ce)
    users = base.read(spark, d, "events").select("user_id").distinct()
    types = ce.select("consent_type").distinct()   # at most one row per consent type
    return cp.has_consent(users.crossJoin(F.broadcast(types)), cur)


@query("retention_expiry", f"""
SELECT event_id, e.event_type AS data_type,
       CASE WHEN retention_days IS NULL THEN -1
            ELSE CAST(floor((epoch(ts) + retention_days * 86400 - epoch({AS_OF_SQL})) / 86400) AS BIGINT) END
         AS days_until_expiry,
       CASE WHEN retention_days IS NULL THEN true
            ELSE floor((epoch(ts) + retention_days * 86400 - epoch({AS_OF_SQL})) / 86400) > 0 END AS should_retain
FROM events e LEFT JOIN {POLICIES_SQL} ON p.data_type = e.event_type""")
def retention_expiry(spark, d):
    """CP-8 over every event record (policy per event kind; no policy -> keep, -1)."""
    e = base.read(spark, d, "events").select("event_id", F.col("event_type").alias("data_type"),
                                             F.col("ts").alias("created_at"))
    pol = spark.createDataFrame(POLICIES, "data_type string, retention_days int")
    return cp.retention(e, pol, AS_OF).select("event_id", "data_type",
                                              F.col("days_until_expiry").cast("long").alias("days_until_expiry"),
                                              "should_retain")


REQ_TYPES = ("access", "rectification", "erasure", "portability")
REQ_SQL = f"""
rq AS (SELECT 'dsr_' || event_id AS request_id, user_id,
              CASE event_id % 4 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(REQ_TYPES))} END AS request_type,
              ts AS filed_at FROM events WHERE event_type = 'error'),
pr AS (SELECT request_id, filed_at + INTERVAL 1 DAY AS ts FROM rq WHERE CAST(substr(request_id, 5) AS BIGINT) % 2 = 0),
dsr AS (SELECT rq.*, CASE WHEN pr.ts IS NOT NULL AND request_type = 'erasure' THEN 'processed' ELSE 'pending' END
                       AS status,
               CASE WHEN pr.ts IS NOT NULL AND request_type = 'erasure' THEN pr.ts END AS processed_at
        FROM rq LEFT JOIN pr USING (request_id))"""


def subject_requests(spark, d):
    e = base.read(spark, d, "events").where(F.col("event_type") == "error")
    types = F.array(*[F.lit(t) for t in REQ_TYPES])
    rq = e.select(F.concat(F.lit("dsr_"), F.col("event_id").cast("string")).alias("request_id"), "user_id",
                  F.element_at(types, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("request_type"),
                  F.col("ts").alias("filed_at"), "event_id")
    processed = rq.where(F.pmod("event_id", F.lit(2)) == 0) \
                  .select("request_id", (F.col("filed_at") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    return cp.dsr_state(rq.drop("event_id"), processed)


@query("subject_request_state", "WITH " + REQ_SQL.strip() + "\nSELECT request_id, user_id, request_type, filed_at, status, processed_at FROM dsr")
def subject_request_state(spark, d):
    """CP-9: requests filed from error events; only erasure requests get processed."""
    return subject_requests(spark, d).select("request_id", "user_id", "request_type", "filed_at", "status",
                                             "processed_at")


GDPR_SQL = "WITH " + CONSENT_CTE + "," + REQ_SQL.strip() + f""",
st AS (SELECT (SELECT count(DISTINCT user_id) FROM cur) AS total_users_with_consent,
              (SELECT count(*) FROM {POLICIES_SQL}) AS retention_policies,
              (SELECT count(*) FROM dsr WHERE status = 'pending') AS pending_data_subject_requests,
              (SELECT count(*) FROM dsr WHERE status = 'processed') AS processed_data_subject_requests),
st2 AS (SELECT *, CAST(greatest(100.0 - CASE WHEN retention_policies = 0 THEN 20 ELSE 0 END
                         - CASE WHEN pending_data_subject_requests > 0 THEN 10 ELSE 0 END
                         - CASE WHEN total_users_with_consent = 0 THEN 30 ELSE 0 END, 0.0) AS DOUBLE) AS compliance_score FROM st)
SELECT *,
       list_filter([CASE WHEN compliance_score < 70 THEN 'CRITICAL: Compliance score below 70%. Immediate action required.' END,
                    CASE WHEN pending_data_subject_requests > 0 THEN 'Process ' || pending_data_subject_requests || ' pending data subject requests within 30 days.' END,
                    CASE WHEN total_users_with_consent = 0 THEN 'No consent records found. Implement consent tracking system.' END,
                    CASE WHEN retention_policies = 0 THEN 'Define data retention policies for each data type.' END], lambda x: x IS NOT NULL)
         AS recommendations
FROM st2"""


@query("gdpr_status", GDPR_SQL)
def gdpr_status(spark, d):
    """CP-10 + CP-11."""
    cur = cp.current_consent(consent_events(spark, d))
    pol = spark.createDataFrame(POLICIES, "data_type string, retention_days int")
    return cp.gdpr_recommendations(cp.gdpr_status(cur, pol, subject_requests(spark, d)))


@query("gdpr_status_bare", GDPR_SQL.replace("(SELECT count(DISTINCT user_id) FROM cur)", "(SELECT count(DISTINCT user_id) FROM cur WHERE user_id < 0)")
       .replace(f"(SELECT count(*) FROM {POLICIES_SQL})", f"(SELECT count(*) FROM {POLICIES_SQL} WHERE retention_days < 0)"))
def gdpr_status_bare(spark, d):
    """CP-10 + CP-11 without consents and policies: the score falls below 70."""
    cur = cp.current_consent(consent_events(spark, d)).where("user_id < 0")
    pol = spark.createDataFrame(POLICIES, "data_type string, retention_days int").where("retention_days < 0")
    return cp.gdpr_recommendations(cp.gdpr_status(cur, pol, subject_requests(spark, d)))


@query("erase_with_audit", f"""
SELECT {AS_OF_SQL} AS ts, 'DATA_DELETE' AS action, 'dpo' AS "user",
       'data:orders:' || CAST(o_custkey AS VARCHAR) AS resource, 'success' AS status, 'reason=subject request' AS details
FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def erase_with_audit(spark, d):
    """CP-13 / JN-10: erase the orders of customers who filed erasure (negative
    balance marks them here); one audit row per erased subject."""
    orders = base.read(spark, d, "orders")
    ids = base.read(spark, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    _, audit = cp.erase(orders, ids, "o_custkey", "dpo", "subject request", AS_OF, "orders")
    return audit.withColumn("details", cp.details_text(F.col("details")))


@query("erase_remaining", """
SELECT count(*) AS remaining_orders, count(DISTINCT o_custkey) AS remaining_customers
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def erase_remaining(spark, d):
    """CP-13: what is left after the erasure (left-anti join)."""
    orders = base.read(spark, d, "orders")
    ids = base.read(spark, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    remaining, _ = cp.erase(orders, ids, "o_custkey", "dpo", "subject request", AS_OF, "orders")
    return remaining.agg(F.count(F.lit(1)).alias("remaining_orders"),
                         F.count_distinct("o_custkey").alias("remaining_customers"))


_HIT_SQL = lambda c: "(" + " OR ".join(f"regexp_matches({c}, '{_q(p)}')" for p in PII_PATTERNS.values()) + ")"


@query("protection_report", f"""
WITH m AS (SELECT text, {_mask_value_sql('text')} AS masked FROM documents),
t AS (SELECT count(*) AS records, count(*) FILTER (WHERE {_HIT_SQL('text')}) AS records_with_pii,
  count(*) FILTER (WHERE {_HIT_SQL('text')} AND NOT coalesce({_HIT_SQL('masked')}, false)) AS records_masked FROM m)
SELECT *, true AS audit_chain_intact, CASE WHEN records > 0 THEN records_with_pii * 100.0 / records ELSE 0.0 END AS pii_detected_pct,
  CASE WHEN records_with_pii > 0 THEN records_masked * 100.0 / records_with_pii ELSE 100.0 END AS pii_masked_pct FROM t""")
def protection_report(spark, d):
    """CP-12: PII share over every document and integrity of the untampered chain."""
    docs = spread(base.read(spark, d, "documents").select("text"), base.SPREAD)
    return cp.protection_report(docs, "text", cp.verify_chain(*sealed(spark, d), "chain_key", block=CHAIN_BLOCK))
