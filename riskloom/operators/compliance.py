"""Compliance records as tables (CP-1 .. CP-15).

The audit log is append-only with a SHA-256 hash chain.  Hashing one entry after
the other is sequential by definition, so a chain is hashed in blocks of
``BLOCK`` entries, side by side: an entry's hash covers the entry and the hash before it
in its block, the first one starts from ``sha256(chain # level # block)``.  The
last hashes of the blocks are the entries of the next level, hashed the same
way, until one block is left; its last hash and the number of entries are the
chain's *head*, stored apart from the log.  Every entry, with its details, is
under the head: changing, removing, adding or cutting off entries or whole
blocks changes it.  Positions come from the balanced running totals, so a hot
chain key never lands in one task, and a group that is gathered has at most ``BLOCK`` entries.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.masking import PII_PATTERNS, mask_frame, mask_value
from riskloom.operators.ordering import materialize, running_totals

BLOCK = 512

# Actions of the entry kinds.
PREDICTION, ACCESS, EXPORT, DELETE = "PREDICTION_MADE", "DATA_ACCESS", "DATA_EXPORT", "DATA_DELETE"


def entry_string(*cols: Column) -> Column:
    """Canonical text of an entry (null-safe, fixed field order)."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def details_text(details: Column) -> Column:
    """Canonical text of a details map: ``key=value`` in key order (null value: empty)."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(details)), lambda k: F.concat(k, F.lit("="), F.coalesce(details[k], F.lit("")))), ";")


def sequence_entries(log: DataFrame, chain_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """0-based ``seq`` per chain in order."""
    one = "_rl_one"
    rt = running_totals(log.withColumn(one, F.lit(1).cast("long")), chain_cols, order_cols, [one])
    return rt.withColumn("seq", F.col(f"cum_{one}") - 1).drop(one, f"cum_{one}")


def genesis(chain_key: Column, level: int, block: Column) -> Column:
    return F.sha2(F.concat_ws("#", chain_key.cast("string"), F.lit(str(level)), block.cast("string")), 256)


def _linked(level: int) -> Column:
    """Last hash of the block ``xs``, each of its texts hashed over the hash before it."""
    return F.aggregate("xs", genesis(F.col("chain"), level, F.col("block")), lambda acc, x: F.sha2(F.concat(acc, x["text"]), 256))


def _hash_level(rows: DataFrame, level: int, block: int) -> DataFrame:
    """(chain, seq, text) -> (chain, block, last): the last hash of every block."""
    grp = rows.withColumn("block", F.floor(F.col("seq") / block)).groupBy("chain", "block").agg(
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("xs"))
    return grp.select("chain", "block", _linked(level).alias("last"))


def _head(blocks: DataFrame, block: int, levels: int) -> DataFrame:
    """(chain, section, digest) from the blocks of level 0; a section is a block of the top level."""
    for level in range(1, levels):
        blocks = _hash_level(blocks.select("chain", F.col("block").alias("seq"), F.col("last").alias("text")), level, block)
    return blocks.select("chain", F.col("block").alias("section"), F.col("last").alias("digest"))


def chain_levels(longest: int, block: int = BLOCK) -> int:
    """Levels until the longest chain is one block."""
    levels = 1
    while longest > block ** levels:
        levels += 1
    return levels


def seal(seq_log: DataFrame, chain_key: str, entry_col: str = "entry", block: int = BLOCK, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """CP-4: the log with each entry's ``hash``, and the heads (chain_key, n_entries, head).

    ``levels`` is fixed for all chains by the longest one, unless given; a chain that needs more then has a
    head for each ``part`` of block ** levels entries, which ``whole_heads`` links."""
    if levels is None:
        levels = chain_levels((seq_log.agg(F.max("seq")).first()[0] or 0) + 1, block)
    # whole entries go to their block, so that none has to look for its hash; maps, which have no order, as lists
    maps = [c for c, kind in seq_log.dtypes if kind.startswith("map")]
    own = [F.map_entries(c).alias(c) if c in maps else F.col(c) for c in seq_log.columns]
    rows = seq_log.select(F.col(chain_key).alias("chain"), F.floor(F.col("seq") / block).alias("block"), F.struct("seq", F.col(entry_col).alias("text"), F.struct(*own).alias("own")).alias("x"))
    grp = rows.groupBy("chain", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    hashes = F.aggregate("xs", F.array(genesis(F.col("chain"), 0, F.col("block"))), lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x["text"]), 256))))
    blocks = materialize(grp.select("chain", "block", "xs", F.slice(hashes, 2, F.size("xs")).alias("hashes"))
                         .select("chain", "block", F.size("xs").cast("long").alias("n"), F.element_at("hashes", -1).alias("last"), F.arrays_zip(F.col("xs.own").alias("own"), F.col("hashes").alias("hash")).alias("entries")))
    whole = blocks.where(F.col("chain").isNotNull() & F.col("block").isNotNull()).select(F.explode("entries").alias("e")).select("e.own.*", "e.hash")
    log = whole.select(chain_key, "seq", *[F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in seq_log.columns if c not in (chain_key, "seq")], "hash")
    counts = blocks.groupBy("chain").agg(F.sum("n").alias("n_entries"))
    heads = _head(blocks, block, levels).join(counts, "chain").select(
        F.col("chain").alias(chain_key), "n_entries", F.sha2(F.concat_ws("#", F.col("n_entries").cast("string"), "digest"), 256).alias("head"),
        F.lit(levels).alias("levels"), F.col("section").alias("part"), "digest")
    return log, heads


def whole_heads(heads: DataFrame, chain_key: str, block: int = BLOCK) -> DataFrame:
    """CP-4: one head per chain (chain_key, n_entries, head, levels) from those of its parts, as ``seal`` gives them:
    their digests are hashed on, level by level, until the longest chain is one block, however long it is."""
    level, top = heads.agg(F.max("levels"), F.max("part")).first()
    rows = heads.select(F.col(chain_key).alias("chain"), F.col("part").alias("seq"), F.col("digest").alias("text"))
    while top:
        rows = _hash_level(rows, level, block).select("chain", F.col("block").alias("seq"), F.col("last").alias("text"))
        level, top = level + 1, top // block
    counts = heads.where("part = 0").select(chain_key, "n_entries")
    return counts.join(rows.select(F.col("chain").alias(chain_key), "text"), chain_key).select(
        chain_key, "n_entries", F.sha2(F.concat_ws("#", F.col("n_entries").cast("string"), "text"), 256).alias("head"), F.lit(level).alias("levels"))


def verify_chain(log: DataFrame, heads: DataFrame, chain_key: str, entry_col: str = "entry", block: int = BLOCK) -> DataFrame:
    """CP-5 / WN-11: one row per chain of the log or the heads: entries ``expected`` and
    ``found``, ``missing`` and ``repeated`` positions, ``mismatched`` entries (their hash does not
    follow from the stored hash before them), ``head_ok`` (the head computed
    from the entries equals the stored one) and ``intact``.  Heads with a ``section`` are held against that section's."""
    rows = log.select(F.col(chain_key).alias("chain"), F.floor(F.col("seq") / block).alias("block"), F.struct("seq", F.col(entry_col).alias("text"), "hash").alias("x"))
    grp = rows.groupBy("chain", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def bad(x: Column, i: Column) -> Column:
        last = F.get(F.col("xs"), i - 1)
        before = F.when(x["seq"] % block == 0, genesis(F.col("chain"), 0, F.col("block"))).when(last["seq"] == x["seq"] - 1, last["hash"])
        return ~F.coalesce(F.sha2(F.concat(before, x["text"]), 256) == x["hash"], F.lit(False))

    # a block is gathered once, for its own checks and for its digest
    blocks = materialize(grp.select("chain", "block", _linked(0).alias("last"), F.size("xs").cast("long").alias("found"), F.size(F.array_distinct(F.array_compact("xs.seq"))).cast("long").alias("places"),
                                    F.size(F.filter("xs", bad)).cast("long").alias("mismatched")))
    counts = blocks.groupBy("chain").agg(*[F.sum(c).alias(c) for c in ("found", "places", "mismatched")])
    levels = heads.agg(F.max("levels")).first()[0] or 1
    digests = _head(blocks, block, levels)
    by = ["chain", "section"] if "section" in heads.columns else ["chain"]
    known = heads.select(F.col(chain_key).alias("chain"), *by[1:], F.col("n_entries").alias("expected"), "head")
    both = known.join(digests.where(F.col("chain").isNotNull()), by, "full").join(counts, "chain", "left")
    head = F.sha2(F.concat_ws("#", F.col("found").cast("string"), "digest"), 256)
    zero = F.lit(0).cast("long")
    out = both.select(
        F.col("chain").alias(chain_key), F.coalesce("expected", zero).alias("expected"), F.coalesce("found", zero).alias("found"),
        F.greatest(F.coalesce("expected", zero) - F.coalesce("places", zero), zero).alias("missing"),
        F.coalesce(F.col("found") - F.col("places"), zero).alias("repeated"),
        F.coalesce("mismatched", zero).alias("mismatched"), F.coalesce(head == F.col("head"), F.lit(False)).alias("head_ok"))
    return out.withColumn("intact", F.col("head_ok") & (F.col("mismatched") == 0) & (F.col("expected") == F.col("found")) & (F.col("missing") == 0))


def audit_report(log: DataFrame, as_of: dt.datetime, days: int = 30, top_k: int = 5) -> DataFrame:
    """CP-6: totals over the last ``days``, counts by action (the ``ACTIONS`` most frequent,
    largest first; the rest is ``other_actions``) and the top users."""
    w = log.where((F.col("ts") > F.lit(as_of - dt.timedelta(days=days))) & (F.col("ts") <= F.lit(as_of)))
    def top(col, k, name):
        g = w.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col)).limit(k)
        return g.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(col).alias("v")))),
                                 lambda x: F.struct(x["v"].alias(col), (-x["neg"]).alias("n"))).alias(name))
    actions = top("action", ACTIONS, "by_action")
    users = top("user", top_k, "top_users").select(F.transform("top_users", lambda x: x["user"]).alias("top_users"))
    tot = w.agg(F.count(F.lit(1)).alias("total_actions"), F.count_distinct("user").alias("unique_users"))
    named = F.aggregate("by_action", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return tot.crossJoin(actions).crossJoin(users).withColumn("other_actions", F.col("total_actions") - named)


ACTIONS = 100


def current_consent(events: DataFrame) -> DataFrame:
    """WN-13: the latest event per (user, consent type) wins (ties: larger event id)."""
    return events.groupBy("user_id", "consent_type").agg(
        F.max_by("granted", F.struct("ts", "event_id")).alias("granted"),
        F.max("ts").alias("ts"))


def has_consent(requests: DataFrame, consent: DataFrame) -> DataFrame:
    """CP-7: consent check for (user_id, consent_type) requests; unknown -> false."""
    return requests.join(consent.select("user_id", "consent_type", "granted"), ["user_id", "consent_type"], "left") \
                   .withColumn("has_consent", F.coalesce(F.col("granted"), F.lit(False))).drop("granted")


def retention(records: DataFrame, policies: DataFrame, as_of: dt.datetime) -> DataFrame:
    """CP-8: days left = floor((created + policy - as_of) / 1 day); keep when > 0;
    no policy -> keep with -1.  The policy table is one row per data type."""
    j = records.join(F.broadcast(policies), "data_type", "left")
    secs = F.unix_timestamp(F.col("created_at")) + F.col("retention_days") * 86400 - F.lit(int(as_of.replace(
        tzinfo=dt.timezone.utc).timestamp()))
    left = F.floor(secs / 86400)
    return j.withColumn("days_until_expiry", F.when(F.col("retention_days").isNull(), F.lit(-1)).otherwise(left)) \
            .withColumn("should_retain", F.when(F.col("retention_days").isNull(), F.lit(True))
                        .otherwise(F.col("days_until_expiry") > 0))


def dsr_state(requests: DataFrame, processed: DataFrame) -> DataFrame:
    """CP-9: subject requests with their status; only erasure requests can be processed."""
    p = processed.select("request_id", F.col("ts").alias("processed_at"))
    j = requests.join(p, "request_id", "left")
    done = F.col("processed_at").isNotNull() & (F.col("request_type") == "erasure")
    return j.withColumn("status", F.when(done, F.lit("processed")).otherwise(F.lit("pending"))) \
            .withColumn("processed_at", F.when(done, F.col("processed_at")))


def gdpr_status(consent: DataFrame, policies: DataFrame, dsr: DataFrame) -> DataFrame:
    """CP-10: compliance score 100 -20 (no policies) -10 (pending requests) -30 (no consent)."""
    c = consent.agg(F.count_distinct("user_id").alias("total_users_with_consent"))
    p = policies.agg(F.count(F.lit(1)).alias("retention_policies"))
    r = dsr.agg(F.count_if(F.col("status") == "pending").alias("pending_data_subject_requests"),
                F.count_if(F.col("status") == "processed").alias("processed_data_subject_requests"))
    j = c.crossJoin(p).crossJoin(r)
    score = (F.lit(100.0) - F.when(F.col("retention_policies") == 0, 20).otherwise(0)
             - F.when(F.col("pending_data_subject_requests") > 0, 10).otherwise(0)
             - F.when(F.col("total_users_with_consent") == 0, 30).otherwise(0))
    return j.withColumn("compliance_score", F.greatest(score, F.lit(0.0)))


# Recommendation texts, in checking order.
CRITICAL_SCORE = 70
LOW_SCORE = "CRITICAL: Compliance score below 70%. Immediate action required."
PENDING = ("Process ", " pending data subject requests within 30 days.")
NO_CONSENT = "No consent records found. Implement consent tracking system."
NO_POLICIES = "Define data retention policies for each data type."


def gdpr_recommendations(status: DataFrame) -> DataFrame:
    """CP-11: recommendation list from the status row."""
    pending = F.col("pending_data_subject_requests")
    recs = [F.when(F.col("compliance_score") < CRITICAL_SCORE, F.lit(LOW_SCORE)),
            F.when(pending > 0, F.concat(F.lit(PENDING[0]), pending.cast("string"), F.lit(PENDING[1]))),
            F.when(F.col("total_users_with_consent") == 0, F.lit(NO_CONSENT)),
            F.when(F.col("retention_policies") == 0, F.lit(NO_POLICIES))]
    return status.withColumn("recommendations", F.array_compact(F.array(*recs)))


def protection_report(texts: DataFrame, text_col: str, chain_ok: DataFrame) -> DataFrame:
    """CP-12: share of texts with detected PII, share of these in which the mask of an export leaves none, and chain integrity."""
    found = lambda c: functools.reduce(Column.__or__, [c.rlike(p) for p in PII_PATTERNS.values()])
    t = texts.select(found(F.col(text_col)).alias("hit"), F.coalesce(found(mask_value(F.col(text_col))), F.lit(False)).alias("left")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("hit").alias("records_with_pii"), F.count_if(F.col("hit") & ~F.col("left")).alias("records_masked"))
    c = chain_ok.agg(F.coalesce(F.bool_and("intact"), F.lit(True)).alias("audit_chain_intact"))
    return t.crossJoin(c).withColumn(
        "pii_detected_pct", F.when(F.col("records") > 0, F.col("records_with_pii") * 100.0 / F.col("records"))
        .otherwise(F.lit(0.0))).withColumn(
        "pii_masked_pct", F.when(F.col("records_with_pii") > 0, F.col("records_masked") * 100.0 / F.col("records_with_pii")).otherwise(F.lit(100.0)))


def erase(df: DataFrame, ids: DataFrame, key: str, user: str, reason: str, as_of: dt.datetime,
          data_type: str) -> tuple[DataFrame, DataFrame]:
    """CP-13 / JN-10: (remaining rows, audit rows).  The id list is joined
    with a left-anti join; each erased id produces one DATA_DELETE row."""
    remaining = df.join(ids.select(key), key, "left_anti")
    erased = df.select(key).join(ids.select(key), key, "left_semi").distinct()
    audit = erased.select(F.lit(as_of).alias("ts"), F.lit("DATA_DELETE").alias("action"), F.lit(user).alias("user"),
                          F.concat(F.lit(f"data:{data_type}:"), F.col(key).cast("string")).alias("resource"),
                          F.lit("success").alias("status"),
                          F.create_map(F.lit("reason"), F.lit(reason)).alias("details"))
    return remaining, audit


def masked_export(df: DataFrame, skip: tuple = ()) -> DataFrame:
    """CP-2: masked projection for export (FN-5); the audit row is written by the caller."""
    return mask_frame(df, skip)


def details_map(pairs: Mapping[str, Column]) -> Column:
    """CP-3: ``map<string,string>`` details column."""
    kv = []
    for k, v in pairs.items():
        kv += [F.lit(k), v.cast("string")]
    return F.create_map(*kv)
