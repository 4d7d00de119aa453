"""An audit log that grows by batches (CP-4, CP-14).

The log's right *edge* is kept beside it: for every chain and level, how many entries the
level has and the hash so far of its open block.  A batch hashes its own entries, starting from the
edge, and one entry a level for every block that it fills; nothing older is read.  The head that
follows from the edge is the head that ``compliance.seal`` computes from the whole log.

On disk a batch is one folder of the log and one of the edge; both are overwritten, so a
batch that is run again, after a failure or by mistake, leaves the same log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.masking import mask_frame
from riskloom.operators.compliance import BLOCK, PREDICTION, details_map, details_text, entry_string, genesis, has_consent, sequence_entries
from riskloom.operators.ordering import materialize

EDGE = "chain string, level int, count long, hash string"


def empty_edge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGE)


def _extend(rows: DataFrame, edge: DataFrame, level: int, block: int, top: bool) -> DataFrame:
    """(chain, seq, text) of new entries of a level -> one row per touched block: chain, block, entries (seq, hash).
    The open block goes on from the edge; the top level has one block, however full."""
    place = F.lit(0).cast("long") if top else F.floor(F.col("seq") / block)
    grp = rows.withColumn("block", place).groupBy("chain", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("xs"))
    own = edge.where(F.col("level") == level).select("chain", F.col("count").alias("had"), F.col("hash").alias("open"))
    at = F.lit(0) if top else F.floor(F.col("had") / block)
    inside = (F.col("had") > 0) if top else (F.col("had") % block > 0)
    start = F.when(inside & (at == F.col("block")), F.col("open")).otherwise(genesis(F.col("chain"), level, F.col("block")))
    hashes = F.aggregate("xs", F.array(start), lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x["text"]), 256))))
    return grp.join(own, "chain", "left").withColumn("start", start).select(
        "chain", "block", F.arrays_zip(F.col("xs.seq").alias("seq"), F.slice(hashes, 2, F.size("xs")).alias("hash")).alias("entries"))


def append_entries(entries: DataFrame, edge: DataFrame, chain_key: str, entry_col: str = "entry", block: int = BLOCK, levels: int = 3,
                   sections: bool = False) -> tuple[DataFrame, DataFrame]:
    """CP-4: (new entries with ``hash``, new edge).

    ``entries`` carry their ``seq``, which goes on from the edge's count of level 0.  A chain may hold at most
    block ** levels entries; more is an error, unless ``sections``: then the top level has blocks too, and the edge keeps the
    last hash of every full one (level ``levels``), the end of a section.  No entries leave the edge as it is.
    """
    rows = entries.select(F.col(chain_key).cast("string").alias("chain"), "seq", F.col(entry_col).alias("text"))
    hashes, parts = None, []
    for level in range(levels):
        top = level == levels - 1 and not sections
        done = materialize(_extend(rows, edge, level, block, top))
        last = F.element_at("entries", -1)
        if level == 0:
            hashes = done.select(F.col("chain").alias(chain_key), F.explode("entries").alias("e")).select(chain_key, "e.seq", "e.hash")
        parts.append(done.groupBy("chain").agg(F.max(F.struct(last["seq"].alias("seq"), last["hash"].alias("hash"))).alias("m"))
                     .select("chain", F.lit(level).alias("level"), (F.col("m.seq") + 1).alias("count"), F.col("m.hash").alias("hash")))
        # blocks that are full now are entries of the next level
        rows = done.where((last["seq"] + 1) % block == 0).select("chain", F.col("block").alias("seq"), last["hash"].alias("text"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = materialize(found)
    if sections:
        ended = rows.select("chain", F.lit(levels).alias("level"), (F.col("seq") + 1).alias("count"), F.col("text").alias("hash"))
        found = found.unionByName(ended)
    elif not found.where(F.col("count") > F.lit(block) ** (F.lit(levels) - F.col("level"))).isEmpty():
        raise ValueError(f"a chain holds more than {block} ** {levels} entries")
    kept = edge.join(found.where(F.col("level") < levels).select("chain", "level"), ["chain", "level"], "left_anti")
    return entries.join(hashes.withColumnRenamed(chain_key, "_chain"), (F.col(chain_key).cast("string") == F.col("_chain")) & (entries["seq"] == hashes["seq"])).drop("_chain").drop(hashes["seq"]), found.unionByName(kept)


def edge_heads(edge: DataFrame, chain_key: str, block: int = BLOCK, levels: int = 3, sections: bool = False) -> DataFrame:
    """``chain_key, n_entries, head, levels`` as ``compliance.seal`` gives them; with ``sections`` one row and ``section`` for every
    block ** levels entries of a chain."""
    by = edge.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("level", "count", "hash"))).alias("at"))
    n = F.col("at")[0]["count"]

    def step(digest: Column, level: int) -> Column:
        """Digest of the last block of a level; ``digest``: that of the open block below, null if there is none."""
        own = F.get(F.col("at"), level)
        count = F.coalesce(own["count"], F.lit(0).cast("long"))
        top = level == levels - 1 and not sections
        begun = count > 0 if top else count % block > 0
        before = F.when(begun, own["hash"]).otherwise(genesis(F.col("chain"), level, F.lit(0).cast("long") if top else F.floor(count / block)))
        return F.when(digest.isNotNull(), F.sha2(F.concat(before, digest), 256)).when(begun, own["hash"])

    digest = F.lit(None).cast("string")
    for level in range(levels):
        digest = step(digest, level)
    if not sections:
        return by.select(F.col("chain").alias(chain_key), n.alias("n_entries"), F.sha2(F.concat_ws("#", n.cast("string"), digest), 256).alias("head"), F.lit(levels).alias("levels"))
    ended = F.transform(F.filter("at", lambda x: x["level"] == levels), lambda x: F.struct((x["count"] - 1).alias("section"), x["hash"].alias("digest")))
    ends = F.concat(ended, F.filter(F.array(F.struct(F.floor(n / block ** levels).alias("section"), digest.alias("digest"))), lambda x: x["digest"].isNotNull()))
    return by.select("chain", n.alias("n_entries"), F.explode(ends).alias("e")).select(
        F.col("chain").alias(chain_key), "n_entries", F.sha2(F.concat_ws("#", F.col("n_entries").cast("string"), "e.digest"), 256).alias("head"),
        F.lit(levels).alias("levels"), "e.section")


def _batches(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}")
    return df if before is None else df.where(F.col("batch") == before)


def read_edge(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The edge before ``batch``: what batch - 1 left (batches count from 0)."""
    return _batches(spark, folder, "edge", batch - 1).drop("batch") if batch else empty_edge(spark)


def append_batch(log: DataFrame, folder: str, batch: int, chain_col: str, order_cols: list[str], entry: Column, block: int = BLOCK, levels: int = 3,
                 sections: bool = False) -> None:
    """Append the rows of ``log`` as batch number ``batch`` (0, 1, 2, ... in turn) of the store in ``folder``.

    Rows of a chain are placed by ``order_cols`` behind those of earlier batches; ``entry`` is their canonical text (it may use
    ``seq``).  Running a batch again replaces it; later batches must then be run again too."""
    spark = log.sparkSession
    edge = read_edge(spark, folder, batch)
    had = edge.where("level = 0").select(F.col("chain").alias("_chain"), F.col("count").alias("_had"))
    new = sequence_entries(log, [chain_col], order_cols).join(had, F.col(chain_col).cast("string") == F.col("_chain"), "left")
    new = new.withColumn("seq", F.col("seq") + F.coalesce("_had", F.lit(0))).drop("_chain", "_had")
    sealed, edge = append_entries(new.withColumn("entry", entry), edge, chain_col, block=block, levels=levels, sections=sections)
    sealed.write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")
    edge.write.mode("overwrite").parquet(f"{folder}/edge/batch={batch}")


def prediction_entries(predictions: DataFrame, ts: Column, user: Column, claim: Column, score: Column, version: Column, key: Column) -> DataFrame:
    """CP-3 rows of served predictions: key, ts, action, user, resource, status, details."""
    return predictions.select(key.alias("prediction_id"), ts.alias("ts"), F.lit(PREDICTION).alias("action"), user.cast("string").alias("user"),
                              F.concat(F.lit("prediction:"), key.cast("string")).alias("resource"), F.lit("success").alias("status"),
                              details_map({"claim_id": claim.cast("string"), "fraud_score": score.cast("string"), "model_version": version}).alias("details"))


def log_entry(chain: Column) -> Column:
    """Canonical text of a prediction entry."""
    return entry_string(chain, F.col("seq"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("action"), F.col("user"), F.col("resource"), F.col("status"), details_text(F.col("details")))


def comply(predictions: DataFrame, log: DataFrame, consent: DataFrame, key: str = "prediction_id", user_col: str = "user_id", skip: tuple = ()) -> DataFrame:
    """CP-14: every prediction with its strings masked, ``gdpr_compliant`` (the user's current consent to data
    processing; unknown: false), ``audit_logged`` and the ``audit_hash`` of its entry in the sealed log."""
    asked = has_consent(predictions.withColumn("consent_type", F.lit("data_processing")), consent).withColumnRenamed("has_consent", "gdpr_compliant").drop("consent_type")
    logged = log.select(F.col("prediction_id").alias("_id"), F.col("hash").alias("audit_hash"))
    both = asked.join(logged, F.col(key) == F.col("_id"), "left").drop("_id").withColumn("audit_logged", F.col("audit_hash").isNotNull())
    return mask_frame(both, skip=(key, user_col, "gdpr_compliant", "audit_logged", "audit_hash", *skip))
