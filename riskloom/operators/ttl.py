"""Result cache with a fixed time to live (ML-11, PF-5).

A request is answered from the cache if its key was scored at most ``ttl``
seconds ago; an entry expires by its creation, and a hit does not renew it.  So a
key's scored requests form a chain: the first one, then always the first request
later than ``ttl`` after the last scored one.  A key may hold a third of all
rows, so the chain is not walked row by row:

* a request that comes later than ``ttl`` after the request before it is scored
  whatever happened earlier -- a chain starts there;
* for every request, the first one later than ``ttl`` after it lies in the next
  time slice of ``ttl`` seconds or the one after that (or it starts a chain), so
  it is found by a window over (key, slice);
* links are followed by doubling: every round joins the links with themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.ordering import materialize, with_previous

TTL_SECONDS = 600


def mark_scored(requests: DataFrame, key: str, ts: str, row_id: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Adds ``is_new``: true where the request is scored, false where the cache answers.

    Requests of equal time are ordered by ``row_id`` (unique).  Null keys are one key.
    """
    limit = ttl * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = requests.select(F.struct(F.col(key).alias("k")).alias("key"), micros.alias("t"), F.col(row_id).alias("id"))
    rows = with_previous(own, ["key"], ["t", "id"], ["t"])
    rows = materialize(rows.withColumn("starts", F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > limit)).drop("prev_t"))
    slice_ = lambda t: F.floor(t / limit)
    events = rows.select("key", slice_(F.col("t")).alias("s"), "t", "id", "starts")
    # only requests of bursts can be followed by one that does not start a chain
    asks = rows.select("key", slice_(F.col("t") + limit).alias("s"), (F.col("t") + limit).alias("t"), F.col("id").alias("asker"))
    both = events.unionByName(asks, allowMissingColumns=True)
    # equal times: the asker comes after all events of that moment
    later = Window.partitionBy("key", "s").orderBy("t", F.col("asker").isNotNull(), "id").rowsBetween(1, Window.unboundedFollowing)
    first = F.first(F.when(F.col("id").isNotNull(), F.struct("id", "starts")), ignorenulls=True).over(later)
    asked = both.withColumn("hit", first).where("asker IS NOT NULL").select("key", "s", "asker", "hit")
    heads = events.groupBy("key", "s").agg(F.min_by(F.struct("id", "starts"), F.struct("t", "id")).alias("head")).withColumn("s", F.col("s") - 1)
    hit = F.coalesce("hit", "head")
    links = asked.join(heads, ["key", "s"], "left").select(F.col("asker").alias("a"), hit["id"].alias("b"), hit["starts"].alias("starts"))
    links = materialize(links.where(~F.col("starts")).select("a", "b"))
    scored = materialize(rows.where("starts").select("id"))
    while not links.isEmpty():
        scored = materialize(scored.union(scored.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id"))).distinct())
        links = materialize(links.alias("x").join(links.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b"))
    return requests.join(scored.select(F.col("id").alias("_scored")), F.col(row_id) == F.col("_scored"), "left") \
                   .withColumn("is_new", F.col("_scored").isNotNull()).drop("_scored")
