"""Balanced label propagation: linked documents move to their neighbours' shards, under capacity quotas.

Documents are linked when they share a link key (here: equal texts). Each round joins the documents with the shard
counts of their keys, lets a document ask for the shard that holds most of its neighbours, and grants each flow
between two shards what the receiving shard has room for, plus what flows the other way. Ties are broken by an order
of the shards that is drawn for each key, so that the ends of a pair agree on one of their two shards. Rounds that ask
for any shard, where full shards swap, take turns with rounds that ask for open shards alone. After the rounds, linked
documents beyond a shard's exact share, key by key, and the documents without links fill the shards that lack rows, so
that row counts differ by one at most (law `rows`). A key that holds more than a shard's share is spread over as many shards
as it needs.

Only DataFrame functions run. A key's rows never meet in one task: counts are pre-aggregated, joins on a hot key can
be split by Spark, and ranks are counted in buckets of bounded size.

Null texts are linked to nothing and have size 1; very long texts count by their bytes and are keyed by a digest; equal non-null texts are linked, the empty one included. Repeated
rows are placed each, an empty table gives no row, and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm._shared import discard, materialize, small

SHARDS = 16
#: Rows of a ranking bucket.
BUCKET_ROWS = 50_000


def _best(votes: list[Column], key: Column, now: Column, allowed: list[bool], free: list[bool] | None = None) -> Column:
    """The allowed (or present) shard with most votes; ties go to free shards, then by an order of the shards that all of a key's rows share."""
    choices = [
        F.when(F.lit(allowed[t]) | (now == t), F.struct(v.alias("n"), F.lit(bool(free and free[t])).alias("free"), F.xxhash64(key, F.lit(t)).alias("o"), F.lit(t).alias("t")))
        for t, v in enumerate(votes)
    ]
    return F.array_max(F.array(*choices))["t"]


def propagate(members: DataFrame, shards: int, shares: list[int], rounds: int = 12) -> DataFrame:
    """members (uid, key; a row per document and key) to (uid, shard), with shards holding at most about their shares."""
    state = materialize(members.select("uid").distinct().withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")), "shards-0")
    held = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}  # one row per shard
    still = False
    for step in range(1, rounds + 1):
        free = [shares[t] > held.get(t, 0) for t in range(shards)]
        swapping = step % 2 == 1
        placed = members.join(state, "uid")
        counts = placed.groupBy("key").agg(*[F.count(F.when(F.col("shard") == t, 1)).alias(f"c{t}") for t in range(shards)])
        counts = materialize(counts, f"counts-{step}")  # written, so that Spark can split a hot key in the join
        votes = members.join(small(counts), "key").groupBy("uid").agg(F.min("key").alias("key"), *[F.sum(f"c{t}").alias(f"v{t}") for t in range(shards)])
        best = _best([F.col(f"v{t}") for t in range(shards)], F.col("key"), F.col("shard"), [True] * shards if swapping else free, None if swapping else free)
        asked = state.join(votes, "uid").select("uid", "shard", best.alias("to"))
        asked = materialize(asked, f"asked-{step}")
        discard(counts)
        flows = {(r["shard"], r["to"]): r["count"] for r in asked.where("shard <> to").groupBy("shard", "to").count().collect()}
        if not flows and swapping:
            break
        granted = []
        for t in range(shards):
            incoming = {s: n for (s, to), n in flows.items() if to == t}
            swaps = {s: min(n, flows.get((t, s), 0)) for s, n in incoming.items()}
            room = max(0, shares[t] - held.get(t, 0))
            wanted = sum(n - swaps[s] for s, n in incoming.items())
            for s, n in sorted(incoming.items()):
                extra = (n - swaps[s]) * min(1.0, room / wanted) if wanted else 0
                granted.append((s, t, (swaps[s] + extra) / n))
        if not any(p for _, _, p in granted):
            if still:
                break
            still = True
            continue
        still = False
        grant = F.coalesce(*[F.when((F.col("shard") == s) & (F.col("to") == t), p) for s, t, p in granted], F.lit(0.0))
        draw = F.pmod(F.xxhash64("uid", F.lit(step)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        last, state = state, materialize(asked.select("uid", F.when(draw < grant, F.col("to")).otherwise(F.col("shard")).alias("shard")), f"shards-{step}")
        discard(last, asked)
        held = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
    return state


def _ranked(rows: DataFrame, group: list[str], bucket: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`, their 0-based rank within group by (bucket, order), counted bucket by bucket."""
    sizes = rows.groupBy(*group, *bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*group, *bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*group, *bucket).orderBy(*order)) - 1)
    return inside.join(base, [*group, *bucket]).withColumn(name, F.col("__base") + F.col("__k")).drop("__base", "__k")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for documents (doc_id, text)."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(text).alias("key"),
    )
    rows = materialize(rows, "rows")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shares = [total // shards + (t < total % shards) for t in range(shards)]
    keys = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = materialize(keys, "keys")
    members = materialize(rows.select("uid", "key").join(small(keys), "key"), "members")
    state = propagate(members.select("uid", "key"), shards, shares, rounds)

    blocks = max(1, -(-total // (BUCKET_ROWS * shards)))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("shard") + 1)
    linked = state.join(members, "uid").select("uid", "shard", "key", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("b"), F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / BUCKET_ROWS)).alias("salt"))
    linked = materialize(_ranked(linked, ["shard"], ["b", "salt"], ["key", "uid"], "slot"), "linked")
    kept = linked.where(F.col("slot") < share).select("uid", "shard", "slot")
    held = {r["shard"]: r["count"] for r in kept.groupBy("shard").count().collect()}
    loose = rows.select("uid").join(kept, "uid", "left_anti").join(members.select("uid", "key", "n"), "uid", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / BUCKET_ROWS)), F.lit(0))
    loose = loose.select("uid", "key", F.pmod(F.when(F.col("key").isNull(), F.xxhash64("uid")).otherwise(F.xxhash64("key")), F.lit(blocks * shards)).alias("b"), salt.alias("salt"))
    loose = _ranked(loose, [], ["b", "salt"], ["key", "uid"], "rank").drop("key") if blocks * shards > 1 else loose.withColumn("rank", F.row_number().over(Window.orderBy("key", "uid")) - 1)
    place, begin = F.lit(None), 0
    for t in range(shards):
        lack = shares[t] - held.get(t, 0)
        if lack:
            here = (F.col("rank") >= begin) & (F.col("rank") < begin + lack)
            place = F.coalesce(place, F.when(here, F.struct(F.lit(t).alias("shard"), (F.col("rank") - begin + held.get(t, 0)).cast("long").alias("slot"))))
            begin += lack
    filled = loose.select("uid", place.alias("p")).select("uid", "p.shard", "p.slot") if begin else kept.limit(0)
    placed = kept.select("uid", "shard", F.col("slot").cast("long").alias("slot")).unionByName(filled)
    return rows.join(placed, "uid").select("doc_id", "size", "text_crc32", "shard", "slot")


def sharding_digest(docs: DataFrame) -> DataFrame:
    rows = shard_documents(docs)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
