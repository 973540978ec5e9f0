"""Sharding by vector bin packing over bytes, tokens and rows.

Rows of one text form a group. Groups large enough to matter are placed one by
one; all others are gathered, by a hash of their text, into a fixed number of
bundles. Largest first, each group or bundle goes to the shard where the dot
product of its vector with the residual capacity is highest. Only those at most
`shards * (BUNDLES + BIG)` vectors, whatever the input, are placed on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filled, n_words, ranked

#: Bundles of small groups for each shard, and the fraction of a shard from which a group is placed by itself.
BUNDLES = 64
BIG = 128
DIMENSIONS = ("bytes", "tokens", "rows")


def place(vectors: list[tuple[tuple, tuple[float, ...]]], shards: int) -> dict:
    """Shard of each (key, vector), largest first; ties go to the lower shard. Takes vectors * shards steps, in numpy."""
    if not vectors:
        return {}
    sizes = np.array([v for _, v in vectors], float)
    sizes *= shards / np.maximum(sizes.sum(axis=0), 1)
    order = sorted(range(len(vectors)), key=lambda i: (-sizes[i].max(), -sizes[i].sum(), vectors[i][0]))
    residual, out = np.ones((shards, len(DIMENSIONS))), {}
    for i in order:
        best = int(np.argmax(residual @ sizes[i]))
        out[vectors[i][0]] = best
        residual[best] -= sizes[i]
    return out


def shard(docs: DataFrame, shards: int = 40, text: str = "text", id_col: str = "doc_id", overhead: int = 16, carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs` with the columns of `carry` (all by default).

    Adds size (UTF-8 bytes plus `overhead`), tokens (words), text_crc32, shard
    and slot (long, gapless from 0 in each shard), replacing columns of these
    names. Equal texts share a shard unless their group alone exceeds a
    shard's capacity in some dimension; such a group is cut by its rows' places
    in the input into parts of about half a capacity. Null text counts as empty; null or
    repeated ids are ordinary rows. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    added = ["size", "tokens", "text_crc32", "shard", "slot"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    t = filled(docs[text])
    rows = scratch.save(
        docs.select(
            F.struct(*[docs[c] for c in carried]).alias("_row"), docs[id_col].alias("_id"), F.monotonically_increasing_id().alias("_at"), (F.octet_length(t) + overhead).cast("long").alias("size"),
            n_words(docs[text]).alias("tokens"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("_group"),
        ),
        "rows",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = scratch.save(rows.groupBy("_group").agg(*sums), "groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    cap = {d: max(total[d], 1) / shards for d in DIMENSIONS}
    share = F.greatest(*[F.col(d) / F.lit(float(cap[d])) for d in DIMENSIONS])
    # At most 3 * shards * BIG groups reach this share: a fixed bound for driver and broadcast.
    big = groups.withColumn("_share", share).where(F.col("_share") > 1 / BIG)
    big = big.select("_group", *DIMENSIONS, F.when(F.col("_share") > 1, F.ceil(2 * F.col("_share"))).otherwise(1).cast("int").alias("_parts"))
    big_rows = big.collect()
    spec = "_group binary, _parts int"
    parts = spark.createDataFrame([(r["_group"], r["_parts"]) for r in big_rows], spec)
    n_bundles = shards * BUNDLES
    bundle = F.pmod(F.xxhash64("_group"), F.lit(n_bundles)).cast("int")
    keyed = rows.join(F.broadcast(parts), "_group", "left").withColumns(
        {"_bundle": F.when(F.col("_parts").isNull(), bundle).otherwise(-1), "_part": F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_at"), F.col("_parts")).cast("int")).otherwise(0)}
    )
    single = keyed.where("_bundle < 0").groupBy("_group", "_part").agg(*sums).collect()
    bundled = keyed.where("_bundle >= 0").groupBy("_bundle").agg(*sums).collect()
    vectors = [((0, bytes(r["_group"]).hex(), r["_part"]), tuple(r[d] for d in DIMENSIONS)) for r in single]
    vectors += [((1, "", r["_bundle"]), tuple(r[d] for d in DIMENSIONS)) for r in bundled]
    placed = place(vectors, shards)
    own = spark.createDataFrame([(bytes.fromhex(k[1]), k[2], s) for k, s in placed.items() if k[0] == 0], "_group binary, _part int, _own int")
    shared = spark.createDataFrame([(k[2], s) for k, s in placed.items() if k[0] == 1], "_bundle int, _shared int")
    out = keyed.join(F.broadcast(own), ["_group", "_part"], "left").join(F.broadcast(shared), "_bundle", "left").withColumn("shard", F.coalesce("_own", "_shared"))
    out = ranked(out.select("_row", "size", "tokens", "text_crc32", "shard", "_group", "_id"), ["shard"], ["_group", "_id"], scratch, "slots")
    return out.select("_row.*", "size", "tokens", "text_crc32", "shard", F.col("_rank").alias("slot"))
