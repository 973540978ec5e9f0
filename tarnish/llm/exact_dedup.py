"""Exact dedup by content sort, DataFrame functions only.

Sampled splitters range-partition the rows on the first bytes of the normalised
text, ties among these broken by a hash of all of it; an external sort places
equal texts side by side, and each row is compared in full with its neighbour.
Groups that would fill a good part of a partition are dealt over several ranges
first, and their few local groups merged by full text afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, filled, restored, shuffle_partitions

#: Equal texts are hot from so many bytes together, and from this part of a partition; so at most `partitions / HOT_PART` groups are.
HOT_BYTES, HOT_PART = 256 << 10, 0.25
#: A row counts for so many bytes besides its text.
ROW_BYTES = 64
#: Bytes of the text in the range key.
HEAD = 64


def normalised(text: str):
    return F.regexp_replace(filled(text), SPACE, " ")


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`, with the columns of `carry` (all by default).

    Adds keep_id (smallest id among equal texts), group_size (long), kept
    (boolean: the row that stays) and text_sha256 (lowercase hex of the
    normalised text). A column of `docs` with one of these names is replaced;
    inner names start with `_x_`. Null text counts as empty. Null ids sort
    last: keep_id is null only if all ids of the group are. Of rows equal in
    text and id exactly one is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    scratch = Scratch(spark, "exact-dedup")
    source = docs.select(F.struct(*[docs[c] for c in carried]).alias("_x_row"), docs[id_col].alias("_x_id"), docs[text].alias("_x_raw"))
    rows = source.withColumn("_x_hash", F.xxhash64(normalised("_x_raw")))
    counts = scratch.save(rows.groupBy("_x_hash").agg(F.sum(F.octet_length(filled("_x_raw")) + F.lit(ROW_BYTES)).alias("_x_bytes")), "counts")
    total = counts.agg(F.sum("_x_bytes")).first()[0] or 0
    part = max(HOT_BYTES, HOT_PART * total / shuffle_partitions(spark))
    groups = scratch.save(counts.where(F.col("_x_bytes") > part).select("_x_hash", F.ceil(F.col("_x_bytes") / part).alias("_x_salts")), "hot")
    hot = not groups.isEmpty()
    # Dealt by place in the input: ids may be null or repeated.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_x_salts")).cast("int") if hot else F.lit(None).cast("int")
    if hot:
        rows = rows.join(groups, "_x_hash", "left")
    # Without salts they are no key: a constant would cost the windows a shuffle of their own.
    keys = ["_x_head", "_x_hash", "_x_salt"][: 3 if hot else 2]
    rows = rows.withColumns({"_x_head": F.substring(normalised("_x_raw").cast("binary"), 1, HEAD), "_x_salt": salt}).repartitionByRange(shuffle_partitions(spark), *keys)
    # Normalised again after the shuffle, so that each text crosses it once.
    rows = rows.withColumn("_x_text", normalised("_x_raw")).drop("_x_raw")
    sorted_ = Window.partitionBy(*keys).orderBy("_x_text", F.asc_nulls_last("_x_id"))
    equals = Window.partitionBy(*keys).orderBy("_x_text").rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.withColumns({"kept": ~F.lag("_x_text").over(sorted_).eqNullSafe(F.col("_x_text")), "keep_id": F.min("_x_id").over(equals), "group_size": F.count(F.lit(1)).over(equals)})
    rows = rows.withColumn("text_sha256", F.sha2("_x_text", 256))
    if not hot:
        return rows.select("_x_row.*", *added)
    head_text = F.when(F.col("kept") & F.col("_x_salt").isNotNull(), F.col("_x_text")).alias("_x_text")
    local = scratch.save(rows.select("_x_row", *keys, *added, head_text), "local")
    # One row per hot text and salt: about as many as bytes of hot texts fill parts.
    same = Window.partitionBy("_x_hash", "_x_text")
    merged = local.where("kept and _x_salt is not null").select(
        "_x_hash", "_x_salt", "text_sha256", F.min("keep_id").over(same).alias("_x_keep"), F.sum("group_size").over(same).alias("_x_size"),
        (F.row_number().over(same.orderBy(F.asc_nulls_last("keep_id"), "_x_salt")) == 1).alias("_x_stays"),
    )
    warm = local.where("_x_salt is not null").join(merged, ["_x_hash", "_x_salt", "text_sha256"], "left")
    warm = warm.select("_x_row.*", F.col("_x_keep").alias("keep_id"), F.col("_x_size").alias("group_size"), (F.col("kept") & F.col("_x_stays")).alias("kept"), "text_sha256")
    return local.where("_x_salt is null").select("_x_row.*", *added).unionByName(warm)


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of `docs` that stay, with its own columns, whatever their names; see `exact_groups`."""
    rows = docs.select(docs[id_col].alias("_x_id"), docs[text].alias("_x_text"), F.struct(*[docs[c] for c in docs.columns]).alias("_x_whole"))
    return restored(exact_groups(rows, "_x_text", "_x_id", carry=["_x_whole"]).where("kept"), "_x_whole", docs)
