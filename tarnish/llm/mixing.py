"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target/size times. Documents of a source
are put in order, their expected copies prefix-summed, one random offset added,
and a document is emitted once per integer boundary its stretch crosses. The
order decides how near the words taken come to the target: sizes rise over one
half of a source, drawn by a hash of the id, and fall over the other, so what
the offset adds on the way up it takes away on the way down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, n_words, ranked


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """Adds `target` to rows (source, source_size), one per source.

    Sources in code point order, null last, take the weights in turn. All sizes
    together are shared by weight; a target stops at `cap` times its source's
    size, and the excess is shared by weight among the rest until none is above.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    keyed = sizes.withColumn("_one", F.lit(0))
    order = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    placed = ranked(keyed, ["_one"], order, scratch, "sources").withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    )
    placed = scratch.save(placed.drop("_one", "_rank").withColumn("_most", F.lit(cap) * F.col("source_size")), "weights")
    share, capped = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(share) > F.col("_most")
        row = placed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("_most")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("_w"))).alias("w"), F.count_if(over).alias("n"),
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, share = row["n"], ((row["all"] or 0) - row["fixed"]) / row["w"]
    return placed.withColumn("target", F.least(F.col("_w") * F.lit(share), F.col("_most"))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 7, text: str = "text", source: str = "source", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per row of `docs` with the columns of `carry` (all by default).

    Adds size (words), source_size, target, copies (times the mix takes the
    row, 0 upward) and taken (copies * size), replacing columns of these names.
    Null text has size 0; a null source is a source of its own; a source of no
    words takes none. Rows equal in source, size and id share their copies in
    any order. An empty table gives no rows. The same rows and seed give the
    same mix on every run.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    added = ["size", "source_size", "target", "copies", "taken"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    rows = docs.select(
        F.struct(*[docs[c] for c in carried]).alias("_row"), n_words(docs[text]).alias("_size"), docs[source].isNull().alias("_none"), F.coalesce(docs[source], F.lit("")).alias("_source"), docs[id_col].alias("_id"),
    )
    by = ["_none", "_source"]
    rising = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(2)) == 0
    placed = ranked(rows, by, [~rising, F.when(rising, F.col("_size")).otherwise(-F.col("_size")), F.xxhash64("_id"), F.col("_id")], scratch, "order")
    sizes = placed.groupBy(*by).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = source_targets(sizes.select(F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size"), weights, cap)
    targets = targets.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate")
    targets = scratch.save(targets.select(*by, "source_size", "target", rate), "targets")

    # Multiples of 2^-20 keep whole rates exact.
    offset = F.pmod(F.xxhash64("_none", "_source", F.lit(seed)), F.lit(2**20)) / F.lit(float(2**20))
    upto = lambda n: F.floor(offset + F.col("_rate") * n)
    out = placed.join(targets, by).withColumn("copies", (upto(F.col("_rank") + 1) - upto(F.col("_rank"))).cast("int"))
    return out.select("_row.*", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 7, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of `docs` as often as `mix` takes it, with its own columns.

    Only ids, sources and sizes are put in order; texts, which would make the
    range of the longest documents far larger than the others, then come by a
    join. `docs` is read twice and must give the same rows. Rows equal in id,
    source and size are taken by turns. Inner names start with `_m_`.
    """
    scratch = Scratch(docs.sparkSession, "take")
    keys = ["_m_id", "_m_source", "_m_size"]
    light = docs.select(docs[id_col].alias("_m_id"), docs[source].alias("_m_source"), docs[text].alias("_m_text"))
    mixed = mix(light, weights, cap, seed, "_m_text", "_m_source", "_m_id", carry=keys[:2]).withColumnRenamed("size", "_m_size")
    per = scratch.save(mixed.groupBy(*keys).agg(F.sum("copies").alias("_m_copies"), F.count(F.lit(1)).alias("_m_rows")), "copies")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_m_row"), docs[id_col].alias("_d_id"), docs[source].alias("_d_source"), n_words(docs[text]).alias("_d_size"))
    same = F.col("_d_id").eqNullSafe(F.col("_m_id")) & F.col("_d_source").eqNullSafe(F.col("_m_source")) & (F.col("_d_size") == F.col("_m_size"))
    # A row per document has no bound, so it is never broadcast.
    joined = rows.join(per.where("_m_copies > 0").hint("merge"), same)
    out = joined.where("_m_rows = 1").select("_m_row", F.col("_m_copies").alias("_m_n"))
    if per.where("_m_rows > 1").limit(1).count():
        shared = joined.where("_m_rows > 1").select("_m_row", "_m_copies", "_m_rows", F.to_json(F.struct(*keys)).alias("_m_key"))
        shared = ranked(shared, ["_m_key"], [F.xxhash64("_m_row")], scratch, "turns")
        by_turn = lambda k: F.floor(F.col("_m_copies") * k / F.col("_m_rows"))
        out = out.unionByName(shared.select("_m_row", (by_turn(F.col("_rank") + 1) - by_turn(F.col("_rank"))).alias("_m_n")).where("_m_n > 0"))
    return out.select("_m_row", F.explode(F.sequence(F.lit(1).cast("long"), "_m_n")).alias("_m_copy")).select("_m_row.*")
