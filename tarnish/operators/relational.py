"""Filters, pages, series and per-group lookups of the console queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def within_days(column: str | Column, as_of: str, days: int | Column) -> Column:
    """Strictly later than `days` days before `as_of`."""
    days = F.lit(days) if isinstance(days, int) else days
    return F.col(column) > moment(as_of) - F.make_dt_interval(days=days) if isinstance(column, str) else column > moment(as_of) - F.make_dt_interval(days=days)


def clamped_days(asked: float | None, default: int = 30, most: int = 365) -> int:
    """Days of a window as asked for: no number or not positive gives the default."""
    if asked is None or asked != asked or asked <= 0:
        return default
    return min(int(asked), most)


def page_bounds(limit: int | None = None, offset: int | None = None, default: int = 50, most: int = 200) -> tuple[int, int]:
    return max(1, min(limit or default, most)), max(0, offset or 0)


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that were given; true if none was."""
    given = [c for c in conditions if c is not None]
    return reduce(and_, given) if given else F.lit(True)


def failed() -> Column:
    return F.col("status") >= 400


def succeeded() -> Column:
    return F.col("status").isNull() | (F.col("status") < 400)


def search(term: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns; the term's own % and _ stay wildcards."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{term}%") for c in columns])


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def sorted_by(key: str | None, allowed: Mapping[str, str], default: str, descending: bool = True) -> Column:
    """Sort key of an allow-list, nulls last; an unknown key is the default."""
    column = F.col(allowed.get(key or "", allowed[default]))
    return column.desc_nulls_last() if descending else column.asc_nulls_last()


def daily_series(as_of: str, days: int, spark) -> DataFrame:
    """One row per day, the last one that of `as_of`."""
    last = F.to_date(moment(as_of))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def gap_filled(calendar: DataFrame, *counted: DataFrame) -> DataFrame:
    """Left joins of per-day aggregates onto a calendar, zero where a day is missing."""
    out = calendar
    for df in counted:
        out = out.join(df, "day", "left")
    return out.fillna(0)


def counts_where(**conditions: Column) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def latest_per(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: the columns of its last row by `order`. Aggregates before the shuffle."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return df.groupBy(key).agg(last).select(key, "_last.*")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by `order`, all columns kept. Aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key by `order`: a map to which later entries are written over."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def presence(left: DataFrame, right: DataFrame, key: str, left_flag: str, right_flag: str) -> DataFrame:
    """Union of the keys of two sides with a flag for each: full outer join."""
    a, b = left.select(key).distinct().withColumn(left_flag, F.lit(True)), right.select(key).distinct().withColumn(right_flag, F.lit(True))
    return a.join(b, key, "full").fillna(False, [left_flag, right_flag])


def upsert_counter(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """What repeated insert-or-increment leaves: count, first and last time per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("report_count"), F.min(at).alias("first_reported_at"), F.max(at).alias("last_reported_at"))


def merge_counter(state: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of counters after another batch of them."""
    both = state.unionByName(new)
    return both.groupBy(*keys).agg(F.sum("report_count").alias("report_count"), F.min("first_reported_at").alias("first_reported_at"), F.max("last_reported_at").alias("last_reported_at"))


def upsert_keep_old(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert in which a null of the new row keeps the old value."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), list(keys), "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest])


def upsert_overwrite(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `old` whose key is not in `new`, and all of `new`."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old`, and the rows of `new` whose key it lacks."""
    return old.unionByName(new.join(old, list(keys), "left_anti"))


def retained(df: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """What retention leaves: rows not older than `days` days."""
    return df.where(F.col(at) >= moment(as_of) - F.make_dt_interval(days=F.lit(days)))


def cascade(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children that stay once the rows not in `parents` are deleted with all that hangs on them."""
    return children.join(parents.select(F.col(pk).alias(fk)).distinct(), fk, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children with their reference set to null where the parent is gone."""
    there = parents.select(F.col(pk).alias("_pk")).distinct()
    return children.join(there, children[fk] == F.col("_pk"), "left").withColumn(fk, F.col("_pk")).drop("_pk")


def first_appearance(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Per key the first position it has in an ordered history, and how far from the head that is.

    `predates` says that it was there at the very first position: it came from before the history.
    """
    bounds = df.agg(F.min(seq).alias("_lo"), F.max(seq).alias("_hi"))
    first = df.groupBy(*keys).agg(F.min(seq).alias("first_seq"))
    # One row: a fixed bound.
    return first.crossJoin(F.broadcast(bounds)).select(*keys, "first_seq", (F.col("_hi") - F.col("first_seq")).alias("from_head"), (F.col("first_seq") == F.col("_lo")).alias("predates"))


def revision_pairs(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Each revision of a key beside the one before it, where the value changed."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def first_installation(asked: DataFrame, installed: DataFrame) -> DataFrame:
    """(org, full_name) with the first installation (org, installation, full_name) of the organisation that lists the repository, whatever its case; null if none does."""
    name = F.lower("full_name")
    first = installed.groupBy("org", name.alias("_name")).agg(F.min("installation").alias("installation"))
    return asked.withColumn("_name", name).join(first, ["org", "_name"], "left").drop("_name")
