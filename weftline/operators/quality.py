"""Named rules, duplicates, reasons and the account of what became of every row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.enrich import BROADCAST_BYTES, lookup
from weftline.operators.standardize import labels
from weftline.sources.readers import SMALL_BYTES, estimated_bytes

def in_scope(df: DataFrame, condition: Column | str | None) -> DataFrame:
    """Without the rows for which the condition is false; where it is null, the row stays, for the rules to judge."""
    return df if condition is None else df.filter(F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(True)))


def with_errors(df: DataFrame, rules: Mapping[str, str | Column], key: Sequence[str] = ()) -> DataFrame:
    """Adds ``_validation_errors``: cast errors, then the names of rules that are false or null, then ``missing_key:<k>``."""
    conditions = {n: F.expr(r) if isinstance(r, str) else r for n, r in rules.items()}
    found = {n: ~F.coalesce(c, F.lit(False)) for n, c in conditions.items()} | {f"missing_key:{k}": F.col(f"`{k}`").isNull() for k in key}
    errors = labels(found)
    return df.withColumn("_validation_errors", F.concat("_cast_errors", errors) if "_cast_errors" in df.columns else errors)


def json_order(df: DataFrame) -> Column:
    """Order by the text of the whole row, columns by name: total but for identical rows, and dear, as each row carries it."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))


def _order(df: DataFrame, tie_break: Sequence[str] | None) -> Column:
    """Never null, and ordered as the columns are, nulls first. One whole number is itself, which sums up without sorting."""
    if not tie_break:
        return json_order(df)
    if len(tie_break) == 1 and dict(df.dtypes)[tie_break[0]] in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(f"`{tie_break[0]}`").cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    return F.struct(*(F.col(f"`{c}`") for c in tie_break))


def _ranked_whole(checked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Ranks by one window over whole rows; those that aren't valid are alone."""
    alone = F.when(F.col("_valid"), -1).otherwise(F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy(*(F.col(f"`{k}`") for k in key), alone).orderBy("_order"))
    return checked.withColumn("_duplicate_rank", F.when(F.col("_valid") & (rank > 1), 2).otherwise(1))


def _ranked(checked: DataFrame, key: Sequence[str], most: int) -> DataFrame:
    """Ranks by the first order of each key that occurs twice."""
    names = [f"_k{i}" for i in range(len(key))]
    orders = checked.filter("_valid").groupBy(*(F.col(f"`{k}`").alias(n) for k, n in zip(key, names)), "_order").agg(F.count(F.lit(1)).alias("_n"))
    firsts = orders.groupBy(*names).agg(F.min("_order").alias("_first"), F.min_by("_n", "_order").alias("_ties"), F.sum("_n").alias("_n")).filter("_n > 1").drop("_n")
    firsts = lookup(firsts, most)
    joined = checked.join(firsts, [F.col(f"`{k}`") == F.col(n) for k, n in zip(key, names)], "left").drop(*names)
    leads = F.col("_first").isNull() | (F.col("_order") == F.col("_first"))
    tied = F.col("_valid") & F.coalesce((F.col("_order") == F.col("_first")) & (F.col("_ties") > 1), F.lit(False))
    rank = F.when(~F.col("_valid") | leads, 1).otherwise(2)
    if firsts.filter("_ties > 1").isEmpty():
        return joined.withColumn("_duplicate_rank", rank)
    keys = [F.col(f"`{k}`") for k in key]
    one = Window.partitionBy(*keys, "_part").orderBy("_order")
    some = joined.filter(tied).withColumn("_leads", F.row_number().over(one) == 1)
    of_all = F.row_number().over(Window.partitionBy(*keys, F.when(F.col("_leads"), -1).otherwise(F.col("_part"))).orderBy("_order"))
    some = some.withColumn("_duplicate_rank", F.when(F.col("_leads") & (of_all == 1), 1).otherwise(2)).drop("_leads")
    return joined.filter(~tied).withColumn("_duplicate_rank", rank).unionByName(some)


def classified(df: DataFrame, rules: Mapping[str, str | Column], key: Sequence[str], tie_break: Sequence[str] | None = None, most: int = BROADCAST_BYTES, small: int = SMALL_BYTES) -> DataFrame:
    """Adds errors, the rank among rows of the same key, and ``_rejection_reason``, null for accepted rows.

    Valid and invalid rows are ranked apart, so an invalid one never displaces a valid one; of valid rows of a key the
    first by ``tie_break`` (else by JSON text) survives, whatever the order of the input. A reason is the errors joined by
    semicolons, else ``duplicate_key``. Rows of a null key are rejected. ``_duplicate_rank`` is 1 for the survivor and 2 for
    the others.

    Only keys and orders travel: they are counted by partial aggregation, at once, and the keys that occur twice come back
    with their first order as a lookup of measured size (see enrich.lookup), so a key may hold any share of the rows. Only
    rows that tie for the first place are sent anywhere, in as many parts as the input has. That judges all rows twice; the rows
    of a table estimated below ``small`` bytes, of which no task can get too many, are judged once and ranked by a window
    instead, with the same result. A name of the rows that begins with an underscore may be replaced.
    """
    if not key:
        raise ValueError("a key is needed")
    checked = with_errors(df, rules, key)
    checked = checked.withColumns({"_order": _order(checked, tie_break), "_valid": F.size("_validation_errors") == 0, "_part": F.spark_partition_id()})
    ranked = _ranked_whole(checked, key) if estimated_bytes(checked) < small else _ranked(checked, key, most)
    reason = F.when(~F.col("_valid"), F.array_join("_validation_errors", ";")).when(F.col("_duplicate_rank") > 1, "duplicate_key")
    return ranked.withColumn("_rejection_reason", reason).drop("_valid", "_part", "_order", "_first", "_ties")


def first_by_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key alone; Spark stops at one row a key before the shuffle already."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= 1).drop("_rank")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_rejection_reason").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_rejection_reason").isNotNull())


def reason_counts(df: DataFrame) -> DataFrame:
    """Rows per single reason; a row of two errors counts for both."""
    return rejected(df).select(F.explode(F.split("_rejection_reason", ";")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


@dataclass(frozen=True)
class Account:
    initial: int
    scoped: int
    valid: int
    rejected: int
    duplicates: int

    @property
    def invalid(self) -> int:
        return self.rejected - self.duplicates

    @property
    def out_of_scope(self) -> int:
        return self.initial - self.scoped

    def checked(self) -> Account:
        if self.initial != self.valid + self.rejected + self.out_of_scope or self.out_of_scope < 0:
            raise ValueError(f"rows went missing or came up: {self}")
        return self


def totals(df: DataFrame) -> DataFrame:
    """scoped, valid, rejected and duplicates of classified rows, in one pass."""
    reason = F.col("_rejection_reason")
    n = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    return df.agg(F.count(F.lit(1)).alias("scoped"), n(reason.isNull(), "valid"), n(reason.isNotNull(), "rejected"), n(F.coalesce(reason == "duplicate_key", F.lit(False)), "duplicates"))


def account(df: DataFrame, initial: int) -> Account:
    row = totals(df).first()
    return Account(initial, row["scoped"], row["valid"], row["rejected"], row["duplicates"]).checked()


def missing_references(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference is no parent's key."""
    known = parents.select(F.col(key).alias("_parent")).filter("_parent is not null").distinct()
    return df.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_parent"), "left_anti")
