"""Validation rules: declarations compiled to one table of (check_name, violations)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


@dataclass
class Rules:
    """Collects checks on tables; row predicates of one table share one scan."""

    rows: dict[str, tuple[DataFrame, list[tuple[str, Column]]]] = field(default_factory=dict)
    joins: list[DataFrame] = field(default_factory=list)

    def must(self, name: str, table: str, df: DataFrame, holds: Column) -> "Rules":
        """A predicate that every row must satisfy; unknown counts as violated."""
        self.rows.setdefault(table, (df, []))[1].append((name, holds))
        return self

    def mask(self, name: str, table: str, df: DataFrame, column: str, known: int) -> "Rules":
        """A set of bits that holds known ones only."""
        return self.must(name, table, df, F.col(column).bitwiseAND(F.lit(~known)) == 0)

    def max_or_none(self, name: str, table: str, df: DataFrame, column: str, most: int) -> "Rules":
        """At most ``most``, or null."""
        return self.must(name, table, df, F.col(column).isNull() | (F.col(column) <= most))

    def unique(self, name: str, df: DataFrame, keys: list[str]) -> "Rules":
        """Rows beyond the first of each key."""
        more = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        return self._add(name, more)

    def ref(self, name: str, df: DataFrame, column: str, to: DataFrame, key: str, nullable: bool = False) -> "Rules":
        """Values without a row in the table they refer to."""
        used = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
        lost = used.join(to.select(F.col(key).alias("_v")), "_v", "left_anti")
        lost = lost.where(F.col("_v").isNotNull()) if nullable else lost
        return self._add(name, lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations")))

    def csr(self, name: str, df: DataFrame, row: str, offset: str, size: str) -> "Rules":
        """Offsets must start at 0 and grow by each row's size. Rows are looked at beside the one before,
        inside blocks of rows: each block takes the last row of the block before along."""
        block = F.floor(F.col(row) / F.lit(65536))
        rows = df.select(row, offset, size, F.explode(F.array_distinct(F.array(block, F.floor((F.col(row) + 1) / F.lit(65536))))).alias("_b"), block.alias("_own"))
        w = W.Window.partitionBy("_b").orderBy(row)
        due = F.when(F.col(row) == 0, F.lit(0)).otherwise(F.lag(F.col(offset) + F.col(size)).over(w))
        bad = rows.withColumn("_due", due).where(F.col("_b") == F.col("_own"))
        return self._add(name, bad.agg(F.count_if(~F.col(offset).eqNullSafe(F.col("_due"))).alias("violations")))

    def count(self, name: str, df: DataFrame, rows: int) -> "Rules":
        """How many rows a table has too many or too few."""
        return self._add(name, df.agg(F.abs(F.count("*") - rows).alias("violations")))

    def equal(self, name: str, a: DataFrame, b: DataFrame) -> "Rules":
        """Rows that only one of two tables has."""
        both = a.exceptAll(b).unionAll(b.exceptAll(a))
        return self._add(name, both.agg(F.count("*").alias("violations")))

    def _add(self, name: str, df: DataFrame) -> "Rules":
        self.joins.append(df.select(F.lit(name).alias("check_name"), F.col("violations").cast("long")))
        return self

    def report(self) -> DataFrame:
        out = list(self.joins)
        for df, checks in self.rows.values():
            one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(checks)))
            pairs = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("violations")) for i, (n, _) in enumerate(checks)))
            out.append(one.select(F.explode(pairs).alias("x")).select("x.*"))
        return reduce(DataFrame.unionByName, out)
