"""Order-dependent work without a single-task bottleneck.

Two situations need an order:

* **within a subject** (lag, lead, running flags over a loan's months). A subject
  is small in a real monthly history, so an ordinary keyed window is right. If one
  key does hold a large share of the rows, ``Timeline`` range-splits that key into
  slices and carries state between slices through a table of one row per slice.
* **across the whole book** (rank by score, prefix sums). ``numbered`` and
  ``prefix_sums`` range-partition on the order, number rows inside partitions and
  add per-partition offsets. No window ever spans all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.storage import durable

SLICE = "_slice"
WHOLE_SUBJECT = -1
#: Rows of one key beyond which its rows are range-split.
HOT_ROWS = 1_000_000
#: Groups of key values that are counted before the values themselves.
VALUE_GROUPS = 1 << 16


def heavy_values(scan: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Key values that hold more than ``hot_rows`` rows: a table, as there may be any number of them.

    A value that heavy makes its group of values heavy too. Groups are counted first, combined within tasks to a table of
    fixed size; only the values of heavy groups are counted by themselves, so ordinary keys are never shuffled.
    """
    present = scan.where(F.col(column).isNotNull()).select(column)
    group, rows = F.pmod(F.xxhash64(column), F.lit(VALUE_GROUPS)), F.count(F.lit(1)).alias("_rows")
    heavy = durable(present.groupBy(group.alias("_group")).agg(rows).where(F.col("_rows") > hot_rows).select("_group"))
    if heavy.isEmpty():
        return present.limit(0)
    # At most one row per group.
    suspects = present.join(F.broadcast(heavy), group == F.col("_group"), "left_semi")
    return durable(suspects.groupBy(column).agg(rows).where(F.col("_rows") > hot_rows).select(column))


@dataclass(frozen=True)
class Timeline:
    """Rows of many subjects, each with an order; keyed windows that survive hot keys."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @classmethod
    def of(
        cls,
        rows: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot: DataFrame | None = None,
        hot_column: str | None = None,
    ) -> Timeline:
        """``hot`` has one column, the values of ``hot_column`` (the last key) whose rows are range-split."""
        keys, order = tuple(keys), tuple(order)
        if hot is None or SLICE in rows.columns or hot.isEmpty():
            return cls(rows, keys, order)
        listed = hot.select(F.col(hot.columns[0]).alias("_hot"))
        is_hot = F.col(hot_column or keys[-1]) == F.col("_hot")
        # A fixed count keeps adaptive execution from merging the slices again.
        slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        split = durable(
            rows.join(listed, is_hot, "left_semi")
            .repartitionByRange(slices, *keys, *order)
            .withColumn(SLICE, F.spark_partition_id())
        )
        whole = rows.join(listed, is_hot, "left_anti").withColumn(SLICE, F.lit(WHOLE_SUBJECT))
        return cls(whole.unionByName(split), keys, order)

    @property
    def sliced(self) -> bool:
        return SLICE in self.rows.columns

    @property
    def _window(self):
        parts = (*self.keys, SLICE) if self.sliced else self.keys
        return Window.partitionBy(*parts).orderBy(*[F.col(c).asc_nulls_first() for c in self.order])

    @property
    def _so_far(self):
        return self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_rows(self, rows: DataFrame) -> Timeline:
        return replace(self, rows=rows)

    def with_columns(self, columns: dict[str, Column]) -> Timeline:
        return self.with_rows(self.rows.withColumns(columns))

    def _carried(self, per_slice: dict[str, Column], across: dict[str, Column]) -> DataFrame:
        """Join each slice of a hot subject to state from its other slices.

        One row per slice of a hot subject: bounded by partitions plus hot keys.
        """
        slices = self.rows.where(F.col(SLICE) != WHOLE_SUBJECT).groupBy(*self.keys, SLICE)
        state = slices.agg(*[c.alias(n) for n, c in per_slice.items()])
        state = state.select(*self.keys, SLICE, *[c.alias(n) for n, c in across.items()])
        return self.rows.join(F.broadcast(state), [*self.keys, SLICE], "left")

    @property
    def _earlier(self):
        return Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)

    @property
    def _neighbour(self):
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def _order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def lag(self, **names: str) -> Timeline:
        """``name=column`` adds the column's value in the subject's previous row."""
        local = {n: F.lag(c).over(self._window) for n, c in names.items()}
        if not self.sliced:
            return self.with_columns(local)
        values = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
        rows = self._carried(
            {"_edge": F.max_by(values, self._order_key())},
            {"_edge": F.lag("_edge").over(self._neighbour)},
        )
        first = F.row_number().over(self._window) == 1
        filled = {n: F.when(first, F.col(f"_edge.{n}")).otherwise(c) for n, c in local.items()}
        return self.with_rows(rows.withColumns(filled).drop("_edge"))

    def lead(self, **names: str) -> Timeline:
        """``name=column`` adds the column's value in the subject's next row."""
        local = {n: F.lead(c).over(self._window) for n, c in names.items()}
        if not self.sliced:
            return self.with_columns(local)
        values = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
        rows = self._carried(
            {"_edge": F.min_by(values, self._order_key())},
            {"_edge": F.lead("_edge").over(self._neighbour)},
        )
        last = F.lead(F.lit(1)).over(self._window).isNull()
        filled = {n: F.when(last, F.col(f"_edge.{n}")).otherwise(c) for n, c in local.items()}
        return self.with_rows(rows.withColumns(filled).drop("_edge"))

    def first(self, **names: str) -> Timeline:
        """``name=column`` adds the column's value in the subject's first row."""
        local = {n: F.first_value(c).over(self._so_far) for n, c in names.items()}
        if not self.sliced:
            return self.with_columns(local)
        values = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
        opening = self._neighbour.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self._carried(
            {"_edge": F.min_by(values, self._order_key())},
            {"_edge": F.first_value("_edge").over(opening)},
        )
        hot = F.col(SLICE) != WHOLE_SUBJECT
        filled = {n: F.when(hot, F.col(f"_edge.{n}")).otherwise(c) for n, c in local.items()}
        return self.with_rows(rows.withColumns(filled).drop("_edge"))

    def running_sum(self, **terms: Column) -> Timeline:
        """Inclusive running totals; integral terms give exact counters."""
        local = {n: F.sum(c).over(self._so_far) for n, c in terms.items()}
        if not self.sliced:
            return self.with_columns(local)
        rows = self._carried(
            {f"_{n}": F.sum(c) for n, c in terms.items()},
            {f"_before_{n}": F.sum(f"_{n}").over(self._earlier) for n in terms},
        )
        total = {n: c + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n, c in local.items()}
        return self.with_rows(rows.withColumns(total).drop(*[f"_before_{n}" for n in terms]))

    def running_any(self, **flags: Column) -> Timeline:
        """Sticky flags: true from the first row where the condition holds."""
        local = {n: F.bool_or(c).over(self._so_far) for n, c in flags.items()}
        if not self.sliced:
            return self.with_columns(local)
        rows = self._carried(
            {f"_{n}": F.bool_or(c) for n, c in flags.items()},
            {f"_before_{n}": F.bool_or(f"_{n}").over(self._earlier) for n in flags},
        )
        either = {n: c | F.coalesce(F.col(f"_before_{n}"), F.lit(False)) for n, c in local.items()}
        return self.with_rows(rows.withColumns(either).drop(*[f"_before_{n}" for n in flags]))

    def number(self, name: str) -> Timeline:
        """1-based position in the subject's order."""
        return self.running_sum(**{name: F.lit(1).cast("long")})

    def whole(self, **measures: Column) -> Timeline:
        """Aggregates over the whole subject, repeated on its rows.

        Computed in the same keyed partitions as the other windows, so no further
        shuffle and no self-join. Hot subjects are pre-aggregated instead.
        """
        everything = Window.partitionBy(*self.keys)
        windowed = {n: c.over(everything) for n, c in measures.items()}
        if not self.sliced:
            return self.with_columns(windowed)
        hot = F.col(SLICE) != WHOLE_SUBJECT
        cold = self.rows.where(~hot).withColumns(windowed)
        totals = self.rows.where(hot).groupBy(*self.keys).agg(
            *[c.alias(n) for n, c in measures.items()]
        )
        spread = self.rows.where(hot).join(F.broadcast(totals), list(self.keys), "left")
        return self.with_rows(cold.unionByName(spread))


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "position") -> tuple[DataFrame, int]:
    """Global 1-based positions in the given order, and the row count.

    One range shuffle. Rows are materialised, then each partition's offset (one
    row per partition) is added to the local position.
    """
    ordered = durable(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_tag", F.monotonically_increasing_id())
    )
    part = F.shiftright("_tag", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_tag").bitwiseAND((1 << 33) - 1)
    positioned = (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_part", "_offset", "_tag")
    )
    return positioned, ordered.count()


def prefix_sums(
    rows: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    **terms: Column,
) -> DataFrame:
    """Inclusive running sums per group in a global order, for groups of any size.

    Groups are range-split over partitions; a table of one row per (partition,
    group) pair carries the totals of earlier partitions.
    """
    groups = list(groups)
    values = {f"_term_{n}": c for n, c in terms.items()}
    ordered = durable(
        rows.withColumns(values)
        .repartitionByRange(*groups, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    totals = ordered.groupBy(*groups, "_part").agg(*[F.sum(v).alias(f"_sum{v}") for v in values])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *groups, "_part",
        *[F.coalesce(F.sum(f"_sum{v}").over(before), F.lit(0)).alias(f"_before{v}") for v in values],
    )
    here = (
        Window.partitionBy("_part", *groups).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = ordered.withColumns({f"_run{v}": F.sum(v).over(here) for v in values})
    # One row per partition and group that meet: at most partitions plus groups. Null groups join too.
    carried = carried.select(*[F.col(c).alias(f"_at_{c}") for c in (*groups, "_part")], *[f"_before{v}" for v in values])
    same = F.lit(True)
    for c in (*groups, "_part"):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    joined = running.join(carried, same)
    sums = {n: F.col(f"_run_term_{n}") + F.col(f"_before_term_{n}") for n in terms}
    return joined.withColumns(sums).select(*rows.columns, *terms)
