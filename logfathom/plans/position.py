"""First-N, last-N and as-of-position selection by arrival order.

A plain ``row_number() over (partition by source order by seq)`` sends a whole
source through one task. Here rows are first counted per (source, stretch of
arrival positions); the counts decide which stretches can hold wanted rows, and
only those are ranked. Each ranking task sees at most N rows plus one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import join_small, materialize

STRETCH_BITS = 16
# Positions made from times (`order_by_time`): so many per microsecond, all of them beyond TIMES,
# and cut into stretches of about 17 seconds.
TURNS = 1024
TIMES = 1 << 59
TIME_STRETCH_BITS = 34
# Stretches that one task sums up.
STRETCHES = 4096


def stretch(position: str = "seq") -> Column:
    place = F.col(position)
    return F.when(place >= TIMES, F.shiftright(place, TIME_STRETCH_BITS)).otherwise(
        F.shiftright(place, STRETCH_BITS))


def running_total(counts: DataFrame, newest: bool = False, keys: tuple[str, ...] = ("source",),
                  of: tuple[str, ...] = ("n",)) -> DataFrame:
    """Add `before`: rows of the source (or other keys) in the stretches before (or, newest first,
    behind) each. Of counts with other names than `n` it is called `before_<name>`.

    In two levels: a task sums up the stretches of one group, and one row per group is left to
    carry over, so a source of millions of stretches is no single task's work.
    """
    def ordered(c):
        return F.col(c).desc() if newest else F.col(c)

    grouped = counts.withColumn("_group", F.floor(F.col("stretch") / STRETCHES).cast("bigint"))
    past = Window.unboundedPreceding, -1
    outer = Window.partitionBy(*keys).orderBy(ordered("_group")).rowsBetween(*past)
    inner = Window.partitionBy(*keys, "_group").orderBy(ordered("stretch")).rowsBetween(*past)
    sums = grouped.groupBy(*keys, "_group").agg(*[F.sum(c).alias(f"_sum_{c}") for c in of])
    sums = sums.select(*keys, "_group", *[
        F.coalesce(F.sum(f"_sum_{c}").over(outer), F.lit(0)).alias(f"_carry_{c}") for c in of])
    return (grouped.withColumns({f"_inner_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in of})
            .join(sums, [*keys, "_group"])
            .withColumns({"before" if c == "n" else f"before_{c}": F.col(f"_inner_{c}") + F.col(f"_carry_{c}")
                          for c in of})
            .drop("_group", *[f"_{part}_{c}" for part in ("inner", "carry") for c in of]))


def carried_values(ends: DataFrame) -> DataFrame:
    """(source, stretch, before, after) of a table (source, stretch, first, last) of the first and last
    known value of each stretch: the last one before it, and the first one in it or behind it.

    In the two levels of `running_total`.
    """
    grouped = ends.withColumn("_group", F.floor(F.col("stretch") / STRETCHES).cast("bigint"))

    def known(c):
        return F.when(F.col(c).isNotNull(), F.col("stretch"))

    past, coming = (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)
    over = Window.partitionBy("source").orderBy("_group")
    sums = grouped.groupBy("source", "_group").agg(
        F.max_by("last", known("last")).alias("last"), F.min_by("first", known("first")).alias("first"))
    sums = sums.select(
        "source", "_group", F.last("last", ignorenulls=True).over(over.rowsBetween(*past)).alias("_before"),
        F.first("first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inner = Window.partitionBy("source", "_group").orderBy("stretch")
    return (grouped.withColumn("_last", F.last("last", ignorenulls=True).over(inner.rowsBetween(*past)))
            .withColumn("_first", F.first("first", ignorenulls=True).over(inner.rowsBetween(*coming)))
            .join(sums, ["source", "_group"])
            .select("source", "stretch", F.coalesce("_last", "_before").alias("before"),
                    F.coalesce("_first", "_after").alias("after")))


def turns(events: DataFrame) -> DataFrame:
    """Add `turn`: the place of a row among those of its source and time, from 0, by position and
    message. Times that go over several stretches of positions, as that of a whole untimed file, are
    counted per stretch first, so that no task ranks more than a stretch.
    """
    rows = events.withColumn("stretch", stretch())
    long = (rows.groupBy("source", "ts").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b"))
            .filter("a < b").select("source", "ts"))
    counts = (join_small(rows.select("source", "ts", "stretch"), long, ["source", "ts"], "left_semi")
              .groupBy("source", "ts", "stretch").agg(F.count(F.lit(1)).alias("n")))
    before = running_total(counts, keys=("source", "ts")).select("source", "ts", "stretch", "before")
    near = F.row_number().over(Window.partitionBy("source", "ts", "stretch").orderBy("seq", "message"))
    return (join_small(rows, before, ["source", "ts", "stretch"], "left")
            .withColumn("turn", F.coalesce("before", F.lit(0)) + near - 1)
            .select(*events.columns, "turn"))


def stretch_counts(df: DataFrame, position: str = "seq") -> DataFrame:
    """(source, stretch, n, before): rows per stretch and rows of the source in earlier stretches."""
    counts = (df.select("source", stretch(position).alias("stretch"))
                .groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n")))
    return running_total(counts)


def edge_rows(df: DataFrame, n: int, newest: bool = True, position: str = "seq",
              slack: int = 0) -> DataFrame:
    """The n newest (or oldest) rows of every source.

    With ``slack`` a source is trimmed only when it holds more than n + slack rows.
    """
    counts = (df.select("source", stretch(position).alias("stretch"))
                .groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n")))
    bound = F.min("stretch") if newest else F.max("stretch")
    per_source = (running_total(counts, newest).withColumnRenamed("before", "nearer")
                  .groupBy("source")
                  .agg(F.sum("n").alias("_total"),
                       (F.min(F.when(F.col("nearer") < n, F.col("stretch"))) if newest
                        else F.max(F.when(F.col("nearer") < n, F.col("stretch")))).alias("_cut"),
                       bound.alias("_end"))
                  .select("source", "_total",
                          F.when(F.col("_total") <= n + slack, F.col("_end"))
                           .otherwise(F.col("_cut")).alias("_cut")))
    joined = join_small(df, per_source, ["source"])
    inside = stretch(position) >= F.col("_cut") if newest else stretch(position) <= F.col("_cut")
    near = joined.filter(inside)
    order = F.col(position).desc() if newest else F.col(position)
    if slack:
        # Untrimmed sources hold at most n + slack rows, so one ranking serves both cases.
        keep = F.when(F.col("_total") <= n + slack, F.lit(n + slack)).otherwise(F.lit(n))
    else:
        keep = F.lit(n)
    ranked = near.withColumn("_rank", F.row_number().over(
        Window.partitionBy("source").orderBy(order)))
    return ranked.filter(F.col("_rank") <= keep).drop("_rank", "_cut", "_total")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                rank: str = "rank", spread: int = 64) -> DataFrame:
    """The n first rows of every key, ranked from 1.

    Rows are ranked within (key, group of input partitions) first. Spark limits
    every input partition before the shuffle, and a hot key meets `spread` tasks
    before its last few rows meet one.
    """
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_salt", F.spark_partition_id() % spread)
              .withColumn("_near", F.row_number().over(part))
              .filter(F.col("_near") <= n)
              .withColumn(rank, F.row_number().over(whole))
              .filter(F.col(rank) <= n)
              .drop("_salt", "_near"))


def mark_ranks(marks: DataFrame, df: DataFrame, counts: DataFrame) -> DataFrame:
    """(source, mark, total): rows of the source that arrived no later than each mark.

    Only stretches with a mark are looked into, and each of their rows once.
    """
    at = (marks.select("source", "mark", "mark_seq").withColumn("stretch", stretch("mark_seq"))
               .join(counts.select("source", "stretch", "before"), ["source", "stretch"]))
    rows = join_small(df.select("source", "seq", stretch().alias("stretch")),
                      at.select("source", "stretch").distinct(), ["source", "stretch"], "left_semi")
    line = (rows.withColumn("mark", F.lit(None).cast("bigint"))
                .withColumn("before", F.lit(0).cast("bigint"))
                .unionByName(at.select("source", F.col("mark_seq").alias("seq"), "stretch",
                                       "mark", "before")))
    upto = (Window.partitionBy("source", "stretch").orderBy("seq", F.col("mark").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    return (line.withColumn("total", F.col("before") + F.count_if(F.col("mark").isNull()).over(upto))
                .filter(F.col("mark").isNotNull()).select("source", "mark", "total"))


def kind_counts(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Several `stretch_counts` in one pass: per stretch and kind of rows, which a condition tells, the
    rows `<kind>` and those in earlier stretches `before_<kind>`; also the time `first_ts` of the first row.
    """
    counts = (df.select("source", "seq", "ts", stretch().alias("stretch"), *[c.alias(k) for k, c in kinds.items()])
              .groupBy("source", "stretch")
              .agg(F.min_by("ts", "seq").alias("first_ts"), *[F.count_if(k).alias(k) for k in kinds]))
    return running_total(counts, of=tuple(kinds))


def kind_ranks(marks: DataFrame, df: DataFrame, counts: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(source, mark, <kind>...): rows of each kind that arrived no later than each mark, in one pass."""
    before = [f"before_{kind}" for kind in kinds]
    at = (marks.select("source", "mark", "mark_seq").withColumn("stretch", stretch("mark_seq"))
               .join(counts.select("source", "stretch", *before), ["source", "stretch"]))
    rows = join_small(df.select("source", "seq", stretch().alias("stretch"), *[c.alias(k) for k, c in kinds.items()]),
                      at.select("source", "stretch").distinct(), ["source", "stretch"], "left_semi")
    line = (rows.withColumns({"mark": F.lit(None).cast("bigint")} | {b: F.lit(0).cast("bigint") for b in before})
                .unionByName(at.select("source", F.col("mark_seq").alias("seq"), "stretch", "mark", *before,
                                       *[F.lit(False).alias(kind) for kind in kinds])))
    upto = (Window.partitionBy("source", "stretch").orderBy("seq", F.col("mark").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    return (line.select("source", "mark", *[(F.col(f"before_{kind}") + F.count_if(kind).over(upto)).alias(kind)
                                            for kind in kinds])
                .filter(F.col("mark").isNotNull()))


def count_until(marks: DataFrame, df: DataFrame) -> DataFrame:
    """(source, mark, total): rows of the source that arrived no later than each mark.

    `marks` has columns (source, mark, mark_seq).
    """
    return mark_ranks(marks, df, stretch_counts(df))


def rows_before(marks: DataFrame, df: DataFrame, n: int, counts: DataFrame | None = None,
                ranks: DataFrame | None = None) -> DataFrame:
    """For every mark, the last n rows of its source that arrived no later than the mark.

    `marks` has columns (source, mark, mark_seq); the result has the columns of `df`
    plus `mark` and `rank` (1 = newest). Marks and rows are laid on a grid of arrival
    ranks with cells of n: a row can only belong to marks in its own cell and the next,
    so they meet in an equi-join, and every joined pair but the border ones is a result.
    `counts` and `ranks` are what `stretch_counts` and `mark_ranks` tell of `df`, where known.
    """
    counts = materialize(stretch_counts(df)) if counts is None else counts
    ranks = materialize(mark_ranks(marks, df, counts)) if ranks is None else ranks
    wide = max(n, 1 << STRETCH_BITS)

    def cells(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / wide).cast("bigint"),
                                    F.floor(last / wide).cast("bigint")))

    # Stretches that hold one of the ranks total - n + 1 .. total of some mark.
    first = F.greatest(F.col("total") - n + 1, F.lit(1))
    needs = ranks.select("source", first.alias("first"), F.col("total").alias("last")) \
                 .withColumn("cell", cells(F.col("first"), F.col("last")))
    spans = counts.withColumn("end", F.col("before") + F.col("n")) \
                  .withColumn("cell", cells(F.col("before") + 1, F.col("end")))
    wanted = (needs.join(spans, ["source", "cell"])
                   .filter((F.col("end") >= F.col("first")) & (F.col("before") < F.col("last")))
                   .select("source", "stretch", "before").distinct())
    rows = join_small(df.withColumn("stretch", stretch()), wanted, ["source", "stretch"])
    in_order = Window.partitionBy("source", "stretch").orderBy("seq")
    placed = rows.withColumn("at", F.col("before") + F.row_number().over(in_order))
    own = F.floor(F.col("at") / n).cast("bigint")
    placed = placed.withColumn("cell", F.explode(F.array(own, own + 1)))
    marked = ranks.withColumn("cell", F.floor(F.col("total") / n).cast("bigint"))
    return (join_small(placed, marked, ["source", "cell"])
            .withColumn("rank", F.col("total") - F.col("at") + 1)
            .filter(F.col("rank").between(1, n))
            .drop("stretch", "before", "at", "cell", "total"))
