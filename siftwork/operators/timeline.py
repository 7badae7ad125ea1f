"""Order and time over a whole table without one task for all of it: ordinals, trailing counts, what was in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators.lineage import checkpointed


def before(cells: DataFrame, bucket: str, order: str, total: str, name: str = "before") -> DataFrame:
    """Exclusive prefix sums of ``total`` over cells ordered by (bucket, order).

    A bucket is summed by itself; only the sums of buckets meet in one task, so these must be few.
    """
    sums = cells.groupBy(F.col(bucket).alias("__bucket")).agg(F.sum(total).alias("__sum"))
    starts = sums.select("__bucket", F.coalesce(F.sum("__sum").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = cells.withColumn("__local", F.coalesce(F.sum(total).over(within), F.lit(0)))
    joined = local.join(starts, F.col(bucket) == F.col("__bucket"))
    return joined.select(*cells.columns, (F.col("__start") + F.col("__local")).cast("long").alias(name))


def with_ordinal(df: DataFrame, name: str = "ordinal", settled: bool = False) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order in which they come: partition after partition, row after row.

    Partitions are counted, their counts summed to offsets, and each row adds its place in its partition; no row is moved. The rows
    are checkpointed first so that both passes see the same ones in the same places; ``settled`` tells that they do anyway. The order of a read of files is
    another: Spark deals files to partitions by size, so those rows are numbered by ``with_file_ordinal``.
    """
    rows = (df if settled else checkpointed(df)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    # one row for each partition
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("of_all", F.lit(0))
    offsets = before(counts, "of_all", "part", "n", "offset").select(F.col("part").alias("of"), "offset")
    joined = rows.withColumn("__part", part).join(F.broadcast(offsets), F.col("__part") == F.col("of"))
    return joined.select(*df.columns, (F.col("offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def with_file_ordinal(read: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the rows of a read of Parquet files 0, 1, 2, ... in the order of the files by path, and in a file from its first row to its last.

    It depends on no partition: the rows of each file are counted, the counts summed to offsets, and each row adds its place in its file.
    """
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = read.select("*", path.alias("__path"), place.alias("__place"))
    # one row for each file
    counts = rows.groupBy(F.col("__path").alias("path")).agg(F.count("*").alias("n")).withColumn("of_all", F.lit(0))
    offsets = before(counts, "of_all", "path", "n", "offset").select(F.col("path").alias("of"), "offset")
    joined = rows.join(F.broadcast(offsets), F.col("__path") == F.col("of"))
    return joined.select(*read.columns, (F.col("offset") + F.col("__place")).alias(name))


def trailing_counts(log: DataFrame, key: str, seconds: list[int], ts: str = "ts", cell_seconds: int = 1, span: int = 86_400) -> DataFrame:
    """How many rows lie in the ``seconds`` up to each row's own time (ties included): adds ``last_<seconds>`` columns.

    A count is the difference of two cumulative ones, at the row's time and so long before it. Those are prefix sums of the rows of each cell of
    time, and a correction inside the one cell: every row, and a probe for each length, is ranked in its cell. So no window spans more than a cell. ``key`` tells rows apart;
    rows without a time have null counts.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    cell = 1_000_000 * cell_seconds
    rows = log.select(F.col(key).alias("__key"), micros.alias("__at")).where(F.col("__at").isNotNull())
    cells = rows.groupBy(F.floor(F.col("__at") / cell).alias("cell")).agg(F.count("*").alias("n")).withColumn("day", F.floor(F.col("cell") * cell_seconds / span))
    sums = before(cells, "day", "cell", "n")
    probes = F.array(*[F.struct(F.lit(s).alias("back"), (F.col("__at") - F.lit(s * 1_000_000)).alias("x")) for s in (0, *seconds)])
    asked = rows.select("__key", F.explode(probes).alias("p")).select("__key", "p.back", "p.x", (F.col("p.back") == 0).cast("int").alias("one"), F.floor(F.col("p.x") / cell).alias("in_cell"))
    upto = Window.partitionBy("in_cell").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = asked.withColumn("local", F.sum("one").over(upto))
    # a probe in a cell without rows: all rows of earlier cells lie before it
    known = ranked.join(sums.select(F.col("cell").alias("of"), "before"), F.col("in_cell") == F.col("of"), "left")
    empty = known.where(F.col("before").isNull()).select(F.col("in_cell").alias("gap")).distinct()
    filled = _carried(empty, sums.withColumn("after", F.col("before") + F.col("n")), span // cell_seconds)
    whole = known.join(filled, F.col("in_cell") == F.col("gap"), "left").withColumn("upto", F.coalesce(F.col("before") + F.col("local"), F.col("carried"), F.lit(0)))
    wide = whole.groupBy("__key").agg(*[F.max(F.when(F.col("back") == s, F.col("upto"))).alias(f"__at_{s}") for s in (0, *seconds)])
    back = wide.select(F.col("__key").alias("__of"), *[(F.col("__at_0") - F.col(f"__at_{s}")).cast("long").alias(f"last_{s}") for s in seconds])
    return log.join(back, F.col(key) == F.col("__of"), "left").drop("__of")


def _carried(gaps: DataFrame, sums: DataFrame, cells_a_day: int) -> DataFrame:
    """For each cell without rows the count at the end of the last cell before it that has some."""
    both = gaps.select(F.col("gap").alias("cell"), F.lit(None).cast("long").alias("after"), F.lit(True).alias("asked")).union(
        sums.select("cell", "after", F.lit(False))
    ).withColumn("day", F.floor(F.col("cell") / cells_a_day))
    carried = carry_forward(both, [], "day", "cell", F.col("after"), "carried")
    return carried.where("asked").select(F.col("cell").alias("gap"), "carried")


def carry_forward(df: DataFrame, by: list[str], piece: str, order: str | list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null up to each row, in order of (piece, order) within ``by``.

    Rows are sorted inside a piece; the last values of pieces are carried over pieces, of which each ``by`` has few.
    """
    order = [order] if isinstance(order, str) else order
    marked = df.withColumn("__v", value)
    inside = Window.partitionBy(*by, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.withColumn("__local", F.last("__v", ignorenulls=True).over(inside))
    known = F.col("__v").isNotNull()
    ends = marked.groupBy(*[F.col(c).alias(f"__p_{c}") for c in (*by, piece)]).agg(F.max_by(F.when(known, F.col("__v")), F.when(known, F.struct(*order))).alias("__end"))
    over = Window.partitionBy(*[F.col(f"__p_{c}") for c in by]).orderBy(f"__p_{piece}").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("__start", F.last("__end", ignorenulls=True).over(over)).drop("__end")
    same = F.lit(True)
    for c in (*by, piece):
        same = same & (F.col(c) == F.col(f"__p_{c}"))
    return local.join(starts, same).select(*df.columns, F.coalesce("__local", "__start").alias(name))


def in_force(requests: DataFrame, entries: DataFrame, key: str, ts: str, entry_ts: str, columns: list[str], piece_seconds: int = 86_400) -> DataFrame:
    """Every request with the columns of the latest entry of its key that is not later than it, null where there is none.

    Requests and entries are put together, sorted by time and carried forward; a key is cut into pieces of time, so a hot one is many tasks. Of entries of one key and
    time the one with the greatest columns counts. Requests without a key or time find nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    entry = F.struct(*[F.col(c) for c in columns])
    left = requests.select(F.col(key).alias("__k"), micros(ts).alias("__at"), F.lit(None).cast(entries.select(entry.alias("e")).schema["e"].dataType).alias("__e"), F.struct(*requests.columns).alias("__row"))
    right = entries.select(F.col(key).alias("__k"), micros(entry_ts).alias("__at"), entry.alias("__e")).where(F.col("__at").isNotNull()).groupBy("__k", "__at").agg(F.max("__e").alias("__e"))
    right = right.withColumn("__row", F.lit(None).cast(left.schema["__row"].dataType))
    sound = F.col("__k").isNotNull() & F.col("__at").isNotNull()
    both = left.where(sound).union(right.where(F.col("__k").isNotNull())).withColumn("__piece", F.floor(F.col("__at") / (1_000_000 * piece_seconds))).withColumn("__asks", F.col("__row").isNotNull())
    carried = carry_forward(both, ["__k"], "__piece", ["__at", "__asks"], F.col("__e"), "__found").where("__asks")
    found = carried.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in columns])
    lost = left.where(~sound).select("__row.*", *[F.col(f"__e.{c}").alias(c) for c in columns])
    return found.union(lost)
