"""Helpers about the running session: lineage cuts, sized broadcasts, skew-safe joins."""

import uuid

from pyspark.sql import DataFrame, Window, functions as F

# Rows one join task may produce for a single key before the key is spread over a grid.
PAIRS_PER_TASK = 4_000_000
# Rows of a large result that one task makes or brings together, where their number is known.
ROWS_PER_TASK = 500_000
# Whether a query deletes its shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of a written table up to which it is broadcast.
BROADCAST_BYTES = 8_000_000


def shared_folder(spark):
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else one below the warehouse.

    One rule for every master; both are shared by driver and executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def _files(spark, path):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    A written table survives lost executors, prunes columns when read, and has real size
    statistics, which the plans built on it use to choose join strategies. ``replaces`` is an
    earlier result that nothing reads any more once this one is written; its files are deleted, and so
    are the shuffle files of the job, which Spark would keep until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quadweave/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if replaces is not None:
        release(replaces)
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a result of :func:`cut_lineage`; nothing may read it afterwards."""
    path = getattr(df, "_written_at", None)
    if path:
        fs, hadoop = _files(df.sparkSession, path)
        fs.delete(hadoop, True)


def broadcast_if_small(df: DataFrame, max_bytes=BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written table whose files are proven small; other frames are left as they are.

    Nothing is executed while a plan is built: adaptive execution knows the size of any other
    frame when it comes to the join.
    """
    path = getattr(df, "_written_at", None)
    if path:
        fs, hadoop = _files(df.sparkSession, path)
        if fs.getContentSummary(hadoop).getLength() <= max_bytes:
            return F.broadcast(df)
    return df


def free_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, or it with underscores after it, so that no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def in_order(df: DataFrame, order, tag: str, partitions=None) -> DataFrame:
    """``df`` dealt out by ranges of ``order`` and sorted within them.

    The new column ``tag`` ascends in that order: the number of the range in the upper bits, the
    row's number within it in the lower 33. Rows that ``order`` does not tell apart are spread over
    ranges as well, so that a run of them is no single task.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(tag, F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(partitions, *order, tag).sortWithinPartitions(*order, tag)
    return dealt.withColumn(tag, F.monotonically_increasing_id())


def placed(rows: DataFrame, tag: str, name: str, weight: str | None = None) -> DataFrame:
    """A written result of :func:`in_order` with ``name`` for ``tag``: how many rows, or how much ``weight``, come before.

    Only the table of ranges, one row each, is summed in one place.
    """
    part, inside = F.shiftright(tag, 33), F.col(tag).bitwiseAND(F.lit((1 << 33) - 1))
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = rows.groupBy(part.alias("_part")).agg(amount.alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    if weight is not None:
        within = Window.partitionBy(part).orderBy(tag).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(weight).over(within), F.lit(0))
    rows = rows.withColumn(tag, F.struct(part.alias("p"), inside.alias("i")))
    # One row per range, as many as the session's setting says: bounded, whatever the input.
    joined = rows.join(F.broadcast(offsets), F.col(f"`{tag}`.p") == F.col("_part"))
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    own = [F.col(quoted(c)) for c in rows.columns if c != tag]
    return joined.select(*own, (F.col("_before") + F.col(f"`{tag}`.i")).alias(name))


def with_positions(df: DataFrame, order, name="position", weight=None, partitions=None) -> DataFrame:
    """``df`` with each row's place (from 0) in the total order of ``order``, and nothing in one task.

    With ``weight``, the sum of that column over the rows before instead of their number.
    """
    tag = free_name("_tag", df)
    return placed(cut_lineage(in_order(df, order, tag, partitions)), tag, name, weight)


def _pairs_by_key(left, right, keys):
    """``keys`` with the number of matching rows on both sides, ``_cl`` and ``_cr``."""
    counts_l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cl"))
    counts_r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cr"))
    return counts_l.join(counts_r, keys)


def _grid_join(left, right, keys, left_id, right_id, counts, target, tasks=None):
    """Inner join on ``keys``, each key of more than ``target`` pairs cut into a grid of cells.

    The side with more rows is cut into more parts, so that few rows are copied. ``tasks``: how many
    tasks the cells are dealt out to; adaptive execution joins none of them.
    """
    pairs = F.col("_cl").cast("double") * F.col("_cr")
    cells = F.ceil(pairs / target)
    parts_l = F.greatest(F.floor(F.sqrt(cells * F.col("_cl") / F.col("_cr"))), F.lit(1))
    hot = F.broadcast(counts.where(pairs > target).select(
        *keys, parts_l.cast("int").alias("_ni"), F.ceil(cells / parts_l).cast("int").alias("_nj")))

    def spread(df, own, other, ident):
        size = {c: F.coalesce(F.col(f"_n{c[1]}"), F.lit(1)) for c in (own, other)}
        out = (
            df.join(hot, keys, "left")
            .withColumn(own, F.pmod(F.xxhash64(*[F.col(c) for c in ident]), size[own]).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), size[other] - 1)))
            .drop("_ni", "_nj")
        )
        return out if tasks is None else out.repartition(tasks, *keys, "_i", "_j")

    return spread(left, "_i", "_j", left_id).join(spread(right, "_j", "_i", right_id), [*keys, "_i", "_j"]).drop("_i", "_j")


def skew_safe_join(left, right, keys, left_id, right_id, target=PAIRS_PER_TASK):
    """Inner many-to-many join on ``keys`` whose hot keys are cut into a grid of tasks.

    A key of more than ``target`` matching pairs is split into cells that yield about ``target``
    rows each; other keys are joined as they are. The result equals the plain join. ``left_id`` /
    ``right_id`` are columns that spread the rows of one key. The list of hot keys is broadcast, as
    each stands for more than ``target`` rows of the result: the rows themselves move once per cell.
    """
    return _grid_join(left, right, keys, left_id, right_id, _pairs_by_key(left, right, keys), target)


def dealt_join(left, right, keys, left_id, right_id, target=ROWS_PER_TASK):
    """(the join of :func:`skew_safe_join`, its number of rows), made by tasks of about ``target`` rows each.

    For results much larger than what is read: adaptive execution sizes tasks by the bytes they read,
    so that the few tasks that it leaves hold more of the result the larger it is. Both sides are read
    twice, once to count.
    """
    counts = cut_lineage(_pairs_by_key(left, right, keys))
    total = int(counts.agg(F.sum(F.col("_cl").cast("decimal(38,0)") * F.col("_cr"))).first()[0] or 0)
    return _grid_join(left, right, keys, left_id, right_id, counts, target, tasks_for(total, target)), total


def tasks_for(rows, target=ROWS_PER_TASK):
    """Number of tasks that leaves each about ``target`` of so many rows."""
    return max(-(-rows // target), 1)
