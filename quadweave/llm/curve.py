"""Sharding along a Hilbert curve through the metadata, with DataFrame functions alone.

1. Every dimension (any columns that can be ordered, and the bytes of the text) is quantised into
   cells that hold equally many rows as far as its values allow. The ends of the cells are values
   of the dimension, ``2^bits - 2`` at most, a frequent value several times; cell 0 is for nulls.
2. A row's cells are a point of a grid; its number along the Hilbert curve of that grid comes from the
   transposed form of the curve (J. Skilling, "Programming the Hilbert curve", 2004), written as
   array functions.
3. Rows are sorted by that number, then by the values themselves, by a hash of the text (equal texts
   lie together) and by id, and written in that order. Neighbours on the curve are alike in all
   dimensions, so each file covers a small box and a filter on any of them skips most files.
4. Shards are cut from the order as runs whose numbers of rows differ by one at most.

Nulls come first in each dimension; a null text has no bytes. Rows that agree in everything are
spread like any others. Other columns pass through, whatever they are called. An empty table gives
an empty result.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from quadweave.llm.common import quoted
from quadweave.runtime import free_name, in_order, placed, with_positions

SHARDS = 40
BITS = 6
DIMENSIONS = ("source", "lang")
#: Bytes a row counts besides its text.
ROW_BYTES = 16
#: How fine percentiles are kept while they are merged.
ACCURACY = 10_000


def text_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def cell_edges(rows: DataFrame, bits=BITS) -> dict[str, list]:
    """Ends of the cells of each column of ``rows``, ascending, from all rows.

    Numbers give percentiles, all columns in one aggregate. Of other columns the distinct values are
    counted and cut by the rows before them. At most ``2^bits - 2`` values a column reach the driver.
    """
    cells = 2**bits - 1
    numeric = [f.name for f in rows.schema if isinstance(f.dataType, NumericType)]
    edges = {}
    if numeric:
        at = F.array(*[F.lit(i / cells) for i in range(1, cells)])
        found = rows.agg(*[F.percentile_approx(F.col(n), at, ACCURACY).alias(n) for n in numeric]).first()
        edges = {n: sorted(found[n] or []) for n in numeric}
    for name in rows.columns:
        if name in edges:
            continue
        counts = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
        before = with_positions(counts, [F.col(name)], "_before", "_n")
        total = rows.where(F.col(name).isNotNull()).count()
        cell = F.floor(F.col("_before") * F.lit(cells) / F.lit(max(1, total)))
        found = before.groupBy(cell.alias("_cell")).agg(F.min(name).alias("_low")).where("_cell > 0").collect()
        edges[name] = []
        for r in sorted(found, key=lambda r: r["_cell"]):
            # A value over several cells counts for each, so that values keep their distance in rows.
            edges[name] += [r["_low"]] * (r["_cell"] - len(edges[name]))
    return edges


def cell_of(value, edges: list, kind: str):
    """0 for null, else one more than the edges that are not above the value."""
    inner = F.size(F.filter(F.lit(edges).cast(f"array<{kind}>"), lambda e: e <= value)) if edges else F.lit(0)
    return F.when(value.isNull(), F.lit(0)).otherwise(1 + inner).cast("long")


def hilbert_index(cells: list, bits: int):
    """The number along the Hilbert curve of points given by columns of cells from 0 to ``2^bits - 1``."""
    n = len(cells)
    if n * bits > 62:
        raise ValueError("dimensions times bits must be at most 62")
    zero = F.lit(0).cast("long")

    def bit_steps(bits_, dimensions):
        return F.array(*[
            F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(i).alias("axis")) for b in bits_ for i in dimensions
        ])

    def turn_back(x, step):
        """Undo the turn that one bit of one axis gives the parts of the curve below it."""
        low, own, first = step["bit"] - 1, F.get(x, step["axis"]), F.get(x, F.lit(0))
        set_ = own.bitwiseAND(step["bit"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(set_ & (k == 0), v.bitwiseXOR(low))
            .when(~set_ & ((k == 0) | (k == step["axis"])), v.bitwiseXOR(swap))
            .otherwise(v),
        )

    point = F.array(*[c.cast("long") for c in cells])
    high = range(bits - 1, 0, -1)
    turned = F.aggregate(bit_steps(high, range(n)), point, turn_back) if bits > 1 else point

    def gray_code(x):
        """Each axis combined with those before it."""
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, F.lit(1), k + 1), zero, lambda a, b: a.bitwiseXOR(b)))

    def corrected(x):
        """The bits set in the last axis turn the lower bits of all."""
        last = F.aggregate(
            F.array(*[F.lit(1 << b).cast("long") for b in high]), zero,
            lambda a, bit: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(bit) != 0, a.bitwiseXOR(bit - 1)).otherwise(a),
        ) if bits > 1 else zero
        return _once(last, lambda fix: F.transform(x, lambda v: v.bitwiseXOR(fix)))

    def interleaved(x):
        """One number of all bits, the highest of each axis first."""
        bit = lambda s: F.when(F.get(x, s["axis"]).bitwiseAND(s["bit"]) != 0, F.lit(1)).otherwise(F.lit(0))
        return F.aggregate(bit_steps(range(bits - 1, -1, -1), range(n)), zero, lambda a, s: a * 2 + bit(s))

    return _once(_once(_once(turned, gray_code), corrected), interleaved)


def _once(value, then):
    """``then`` of a value that is worked out once per row: as the one element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def curve_order(docs: DataFrame, ident="doc_id", text="text", dimensions=DIMENSIONS, bits=BITS) -> list:
    """The columns that put ``docs`` in the order of the curve."""
    values = {f"_d{i}": quoted(c) for i, c in enumerate(dimensions)} | {"_bytes": text_bytes(quoted(text))}
    rows = docs.select(*[v.alias(n) for n, v in values.items()])
    edges = cell_edges(rows, bits)
    cells = [cell_of(v, edges[n], rows.schema[n].dataType.simpleString()) for n, v in values.items()]
    return [hilbert_index(cells, bits), *values.values(), F.xxhash64(quoted(text)), quoted(ident)]


def write_shards(docs: DataFrame, path: str, ident="doc_id", text="text", dimensions=DIMENSIONS, bits=BITS, partitions=None) -> None:
    """All rows and columns of ``docs`` in the order of the curve, one file per range of it.

    The last column of the files is the row's tag, which ascends along the curve.
    """
    order = curve_order(docs, ident, text, dimensions, bits)
    in_order(docs, order, free_name("curve_tag", docs), partitions).write.parquet(path)


def read_shards(spark, path: str, shards=SHARDS) -> DataFrame:
    """The rows of :func:`write_shards`, with two more columns at the end: shard, and slot within it.

    Any number of shards can be read from the same files: they are runs of the order.
    """
    rows = spark.read.parquet(path)
    tag, total = rows.columns[-1], rows.count()
    place = free_name("curve_place", rows)
    numbered = placed(rows, tag, place)
    shard, slot = free_name("shard", numbered), free_name("slot", numbered)
    cut = F.expr(f"(`{place}` * {shards}L) div {max(1, total)}L")
    first = F.expr(f"(`{shard}` * {total}L + {shards - 1}L) div {shards}L")
    numbered = numbered.withColumn(shard, cut.cast("int")).withColumn(slot, F.col(place) - first)
    return numbered.drop(place)


def shard_report(sharded: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of what :func:`read_shards` gives."""
    shard, slot = sharded.columns[-2:]
    return sharded.select(
        quoted(ident).alias(ident), (text_bytes(quoted(text)) + ROW_BYTES).alias("size"), F.crc32(F.coalesce(quoted(text), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
