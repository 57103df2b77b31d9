import glob
import itertools
import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadweave.llm import curve
from quadweave.llm.common import work_folder


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_steps_of_one(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, [f"c{i}" for i in range(n)])
    rows = df.select("*", curve.hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).collect()
    at = {r["h"]: tuple(r)[:n] for r in rows}
    assert sorted(at) == list(range(len(points)))
    for i in range(len(points) - 1):
        assert sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1


def sharded(spark, docs, shards=curve.SHARDS, **options):
    path = work_folder(spark, "shards")
    curve.write_shards(docs, path, **options)
    return path, curve.read_shards(spark, path, shards)


def check(rows, texts, shards):
    """Every row once with its own figures, slots gapless from 0, shards at most one row apart."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert {(r["law"], r["grown_shard"]) for r in rows} <= {("rows", None)}


def test_shards_hold_every_row_once(spark, docs_of, hard_texts):
    texts = list(enumerate(hard_texts)) + [(None, "no id"), (3, "again"), (3, "again")] + [(99, "one text")] * 200
    rng = random.Random(1)
    docs = docs_of([(i, t, rng.choice(["a", "b", "é", None])) for i, t in texts])
    for shards in (1, 7, 40, 1000):
        _, out = sharded(spark, docs, shards)
        check(curve.shard_report(out).collect(), texts, shards)


def test_columns_pass_through_whatever_their_names(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None)]).selectExpr("*", "1 as `curve_tag`", "2 as shard", "'z' as `slot`", "3 as `dotted.name`", "4 as `_tag`", "5 as `curve_place`")
    _, out = sharded(spark, docs, 2)
    assert out.columns[:-2] == docs.columns
    assert sorted(map(tuple, out.select([f"`{c}`" for c in docs.columns]).collect())) == sorted(map(tuple, docs.collect()))
    check(curve.shard_report(out).collect(), [(1, "a"), (2, None)], 2)


def test_empty_table(spark, docs_of):
    path, out = sharded(spark, docs_of([(1, "a")]).where("doc_id > 1"))
    assert curve.shard_report(out).count() == 0


def test_cells_hold_equal_parts_of_all_rows(spark):
    rows = spark.createDataFrame([(i, f"v{i % 50:02}", None if i % 10 == 0 else float(i)) for i in range(5000)], "i long, s string, f double")
    edges = curve.cell_edges(rows, 4)
    for name in rows.columns:
        cells = rows.groupBy(curve.cell_of(F.col(name), edges[name], rows.schema[name].dataType.simpleString()).alias("c")).count().collect()
        held = {r["c"]: r["count"] for r in cells}
        nulls = held.pop(0, 0)
        assert nulls == (500 if name == "f" else 0)
        assert set(held) <= set(range(1, 16)) and max(held.values()) <= 1.6 * (5000 - nulls) / 15


def test_filters_on_any_dimension_skip_most_files(spark, docs_of):
    """Files whose statistics meet a filter: a small part of them, where the unsorted table needs them all."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(4000), f"s{rng.randrange(30):02}") for i in range(6000)]
    docs = docs_of(rows, extra=False).withColumn("lang", F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("es"), F.lit("fr")), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) + 1).cast("int")))
    path, out = sharded(spark, docs, partitions=64)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(path.removeprefix("file:") + "/*.parquet")]
    names = files[0].schema.names

    def touched(column, value):
        hits = 0
        for meta in files:
            stats = [meta.row_group(g).column(names.index(column)).statistics for g in range(meta.num_row_groups)]
            hits += any(s.min <= value <= s.max for s in stats)
        return hits / len(files)

    assert touched("source", "s07") < 0.35 and touched("lang", "es") < 0.6 and touched("n_chars", 100) < 0.35
    assert out.where("source = 's07' and lang = 'es'").select("shard").distinct().count() < 40 * 0.25
