"""Token ids in directly addressable codes.

Ids are cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level ``k`` the
next chunk of those ids that have one. A continuation bitmap per level marks the ids that go on, and
a rank directory counts the marks before every ``RANK_BITS`` bits, so the place of an id's next
chunk is the rank of its mark: any token is read with one step per level and nothing else decoded.
The ids of a range stay together on every level, so a document is read by slices.

File format: a Parquet table ``segments``, uncompressed, one row per segment of whole documents in
ascending document order: ``part`` and ``seq`` (order of segments), ``first`` (ids before it in its
part), ``n_tokens``, ``doc_ids``, ``starts`` (of its documents, in the segment), and ``levels``
(chunks, marks, ranks). A table ``directory`` gives the ids before each part. Spark's committers
write both, so a lost task leaves nothing half written.

Documents in order of id, null first; rows with one id are ordered by a hash of their text. A null
text is empty and holds the end id alone. An empty table gives empty tables.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import bounded_batches, slices
from quadweave.llm.tokenizing import SPACED, encoder

END_ID = 0
CHUNK = 8
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
#: Words whose ids a writing task keeps at hand; about 160 MB.
KEPT_WORDS = 400_000
_LEVELS = "array<struct<chunks: binary, marks: binary, ranks: binary>>"


# --- codes ------------------------------------------------------------------------------------


def encode(ids: np.ndarray) -> list[dict]:
    """Levels of an array of unsigned ids."""
    ids, levels = np.asarray(ids, "u8"), []
    while True:
        more = ids >> np.uint64(CHUNK)
        goes_on = more > 0
        marks = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on, np.arange(0, len(ids), RANK_BITS), dtype="u4") if len(ids) else np.empty(0, "u4")
        ranks = np.concatenate(([0], np.cumsum(blocks[:-1]))).astype("<u4") if len(ids) else blocks
        levels.append({"chunks": ids.astype("u1").tobytes(), "marks": marks.tobytes(), "ranks": ranks.tobytes()})
        if not goes_on.any():
            return levels
        ids = more[goes_on]


def _rank(level, i: int) -> int:
    """Marks before position ``i``."""
    ranks = np.frombuffer(level["ranks"], "<u4")
    if not len(ranks):
        return 0
    block = min(i // RANK_BITS, len(ranks) - 1)
    marks = np.frombuffer(level["marks"], "u1", count=-(-i // 8) - block * RANK_BITS // 8, offset=block * RANK_BITS // 8)
    bits = np.unpackbits(marks, bitorder="little")[: i - block * RANK_BITS]
    return int(ranks[block]) + int(bits.sum())


def token(levels: list[dict], i: int) -> int:
    """The id at position ``i``: one chunk, one mark and one rank per level."""
    value = 0
    for k, level in enumerate(levels):
        value |= level["chunks"][i] << (CHUNK * k)
        if not level["marks"][i // 8] >> (i % 8) & 1:
            return value
        i = _rank(level, i)
    return value


def token_range(levels: list[dict], a: int, b: int) -> np.ndarray:
    """The ids at positions ``a`` to ``b - 1``; on each level they are one slice."""
    ids, at = np.zeros(b - a, "<u4"), np.arange(b - a)
    for k, level in enumerate(levels):
        ids[at] |= np.frombuffer(level["chunks"], "u1", count=b - a, offset=a).astype("<u4") << np.uint32(CHUNK * k)
        first = a // 8
        marks = np.frombuffer(level["marks"], "u1", count=-(-b // 8) - first, offset=first)
        bits = np.unpackbits(marks, bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)
        at = at[bits]
        if not len(at):
            break
        a = _rank(level, a)
        b = a + len(at)
    return ids


# --- files ------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str, ident="doc_id", text="text", end_id=END_ID, segment_tokens=SEGMENT_TOKENS) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending order of id."""
    spark = docs.sparkSession
    id_type = docs.schema[ident].dataType.simpleString()

    def segments(batches):
        part, tail = TaskContext.get().partitionId(), np.uint32(end_id).tobytes()
        enc, first, seq, held = encoder(tokenizer, SPACED, KEPT_WORDS), 0, 0, []
        schema = None

        def flush():
            lengths = np.array([len(x) // 4 for _, x in held])
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            starts = np.cumsum(lengths) - lengths
            return len(ids), pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "first": first, "n_tokens": len(ids), "doc_ids": [d for d, _ in held],
                  "starts": starts.tolist(), "levels": encode(ids)}],
                schema=schema,
            )

        size = 0
        for batch in slices(batches):
            schema = schema or pa.schema([
                ("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()),
                ("doc_ids", pa.list_(batch.schema.field(0).type)), ("starts", pa.list_(pa.int64())),
                ("levels", pa.list_(pa.struct([(c, pa.binary()) for c in ("chunks", "marks", "ranks")]))),
            ])
            texts = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), texts):
                held.append((doc, ids + tail))
                size += len(ids) // 4 + 1
                if size >= segment_tokens:
                    n, out = flush()
                    yield out
                    first, seq, size = first + n, seq + 1, 0
                    held.clear()
        if held:
            yield flush()[1]

    order = [F.col("_id"), F.xxhash64("_text")]
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).repartitionByRange(*order).sortWithinPartitions(*order)
    with bounded_batches(spark):
        rows.mapInArrow(
            segments, f"part int, seq int, first long, n_tokens long, doc_ids array<{id_type}>, starts array<long>, levels {_LEVELS}"
        ).write.option("compression", "none").parquet(f"{path}/segments")
    parts = (
        read_segments(spark, path, id_type).groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).orderBy("part").collect()
    )  # one row per task that wrote
    before, rows = 0, []
    for r in parts:
        rows.append((r["part"], before, r["n_tokens"]))
        before += r["n_tokens"]
    spark.createDataFrame(rows, "part int, tokens_before long, n_tokens long").coalesce(1).write.parquet(f"{path}/directory")


def read_segments(spark, path: str, id_type="bigint") -> DataFrame:
    return spark.read.schema(
        f"part int, seq int, first long, n_tokens long, doc_ids array<{id_type}>, starts array<long>, levels {_LEVELS}"
    ).parquet(f"{path}/segments")


def read_directory(spark, path: str) -> DataFrame:
    return spark.read.schema("part int, tokens_before long, n_tokens long").parquet(f"{path}/directory")


def token_at(spark, path: str, position: int) -> int | None:
    """The id at a position of the whole file: one segment is fetched, one id decoded."""
    part = read_directory(spark, path).where(
        (F.col("tokens_before") <= position) & (position < F.col("tokens_before") + F.col("n_tokens"))
    ).first()
    if part is None:
        return None
    place = position - part["tokens_before"]
    row = read_segments(spark, path).where(
        (F.col("part") == part["part"]) & (F.col("first") <= place) & (place < F.col("first") + F.col("n_tokens"))
    ).select("first", "levels").first()
    return token(row["levels"], place - row["first"])


def read_documents(spark, path: str, ident="doc_id", id_type="bigint", with_ids=False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, read back from the files."""
    # One number per task that wrote.
    before = {r["part"]: r["tokens_before"] for r in read_directory(spark, path).collect()}

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start = before[row["part"]] + row["first"]
                starts = row["starts"]
                ids = [token_range(row["levels"], a, b) for a, b in zip(starts, [*starts[1:], row["n_tokens"]])]
                columns = [
                    pa.array(row["doc_ids"], batch.schema.field(batch.schema.get_field_index("doc_ids")).type.value_type),
                    pa.array([start + a for a in starts], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                ]
                names = [ident, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{ident} {id_type}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return read_segments(spark, path, id_type).mapInArrow(documents, schema)
