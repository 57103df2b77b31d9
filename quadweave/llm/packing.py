"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only lengths decide a packing, and there are at most ``capacity`` different ones. The tasks count
pieces by length; the packing itself works on that histogram and gives runs: pieces ``first`` to
``first + count`` of a length go to ``count`` consecutive sequences at one offset. Its cost does not
depend on the number of documents. Each piece then looks up its place from its rank among the
pieces of its length, which is a rank in its task plus the counts of the tasks before.

Pieces above a third of the capacity fit at most twice into a sequence: the longest is matched with
the longest that fits beside it, which gives as many pairs as any matching. Shorter pieces go, in
falling length, to the sequence with the smallest gap that holds them.

Texts: a null text is empty and gives the end id alone. Only documents longer than the capacity are
cut. Repeated rows are packed each. An empty table gives an empty result.
"""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quadweave.llm.common import give_back, slices, written
from quadweave.llm.tokenizing import PLAIN, encoder

CAPACITY = 4096
END_ID = 1


class _Gaps:
    """Groups of equal sequences by the room left in them; finds the smallest room that suffices."""

    def __init__(self):
        self.by_room = defaultdict(list)
        self.rooms = 0  # bit r is set if sequences with room r are there

    def add(self, room, base, count, used):
        if count and room:
            self.by_room[room].append((base, count, used))
            self.rooms |= 1 << room

    def take(self, size):
        above = self.rooms >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        return room, *group


def pack(histogram: dict[int, int], capacity=CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, count, sequence, offset) that place every piece of the histogram.

    Pieces ``first`` to ``first + count - 1`` of ``length`` go to sequences ``sequence`` onwards.
    """
    left = {k: n for k, n in histogram.items() if n}
    given = defaultdict(int)
    runs, gaps, sequences = [], _Gaps(), 0

    def place(length, count, sequence, offset):
        runs.append((length, given[length], count, sequence, offset))
        given[length] += count
        left[length] -= count

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                place(a, pairs, sequences, 0)
                place(b, pairs, sequences, a)
                gaps.add(capacity - a - b, sequences, pairs, a + b)
                sequences += pairs
        if left[a]:
            gaps.add(capacity - a, sequences, left[a], a)
            sequences += left[a]
            place(a, left[a], sequences - left[a], 0)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            found = gaps.take(s)
            if found is None:
                each = capacity // s
                opened = -(-left[s] // each)
                found = capacity, sequences, opened, 0
                sequences += opened
            room, base, count, used = found
            each = room // s
            full = min(count, left[s] // each)
            for k in range(each if full else 0):
                place(s, full, base, used + k * s)
            gaps.add(room - each * s, base, full, used + each * s)
            rest = min(each - 1, left[s]) if full < count else 0
            if rest:
                for k in range(rest):
                    place(s, 1, base + full, used + k * s)
                gaps.add(room - rest * s, base + full, 1, used + rest * s)
            gaps.add(room, base + full + bool(rest), count - full - bool(rest), used)
    return runs


def pieces_of(docs: DataFrame, tokenizer: str, ident="doc_id", text="text", capacity=CAPACITY, end_id=END_ID) -> DataFrame:
    """(id, piece, start, length, ids, task, rank): tokenised pieces; ``rank`` counts equal lengths of a task."""
    id_type = docs.schema[ident].dataType.simpleString()

    def cut(batches):
        task, ranks, tail = TaskContext.get().partitionId(), defaultdict(int), np.uint32(end_id).tobytes()
        enc = encoder(tokenizer, PLAIN)
        for batch in slices(batches):
            rows = []
            for row, ids in enumerate(enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += tail
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    n = len(part) // 4
                    rows.append((row, piece, a // 4, n, part, ranks[n]))
                    ranks[n] += 1
            row, piece, start, length, part, rank = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(part, pa.binary()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                names=[ident, "piece", "start", "length", "ids", "task", "rank"],
            )
        give_back(keep=True)

    return docs.select(F.col(ident), F.col(text)).mapInArrow(
        cut, f"{ident} {id_type}, piece int, start long, length long, ids binary, task int, rank long"
    )


def placed(pieces: DataFrame, capacity=CAPACITY) -> DataFrame:
    """Written ``pieces`` with ``sequence_id`` and ``offset`` instead of ``task`` and ``rank``."""
    counts = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # At most ``capacity`` rows reach the driver, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(pack(histogram, capacity)), "i8").reshape(-1, 5)
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ).select("task", "length", F.coalesce("before", F.lit(0)).alias("before"))
    total = sum(histogram.values()) + 1
    starts = runs[:, 0] * total + runs[:, 1]
    rest = [c for c in pieces.columns if c not in ("task", "rank")]
    ranked = pieces.join(before, ["task", "length"]).select(*rest, (F.col("rank") + F.col("before")).alias("rank"))

    def look_up(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            run = runs[np.searchsorted(starts, length * total + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(rest))), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=[*rest, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, ident="doc_id", text="text", capacity=CAPACITY, end_id=END_ID) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset): every piece with its place."""
    return placed(written(pieces_of(docs, tokenizer, ident, text, capacity, end_id), "pieces"), capacity)


def packing_digest(docs: DataFrame, tokenizer: str, ident="doc_id", text="text", capacity=CAPACITY, end_id=END_ID) -> DataFrame:
    """As ``pack_documents`` with the checksum ``ids_crc32`` in place of the ids themselves."""

    def checksums(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            sums = pa.array([zlib.crc32(x) for x in batch.column(at).to_pylist()], pa.int64())
            yield batch.set_column(at, "ids_crc32", sums)

    pieces = pieces_of(docs, tokenizer, ident, text, capacity, end_id)
    schema = ", ".join(
        "ids_crc32 long" if f.name == "ids" else f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema
    )
    return placed(written(pieces.mapInArrow(checksums, schema), "pieces"), capacity)
