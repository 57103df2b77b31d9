"""Target-distribution importance resampling with bit-sliced sums.

1. Features of a text are its runs of one to three words, hashed into ``BUCKETS`` buckets by CRC-32. A
   task adds up the bucket counts of its texts, so a pass over the corpus shuffles one row per bucket
   and task.
2. A bucket's gain is the logarithm of how much more often the target texts hold it, in thousandths,
   a signed integer. The gains are sliced into bit planes of one bit per bucket; the last plane is the
   sign and counts negative (two's complement).
3. A document's bucket counts are sliced in the same way. Its weight, the sum over all buckets of
   count times gain, is the sum over all pairs of planes of 2^(i + j) times the ones in their
   conjunction: exact integers, no multiplication of counts and gains.
4. Weights are drawn without replacement: a number from the hash of the document's id, as Gumbel
   noise on top of its weight, and the highest sums are taken. Ranks come from ranges of the sorted
   sums, so no task sees them all.

Texts: null and wordless texts have no features and weight 0. Rows of one id and weight are drawn
next to each other in any order; a null id is written as an empty one and comes last among ties.
Empty tables give empty results; without target texts every target count is zero.
"""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import bounded_batches, quoted, text_slices, written
from quadweave.runtime import free_name, with_positions

BUCKETS = 10_000
LONGEST = 3
SEED = 42
SHARE = (5, 100)
MIN_WORDS = 20
GAIN_UNIT = 1_000

# ASCII letters are folded, digits kept, all other ASCII characters are blanks; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text, buckets=BUCKETS, longest=LONGEST) -> tuple[int, np.ndarray]:
    """(words, bucket of every run of one to ``longest`` words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    found = run = list(map(zlib.crc32, words))
    following = [b" " + w for w in words]
    for n in range(1, longest):
        # A longer run's checksum goes on from the shorter one's.
        run = list(map(zlib.crc32, following[n:], run))
        found = found + run
    return len(words), np.fromiter(found, "u4", len(found)) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text="text", buckets=BUCKETS, longest=LONGEST) -> np.ndarray:
    """How often all texts hold each bucket; the result has one number per bucket."""

    def add_up(batches):
        total = np.zeros(buckets, "i8")
        for part in text_slices(batches, 0):
            for t in part.column(0).to_pylist():
                total += np.bincount(features(t, buckets, longest)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype("i4")), pa.array(total[held])], names=["bucket", "n"])

    found = np.zeros(buckets, "i8")
    with bounded_batches(texts.sparkSession):
        rows = texts.select(quoted(text).alias("_text")).mapInArrow(add_up, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for r in rows:
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray, unit=GAIN_UNIT) -> np.ndarray:
    """floor(unit * ln of the ratio of smoothed frequencies) of each bucket, as integers."""
    n, total_source, total_target = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(unit * math.log(float((t + 1) * (total_source + n)) / float((s + 1) * (total_target + n))))
        for s, t in zip(source.tolist(), target.tolist())
    ], "i8")


def planes(values: np.ndarray, signed=False) -> np.ndarray:
    """Bit planes of integers, lowest bit first, packed into 64-bit words.

    ``signed`` values are in two's complement; their last plane weighs negative.
    """
    bits = max(1, int(max(values.max(initial=0), -1 - values.min(initial=0))).bit_length()) + signed
    width = -(-len(values) // 64) * 8
    out = np.zeros((bits, width), "u1")
    packed = np.packbits((values >> np.arange(bits)[:, None]) & 1 == 1, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def sliced_weight(counts: np.ndarray, gain_planes: np.ndarray) -> int:
    """Sum of count times gain over all buckets by popcounts of plane pairs."""
    count_planes = planes(counts)
    ones = np.bitwise_count(count_planes[:, None, :] & gain_planes[None, :, :]).sum(axis=2, dtype="i8").tolist()
    last = len(gain_planes) - 1
    return sum((-n if j == last else n) << (i + j) for i, row in enumerate(ones) for j, n in enumerate(row))


def noise(ident, seed=SEED) -> int:
    """Gumbel noise in thousandths from the hash of an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-GAIN_UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_weights(docs: DataFrame, target: DataFrame, ident="doc_id", text="text", target_text="text", buckets=BUCKETS, longest=LONGEST, seed=SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""
    gain_planes = planes(gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest)), signed=True)

    def weigh(batches):
        for part in text_slices(batches, 1):
            words, sizes, weights = [], [], []
            for t in part.column(1).to_pylist():
                n, found = features(t, buckets, longest)
                words.append(n)
                sizes.append(len(found))
                weights.append(sliced_weight(np.bincount(found, minlength=buckets), gain_planes) if n else 0)
            scores = [w + noise(i, seed) for w, i in zip(weights, part.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in (words, sizes, weights, scores))],
                names=["_id", "n_words", "n_features", "weight", "score"],
            )

    id_type = docs.schema[ident].dataType.simpleString()
    rows = docs.select(quoted(ident).alias("_id"), quoted(text).alias("_text"))
    return written(rows.mapInArrow(weigh, f"_id {id_type}, n_words long, n_features long, weight long, score long"), "weights")


def draw(weighted: DataFrame, share=SHARE, min_words=MIN_WORDS) -> DataFrame:
    """``weighted`` with ``rank``: 1, 2, 3 ... of the drawn documents by score, null for the others.

    Of the documents with ``min_words`` words at least, the given share (a fraction, rounded down).
    """
    fits = weighted.where(F.col("n_words") >= min_words)
    wanted = fits.count() * share[0] // share[1]
    placed = with_positions(fits, [F.col("score").desc(), F.col("_id").asc_nulls_last()], "_place")
    ranked = placed.withColumn("rank", F.when(F.col("_place") < wanted, F.col("_place") + 1)).drop("_place")
    others = weighted.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others)


def resampling_report(docs: DataFrame, target: DataFrame, ident="doc_id", text="text", target_text="text", share=SHARE, min_words=MIN_WORDS, seed=SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document."""
    drawn = draw(importance_weights(docs, target, ident, text, target_text, seed=seed), share, min_words)
    return drawn.select(F.col("_id").alias(ident), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, ident="doc_id", text="text", target_text="text", share=SHARE, min_words=MIN_WORDS, seed=SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; all rows of a drawn id, which must name one document."""
    drawn = draw(importance_weights(docs, target, ident, text, target_text, seed=seed), share, min_words)
    key = free_name("_drawn", docs)
    chosen = drawn.where("rank is not null").select(F.col("_id").alias(key)).distinct()
    return docs.join(chosen.hint("merge"), quoted(ident).eqNullSafe(F.col(key)), "left_semi")
