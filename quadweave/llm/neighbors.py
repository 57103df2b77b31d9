"""Nearest neighbours over randomly rotated one-bit codes.

A vector is scaled to length one and rotated by a random orthogonal matrix; its code keeps the sign
of each coordinate, one bit each, packed. With the code goes one correction: the inner product of
the rotated vector with its own code. For a query the inner product with a code is estimated from
packed bits only (the query is cut into bit planes) and divided by the correction; the same scalars
bound the error of the estimate. Only candidates whose upper bound reaches the k-th best lower
bound are compared on the original vectors, in double precision.

Queries meet all candidates, block by block: rows are dealt into blocks of bounded size by a hash,
and a task holds one block of queries and one of candidates. Each returns its best ``k`` per query,
and the best of those are ranked. Nothing is sampled; the rotation needs no training.

Vectors that are null, zero, or that hold null or non-finite values take no part, nor do rows without
an id. Vectors meet those of their own length, whatever lengths there are. Every row counts, also where
an id repeats: each such row is a candidate, and a query with answers of its own (ranked by themselves);
only the query's own row is no answer. Ties go to the smaller id. Fewer than ``k`` candidates give as
many rows. Empty tables give empty results.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quadweave.llm.common import written

K = 5
SEED = 5
#: Standard deviations of the estimate's error that the bound allows.
BOUND = 4.0
PLANES = 8
QUERY_BLOCK = 1_024
CANDIDATE_BLOCK = 8_192


@lru_cache(maxsize=4)
def rotation(dim: int, seed=SEED) -> np.ndarray:
    """A random orthogonal matrix of ``dim`` rounded up to full words of 64 bits."""
    size = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, inner product of each unit vector with its own code)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn.T
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view("u8")
    return bits, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])


def _planes(queries: np.ndarray, turn: np.ndarray, planes=PLANES):
    """Rotated unit queries cut into ``planes`` bits: (bit planes, lowest value, step, sum of levels)."""
    turned = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ turn.T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**planes - 1), 1e-12)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype("u2")
    packed = np.stack([np.packbits(levels >> p & 1, axis=1, bitorder="little").view("u8") for p in range(planes)])
    return packed, low, step, levels.sum(axis=1).astype("f8")


def estimates(queries: np.ndarray, bits: np.ndarray, own: np.ndarray, turn: np.ndarray, bound=BOUND):
    """(estimated cosines, half widths of their bounds), one row per query."""
    size = turn.shape[0]
    planes, low, step, levels = _planes(queries, turn)
    ones = np.bitwise_count(bits).sum(axis=1, dtype="i8").astype("f8")
    common = np.zeros((len(queries), len(bits)))
    for p in range(len(planes)):
        for w in range(bits.shape[1]):
            common += float(1 << p) * np.bitwise_count(planes[p][:, None, w] & bits[None, :, w])
    # Sum over set bits of the query's coordinates, then over all with sign.
    set_sum = low[:, None] * ones + step[:, None] * common
    total = low * size + step * levels
    inner = (2 * set_sum - total[:, None]) / np.sqrt(size)
    width = bound * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(size - 1, 1))
    # The cut of the query into levels moves a coordinate by half a step at most.
    return inner / own, width[None, :] + (step[:, None] / 2 * np.sqrt(size)) / own[None, :]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed coordinate by coordinate, so equal vectors give equal values."""
    dot, own, other = np.zeros(len(vectors)), 0.0, np.zeros(len(vectors))
    for i in range(len(query)):
        dot += query[i] * vectors[:, i]
        own += query[i] * query[i]
        other += vectors[:, i] * vectors[:, i]
    return dot / (np.sqrt(own) * np.sqrt(other))


def clean_vectors(df: DataFrame, ident="vec_id", vector="embedding") -> DataFrame:
    """(row, id, vector as doubles) of the rows that take part; ``row`` holds once the result is written."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        df.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        .where(finite & F.exists("v", lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "id", "v")
    )


def build_index(df: DataFrame, ident="vec_id", vector="embedding", seed=SEED) -> DataFrame:
    """(row, id, v, bits, own) of every vector that takes part; written to the shared folder."""

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2))
            for dim in pc.unique(sizes).to_pylist():
                part = batch.filter(pc.equal(sizes, dim))
                bits, own = codes(part.column(2).flatten().to_numpy().reshape(part.num_rows, dim), rotation(dim, seed))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(own)], names=["row", "id", "v", "bits", "own"]
                )

    rows = written(clean_vectors(df, ident, vector), "vectors")
    return written(rows.mapInArrow(run, "row long, id long, v array<double>, bits binary, own double"), "index")


def _best(queries, candidates, dim, k, seed):
    """(query row, query, id, score): per query the best ``k`` of one block, found through the bounds."""
    turn = rotation(dim, seed)
    qrow, qid, q = queries
    crow, cid, v, bits, own = candidates
    out = []
    for a in range(0, len(qid), 64):
        est, width = estimates(q[a : a + 64], bits, own, turn)
        for i in range(len(est)):
            other = crow != qrow[a + i]
            lower, upper = est[i] - width[i], est[i] + width[i]
            if other.sum() > k:
                floor = np.partition(lower[other], -k)[-k]
                rerank = np.flatnonzero(other & (upper >= floor))
            else:
                rerank = np.flatnonzero(other)
            if not len(rerank):
                continue
            exact = cosines(q[a + i], v[rerank])
            top = np.lexsort((cid[rerank], -exact))[:k]
            out += [(int(qrow[a + i]), int(qid[a + i]), int(cid[rerank[t]]), float(exact[t])) for t in top]
    return out


def search(index: DataFrame, queries: DataFrame, k=K, query_block=QUERY_BLOCK, candidate_block=CANDIDATE_BLOCK, seed=SEED) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows of the index for each query row.

    ``queries`` are rows of the index (a query's own row is no answer).
    """
    n, m = index.count(), queries.count()
    blocks, groups = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    dim = F.size("v").alias("dim")
    left = index.select(
        "row", "id", "v", "bits", "own", dim, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    )
    # Own names: a cogroup of frames with common attributes loses columns.
    right = queries.select(
        F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("query"), dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64(F.lit(1), F.col("row")), F.lit(groups)).cast("int").alias("part")
    )

    def matrix(table, name):
        column = table.column(name).combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def meet(key, l: pa.Table, r: pa.Table) -> pa.Table:
        rows = []
        if l.num_rows and r.num_rows:
            bits = np.frombuffer(b"".join(l.column("bits").to_pylist()), "u8").reshape(l.num_rows, -1)
            rows = _best(
                (r.column("query_row").to_numpy(), r.column("query_id").to_numpy(), matrix(r, "query")),
                (l.column("row").to_numpy(), l.column("id").to_numpy(), matrix(l, "v"), bits, l.column("own").to_numpy()), key[0].as_py(), k, seed,
            )
        return pa.table({
            "query_row": pa.array([x[0] for x in rows], pa.int64()), "query_id": pa.array([x[1] for x in rows], pa.int64()),
            "vec_id": pa.array([x[2] for x in rows], pa.int64()), "score": pa.array([x[3] for x in rows], pa.float64()),
        })

    found = left.groupBy("dim", "block", "part").cogroup(right.groupBy("dim", "block", "part")).applyInArrow(meet, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def nearest(df: DataFrame, every=50, k=K, ident="vec_id", vector="embedding", seed=SEED) -> DataFrame:
    """The ``k`` nearest others of every row whose id is divisible by ``every``."""
    index = build_index(df, ident, vector, seed)
    return search(index, index.where(F.col("id") % every == 0), k, seed=seed)
