"""Indel similarity of string pairs in Arrow batches.

The kernel computes longest common subsequences bit-parallel: numpy words for strings of up to 64
characters, Python integers beyond. It is shipped to the executors by value, so they need numpy
and pyarrow only.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCK = 4096


def _lcs_block(a, b, la, lb):
    """LCS lengths of strings of at most 64 characters, one machine word per pair."""
    wa, wb = int(la.max()), int(lb.max())
    ca = np.array(a, dtype=f"U{wa}").view(np.uint32).reshape(len(a), wa)
    cb = np.array(b, dtype=f"U{wb}").view(np.uint32).reshape(len(b), wb)
    state = np.full(len(a), ~np.uint64(0))
    packed = np.zeros((len(a), 8), dtype=np.uint8)
    for j in range(wb):
        hits = (ca == cb[:, j : j + 1]) & (j < lb)[:, None]
        bits = np.packbits(hits, axis=1, bitorder="little")
        packed[:, : bits.shape[1]] = bits
        match = packed.view("<u8").ravel()
        used = state & match
        state = (state + used) | (state - used)
    mask = np.where(la >= 64, ~np.uint64(0), (np.uint64(1) << la.astype(np.uint64) % 64) - np.uint64(1))
    return np.bitwise_count(~state & mask).astype(np.int64)


def _lcs_long(a, b):
    """LCS length by bit-parallel arithmetic on an arbitrarily long word."""
    where = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        used = state & where.get(ch, 0)
        state = ((state + used) | (state - used)) & full
    return len(a) - state.bit_count()


def indel_ratios(a, b):
    """Indel similarity of two equally long lists of strings, as a float array."""
    la = np.fromiter((len(x) for x in a), dtype=np.int64, count=len(a))
    lb = np.fromiter((len(x) for x in b), dtype=np.int64, count=len(b))
    total = la + lb
    lcs = np.zeros(len(a), dtype=np.int64)
    plain = np.fromiter(
        ("\0" not in x and "\0" not in y for x, y in zip(a, b)), dtype=bool, count=len(a)
    )
    short = np.flatnonzero((la > 0) & (lb > 0) & (la <= 64) & (lb <= 64) & plain)
    short = short[np.argsort(total[short], kind="stable")]
    for start in range(0, len(short), _BLOCK):
        idx = short[start : start + _BLOCK]
        lcs[idx] = _lcs_block([a[i] for i in idx], [b[i] for i in idx], la[idx], lb[idx])
    rest = (la > 0) & (lb > 0) & ~((la <= 64) & (lb <= 64) & plain)
    for i in np.flatnonzero(rest):
        lcs[i] = _lcs_long(a[i], b[i])
    return np.where(total == 0, 1.0, 1.0 - (total - 2 * lcs) / np.maximum(total, 1))


def ratio_array(a: pa.Array, b: pa.Array) -> pa.Array:
    """Indel ratios of two Arrow string arrays; each distinct pair is computed once."""
    known = pc.and_(a.is_valid(), b.is_valid())
    out = np.full(len(a), np.nan)
    rows = np.flatnonzero(known.to_numpy(zero_copy_only=False))
    if len(rows):
        ea, eb = a.take(pa.array(rows)).dictionary_encode(), b.take(pa.array(rows)).dictionary_encode()
        code = ea.indices.to_numpy().astype(np.int64) * len(eb.dictionary) + eb.indices.to_numpy()
        uniq, inverse = np.unique(code, return_inverse=True)
        wa, wb = ea.dictionary.to_pylist(), eb.dictionary.to_pylist()
        ratios = indel_ratios(
            [wa[c // len(wb)] for c in uniq.tolist()], [wb[c % len(wb)] for c in uniq.tolist()]
        )
        out[rows] = ratios[inverse]
    return pa.array(out, mask=~known.to_numpy(zero_copy_only=False))


def ratio_of_values(a: pa.Array, b: pa.Array) -> pa.Array:
    return ratio_array(a, b)


def ratio_of_lists(a: pa.Array, b: pa.Array) -> pa.Array:
    flat = ratio_array(a.flatten(), b.flatten())
    sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, flat)


def indel_ratio(a, b):
    """1 - (|a|+|b|-2 LCS)/(|a|+|b|); null when either side is null."""
    return arrow_udf(ratio_of_values, DoubleType())(a, b)


def indel_ratio_lists(a, b):
    """Element-wise :func:`indel_ratio` of two arrays of equal length."""
    return arrow_udf(ratio_of_lists, ArrayType(DoubleType()))(a, b)
