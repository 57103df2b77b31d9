"""SimHash near-duplicates with pigeonring candidates.

A fingerprint has 64 bits in ``SEGMENTS`` segments on a ring. If two fingerprints differ in at most
``DISTANCE`` bits, some start ``i`` exists from which every chain of ``l`` consecutive segments
differs in at most ``l * DISTANCE / SEGMENTS`` bits. With five segments and four bits the first
segment of that chain is equal, two differ in at most one bit, three in two, four in three. Rows
meet on (start, first segment, second segment with at most one bit masked out), the further chain
sums prune, and only then the whole fingerprints are compared.

Work is done on distinct fingerprints: exact copies fold into one row before anything is compared.
Fingerprints that meet are joined into trees inside their task, so a group of ``n`` gives at most
``n - 1`` links; a group too large for one task is cut into blocks, and every two blocks meet in a
task of their own. No candidate is dropped.

Texts: a null or wordless text has fingerprint zero, which links like any other. Fewer words than a
shingle make one shingle. Repeated rows each get a row. A null id takes part through its
fingerprint; its class carries the smallest id that is there, or null. Empty tables give empty
results.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from quadweave.llm.common import each_slice, give_back, numbered, slices, written
from quadweave.operators.clusters import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 5
#: Distinct fingerprints one task compares with each other; larger groups are cut into blocks.
BLOCK = 20_000
#: Groups up to this size are compared as one matrix.
SMALL = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text, n=SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, "u8")
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(line, SEED)], "u8")
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())),
        "u8", len(words) - n + 1,
    )


def fingerprint(text, n=SHINGLE) -> int:
    """Bit ``b`` is set if it is set in over half of the hashes."""
    h = shingle_hashes(text, n)
    if not len(h):
        return 0
    counts = np.zeros(64, "i8")
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    bits = 2 * counts > len(h)
    return int(np.packbits(bits, bitorder="little").view("u8")[0])


def fingerprints(docs: DataFrame, ident="doc_id", text="text", n=SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""
    id_type = docs.schema[ident].dataType.simpleString()

    def each(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[ident, "fp"])
        give_back()

    return docs.select(F.col(ident), F.col(text)).mapInArrow(each, f"{ident} {id_type}, fp long")


def segment_bounds(segments=SEGMENTS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment; widths differ by one at most."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _near(x, y, masks, budgets):
    """Which rows of ``x`` and ``y`` pass every chain sum from the start; they broadcast."""
    differ = x ^ y
    total = np.zeros(differ.shape, "u1")
    alive = np.ones(differ.shape, bool)
    for mask, budget in zip(masks, budgets):
        total += np.bitwise_count(differ & mask)
        alive &= total <= budget
    return alive


def _forest(x: np.ndarray, start, bounds, distance) -> list[tuple[int, int]]:
    """Links of a spanning forest of the rows of ``x`` that the ring chain from ``start`` finds.

    Rows share the segment ``start``. Few rows are compared at once. Many are sorted by the second
    segment with one bit masked out, for each bit, and meet within runs of equal values.
    """
    ring = [bounds[(start + k) % len(bounds)] for k in range(len(bounds))]
    masks = [np.uint64(((1 << w) - 1) << low) for low, w in ring]
    budgets = [k * distance // len(bounds) for k in range(1, len(bounds) + 1)]
    signed, label, links = x.view("i8"), np.arange(len(x)), []

    def meet(p, others):
        """Link row ``p`` to one of ``others`` in each tree but its own."""
        others = others[label[others] != label[p]]
        if len(others):
            trees, first = np.unique(label[others], return_index=True)
            links.extend((int(signed[p]), int(signed[q])) for q in others[first])
            label[np.isin(label, trees)] = label[p]

    if len(x) <= SMALL:
        one, two = np.nonzero(np.triu(_near(x[:, None], x[None, :], masks, budgets), 1))
        for p, q in zip(one.tolist(), two.tolist()):
            meet(p, np.array([q]))
        return links
    low, width = ring[1]
    for bit in range(width):
        key = x & masks[1] & ~np.uint64(1 << (low + bit))
        order = np.argsort(key, kind="stable")
        runs = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0, [True])))
        for a in np.flatnonzero(np.diff(runs) > 1):
            rows = order[runs[a] : runs[a + 1]]
            for i, p in enumerate(rows[:-1]):
                rest = rows[i + 1 :]
                rest = rest[label[rest] != label[p]]
                if len(rest):
                    meet(p, rest[_near(x[rest], x[p], masks, budgets)])
    return links


def linked(fps: DataFrame, distance=DISTANCE, segments=SEGMENTS, block=BLOCK) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints ``fp`` within ``distance`` bits.

    The links hold a path between any two fingerprints that a chain of near pairs joins; links that
    add nothing to that within a task are left out. ``distance`` must be under ``segments``, so
    that the first segment of a chain is equal.
    """
    if distance >= segments:
        raise ValueError("the first segment of a chain must be equal: distance < segments")
    bounds = segment_bounds(segments)
    ring = F.explode(F.array(*[
        F.struct(F.lit(i).alias("start"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << w) - 1)).alias("part"))
        for i, (low, w) in enumerate(bounds)
    ])).alias("k")
    rows = fps.select("fp", ring).select("fp", "k.start", "k.part")
    # At most 2^width values for each segment, 40,960 rows with the defaults: safe to broadcast.
    sizes = F.broadcast(rows.groupBy("start", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Groups of one need no task. A group of n is cut into b blocks; row of block i goes to (i, j) for all j.
    rows = (
        rows.join(sizes.withColumn("b", F.ceil(F.col("n") / block).cast("int")), ["start", "part"])
        .withColumn("i", F.pmod(F.xxhash64("fp"), F.col("b")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
        .select("start", "part", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")
    )

    def trees(batches):
        """Rows come sorted by group; one group at a time is held."""
        key, held = None, []

        def flush():
            if key is None:
                return None
            x = np.unique(np.concatenate(held).view("u8"))
            found = _forest(x, key[0], bounds, distance) if len(x) > 1 else []
            return found

        out = []
        for batch in batches:
            names = batch.schema.names
            cols = [batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("start", "part", "lo", "hi")]
            fp = batch.column(names.index("fp")).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1 if len(fp) else []
            edges = [0, *map(int, change), len(fp)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in cols)
                if now != key:
                    out += flush() or []
                    key, held = now, []
                held.append(fp[a:b])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
                out = []
        out += flush() or []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])

    return (
        rows.repartition("start", "part", "lo", "hi").sortWithinPartitions("start", "part", "lo", "hi")
        .mapInArrow(trees, "u long, v long")
    )


def _classes(docs, ident, text, distance):
    """(rows: id, fp), (names: fp, component, component_id)."""
    prints = written(fingerprints(docs, ident, text), "fingerprints")
    folded = written(prints.groupBy("fp").agg(F.min(ident).alias("low")), "fingerprints-folded")
    parts = connected_components(linked(folded.select("fp"), distance))
    joined = written(
        folded.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
        .select("fp", "low", F.coalesce("component", "fp").alias("component")),
        "fingerprint-classes",
    )
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    return prints, joined.join(lows, "component").select("fp", "component", "component_id")


def near_duplicate_classes(docs: DataFrame, ident="doc_id", text="text", distance=DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 hex digits, smallest id reachable over links."""
    prints, names = _classes(docs, ident, text, distance)
    return prints.join(names, "fp").select(
        ident, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@F.arrow_udf(LongType())
def _fingerprint_of(texts: pa.Array) -> pa.Array:
    parts = each_slice(texts, lambda part: [fingerprint(t) for t in part])
    return pa.array(np.array([x for part in parts for x in part], "u8").view("i8"))


def drop_near_duplicates(docs: DataFrame, ident="doc_id", text="text", distance=DISTANCE) -> DataFrame:
    """One row of each class, with all columns of ``docs``: the row with the smallest id.

    Of rows that repeat that id within the class one stays. A class without any id keeps one row.
    """
    columns = docs.columns
    docs, ident, text = numbered(docs, ident, text)
    prints, names = _classes(docs, ident, text, distance)
    kept = written(
        # An id's rows in classes of other ids count as well: the id alone does not tell which of its rows stays.
        prints.join(names, "fp").groupBy(F.col(ident).alias("_near_id"))
        .agg(F.count(F.lit(1)).alias("_near_n"), F.max(F.col(ident).eqNullSafe(F.col("component_id"))).alias("_near_low"))
        .where("_near_low").drop("_near_low"),
        "kept-ids",
    )
    same = F.col(ident) == F.col("_near_id")
    # Texts are shuffled at every size: a plan that broadcasts the ids of small inputs only does not tell how it grows.
    result = docs.join(kept.where("_near_n = 1").hint("merge"), same).select(*docs.columns)
    if kept.where("_near_n > 1 or _near_id is null").limit(1).count():
        # Repeated or missing ids: the class of each such row decides.
        again = docs.join(kept.where("_near_n > 1"), same).select(*docs.columns)
        unnamed = docs.where(F.col(ident).isNull())
        rare = again.unionByName(unnamed).withColumn("_near_fp", _fingerprint_of(F.col(text)))
        names = names.select(F.col("fp").alias("_near_fp"), F.col("component").alias("_near_class"), F.col("component_id").alias("_near_low"))
        result = result.unionByName(
            rare.join(names, "_near_fp").where(F.col(ident).eqNullSafe(F.col("_near_low")))
            .dropDuplicates(["_near_class"]).select(*docs.columns)
        )
    return result.toDF(*columns)
