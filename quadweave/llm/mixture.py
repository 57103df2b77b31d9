"""Mixing sources to target weights by blocks of words.

1. The words of a source form one stream, its documents in a pseudorandom order, cut into blocks of
   ``block_words``.
2. Sources share 100 % of all words by weight, at most ``max_repeats`` times their size each.
3. Output shards of ``shard_slots`` slots draw their source counts: a multinomial draw conditioned on
   the totals of the mix, so that all shards together meet the targets. The draw is made slot by slot
   through a keyed permutation of all slots; a shard needs no other shard and no driver.
4. A slot's number within its source goes through a keyed permutation of the source's blocks, a new
   one for each pass over the source; the last slot of a source takes only the words it still needs.
5. Slots are joined with the blocks by (source, block).

``mix_slots`` is the mix itself, shard by shard; ``mix_report`` and ``mix_documents`` are made of it.

Texts: a null text has no words; wordless documents take nothing. A null source is a source of its
own, last in order. Rows without an id and repeated rows are documents of their own each. An empty
table gives an empty result. The tables of sources (one row each) reach the driver; all else stays
with the tasks.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from quadweave.llm.common import WORD, WORD_SQL, each_slice, give_back, numbered, written

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
MAX_REPEATS = 3
SEED = 20
#: Buckets of a source's documents at least, and documents of the table per bucket beyond that.
BUCKETS = 64
BUCKET_ROWS = 100_000
#: Sources up to which their table, which the driver holds anyway, is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def cyclic_weights(n: int) -> list[int]:
    """1, 2, 3 in turn."""
    return [1 + i % 3 for i in range(n)]


def share(total: float, sizes: list[int], weights: list[float], max_repeats=MAX_REPEATS) -> list[float]:
    """Targets by weight, none above ``max_repeats`` times its size; what is cut goes to the others."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    rest = float(total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = float(max_repeats * sizes[i])
            rest -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def permute(x: np.ndarray, n: int, key: int, inverse=False, rounds=6) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network on the next even number of bits, walked into range."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(_key(key, r)) for r in range(rounds)]

    def mixed(right, k):
        z = right + k
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) & mask

    def once(v):
        left, right = v >> half, v & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ mixed(left, k), left
        else:
            for k in keys:
                left, right = right, left ^ mixed(right, k)
        return left << half | right

    with np.errstate(over="ignore"):
        v = once(np.asarray(x, "u8"))
        while (out := v >= np.uint64(n)).any():
            v[out] = once(v[out])
    return v.astype("i8")


def slot_plan(size: int, target: float, block_words=BLOCK_WORDS, key=0, max_repeats=MAX_REPEATS) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) so that a source gives round(target) words."""
    want = min(round(target), max_repeats * size)
    if size <= 0 or want <= 0:
        return 0, 0, 0
    blocks = -(-size // block_words)
    short = block_words * blocks - size  # words the last block lacks
    passes, rest = divmod(want, size)
    if rest == 0:
        passes, rest = passes - 1, size
    # Where this pass deals the short block, and how many words k slots of it hold.
    at = int(permute(np.array([blocks - 1]), blocks, _key(key, passes), inverse=True)[0])

    def filled(k):
        return k * block_words - (short if at < k else 0)

    k = -(-rest // block_words)
    k += filled(k) < rest
    return blocks, passes * blocks + k, rest - filled(k - 1)


def deal(slots: np.ndarray, shard: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, number within the source) of each slot of a shard, drawn without replacement.

    All slots of the mix are numbered source by source; a keyed permutation of these numbers says which
    ones a shard's places get. A shard's source counts are thereby a multinomial draw conditioned on
    the totals, for totals of any size, and no slot is drawn twice.
    """
    ends = np.cumsum(slots)
    total = int(ends[-1]) if len(ends) else 0
    drawn = permute(np.arange(shard * shard_slots, min((shard + 1) * shard_slots, total)), total, _key(seed, "deal"))
    source = np.searchsorted(ends, drawn, "right")
    return source, drawn - (ends - slots)[source]


def _row_key(seed, ident, source, text):
    """A keyed hash of a row's id, source and text: its place in its stream, and the key of its text."""
    return F.xxhash64(F.lit(seed), F.col(ident), F.col(source), F.col(text))


def _streams(docs, ident, text, source, block_words, seed):
    """(row columns, source name, size, words of the source before the document).

    The order of a source's documents is that of a keyed hash. Sources are cut into hash buckets, so
    a large source is summed by many tasks: within buckets first, then over the buckets' totals.
    """
    rows = docs.select(F.col(ident).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"), _row_key(seed, ident, source, text).alias("_hash"))
    rows = written(rows, "sizes")
    buckets = max(BUCKETS, rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    totals = written(
        rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_rows")), "source-sizes"
    )
    by_source = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_words").over(by_source), F.lit(0)))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    same = rows["_source"].eqNullSafe(before["_source"]) & (rows["_bucket"] == before["_bucket"])
    streams = rows.join(before.select("_source", "_bucket", "_before"), same).select(
        rows["_id"], rows["_source"], rows["_size"], rows["_hash"], (F.col("_before") + F.col("_inside")).alias("_start")
    )
    return written(streams, "streams"), totals


def source_plan(totals: DataFrame, weights=None, block_words=BLOCK_WORDS, max_repeats=MAX_REPEATS, seed=SEED) -> list[dict]:
    """One row per source in order of code points, null last: its size, target, blocks and slots."""
    found = totals.groupBy("_source").agg(F.sum("_words").alias("size")).collect()
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [r["size"] for r in found]
    weights = weights or cyclic_weights(len(sizes))
    plan = []
    for i, (r, t) in enumerate(zip(found, share(sum(sizes), sizes, weights, max_repeats))):
        blocks, slots, last = slot_plan(r["size"], t, block_words, _key(seed, i), max_repeats)
        plan.append({"source": r["_source"], "index": i, "size": r["size"], "target": t, "blocks": blocks, "slots": slots, "last": last})
    return plan


def _slots(spark, plan, shard_slots, seed):
    """(source index, block, pass, words or -1 for all, shard, slot) of every slot of the mix."""
    slots = np.array([p["slots"] for p in plan], "i8")
    shards = max(1, -(-int(slots.sum()) // shard_slots))
    facts = [(p["blocks"], p["slots"], p["last"]) for p in plan]

    def draw(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                source, number = deal(slots, shard, shard_slots, seed)
                order = np.argsort(source, kind="stable")
                columns = [[], [], [], [], [], []]
                for slot in np.split(order, np.flatnonzero(np.diff(source[order])) + 1) if len(order) else []:
                    i = int(source[slot[0]])
                    blocks, total, last = facts[i]
                    k = number[slot]
                    passes = k // blocks
                    block = np.empty_like(k)
                    for p in np.unique(passes):
                        at = passes == p
                        block[at] = permute(k[at] % blocks, blocks, _key(_key(seed, i), p))
                    words = np.where(k == total - 1, last, -1)
                    for column, values in zip(columns, (np.full(len(k), i), block, passes, words, np.full(len(k), shard), slot)):
                        column.append(values)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c).astype("i8")) for c in columns], names=["_index", "_block", "_pass", "_words", "_shard", "_slot"]
                    )

    tasks = max(1, min(shards, spark.sparkContext.defaultParallelism * 8))
    return spark.range(0, shards, 1, tasks).mapInArrow(draw, "_index long, _block long, _pass long, _words long, _shard long, _slot long")


def _taken(docs, ident, text, source, weights, block_words, shard_slots, max_repeats, seed):
    """(streams, plan frame, pieces): pieces of documents that slots take, as ranges of words."""
    spark = docs.sparkSession
    streams, totals = _streams(docs, ident, text, source, block_words, seed)
    plan = source_plan(totals, weights, block_words, max_repeats, seed)
    names = spark.createDataFrame(
        [(p["source"], p["index"], p["size"], p["target"]) for p in plan], f"_plan_source {docs.schema[source].dataType.simpleString()}, _index long, _source_size long, _target double"
    )
    if len(plan) <= BROADCAST_SOURCES:
        names = F.broadcast(names)
    streams = streams.join(names, F.col("_source").eqNullSafe(F.col("_plan_source"))).drop("_plan_source")
    b = F.lit(block_words)
    parts = streams.where("_size > 0").select(
        "_id", "_hash", "_start", "_size", "_index",
        F.explode(F.sequence(F.floor(F.col("_start") / b), F.floor((F.col("_start") + F.col("_size") - 1) / b))).alias("_block"),
    )
    # Written, so that the join knows how many slots there are: a plan would take them for a handful.
    slots = written(_slots(spark, plan, shard_slots, seed), "slots")
    # A block's end within its document, cut where the last slot of a source stops early.
    end = F.least(
        F.col("_start") + F.col("_size"),
        F.col("_block") * b + F.when(F.col("_words") >= 0, F.col("_words")).otherwise(b),
    )
    begin = F.greatest("_start", F.col("_block") * b)
    pieces = parts.join(slots, ["_index", "_block"]).select(
        "_id", "_hash", "_index", "_start", "_block", "_pass", "_shard", "_slot", (begin - F.col("_start")).alias("_from"), (end - F.col("_start")).alias("_to")
    ).where("_to > _from")
    return streams, pieces


def mix_slots(docs: DataFrame, ident="doc_id", text="text", source="source", weights=None, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, max_repeats=MAX_REPEATS, seed=SEED) -> DataFrame:
    """(shard, slot, source_index, pass, block, place, doc_id, first, end): the mix, a row per slot and document.

    A slot holds the words ``first`` to ``end`` (excluded, from 0) of its documents, in the order of ``place``,
    the document's start in its source. Sources are numbered in order of code points, null last.
    """
    _, pieces = _taken(docs, ident, text, source, weights, block_words, shard_slots, max_repeats, seed)
    return pieces.select(
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_index").alias("source_index"), F.col("_pass").alias("pass"),
        F.col("_block").alias("block"), F.col("_start").alias("place"), F.col("_id").alias(ident), F.col("_from").alias("first"), F.col("_to").alias("end"),
    )


def mix_report(docs: DataFrame, ident="doc_id", text="text", source="source", weights=None, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, max_repeats=MAX_REPEATS, seed=SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    streams, pieces = _taken(docs, ident, text, source, weights, block_words, shard_slots, max_repeats, seed)
    # Source and place in its stream name a document, whatever its id.
    taken = pieces.groupBy("_index", "_start", "_id").agg(F.sum(F.col("_to") - F.col("_from")).alias("taken"))
    taken = taken.select(F.col("_index").alias("_i"), F.col("_start").alias("_s"), "taken", F.lit(True).alias("_has"))
    same = (F.col("_index") == F.col("_i")) & (F.col("_start") == F.col("_s")) & (F.col("_size") > 0)
    return streams.join(taken, same, "left").select(
        F.col("_id").alias(ident), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def _cut(text, spans):
    """The words of ``text`` in the given ranges, white space inside a range kept."""
    words = [m.span() for m in WORD.finditer(text)]
    runs = []
    for a, b in spans:
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    if runs == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)


@F.arrow_udf(StringType())
def _cut_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = pa.StructArray.from_arrays([texts, spans], names=["text", "spans"])
    parts = each_slice(rows, lambda part: pa.array(
        [_cut(r["text"], [(s["_from"], s["_to"]) for s in r["spans"]]) for r in part], pa.string()
    ))
    give_back()
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def mix_documents(docs: DataFrame, ident="doc_id", text="text", source="source", chars="n_chars", weights=None, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, max_repeats=MAX_REPEATS, seed=SEED) -> DataFrame:
    """The mix as documents: one row per document and pass over its source, with the words taken in it.

    Columns are those of ``docs``; ``chars``, if there, is the length of the new text. A document
    taken whole keeps its text as it is.
    """
    columns = docs.columns
    docs, ident, text, source, *chars = numbered(docs, ident, text, source, *([chars] if chars in columns else []))
    streams, pieces = _taken(docs, ident, text, source, weights, block_words, shard_slots, max_repeats, seed)
    spans = pieces.groupBy("_index", "_start", "_pass").agg(F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("_spans"))
    # Rows with one key are numbered alike on both sides: by id and source, repeated rows in any order.
    number = lambda *order: F.row_number().over(Window.partitionBy("_mix_key").orderBy(*order))
    taken = (
        streams.select("_id", F.col("_hash").alias("_mix_key"), "_source", "_index", "_start", "_size")
        .withColumn("_mix_n", number("_id", "_source", "_start"))
        # A wordless document starts where the next one does.
        .where("_size > 0").join(spans, ["_index", "_start"]).select("_mix_key", "_mix_n", "_spans")
    )
    rows = docs.select(*docs.columns, _row_key(seed, ident, source, text).alias("_mix_key")).withColumn("_mix_n", number(ident, source))
    a, b = rows.alias("a"), taken.hint("merge").alias("b")
    # The texts are shuffled and sorted once, by the key that the numbers are dealt by: so the join
    # has no other key, and the numbers are compared by their difference.
    same = (F.col("a._mix_key") == F.col("b._mix_key")) & (F.col("a._mix_n") - F.col("b._mix_n") == 0)
    mixed = a.join(b, same).select(*[F.col(f"a.`{c}`") for c in docs.columns], F.col("b._spans"))
    mixed = mixed.withColumn(text, _cut_text(F.col(text), F.col("_spans"))).drop("_spans")
    for c in chars:
        mixed = mixed.withColumn(c, F.length(text).cast(docs.schema[c].dataType))
    return mixed.select(*docs.columns).toDF(*columns)
