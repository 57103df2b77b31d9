"""Alignment of two tokenizers over the same text, and how often their ids are linked in a corpus.

1. Both tokenizers encode the text with one blank before it; a token is the range of bytes it stands
   for. A text whose tokens of either side do not spell it (or that is null or empty) has no tokens.
2. Divide and conquer at shared cuts. An interval of tokens starts and ends where both sides do. The
   end of its middle A token is looked up among the B ends by bisection; if it is not there, the end
   nearest to the middle that is. The interval is cut there and both halves go on. An interval
   without a shared end inside is a leaf: one group. All intervals of a slice of documents are
   worked on together, one level of the recursion after the other.
3. Every A and B token of a group are linked. Tasks keep a dictionary of the id pairs they have met,
   in chunks of a bounded number of pairs, and how many documents hold each; only these partial
   counts are shuffled, and added up over the corpus. A document keeps the places of its pairs in
   the dictionary of its chunk.
4. Each chunk then gets the corpus-wide counts of its own pairs, by a join on the pair, and its
   documents look them up. So no task holds more than one chunk's dictionary.

Repeated rows are documents of their own each, whatever their id, and null ids are kept. An empty
table gives an empty result.
"""

import hashlib
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import KEPT_BY_WORKERS, quoted, text_slices, written
from quadweave.llm.tokenizing import _BYTE_LETTERS, _LETTER, SPACED, WordEncoder

#: Pairs in the dictionary of a chunk, beyond which the next slice opens a new chunk.
PAIRS_PER_CHUNK = 300_000
KEPT_WORDS = 150_000
# Marks that no piece has after a letter.
_MARKS = ".,;:!?)\"'"
#: Groups with up to so many links are written out together; others go through their distinct ids.
SMALL_GROUP = 64
#: Ends next to the middle that are tried one by one before the whole interval is looked up.
NEAR_TRIES = 6


class PieceEncoder:
    """Ids of a sentencepiece model as 32-bit integers, one dictionary lookup per word.

    A text can be cut wherever no piece holds the two characters around the cut: before blanks,
    around line ends, and between a letter and one of some punctuation marks. The constructor checks
    that of its vocabulary. Memory is bounded by two generations of words.
    """

    def __init__(self, path, kept_words=KEPT_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        whole = [p for i, p in enumerate(pieces) if not self.model.is_byte(i)]
        if any("▁" in p.lstrip("▁") or "\n" in p or re.search(rf"[{_LETTER}][{_MARKS}]", p) for p in whole):
            raise ValueError("a piece goes over a place where words are cut")
        self.cut = re.compile(rf" *[^ \n{_MARKS}]++(?<=[{_LETTER}])| *[^ \n]+| +|\n").findall
        self.kept_words = kept_words
        self.known, self.older, self.unspelled = {}, {}, set()
        self.token_bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that start with a blank: the model's own blank, which it puts before a text."""
        return _by_words(self, texts)

    def _learn(self, words):
        # No piece goes over a line end: what follows one is encoded without the model's own blank.
        words = list(words)
        found = self.model.encode([w[1:] if w[0] == " " else "\n" + w for w in words], num_threads=1)
        blank = [self.model.piece_to_id("▁")]
        for w, ids in zip(words, found):
            self.known[w] = array("I", (ids or blank) if w[0] == " " else ids[2:]).tobytes()


class ByteEncoder(WordEncoder):
    """Ids of a byte-level vocabulary, and the bytes of each id."""

    def __init__(self, path, kept_words=KEPT_WORDS):
        super().__init__(path, SPACED, kept_words)
        letters = {chr(c): b for b, c in _BYTE_LETTERS.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.unspelled = set()
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.token_bytes[i] = bytes(letters.get(c, ord(c) & 255) for c in entry)

    def encode(self, texts: list[str]) -> list[bytes]:
        return _by_words(self, texts)


def _by_words(encoder, texts) -> list[bytes]:
    """Ids of whole texts from those of their words; nothing for a text that its tokens do not spell."""
    cuts = [encoder.cut(t) for t in texts]
    known = encoder.known
    new = set(chain.from_iterable(cuts)).difference(known)
    if new and len(known) > encoder.kept_words:
        new.update(chain.from_iterable(cuts))
        encoder.older, encoder.known = known, (known := {})
        encoder.unspelled.intersection_update(encoder.older)
    if new:
        older = encoder.older
        known.update((w, older[w]) for w in new if w in older)
        new = new.difference(older)
        encoder._learn(new)
        spelling = encoder.token_bytes.__getitem__
        encoder.unspelled.update(w for w in new if b"".join(map(spelling, memoryview(known[w]).cast("I"))) != w.encode())
    get, bad = known.__getitem__, encoder.unspelled
    return [b"" if bad and not bad.isdisjoint(c) else b"".join(map(get, c)) for c in cuts]


class _Side:
    """An encoder with tables by id: the number of bytes, and the id's decimal writing with each follower."""

    def __init__(self, encoder, last: bytes):
        self.encode = encoder.encode
        self.lengths = np.array([len(b) for b in encoder.token_bytes], "i8")
        # Twice the id: more of the group follow; plus one: the last of its side of the group.
        self.writing = [w for i in range(len(encoder.token_bytes)) for w in (b"%d," % i, b"%d%s" % (i, last))]


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str):
    """One pair of encoders per Python worker; a ``.model`` file is a sentencepiece model."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    a, b = (_Side(PieceEncoder(p) if p.endswith(".model") else ByteEncoder(p), last) for p, last in ((path_a, b"|"), (path_b, b";")))
    return a, b, a.writing + b.writing


KEPT_BY_WORKERS.append(sides.cache_clear)


def shared_cuts(ends_a, ends_b, bounds_a, bounds_b):
    """(a, b): token numbers at which groups start, in order, and the numbers of tokens at the end.

    ``ends`` are ascending byte offsets; ``bounds`` are the token numbers at which documents start
    and the last one ends, both sides at the same byte.
    """
    lo_a, hi_a, lo_b, hi_b = bounds_a[:-1], bounds_a[1:], bounds_b[:-1], bounds_b[1:]
    found_a, found_b = [bounds_a], [bounds_b]

    def look_up(tokens):
        place = np.searchsorted(ends_b, ends_a[tokens])
        return place, ends_b[place] == ends_a[tokens]

    while True:
        # One token on a side leaves no end inside.
        inner = np.flatnonzero((hi_a - lo_a > 1) & (hi_b - lo_b > 1))
        if not len(inner):
            break
        lo_a, hi_a, lo_b, hi_b = lo_a[inner], hi_a[inner], lo_b[inner], hi_b[inner]
        middle = (lo_a + hi_a - 2) // 2
        cut, (place, hit) = middle.copy(), look_up(middle)
        left = np.flatnonzero(~hit)
        for step in range(1, NEAR_TRIES + 1):
            for side in (-step, step):
                at = middle[left] + side
                fits = (at >= lo_a[left]) & (at < hi_a[left] - 1)
                tried, at = left[fits], at[fits]
                where, good = look_up(at)
                cut[tried[good]], place[tried[good]], hit[tried[good]] = at[good], where[good], True
                left = left[~hit[left]]
        # Wider intervals whose middle has no shared end near it are looked up whole.
        for i in left[hi_a[left] - lo_a[left] > 2 * NEAR_TRIES + 2].tolist():
            inside = np.arange(lo_a[i], hi_a[i] - 1)
            where, good = look_up(inside)
            good = np.flatnonzero(good)
            if len(good):
                best = good[np.argmin(np.abs(inside[good] - middle[i]))]
                cut[i], place[i], hit[i] = inside[best], where[best], True
        a, b = cut[hit] + 1, place[hit] + 1
        found_a.append(a)
        found_b.append(b)
        lo_a, hi_a = np.concatenate((lo_a[hit], a)), np.concatenate((a, hi_a[hit]))
        lo_b, hi_b = np.concatenate((lo_b[hit], b)), np.concatenate((b, hi_b[hit]))
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


class Aligned:
    """The groups of a slice of documents."""

    def __init__(self, texts, a_side, b_side, writing):
        spaced = [" " + t if t else "" for t in texts]
        self.rows = len(texts)
        ids_a = [np.frombuffer(x, "<u4") for x in a_side.encode(spaced)]
        ids_b = [np.frombuffer(x, "<u4") for x in b_side.encode(spaced)]
        for i in range(self.rows):
            if not (len(ids_a[i]) and len(ids_b[i])):
                ids_a[i] = ids_b[i] = ids_a[i][:0]
        self.n_a, self.n_b = np.array([len(x) for x in ids_a], "i8"), np.array([len(x) for x in ids_b], "i8")
        self.a, self.b = np.concatenate(ids_a).astype("i8"), np.concatenate(ids_b).astype("i8")
        self.writing, self.b_from = writing, len(a_side.writing)
        # Documents without tokens have no place in a row of byte offsets.
        self.full = np.flatnonzero(self.n_a)
        bounds_a, bounds_b = (np.concatenate(([0], np.cumsum(n[self.full]))) for n in (self.n_a, self.n_b))
        at_a, at_b = shared_cuts(np.cumsum(a_side.lengths[self.a]), np.cumsum(b_side.lengths[self.b]), bounds_a, bounds_b)
        self.at_a, self.at_b = at_a, at_b
        self.sizes_a, self.sizes_b = np.diff(at_a), np.diff(at_b)
        self.doc = self.full[np.searchsorted(bounds_a, at_a[:-1], "right") - 1] if len(self.full) else np.empty(0, "i8")
        self.n_groups = np.bincount(self.doc, minlength=self.rows)
        products = self.sizes_a * self.sizes_b
        self.n_links = np.zeros(self.rows, "i8")
        np.add.at(self.n_links, self.doc, products)
        self.products = products

    def writings(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document; empty without tokens."""
        group_a, group_b = np.repeat(np.arange(len(self.sizes_a)), self.sizes_a), np.repeat(np.arange(len(self.sizes_b)), self.sizes_b)
        # A group's B tokens follow its A tokens, which follow those of all groups before.
        place_a = np.arange(len(self.a)) + self.at_b[group_a]
        place_b = np.arange(len(self.b)) + self.at_a[group_b + 1]
        last_a, last_b = np.zeros(len(self.a), "i8"), np.zeros(len(self.b), "i8")
        last_a[self.at_a[1:] - 1] = 1
        last_b[self.at_b[1:] - 1] = 1
        codes = np.empty(len(self.a) + len(self.b), "i8")
        codes[place_a], codes[place_b] = 2 * self.a + last_a, self.b_from + 2 * self.b + last_b
        words = list(map(self.writing.__getitem__, codes.tolist()))
        ends = np.cumsum(self.n_a + self.n_b)
        return [b"".join(words[e - n : e])[:-1] for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist())]

    def pairs(self):
        """(pairs, document, place of the pair in pairs, times): distinct id pairs of every document.

        A pair is ``a << 32 | b``.
        """
        small = np.flatnonzero(self.products <= SMALL_GROUP)
        n = self.products[small]
        group = np.repeat(small, n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.divmod(k, self.sizes_b[group])
        keys = [self.a[self.at_a[group] + i] << 32 | self.b[self.at_b[group] + j]]
        docs, times = [self.doc[group]], [np.ones(len(group), "i8")]
        for g in np.flatnonzero(self.products > SMALL_GROUP):
            ua, ca = np.unique(self.a[self.at_a[g] : self.at_a[g + 1]], return_counts=True)
            ub, cb = np.unique(self.b[self.at_b[g] : self.at_b[g + 1]], return_counts=True)
            keys.append((ua[:, None] << 32 | ub).ravel())
            times.append((ca[:, None] * cb).ravel())
            docs.append(np.full(len(keys[-1]), self.doc[g]))
        keys, docs, times = np.concatenate(keys), np.concatenate(docs), np.concatenate(times)
        distinct, where = np.unique(keys, return_inverse=True)
        combined = docs * max(1, len(distinct)) + where
        order = np.argsort(combined, kind="stable")
        combined, times = combined[order], times[order]
        first = np.flatnonzero(np.diff(combined, prepend=-1))
        doc, place = np.divmod(combined[first], max(1, len(distinct)))
        return distinct, doc, place, np.add.reduceat(times, first) if len(first) else times


_ROW = "_chunk long, _place int, _pair long, _n long, _id {id}, n_a long, n_b long, n_groups long, n_links long, _sha string, _places binary, _times binary"


def _aligned(docs, ident, text, path_a, path_b, pairs_per_chunk):
    """Rows of documents (``_pair`` null) and of the dictionaries of chunks."""
    id_type = docs.schema[ident].dataType.simpleString()

    def align(batches):
        both_sides = sides(path_a, path_b)
        context = TaskContext.get()
        chunk, known, counts = (context.partitionId() if context else 0) << 24, {}, np.zeros(0, "i8")

        def dictionary():
            for at in range(0, len(known), 50_000):
                keys = np.fromiter(known, "i8", len(known))[at : at + 50_000]
                n = len(keys)
                void = [pa.nulls(n, f.type) for f in schema][4:]
                head = [pa.array(np.full(n, chunk, "i8")), pa.array(np.arange(at, at + n, dtype="i4")), pa.array(keys), pa.array(counts[at : at + n])]
                yield pa.RecordBatch.from_arrays([*head, *void], schema=schema)

        schema = None
        for part in text_slices(batches, 1):
            if schema is None:
                names = ["_chunk", "_place", "_pair", "_n", "_id", "n_a", "n_b", "n_groups", "n_links", "_sha", "_places", "_times"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), part.column(0).type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
                schema = pa.schema(list(zip(names, kinds)))
            if len(known) > pairs_per_chunk:
                yield from dictionary()
                chunk, known, counts = chunk + 1, {}, np.zeros(0, "i8")
            found = Aligned(part.column(1).to_pylist(), *both_sides)
            pairs, doc, place, times = found.pairs()
            local = np.array([known.setdefault(p, len(known)) for p in pairs.tolist()], "i8")
            if len(counts) < len(known):
                counts = np.concatenate((counts, np.zeros(len(known) - len(counts), "i8")))
            counts[local] += np.bincount(place, minlength=len(pairs))
            own = local[place] if len(place) else place
            order = np.lexsort((own, doc))
            own, times, edges = own[order], times[order], np.searchsorted(doc, np.arange(found.rows + 1))
            # Ascending places as steps: small numbers, which compress well.
            places = [np.diff(own[x:y], prepend=0).astype("<u4").tobytes() for x, y in zip(edges[:-1], edges[1:])]
            repeats = [times[x:y].astype("<u8").tobytes() if (times[x:y] >> 32).any() else times[x:y].astype("<u4").tobytes() for x, y in zip(edges[:-1], edges[1:])]
            sha = [hashlib.sha256(w).hexdigest() if w else "" for w in found.writings()]
            n = found.rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk, "i8")), *(pa.nulls(n, t) for t in kinds[1:4]), part.column(0),
                 *(pa.array(x.astype("i8")) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                 pa.array(sha, pa.string()), pa.array(places, pa.binary()), pa.array(repeats, pa.binary())],
                schema=schema,
            )
        if known:
            yield from dictionary()

    rows = docs.select(quoted(ident).alias("_id"), quoted(text).alias("_text")).mapInArrow(align, _ROW.format(id=id_type))
    return written(rows, "aligned")


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, count): how many documents hold each id pair linked."""
    return rows.where("_pair is not null").groupBy("_pair").agg(F.sum("_n").alias("count"))


def alignment_report(docs: DataFrame, path_a: str, path_b: str, ident="doc_id", text="text", pairs_per_chunk=PAIRS_PER_CHUNK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    rows = _aligned(docs, ident, text, path_a, path_b, pairs_per_chunk)
    counts = written(link_counts(rows), "link-counts")
    # One row per id of the A vocabulary: safe to broadcast whatever the input.
    best = counts.groupBy(F.shiftright("_pair", 32).alias("_a")).agg(F.max("count").alias("_most"))
    known = (
        counts.join(F.broadcast(best), F.shiftright("_pair", 32) == F.col("_a"))
        .select("_pair", "count", (F.col("count") == F.col("_most")).alias("_top"))
    )
    wanted = rows.where("_pair is not null").select("_chunk", "_place", "_pair").join(known.hint("merge"), "_pair")
    papers = rows.where("_pair is null").drop("_pair", "_n", "_place")
    both = papers.unionByName(wanted.drop("_pair"), allowMissingColumns=True)
    id_type = docs.schema[ident].dataType.simpleString()

    def look_up(batches):
        chunk, counts, tops = None, [], []
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            chunks, place = col("_chunk").to_numpy(), col("_place")
            is_doc = np.asarray(place.is_null())
            edges = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(is_doc.astype("i1")) != 0)) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(chunks)]):
                if x == y:
                    continue
                if chunks[x] != chunk:
                    chunk, counts, tops = chunks[x], [], []
                if not is_doc[x]:
                    counts.append(col("count").slice(x, y - x).to_numpy(zero_copy_only=False).astype("i8"))
                    tops.append(col("_top").slice(x, y - x).to_numpy(zero_copy_only=False).astype("i8"))
                    continue
                if len(counts) > 1:
                    counts, tops = [np.concatenate(counts)], [np.concatenate(tops)]
                n_best, count_sum = [], []
                for steps, repeats in zip(col("_places").slice(x, y - x).to_pylist(), col("_times").slice(x, y - x).to_pylist()):
                    at = np.cumsum(np.frombuffer(steps, "<u4").astype("i8"))
                    times = np.frombuffer(repeats, "<u4" if len(repeats) == len(steps) else "<u8").astype("i8")
                    n_best.append(int((tops[0][at] * times).sum()) if len(at) else 0)
                    count_sum.append(int((counts[0][at] * times).sum()) if len(at) else 0)
                kept = [col(c).slice(x, y - x) for c in ("_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), col("_sha").slice(x, y - x)],
                    names=["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    # The dictionary of a chunk comes before its documents, in the order of its places.
    dealt = both.repartition("_chunk").sortWithinPartitions("_chunk", F.col("_place").asc_nulls_last())
    found = dealt.mapInArrow(
        look_up, f"_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return written(found, "alignment").withColumnRenamed("_id", ident)


def align_documents(docs: DataFrame, path_a: str, path_b: str, ident="doc_id", text="text") -> DataFrame:
    """(id, n_a, n_b, groups): the alignment itself, groups as ``a1,a2|b1;a3|b2,b3``."""
    id_type = docs.schema[ident].dataType.simpleString()

    def align(batches):
        both_sides = sides(path_a, path_b)
        for part in text_slices(batches, 1):
            found = Aligned(part.column(1).to_pylist(), *both_sides)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found.n_a), pa.array(found.n_b), pa.array([w.decode() for w in found.writings()], pa.string())],
                names=["_id", "n_a", "n_b", "groups"],
            )

    out = docs.select(quoted(ident).alias("_id"), quoted(text).alias("_text")).mapInArrow(align, f"_id {id_type}, n_a long, n_b long, groups string")
    return out.withColumnRenamed("_id", ident)
