"""Scores of all pairs that meet in a cell of blocking keys, in Arrow batches.

A cell holds rows of one key, sorted next to each other. Common words of all its pairs are counted at
once, as a product of word matrices; comparators are then applied to arrays of pairs. A pair never
becomes a row unless it is proposable: rows are counts of pairs that ended alike. The arithmetic is
that of ``operators.compare``, step by step, in double precision. Shipped to the executors by value,
so they need numpy and pyarrow only.
"""

import json
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Comparators that are worked out here.
COMPARATORS = ("text", "exact", "date", "number")
# Rows of small cells that are looked at together.
_TOGETHER = 64
# Words that one product of matrices looks at; its cells, combinations of values and ended pairs held at once.
_WORDS, _COMBINED, _COMBOS, _ENDED = 2048, 8_000_000, 1_000_000, 400_000
# Pairs of situations whose verdict is remembered.
_VERDICTS = 1_000_000
_OUTCOMES = ("INSUFFICIENT_EVIDENCE", "BELOW_THRESHOLD", "PROPOSABLE")
_EVIDENCE = pa.struct([("concept", pa.string()), ("comparator", pa.string()), ("weight", pa.float64()), ("score", pa.float64()),
                       ("no", pa.int32()), ("pos_a", pa.int32()), ("pos_b", pa.int32())])
SCHEMA = pa.schema([
    ("source_a", pa.string()), ("source_b", pa.string()), ("rank", pa.int32()), ("group_order", pa.int32()), ("reason", pa.string()),
    ("feasible", pa.bool_()), ("score", pa.float64()), ("outcome", pa.string()), ("class_a", pa.string()), ("class_b", pa.string()),
    ("compared_weight", pa.float64()), ("evidence", pa.list_(_EVIDENCE)), ("pairs", pa.int64())])
#: The columns of a cell's rows, as Spark types.
ROWS = ("rank int, key string, cell_i int, cell_j int, part int, class_id string, source string, situation string, n long, "
        "earlier array<string>, values array<struct<c:int,pos:int,word:string,words:string,start:int,end:int,precise:boolean,number:double>>")


@dataclass
class Rules:
    """A group's configuration: (key, comparator, weight, case sensitive, partial, tolerance) of each concept, in order."""

    group_order: int
    concepts: list
    required: list
    minimum_weight: float
    threshold: float


def round4(x):
    return np.floor(x * 10000 + 0.5) / 10000.0


def common_words(lists, left, right):
    """Sizes of the intersections of word lists without duplicates: a matrix of ``left`` by ``right`` (numbers of lists)."""
    sizes = np.diff(lists.offsets.to_numpy())
    codes = lists.flatten().dictionary_encode().indices.to_numpy()
    owner = np.repeat(np.arange(len(lists)), sizes)
    # A word of one list is in no intersection.
    often = np.bincount(codes, minlength=1) > 1
    number, known = np.cumsum(often) - 1, int(often.sum())
    codes, owner = number[codes[often[codes]]], owner[often[codes]]
    out = np.zeros((len(left), len(right)))
    for low in range(0, known, _WORDS):
        some = (codes >= low) & (codes < low + _WORDS)
        held = np.zeros((len(lists), min(_WORDS, known - low)), dtype=np.float32)
        held[owner[some], codes[some] - low] = 1
        out += held[left] @ held[right].T
    return out


def _lists(texts):
    """Texts of words with one space between them as lists; null and empty texts are empty lists."""
    texts = pc.fill_null(texts, "")
    split = pc.split_pattern(texts, " ")
    flat = split.flatten()
    sizes = split.value_lengths().to_numpy().astype(np.int64)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pa.array(~np.repeat(empty, sizes)))
        sizes[empty] = 0
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def _codes(strings):
    """Equal numbers for equal strings; -1 for null."""
    return pc.fill_null(strings.dictionary_encode().indices, -1).to_numpy()


def _floats(column):
    return pc.fill_null(column.cast(pa.float64()), np.nan).to_numpy()


class _Values:
    """The values of one concept in a block: ``first`` and ``count`` by row, in the order of their positions."""

    def __init__(self, columns, at, owner, rows):
        self.owner = owner
        self.count = np.bincount(owner, minlength=rows)
        self.first = np.cumsum(self.count) - self.count
        self.columns = {k: v.take(pa.array(at)) for k, v in columns.items()}
        self.pos = self.columns["pos"].to_numpy()


def _comparator(values, concept, left, right):
    """(score of (value, value), which may be NaN for null) of a concept, from numbers of its values."""
    _, how, _, _, partial, tolerance = concept
    col = values.columns
    if how == "text":
        lists = _lists(col["words"])
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        places = {}
        for side, rows in (("l", left), ("r", right)):
            there = np.zeros(len(values.count), dtype=bool)
            there[rows] = True
            ids = np.flatnonzero(there[values.owner])
            place = np.full(len(lists), -1)
            place[ids] = np.arange(len(ids))
            places[side] = ids, place
        common = common_words(lists, places["l"][0], places["r"][0])

        def text(x, y):
            both = common[places["l"][1][x], places["r"][1][y]]
            with np.errstate(invalid="ignore", divide="ignore"):
                return np.where((size[x] > 0) & (size[y] > 0), both / (size[x] + size[y] - both), np.nan)

        return text
    if how == "exact":
        codes = _codes(col["word"])
        blank = pc.fill_null(pc.equal(col["word"], ""), True).to_numpy(zero_copy_only=False)
        return lambda x, y: np.where(blank[x] | blank[y], np.nan, (codes[x] == codes[y]).astype(float))
    if how == "date":
        start, end = _floats(col["start"]), _floats(col["end"])
        precise = pc.fill_null(col["precise"], False).to_numpy(zero_copy_only=False)

        def date(x, y):
            apart = (start[x] > end[y]) | (start[y] > end[x])
            same = precise[x] & precise[y] & (start[x] == start[y])
            score = np.where(apart, 0.0, np.where(same, 1.0, partial))
            return np.where(np.isnan(start[x]) | np.isnan(start[y]), np.nan, score)

        return date
    known = col["number"].is_valid().to_numpy(zero_copy_only=False)
    number = _floats(col["number"])

    def near(x, y):
        with np.errstate(invalid="ignore"):
            return np.where(known[x] & known[y], (np.abs(number[x] - number[y]) <= tolerance).astype(float), np.nan)

    return near


def _best(values, of, mine, a, b):
    """(best score or NaN, position of a's value, of b's) of pairs of rows; ties keep the first combination.

    ``of`` scores values of the left rows with values of the right rows; ``mine`` tells which pairs have
    their first row on the left.
    """
    ca, cb = values.count[a], values.count[b]
    score, at_a, at_b = np.full(len(a), np.nan), np.zeros(len(a), dtype=np.int32), np.zeros(len(a), dtype=np.int32)
    combos = ca * cb
    some = np.flatnonzero(combos)
    ends = np.cumsum(combos[some])
    start = 0
    while start < len(some):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _COMBOS, "right")))
        pick = some[start:stop]
        size = combos[pick]
        pair = np.repeat(pick, size)
        offset = np.cumsum(size) - size
        k = np.arange(len(pair)) - np.repeat(offset, size)
        x, y = values.first[a[pair]] + k // cb[pair], values.first[b[pair]] + k % cb[pair]
        s = of(np.where(mine[pair], x, y), np.where(mine[pair], y, x))
        known = np.where(np.isnan(s), -np.inf, s)
        top = np.maximum.reduceat(known, offset)
        where = np.minimum.reduceat(np.where(known == np.repeat(top, size), np.arange(len(pair)), len(pair)), offset)
        score[pick] = s[where]
        at_a[pick], at_b[pick] = values.pos[x[where]], values.pos[y[where]]
        start = stop
    return score, at_a, at_b


@dataclass
class CellScorer:
    """Scores blocks of sorted rows (``ROWS``) and gives batches of ``SCHEMA``; ``rules`` by rank."""

    rules: dict
    situations: dict = field(default_factory=dict)
    verdicts: dict = field(default_factory=dict)
    known: list = field(default_factory=list)
    ended: list = field(default_factory=list)
    held: int = 0

    def __call__(self, batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            cuts = self.cell_starts(table)
            # The last cell may go on in the next batch.
            yield from self.blocks(table, cuts)
            rest = table.slice(cuts[-1])
        if rest is not None:
            yield from self.blocks(rest, np.array([0, rest.num_rows]))
        yield from self.flush()

    @staticmethod
    def cell_starts(table):
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for name in ("rank", "key", "cell_i", "cell_j"):
            c = table.column(name).combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def blocks(self, table, cuts):
        """Scores the cells between ``cuts``: small ones of one group together, others alone."""
        rank, i, j = (table.column(c).to_numpy() for c in ("rank", "cell_i", "cell_j"))
        k = 0
        while k + 1 < len(cuts):
            low, stop = cuts[k], k + 1
            whole = lambda n: i[cuts[n]] == j[cuts[n]]
            while stop + 1 < len(cuts) and cuts[stop + 1] - low <= _TOGETHER and rank[cuts[stop]] == rank[low] and whole(stop) and whole(k):
                stop += 1
            if cuts[stop] - low > 1:
                cell = np.repeat(np.arange(stop - k), np.diff(cuts[k : stop + 1]))
                yield from self.block(table.slice(low, cuts[stop] - low).combine_chunks(), cell)
            k = stop

    def situation(self, column):
        """Numbers of the situations of rows, the same in all blocks."""
        coded = column.dictionary_encode()
        ids = []
        for text in coded.dictionary.to_pylist():
            if text not in self.situations:
                self.situations[text] = len(self.known)
                s = json.loads(text)
                self.known.append((s["source"], set(s.get("groups") or ()), set(s.get("primary") or ()), bool(s["untyped"]), set(s["sources_in_cluster"])))
            ids.append(self.situations[text])
        return np.array(ids)[coded.indices.to_numpy()]

    def verdict(self, x, y, rank):
        """0: not a pair of this rank's group, 1: compared, 2: their clusters share a source."""
        if (x, y, rank) not in self.verdicts:
            if len(self.verdicts) > _VERDICTS:
                self.verdicts.clear()
            (source_x, groups_x, primary_x, untyped_x, around_x), (source_y, groups_y, primary_y, untyped_y, around_y) = self.known[x], self.known[y]
            if untyped_x and untyped_y:
                shared = None
            elif untyped_x or untyped_y:
                shared = min(primary_y if untyped_x else primary_x, default=None)
            else:
                shared = min(groups_x & groups_y & (primary_x | primary_y), default=None)
            out = shared == rank and source_x != source_y and source_y not in around_x and source_x not in around_y
            self.verdicts[x, y, rank] = 0 if not out else 2 if around_x & around_y else 1
        return self.verdicts[x, y, rank]

    def block(self, table, cell):
        rank = table.column("rank")[0].as_py()
        n = table.num_rows
        col = {c: table.column(c).combine_chunks() for c in ("part", "class_id", "source", "situation", "n", "earlier", "values")}
        sides = [np.arange(n)] * 2
        if (i := table.column("cell_i")[0].as_py()) != (j := table.column("cell_j")[0].as_py()):
            sides = [np.flatnonzero(col["part"].to_numpy() == x) for x in (i, j)]
        met = self.situation(col["situation"])
        kinds, kind = np.unique(met, return_inverse=True)
        if len({self.known[k][0] for k in kinds}) < 2:
            return
        verdict = np.array([[self.verdict(x, y, rank) for y in kinds.tolist()] for x in kinds.tolist()], dtype=np.int8)
        # Rows that are looked at with all others at once, so that matrices stay small.
        left, right = sides
        step = max(1, _COMBINED // max(1, len(right) * (1 + len(col["values"].flatten()) // n)))
        for low in range(0, len(left), step):
            yield from self.meet(rank, col, cell, kinds, kind, verdict, left[low : low + step], right, i == j)

    def meet(self, rank, col, cell, kinds, kind, verdict, left, right, whole):
        """Ends the pairs of ``left`` and ``right`` rows; of a whole cell each pair of rows once."""
        allowed = (verdict[np.ix_(kind[left], kind[right])] > 0) & (cell[left][:, None] == cell[right])
        if whole:
            allowed &= left[:, None] < right
        if not allowed.any():
            return
        earlier = col["earlier"]
        if len(earlier.flatten()):
            # A pair is formed under the first key that both hold.
            full = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(earlier.value_lengths().fill_null(0).to_numpy())]).astype(np.int32)), earlier.flatten())
            allowed &= common_words(full, left, right) == 0
        x, y = (side[k] for side, k in zip((left, right), np.nonzero(allowed)))
        if not len(x):
            return
        order = {s: k for k, s in enumerate(sorted({self.known[k][0] for k in kinds}))}
        place = np.array([order[self.known[k][0]] for k in kinds])[kind]
        mine = place[x] < place[y]
        a, b = np.where(mine, x, y), np.where(mine, y, x)
        yield from self.end(rank, col, kinds[kind], a, b, mine, verdict[kind[a], kind[b]] == 2, left, right)

    def end(self, rank, col, met, a, b, mine, crossing, left, right):
        rules = self.rules[rank]
        n = len(col["class_id"])
        values = col["values"]
        flat = values.flatten()
        owner = np.repeat(np.arange(n), values.value_lengths().fill_null(0).to_numpy())
        columns = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
        concept = columns["c"].to_numpy()
        total, weighted, reach = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
        missing = np.zeros(len(a), dtype=bool)
        unknown = any(r not in {c[0] for c in rules.concepts} for r in rules.required)
        lacking, some, found = np.full(len(a), unknown), np.zeros(len(a), dtype=bool), []
        missing |= unknown
        for no, spec in enumerate(rules.concepts):
            at = np.flatnonzero(concept == no)
            own = _Values(columns, at, owner[at], n)
            both = (own.count[a] > 0) & (own.count[b] > 0)
            some |= both
            reach = np.where(both, reach + spec[2], reach)
            score, pos_a, pos_b = np.full(len(a), np.nan), None, None
            if both.any():
                score, pos_a, pos_b = _best(own, _comparator(own, spec, left, right), mine, a, b)
            there = ~np.isnan(score)
            total = np.where(there, total + spec[2], total)
            weighted = np.where(there, weighted + np.where(there, score, 0.0) * spec[2], weighted)
            if spec[0] in rules.required:
                lacking |= ~both
                missing |= ~there
            found.append((there, score, pos_a, pos_b))
        feasible = some & (reach >= rules.minimum_weight) & ~lacking
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(total == 0, 0.0, round4(weighted / total))
        outcome = np.where(missing | (total < rules.minimum_weight) | (total == 0), 0, np.where(score >= rules.threshold, 2, 1))
        todo = feasible & ~crossing
        good = todo & (outcome == 2)
        source = met.astype(np.int64)
        size = col["n"].to_numpy()
        pairs = size[a] * size[b]
        rest = ~good
        # What is no outcome has none; a pair found hopeless keeps its score for histograms.
        state = np.where(crossing, 1, 0) * 8 + feasible * 4 + np.where(todo, outcome, 3)
        self.ended.append((np.full(rest.sum(), rank), source[a[rest]], source[b[rest]], state[rest], np.where(crossing, np.nan, score)[rest], pairs[rest]))
        self.held += int(rest.sum())
        if self.held > _ENDED:
            self.fold()
            if self.held > _ENDED // 2:
                yield from self.flush()
        if good.any():
            yield self.proposable(rank, rules, col, np.flatnonzero(good), a, b, score, total, pairs, found)

    def fold(self):
        """Adds up what ended alike."""
        if not self.held:
            return
        rank, x, y, state, score, pairs = (np.concatenate(c) for c in zip(*self.ended))
        # Situations of the same source are one from here on.
        names = sorted({s[0] for s in self.known})
        of = {s: k for k, s in enumerate(names)}
        source = np.array([of[s[0]] for s in self.known])
        first = np.zeros(len(names), dtype=np.int64)
        first[source] = np.arange(len(source))
        key = ((rank.astype(np.int64) * len(names) + source[x]) * len(names) + source[y]) * 16 + state
        bits = score.view(np.int64)
        order = np.lexsort((bits, key))
        key, bits = key[order], bits[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bits[1:] != bits[:-1])]))
        pick = order[new]
        self.ended = [(rank[pick], first[source[x[pick]]], first[source[y[pick]]], state[pick], score[pick], np.add.reduceat(pairs[order], new))]
        self.held = len(pick)

    def flush(self):
        self.fold()
        if self.held:
            (rank, x, y, state, score, pairs), n = self.ended[0], self.held
            names = pa.array([s[0] for s in self.known])
            none = pa.nulls(n, pa.string())
            orders = np.zeros(max(self.rules) + 1, dtype=np.int32)
            for r, rules in self.rules.items():
                orders[r] = rules.group_order
            outcome = pa.array([*_OUTCOMES, None]).take(pa.array(state % 4))
            columns = [names.take(pa.array(x)), names.take(pa.array(y)), rank.astype(np.int32), orders[rank], pa.array([None, "INVARIANT"]).take(pa.array(state // 8)),
                       state // 4 % 2 == 1, pa.array(score, mask=np.isnan(score)), outcome, none, none, pa.nulls(n, pa.float64()), pa.nulls(n, SCHEMA.field("evidence").type), pairs]
            yield _batch(columns)
        self.ended, self.held = [], 0

    def proposable(self, rank, rules, col, good, a, b, score, total, pairs, found):
        a, b, n = a[good], b[good], len(good)
        there = np.stack([f[0][good] for f in found], axis=1)
        row, no = np.nonzero(there)
        of = lambda k, kind: np.stack([np.zeros(n, dtype=kind) if f[k] is None else f[k][good] for f in found], axis=1)[row, no]
        keys, hows, weights = (pa.array([c[k] for c in rules.concepts]) for k in range(3))
        no_ = pa.array(no)
        fields = [keys.take(no_), hows.take(no_), weights.take(no_).cast(pa.float64()), pa.array(round4(of(1, float))), pa.array(no.astype(np.int32)),
                  pa.array(of(2, np.int32)), pa.array(of(3, np.int32))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
        evidence = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_EVIDENCE)))
        take = lambda c, k: col[c].take(pa.array(k))
        columns = [take("source", a), take("source", b), np.full(n, rank, dtype=np.int32), np.full(n, rules.group_order, dtype=np.int32), pa.nulls(n, pa.string()),
                   np.ones(n, dtype=bool), score[good], pa.array([_OUTCOMES[2]] * n), take("class_id", a), take("class_id", b), total[good], evidence, pairs[good]]
        return _batch(columns)


def _batch(columns):
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def scorer(rules):
    """Function for ``mapInArrow`` over rows sorted by cell."""

    def run(batches):
        yield from CellScorer(rules)(batches)

    return run
