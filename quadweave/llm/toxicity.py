"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits that stand for letters), then one Aho-Corasick
automaton finds all lexicon entries at word starts: whole words or stems. Entries covered by an
exception phrase do not count, and of several entries at one word the heaviest counts. The sum of
weights is set against the length of the text, and a logistic curve turns both into a score.

Entries, weights and the curve are learned from labelled rows only, at most ``train_rows`` of them
(those with the smallest hash of their id). A few known words enter with a fixed weight where the
rows say nothing about them. Ids, labels, languages and sources are no input of a score.

Texts: null and empty texts match nothing and get the curve's lowest score for a text without words.
Texts of any length are read whole. Repeated rows are scored each; a document labelled twice counts
by the larger label, of several rows with a labelled id the smallest text is learned from. Without labelled rows of both kinds a fixed curve is used. Empty tables give
empty results.
"""

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import batch_of, slices, written

TRAIN_ROWS = 10_000
THRESHOLD = 0.3
MIN_TOXIC_TEXTS = 3
MIN_EVIDENCE = 20.0
MIN_WEIGHT = 1.0
STEMS = range(3, 9)
SEED_WEIGHT = 4.0
#: Fixed starting words; learned weights replace theirs.
SEED_WORDS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile "
    "dumb dumbass jerk creep filth vermin asshole bastard bitch shit fuck fucking "
    "connard salope abruti debile idiota estupido imbecil basura mierda dummkopf arschloch schwachkopf"
).split()
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "idiot proof", "pond scum", "loser bracket", "stupid simple", "trash talk show")
# Letters of other scripts that look like Latin ones, and digits in the place of letters.
_HOMOGLYPHS = str.maketrans(
    "авекмнорстухіјѕԁԛԝһӏαβεζηικμνορτυχγωıłøđ",
    "abekmhopctyxijsdqwhlabezhikmnoptuxywilod",
)
_FOLD = _HOMOGLYPHS | {c: None for c in range(0x300, 0x370)} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
_DIGITS = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"(?=[0-9@$]*[a-z])[a-z0-9@$]*[0-9@$](?=[a-z0-9@$]*)[a-z0-9@$]*")
_TAIL = re.compile(r"[@$]+(?![a-z0-9])")
_BETWEEN = re.compile(r"[\W_]+")


def fold(text) -> str:
    """Words in plain small letters, one blank around each."""
    t = (text or "").casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).translate(_FOLD)
    if any(c in t for c in "013457@$"):
        t = _MIXED.sub(lambda m: m[0].translate(_DIGITS), _TAIL.sub(" ", t))
    return f" {_BETWEEN.sub(' ', t).strip()} "


@dataclass
class Lexicon:
    """Entries (" word " or " stem") with weights, and the curve over (1, log rate, log sum, matched)."""

    weights: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.2, 0.5, 1.0])
    exceptions: tuple = EXCEPTIONS

    def automaton(self):
        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(a):
            a.make_automaton()
        return a


def matched(automaton, folded: str) -> float:
    """Sum over words of the heaviest entry at each, without those inside exception phrases."""
    best, spared = {}, []
    if len(automaton):
        for end, (size, w) in automaton.iter(folded):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
    for a, b in spared:
        for s in [s for s in best if a <= s < b]:
            del best[s]
    return sum(best.values())


def features(total: float, words: int) -> list[float]:
    return [1.0, float(np.log1p(100.0 * total / max(words, 1))), float(np.log1p(total)), float(total > 0)]


def probability(curve, total, words) -> float:
    z = float(np.dot(curve, features(total, words)))
    return float(1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0))))


def _entries(folded: str) -> Counter:
    """Every word and every stem of a folded text, with its occurrences."""
    out = Counter()
    for word, n in Counter(folded.split()).items():
        out[f" {word} "] += n
        for k in STEMS:
            if len(word) <= k:
                break
            out[f" {word[:k]}"] += n
    return out


def _fit_curve(rows: list[tuple[float, int, int]], steps=30, ridge=0.1) -> list[float]:
    """Logistic regression by Newton steps."""
    x = np.array([features(t, n) for t, n, _ in rows])
    y = np.array([label for _, _, label in rows], float)
    beta = np.zeros(x.shape[1])
    pull = ridge * np.diag([0.01, 1, 1, 1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ beta)
    return beta.tolist()


def training_rows(docs, labels, ident="doc_id", text="text", label="toxic", train_rows=TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from; at most ``train_rows``, one per id."""
    picked = (
        labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_id")).agg(F.max(label).alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    )
    # At most ``train_rows`` pairs of numbers.
    texts = docs.select(F.col(ident).alias("_id"), F.col(text).alias("text"))
    # However many rows an id has, one is learned from.
    one = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_toxic").agg(F.min("text").alias("text"))
    return one.select("text", F.col("_toxic").cast("int").alias("toxic"))


def learn(rows: DataFrame, exceptions=EXCEPTIONS) -> Lexicon:
    """A lexicon from (text, toxic). Counts are made by the tasks; the driver sees candidate entries."""
    # Read three times below.
    rows = written(rows.select("text", "toxic"), "training")
    schema = pa.schema([("entry", pa.string()), ("texts", pa.int64()), ("times", pa.int64()), ("words", pa.int64())])

    def count(candidates):
        def run(batches):
            texts, times, words = Counter(), Counter(), [0, 0]
            for batch in slices(batches):
                for text in batch.column(0).to_pylist():
                    found = _entries(folded := fold(text))
                    words[0] += folded.count(" ") - 1
                    words[1] += 1
                    if candidates is not None:
                        found = {e: found[e] for e in found.keys() & candidates}
                    texts.update(found.keys())
                    times.update(found)
            names = [*texts, None]
            yield batch_of(schema, names, [*texts.values(), words[1]], [*times.values(), 0], [*([0] * len(texts)), words[0]])

        return run

    def counted(part, candidates=None):
        return part.select("text").mapInArrow(count(candidates), "entry string, texts long, times long, words long").groupBy("entry").agg(
            F.sum("texts").alias("texts"), F.sum("times").alias("times"), F.sum("words").alias("words")
        )

    seeds = {f" {w} " for w in SEED_WORDS}
    toxic = {
        r["entry"]: r for r in counted(rows.where("toxic = 1")).where(
            F.col("entry").isNull() | (F.col("texts") >= MIN_TOXIC_TEXTS) | F.col("entry").isin(list(seeds))
        ).collect()
    }
    candidates = frozenset(e for e in toxic if e) | seeds
    clean = {r["entry"]: r for r in counted(rows.where("toxic = 0"), candidates).collect()}

    def figures(side):
        total = side.get(None)
        return (total["texts"], max(total["words"], 1)) if total else (0, 1)

    (texts_t, words_t), (texts_c, words_c) = figures(toxic), figures(clean)
    if not texts_t or not texts_c:
        return Lexicon({w: SEED_WEIGHT for w in seeds}, exceptions=exceptions)
    weights = {}
    for e in candidates:
        nt, ct = (toxic[e]["texts"], toxic[e]["times"]) if e in toxic else (0, 0)
        nc, cc = (clean[e]["texts"], clean[e]["times"]) if e in clean else (0, 0)
        w = float(np.log((ct + 0.5) / words_t) - np.log((cc + 0.5) / words_c))
        # Twice the log-likelihood ratio of "more frequent in toxic texts" on texts that hold the entry.
        share = (nt + nc) / (texts_t + texts_c)
        g = 2 * (nt * np.log(nt / (share * texts_t)) + (nc * np.log(nc / (share * texts_c)) if nc else 0.0)) if nt else 0.0
        if e in seeds and nt + nc < MIN_TOXIC_TEXTS:
            weights[e] = SEED_WEIGHT
        elif w >= MIN_WEIGHT and (e in seeds or nt >= MIN_TOXIC_TEXTS and g >= MIN_EVIDENCE):
            weights[e] = w
    lexicon = Lexicon(weights, exceptions=exceptions)
    lexicon.curve = _fit_curve([(r["total"], r["words"], r["toxic"]) for r in _sums(rows, lexicon, "toxic").collect()])
    return lexicon


def _sums(rows, lexicon, keep):
    """(keep, total, words) of each row."""
    kind = rows.schema[keep].dataType.simpleString()

    def run(batches):
        automaton = lexicon.automaton()
        for batch in slices(batches):
            totals, words = [], []
            for text in batch.column(1).to_pylist():
                folded = fold(text)
                totals.append(matched(automaton, folded))
                words.append(max(folded.count(" ") - 1, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.float64()), pa.array(words, pa.int64())], names=[keep, "total", "words"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, total double, words long")


def score(docs: DataFrame, lexicon: Lexicon, ident="doc_id", text="text", threshold=THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        automaton = lexicon.automaton()
        for batch in slices(batches):
            scores = []
            for t in batch.column(1).to_pylist():
                folded = fold(t)
                scores.append(probability(lexicon.curve, matched(automaton, folded), folded.count(" ") - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=[ident, "score", "predicted"],
            )

    return docs.select(F.col(ident), F.col(text)).mapInArrow(run, f"{ident} {kind}, score double, predicted int")


def held_out(ident):
    """A quarter of the documents, by the checksum of the id's text, that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, ident="doc_id", text="text", label="toxic", train_rows=TRAIN_ROWS, threshold=THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every document, learned from rows that are not held out."""
    lexicon = learn(training_rows(docs, labels.where(~held_out(ident)), ident, text, label, train_rows))
    return score(docs, lexicon, ident, text, threshold).select(ident, held_out(ident).alias("held_out"), "score", "predicted")
