"""Quality rules as a short-circuit cascade.

Each rule rejects a text. Its cost and its share of rejections are measured on a sample; rules run
in falling order of rejections per second, and a text leaves the cascade at the first rule that
rejects it. The verdict does not depend on the order, so a measured order may differ between runs.

Texts: null and empty texts have no words and fail ``few_words``. Texts of any length are read
whole. Repeated rows get the same verdict each. An empty table gives an empty result. Only the
columns named in the call are read; all others pass through ``quality_filter`` untouched.
"""

import time
import unicodedata
from collections import Counter
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadweave.llm.common import SPACES, batch_of, bounded_batches, each_slice, give_back, slices, words_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_SYMBOLS_PER_WORD = 0.1
MEAN_WORD_CHARS = (3.0, 10.0)
MAX_REPEATED_LINES = 0.5
MIN_LETTERS = 0.6
MAX_ELLIPSIS_LINES = 0.5


class Text:
    """Figures of one text, each computed when first asked for."""

    def __init__(self, text):
        self.text = text or ""

    @cached_property
    def raw(self):
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self):
        return words_of(self.raw)

    @cached_property
    def n_words(self):
        return len(self.words)

    @cached_property
    def word_chars(self):
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self):
        return sum(self.raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))

    @cached_property
    def lines(self):
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self):
        """Words inside a window of three words that occurs twice or more."""
        windows = list(zip(self.words, self.words[1:], self.words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        total = covered = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                total += i + 3 - max(i, covered)
                covered = i + 3
        return total

    @cached_property
    def n_letters(self):
        """Letters and the combining marks written with them, such as the vowel signs of Indic scripts."""
        marks = () if self.text.isascii() else [c for c in set(self.text) if unicodedata.category(c)[0] == "M"]
        return sum(map(str.isalpha, self.text)) + sum(map(self.text.count, marks))


def few_words(t):
    return t.n_words < MIN_WORDS


def repeated_words(t):
    return 100 * t.n_repeat_words > 100 * MAX_REPEATED * t.n_words


def many_symbols(t):
    return t.n_symbols > MAX_SYMBOLS_PER_WORD * t.n_words


def odd_word_length(t):
    return not MEAN_WORD_CHARS[0] * t.n_words <= t.word_chars <= MEAN_WORD_CHARS[1] * t.n_words


def repeated_lines(t):
    return t.n_dup_lines > MAX_REPEATED_LINES * len(t.lines)


def few_letters(t):
    return t.n_letters < MIN_LETTERS * t.word_chars


def ellipsis_lines(t):
    cut = sum(x.rstrip().endswith((b"...", "…".encode())) for x in t.lines)
    return cut > MAX_ELLIPSIS_LINES * len(t.lines)


#: Rules that every text is held against, and the further ones of the method.
BASE_RULES = (few_words, repeated_words)
RULES = (*BASE_RULES, many_symbols, odd_word_length, repeated_lines, few_letters, ellipsis_lines)


def estimate(docs: DataFrame, text="text", rules=RULES, sample_rows=2_000, seed=17) -> list[dict]:
    """For each rule on about ``sample_rows`` texts: rows, share rejected, seconds a text.

    Each rule is timed on texts nobody has read before it, so that shared figures count for each.
    Only sums leave the tasks.
    """
    total = docs.count()
    part = docs.select(F.col(text).alias("text"))
    if total > sample_rows:
        part = part.sample(fraction=sample_rows / total, seed=seed)
    schema = pa.schema([("rule", pa.int32()), ("rows", pa.int64()), ("rejected", pa.int64()), ("seconds", pa.float64())])

    def measure(batches):
        sums = [[0, 0, 0.0] for _ in rules]
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for s, rule in zip(sums, rules):
                    fresh, start = Text(text), time.perf_counter()
                    rejected = rule(fresh)
                    s[2] += time.perf_counter() - start
                    s[0] += 1
                    s[1] += bool(rejected)
        give_back()
        yield batch_of(schema, list(range(len(rules))), *zip(*sums))

    with bounded_batches(docs.sparkSession):
        rows = (
            part.mapInArrow(measure, "rule int, rows long, rejected long, seconds double")
            .groupBy("rule").agg(F.sum("rows").alias("n"), F.sum("rejected").alias("r"), F.sum("seconds").alias("s"))
            .collect()
        )
    found = {r["rule"]: r for r in rows if r["n"]}
    return [
        {"rule": rule.__name__, "rows": r["n"], "rejected": r["r"] / r["n"], "seconds": r["s"] / r["n"]}
        if (r := found.get(i)) else {"rule": rule.__name__, "rows": 0, "rejected": 0.0, "seconds": 0.0}
        for i, rule in enumerate(rules)
    ]


def ordered(estimates: list[dict], rules=RULES) -> list:
    """Rules by falling rejections per second; ties and rules without rejections by cost, then given order."""
    by_name = {e["rule"]: e for e in estimates}

    def rank(i):
        e = by_name[rules[i].__name__]
        return (-e["rejected"] / max(e["seconds"], 1e-9), e["seconds"], i)

    return [rules[i] for i in sorted(range(len(rules)), key=rank)]


def first_rejection(t: Text, cascade) -> str | None:
    for rule in cascade:
        if rule(t):
            return rule.__name__
    return None


def cascade_of(docs, text="text", rules=RULES, sample_rows=2_000):
    return ordered(estimate(docs, text, rules, sample_rows), rules)


def quality_filter(docs: DataFrame, text="text", rules=RULES, sample_rows=2_000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    cascade = cascade_of(docs, text, rules, sample_rows)

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        parts = each_slice(texts, lambda part: [first_rejection(Text(t), cascade) is None for t in part])
        give_back()
        return pa.array([x for part in parts for x in part], pa.bool_())

    return docs.where(passes(F.col(text)))


def quality_report(docs: DataFrame, ident="doc_id", text="text", rules=RULES, sample_rows=2_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    The five figures are asked for of every text; the cascade reuses those it needs.
    """
    cascade = cascade_of(docs, text, rules, sample_rows)
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    id_type = docs.schema[ident].dataType.simpleString()

    def report(batches):
        schema = None
        for batch in slices(batches):
            schema = schema or pa.schema(
                [(ident, batch.schema.field(0).type), *((f, pa.int64()) for f in figures), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
            )
            rows = []
            for text in batch.column(1).to_pylist():
                t = Text(text)
                failed = any(rule(t) for rule in BASE_RULES)
                rows.append((*(getattr(t, f) for f in figures), failed, not failed and first_rejection(t, cascade) is None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema
            )

    return docs.select(F.col(ident), F.col(text)).mapInArrow(
        report, f"{ident} {id_type}, " + ", ".join(f"{f} long" for f in figures) + ", base_failed boolean, kept boolean"
    )
