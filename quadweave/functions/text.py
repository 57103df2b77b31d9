"""Text folding and similarity, as column expressions.

``fold`` stays in the JVM: canonical decomposition followed by the removal of marks maps one
character to one character except for Hangul syllables, so ``translate`` does it with a table
built from the Unicode database, and Hangul is decomposed by arithmetic.
"""

import functools
import sys
import unicodedata

from pyspark.sql import Column, functions as F

from quadweave.functions.lcs import indel_ratio, indel_ratio_lists  # noqa: F401

NON_WORD = r"[^\p{L}\p{N}]+"

# English and French stop words.
STOP_WORDS = (
    # English
    "a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "with", "by", "from", "is",
    "are", "was", "were", "be", "all", "every", "any", "that", "this", "these", "those", "which",
    "who", "whom", "what", "me", "my", "it", "its", "as", "at", "into", "their", "there", "please",
    # French
    "le", "la", "les", "l", "un", "une", "des", "de", "du", "d", "et", "ou", "au", "aux",
    "en", "dans", "sur", "pour", "par", "avec", "est", "sont", "qui", "que", "quel", "quelle",
    "quels", "quelles", "ce", "cet", "cette", "ces", "tous", "toutes", "tout", "son", "sa", "ses",
    "leur", "leurs", "moi", "mon", "ma", "mes", "s", "il", "elle", "y",
)


@functools.lru_cache(maxsize=1)
def _base_letters():
    """(characters, base characters): every character whose decomposition has one non-mark."""
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if not unicodedata.decomposition(ch):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c)[0] != "M")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def _from_code(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def _decompose_hangul(ch: Column) -> Column:
    n = F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    tail = n % 28
    return F.concat(
        _from_code((F.lit(0x1100) + F.floor(n / 588)).cast("int")),
        _from_code((F.lit(0x1161) + F.floor((n % 588) / 28)).cast("int")),
        F.when(tail > 0, _from_code((F.lit(0x11A7) + tail).cast("int"))).otherwise(""),
    )


def fold(col) -> Column:
    """Lower case without diacritics; null becomes the empty string."""
    s = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    src, dst = _base_letters()
    bare = F.regexp_replace(F.translate(s, src, dst), r"\p{M}+", "")
    # Asked of the text itself, as no other character becomes a syllable: ``bare`` is worked out once.
    jamo = F.when(
        s.rlike("[가-힣]"),
        F.array_join(
            F.transform(
                F.split(bare, ""),
                lambda ch: F.when(ch.between("가", "힣"), _decompose_hangul(ch)).otherwise(ch),
            ),
            "",
        ),
    ).otherwise(bare)
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.lower(jamo))


def normalize(col) -> Column:
    """Folded text whose runs of other characters than letters and digits are one space."""
    return normalize_folded(fold(col))


def normalize_folded(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, NON_WORD, " "))


def tokens(col) -> Column:
    """Folded words, in order, stop words included."""
    return tokens_of_normalized(normalize(col))


def tokens_of_normalized(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def content_words(col) -> Column:
    """Distinct folded words without stop words."""
    return content_words_of(tokens(col))


def content_words_of(words: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(words, stop)


def sorted_tokens(col) -> Column:
    return F.array_join(F.array_sort(tokens(col)), " ")


def jaccard(a: Column, b: Column) -> Column:
    """|a n b| / |a u b| of two arrays without duplicates; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def split_local_name(col) -> Column:
    """camelCase, snake_case and kebab-case names as words."""
    s = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.translate(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2"), "_-", "  ")


def slug(col) -> Column:
    """Identifier made from a label; ``group`` when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(fold(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("group")).otherwise(s)


def not_blank(c) -> Column:
    """Whether a text has a character that is not white space of any kind."""
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\P{javaWhitespace}")


def collapse_ws(col) -> Column:
    """Whitespace runs as one space, trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal strings."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((a == b) | (longest == 0), F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longest
    )


def round4(col) -> Column:
    """Half-up rounding to four decimals."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 10000 + 0.5) / 10000.0


def token_sort_ratio(a, b) -> Column:
    """:func:`indel_ratio` of the sorted words."""
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def label_score(query_words: Column, label_words: Column) -> Column:
    """How well a label answers a query.

    ``query_words``: distinct words in order; ``label_words``: all words in order. The same words
    give 1, all query words somewhere in the label 0.9, else 0.85 x the mean best similarity.
    """
    best = F.transform(
        query_words,
        lambda q: F.array_max(F.transform(label_words, lambda w: edit_similarity(q, w))),
    )
    mean = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(query_words)
    return (
        F.when((F.size(query_words) == 0) | (F.size(label_words) == 0), F.lit(0.0))
        .when(query_words == label_words, F.lit(1.0))
        .when(F.size(F.array_except(query_words, label_words)) == 0, F.lit(0.9))
        .otherwise(mean * F.lit(0.85))
    )


def same_name(a: Column, b: Column) -> Column:
    """Equal words, or as many words whose aligned similarities all reach 0.75."""
    return (a == b) | (
        (F.size(a) == F.size(b))
        & (F.size(a) > 0)
        & F.forall(
            F.arrays_zip(a.alias("x"), b.alias("y")),
            lambda z: edit_similarity(z["x"], z["y"]) >= 0.75,
        )
    )
