"""Joins of distinct values by similarity: strings by indel ratio, dates by overlap, numbers by equality.

Nothing that reaches its level is lost: the filters before the comparison follow from the level alone.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quadweave.functions.dates import interval_overlaps
from quadweave.functions.lcs import indel_ratio
from quadweave.runtime import cut_lineage, dealt_join, skew_safe_join

# Ratio from which pairs of letters are counted; below it their bound proves nothing and letters are.
PAIRS_FROM = 0.68
START, END = "\u0002", "\u0003"
# Ways of leaving letters out of a text up to which all are listed.
MOST_WAYS = 300


def _least_ratio(level):
    """Smallest ratio whose rounded percentage reaches ``level``, which is above 0."""
    return (F.greatest(F.ceil(level - 1e-6), F.lit(1)) - 0.5) / 100


def _least_common(n, r):
    """Grams that a string of ``n`` letters shares with every string at ratio ``r`` or more.

    With s letters in both and d = (1 - r) s of them in no common subsequence, (s - d) / 2 letters are
    common. Each of the d breaks at most one pair of neighbours, ends of the text included, so that
    (s - d) / 2 + 1 - d pairs are common as well. The other string has at least r n / (2 - r) letters.
    """
    s = n + r * n / (2 - r)
    needed = F.when(r >= PAIRS_FROM, s * (1.5 * r - 1) + 1).otherwise(s * r / 2)
    return F.greatest(F.ceil(needed - 1e-9), F.lit(1)).cast("int")


def _grams(texts) -> DataFrame:
    """(id, n, r, gram): every gram of each text, its repeats numbered, as a hash with its slot.

    Two grams under one hash only bring texts together that have no need to.
    """
    letters = F.split("t", "")
    ends = F.concat(F.array(F.lit(START)), F.when(F.col("n") > 0, letters).otherwise(F.array().cast("array<string>")), F.array(F.lit(END)))
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: F.concat(F.element_at("e", i), F.element_at("e", i + 1)))
    single = F.when(F.col("n") > 0, letters).otherwise(F.array(F.lit("")))
    each = texts.withColumn("e", ends).select("slot", "id", "n", "r", F.explode(F.when(F.col("r") >= PAIRS_FROM, pairs).otherwise(single)).alias("g"))
    held = each.groupBy("slot", "id", "n", "r", "g").agg(F.count(F.lit(1)).cast("int").alias("c"))
    numbered = F.explode(F.transform(F.sequence(F.lit(1), F.col("c")), lambda i: F.xxhash64("slot", "g", i)))
    return held.select("id", "n", "r", numbered.alias("gram"))


def _left_out(n, other, r):
    """Letters that a text of ``n`` may lack in the subsequence it must share with one of ``other`` letters."""
    return n - F.ceil(r * (n + other) / 2 - 1e-9).cast("int")


def _ways(n, out):
    """Number of ways to leave ``out`` of ``n`` letters out: none, one or two; more are too many."""
    return F.when(out <= 1, F.when(out == 1, n).otherwise(1)).when(out == 2, n * (n - 1) / 2).otherwise(MOST_WAYS + 1)


def _listed(n_a, n_b, r):
    """Whether the common subsequences of texts of these lengths are few enough to list them all."""
    return (_ways(n_a, _left_out(n_a, n_b, r)) <= MOST_WAYS) & (_ways(n_b, _left_out(n_b, n_a, r)) <= MOST_WAYS)


def _near_lengths(n_a, n_b, r):
    return 2 * F.least(n_a, n_b) >= r * (n_a + n_b) - 1e-9


def _without(t, out):
    """The texts that are left of ``t`` without any ``out`` letters, none, one or two."""
    n = F.char_length(t)

    def but(text, i):
        return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text)))

    one = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: but(t, i)))
    two = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(2), n), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: but(but(t, j), i)))))
    return F.array_distinct(F.when(out == 0, F.array(t)).when(out == 1, one).otherwise(two))


def _subsequences(texts, lengths, side) -> DataFrame:
    """(key, id_, n_): texts under what they may share with a text of each length that the other side has."""
    own, other = (F.col("n"), F.col("m")) if side == "a" else (F.col("m"), F.col("n"))
    met = texts.join(lengths, "slot").where(_near_lengths(own, other, F.col("r")) & _listed(own, other, F.col("r")))
    each = met.withColumn("sub", F.explode(_without(F.col("t"), _left_out(F.col("n"), F.col("m"), F.col("r")))))
    return each.select(F.xxhash64("slot", own, other, "sub").alias("key"), F.col("id").alias(f"id_{side}"))


def _by_grams(left, right, lengths) -> DataFrame:
    """(id_a, id_b): texts that share a rare gram, of lengths whose common subsequences are not listed."""
    def unlisted(texts, others, side):
        own, other = (F.col("n"), F.col("m")) if side == "a" else (F.col("m"), F.col("n"))
        some = texts.select("slot", "n", "r").distinct().join(others, "slot").where(
            _near_lengths(own, other, F.col("r")) & ~_listed(own, other, F.col("r"))).select("slot", "n").distinct()
        return texts.join(some, ["slot", "n"], "left_semi")

    grams = [cut_lineage(_grams(unlisted(t, lengths[1 - k], "ab"[k]))) for k, t in enumerate((left, right))]
    often = grams[0].select("gram").unionByName(grams[1].select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rare = Window.partitionBy("id").orderBy("often", "gram")
    total = F.when(F.col("r") >= PAIRS_FROM, F.col("n") + 1).otherwise(F.greatest("n", F.lit(1)))

    def under(held, side):
        ranked = held.join(often, "gram").withColumn("place", F.row_number().over(rare))
        first = ranked.where(F.col("place") <= total - _least_common(F.col("n"), F.col("r")) + 1)
        return first.select("gram", F.col("id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}"), *(["r"] if side == "a" else []))

    met = skew_safe_join(under(grams[0], "a"), under(grams[1], "b"), ["gram"], ["id_a"], ["id_b"])
    n_a, n_b, r = F.col("n_a"), F.col("n_b"), F.col("r")
    return met.where(_near_lengths(n_a, n_b, r) & ~_listed(n_a, n_b, r)).select("id_a", "id_b")


def similar_strings(left, right, levels) -> DataFrame:
    """(slot, v_a, v_b, best): strings of one slot whose rounded indel ratio of 100 reaches the slot's level.

    ``left`` and ``right``: (slot, v, t), one row per distinct text ``t`` and its identifier ``v``;
    ``levels``: (slot, level), levels above 0. Where a level lets texts of two lengths differ in few
    letters only, they meet under the subsequences that they may have in common, which brings hardly
    any others together. Of other lengths, a text is looked up under its rarest grams only, as many as
    leave out fewer than it must share; grams held by many texts are compared in a grid of tasks.
    """
    level = levels.select("slot", _least_ratio(F.col("level")).alias("r"))
    # Numbered as they are written: the numbers stay what they are, whatever reads them.
    left, right = (cut_lineage(t.join(level, "slot").select(F.monotonically_increasing_id().alias("id"), "slot", "v", "t", F.char_length("t").alias("n"), "r"))
                   for t in (left, right))
    lengths = [t.select("slot", F.col("n").alias("m")).distinct() for t in (left, right)]
    few, _ = dealt_join(_subsequences(left, lengths[1], "a"), _subsequences(right, lengths[0], "b"), ["key"], ["id_a"], ["id_b"])
    met = few.select("id_a", "id_b").unionByName(_by_grams(left, right, lengths)).distinct()
    met = met.join(left.select(F.col("id").alias("id_a"), "slot", "r", F.col("v").alias("v_a"), F.col("t").alias("t_a")), "id_a")
    met = met.join(right.select(F.col("id").alias("id_b"), F.col("slot").alias("slot_b"), F.col("v").alias("v_b"), F.col("t").alias("t_b")), "id_b")
    best = F.round(indel_ratio(F.col("t_a"), F.col("t_b")) * 100).cast("double")
    scored = met.where("slot = slot_b").select("slot", "v_a", "v_b", "r", best.alias("best"))
    return scored.where(F.col("best") >= F.col("r") * 100).select("slot", "v_a", "v_b", "best")


def overlapping_dates(left, right) -> DataFrame:
    """(slot, v_a, v_b, best): days, months and years that overlap; 100 for one day, else 85.

    ``left`` and ``right``: (slot, v, start, end), one row per distinct interval. No interval leaves
    its year, so that the year is the key.
    """
    a, b = (t.select("slot", F.year("start").alias("year"), F.col("v").alias(f"v_{s}"), F.struct("start", "end").alias(f"d_{s}"))
            for t, s in ((left, "a"), (right, "b")))
    p, q = F.col("d_a"), F.col("d_b")
    day = (p["start"] == p["end"]) & (q["start"] == q["end"]) & (p["start"] == q["start"])
    met = skew_safe_join(a, b, ["slot", "year"], ["v_a"], ["v_b"]).where(interval_overlaps(p, q))
    return met.select("slot", "v_a", "v_b", F.when(day, 100.0).otherwise(85.0).alias("best"))


def equal_values(left, right) -> DataFrame:
    """(slot, v_a, v_b, best): values that both sides hold, at 100."""
    return left.select("slot", "v").join(right.select("slot", "v"), ["slot", "v"]).select(
        "slot", F.col("v").alias("v_a"), F.col("v").alias("v_b"), F.lit(100.0).alias("best"))
