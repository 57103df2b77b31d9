"""Comparators and the scoring of candidate pairs.

A value ready for comparison is a *feature*: a small struct with its normalised text, sorted words,
content words, date, number and linked IRI, prepared once per value. A pair row carries the
features of both sides, so scoring is a row-local expression: no shuffle
gathers a pair's values, and hot entities can be split freely between tasks.
"""

from pyspark.sql import Column, DataFrame, functions as F

from quadweave.functions.dates import interval_overlaps
from quadweave.functions.lcs import indel_ratio, indel_ratio_lists
from quadweave.functions.text import (
    content_words_of, fold, jaccard, normalize, normalize_folded, round4, tokens_of_normalized,
)
from quadweave.plans.config import concepts_of_group, per_group

# Comparators that may look at the letters of a text.
LETTERED = ("auto", "string", "name", "linkedEntity")

# --- single comparators, as columns over two values ----------------------------------------


def cmp_text(a, b) -> Column:
    """Jaccard of content words; null when either text has none."""
    wa, wb = (content_words_of(tokens_of_normalized(normalize(x))) for x in (a, b))
    return F.when((F.size(wa) > 0) & (F.size(wb) > 0), jaccard(wa, wb))


def cmp_string(a, b, long_text=None) -> Column:
    """Indel ratio of normalised texts; above ``long_text`` characters, if given, the jaccard of content words."""
    na, nb = normalize(a), normalize(b)
    if long_text is None:
        return F.when((na != "") & (nb != ""), indel_ratio(na, nb))
    long = (F.char_length(na) > long_text) | (F.char_length(nb) > long_text)
    short_ratio = indel_ratio(F.when(~long, na), F.when(~long, nb))
    return F.when((na != "") & (nb != ""), F.when(long, cmp_text(a, b)).otherwise(short_ratio))


def cmp_name(a, b) -> Column:
    """Best of the indel ratio and of the indel ratio of sorted words."""
    na, nb = normalize(a), normalize(b)
    sa, sb = (F.array_join(F.array_sort(tokens_of_normalized(n)), " ") for n in (na, nb))
    return F.when((na != "") & (nb != ""), F.greatest(indel_ratio(na, nb), indel_ratio(sa, sb)))


def cmp_exact(a, b, case_sensitive=False) -> Column:
    va, vb = (F.trim(a), F.trim(b)) if case_sensitive else (normalize(a), normalize(b))
    return F.when((va != "") & (vb != ""), F.when(va == vb, 1.0).otherwise(0.0))


def cmp_number(a, b, tolerance=0.0) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.abs(a - b) <= tolerance, 1.0).otherwise(0.0))


def cmp_date(a, b, partial=0.85) -> Column:
    """0 when disjoint, 1 when both are the same day, else ``partial``."""
    same_day = a["day_precise"] & b["day_precise"] & (a["start"] == b["start"])
    return F.when(
        a["start"].isNotNull() & b["start"].isNotNull(),
        F.when(~interval_overlaps(a, b), F.lit(0.0)).when(same_day, F.lit(1.0)).otherwise(F.lit(partial)),
    )


def cmp_linked(iri_a, text_a, iri_b, text_b, cluster_a=None, cluster_b=None, factor=0.9) -> Column:
    """1 for the same entity, else the damped similarity of the labels."""
    same = iri_a == iri_b
    if cluster_a is not None:
        same = same | (cluster_a == cluster_b)
    return F.when(F.coalesce(same, F.lit(False)), F.lit(1.0)).otherwise(factor * cmp_name(text_a, text_b))


# --- features -------------------------------------------------------------------------------


def with_features(values, cluster_of_iri=None, long_text=None) -> DataFrame:
    """Add ``feature`` to resolved values (columns ``comparator``, ``cv``, ``rank``, ``pos``)."""
    cv, comparator = F.col("cv"), F.col("comparator")
    v = values
    if cluster_of_iri is not None:
        ids = cluster_of_iri.select(F.col("iri").alias("_iri"), F.col("cluster_id").alias("_cluster"))
        # Only linked entities are looked up: literals have no key and stay where they are.
        links = v.where(cv["iri"].isNotNull()).join(ids, cv["iri"] == F.col("_iri"), "left").drop("_iri")
        v = links.unionByName(v.where(cv["iri"].isNull()).withColumn("_cluster", F.lit(None).cast("string")))
    else:
        v = v.withColumn("_cluster", F.lit(None).cast("string"))
    has_text = cv["text"].isNotNull()
    v = v.withColumn("_norm", F.when(has_text, normalize_folded(fold(cv["text"]))))
    v = v.withColumn("_tokens", F.when(has_text, tokens_of_normalized(F.col("_norm"))))
    by_words = comparator.isin("text", "string") | ((comparator == "auto") & (cv["kind"] == "TEXT"))
    by_sorted = (comparator.isin("name", "linkedEntity")) | (cv["kind"] == "ENTITY") | (comparator == "auto")
    is_long = by_words & (F.char_length("_norm") > long_text) if long_text is not None else F.lit(False)
    return v.withColumn(
        "feature",
        F.struct(
            F.col("rank").alias("g"),
            F.col("concept_no").alias("c"),
            F.col("pos").alias("pos"),
            comparator.alias("cmp"),
            cv["kind"].alias("kind"),
            # The text itself is only needed up to the length above which words replace it.
            F.when(~is_long & (comparator != "text"), F.col("_norm")).alias("norm"),
            F.coalesce(is_long, F.lit(False)).alias("long"),
            F.when(by_sorted & ~is_long, F.array_join(F.array_sort("_tokens"), " ")).alias("sorted"),
            F.when(by_words, content_words_of(F.col("_tokens"))).alias("words"),
            F.when(comparator == "exact", F.trim(cv["text"])).alias("raw"),
            cv["date"].alias("date"),
            cv["number"].alias("number"),
            cv["iri"].alias("iri"),
            F.col("_cluster").alias("cluster"),
        ),
    ).drop("_norm", "_tokens", "_cluster")


def _by_kind(z) -> Column:
    """What is compared: string, name, text, exact, date, number, linkedEntity, or null."""
    a, b = z["a"], z["b"]
    entity = (a["kind"] == "ENTITY") | (b["kind"] == "ENTITY")
    texty = a["kind"].isin("ENTITY", "TEXT") & b["kind"].isin("ENTITY", "TEXT")
    return F.when(
        a["cmp"] == "auto",
        F.when(entity & texty, F.lit("linkedEntity"))
        .when(~entity & (a["kind"] == b["kind"]),
              F.when(a["kind"] == "TEXT", "string").when(a["kind"] == "DATE", "date").otherwise("number")),
    ).otherwise(a["cmp"])


def _known_same(z) -> Column:
    same = (z["a"]["iri"] == z["b"]["iri"]) | (z["a"]["cluster"] == z["b"]["cluster"])
    return F.coalesce(same, F.lit(False))


def _needs_ratio(z) -> Column:
    short = ~z["a"]["long"] & ~z["b"]["long"]
    full = (z["a"]["norm"] != "") & (z["b"]["norm"] != "")
    use = (
        (z["how"] == "name")
        | ((z["how"] == "linkedEntity") & ~_known_same(z))
        | ((z["how"] == "string") & short)
    )
    return F.coalesce(use & full, F.lit(False))


def _score_of(z, s1, s2, opt) -> Column:
    a, b, how = z["a"], z["b"], z["how"]
    words = F.when((F.size(a["words"]) > 0) & (F.size(b["words"]) > 0), jaccard(a["words"], b["words"]))
    exact = F.when(
        opt["case_sensitive"],
        F.when((a["raw"] != "") & (b["raw"] != ""), F.when(a["raw"] == b["raw"], 1.0).otherwise(0.0)),
    ).otherwise(
        F.when((a["norm"] != "") & (b["norm"] != ""), F.when(a["norm"] == b["norm"], 1.0).otherwise(0.0))
    )
    name = F.greatest(s1, s2)
    return (
        F.when(how == "string", F.when(a["long"] | b["long"], words).otherwise(s1))
        .when(how == "name", name)
        .when(how == "text", words)
        .when(how == "exact", exact)
        .when(how == "date", cmp_date(a["date"], b["date"], opt["partial"]))
        .when(how == "number", cmp_number(a["number"], b["number"], opt["tolerance"]))
        .when(how == "linkedEntity", F.when(_known_same(z), 1.0).otherwise(opt["label_factor"] * name))
    )


def score_pairs(pairs, cfg) -> DataFrame:
    """Score pairs given with ``rank``, ``group_order`` and the features ``f_a``, ``f_b``.

    Adds ``score`` (weighted mean over the concepts both sides could compare, 4 decimals),
    ``compared_weight``, ``evidence`` (concept, comparator, weight, score, pos_a, pos_b) and
    ``outcome``. The features are dropped.
    """
    combos = F.flatten(
        F.transform(
            F.filter("f_a", lambda x: x["g"] == F.col("rank")),
            lambda x: F.transform(
                F.filter("f_b", lambda y: (y["g"] == x["g"]) & (y["c"] == x["c"])),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        )
    )
    df = pairs.withColumn("_z", combos).drop("f_a", "f_b")
    df = df.withColumn(
        "_z", F.transform("_z", lambda z: F.struct(z["a"].alias("a"), z["b"].alias("b"), _by_kind(z).alias("how")))
    )

    def texts(side, field, sorted_only):
        def pick(z):
            use = _needs_ratio(z)
            if sorted_only:
                use = use & (z["how"] != "string")
            return F.when(use, z[side][field])

        return F.transform("_z", pick)

    # Arrow batches only where some concept compares letters.
    lettered = any(c.comparator in LETTERED for g in cfg.groups for c in g.concepts)
    ratios = indel_ratio_lists if lettered else lambda a, b: F.transform(a, lambda _: F.lit(None).cast("double"))
    df = (
        df.withColumn("_a1", texts("a", "norm", False))
        .withColumn("_b1", texts("b", "norm", False))
        .withColumn("_a2", texts("a", "sorted", True))
        .withColumn("_b2", texts("b", "sorted", True))
        .withColumn("_s1", ratios(F.col("_a1"), F.col("_b1")))
        .withColumn("_s2", ratios(F.col("_a2"), F.col("_b2")))
        .withColumn("_concepts", concepts_of_group(cfg))
    )
    scored = F.transform(
        F.arrays_zip("_z", "_s1", "_s2"),
        lambda t: F.struct(
            t["_z"]["a"]["c"].alias("c"),
            _score_of(
                t["_z"], t["_s1"], t["_s2"], F.element_at("_concepts", t["_z"]["a"]["c"] + 1)
            ).alias("score"),
            # Ties keep the first combination: the maximum prefers small positions.
            (-t["_z"]["a"]["pos"]).alias("na"),
            (-t["_z"]["b"]["pos"]).alias("nb"),
        ),
    )
    df = df.withColumn("_scored", F.filter(scored, lambda s: s["score"].isNotNull())).drop(
        "_z", "_a1", "_b1", "_a2", "_b2", "_s1", "_s2"
    )
    best = F.transform(
        "_concepts",
        lambda k: F.struct(
            k["concept"].alias("concept"),
            k["comparator"].alias("comparator"),
            k["weight"].alias("weight"),
            k["no"].alias("no"),
            F.array_max(F.filter("_scored", lambda s: s["c"] == k["no"])).alias("best"),
        ),
    )
    df = df.withColumn("_best", F.filter(best, lambda e: e["best"].isNotNull())).drop("_scored", "_concepts")
    total = F.aggregate("_best", F.lit(0.0), lambda acc, e: acc + e["weight"])
    weighted = F.aggregate("_best", F.lit(0.0), lambda acc, e: acc + e["best"]["score"] * e["weight"])
    df = df.withColumn("compared_weight", total).withColumn("_weighted", weighted)
    compared = F.transform("_best", lambda e: e["concept"])
    missing = F.size(F.array_except(per_group(cfg, lambda g: g.required), compared)) > 0
    df = df.withColumn(
        "score", F.when(F.col("compared_weight") == 0, F.lit(0.0)).otherwise(round4(F.col("_weighted") / F.col("compared_weight")))
    )
    return df.withColumn("outcome", outcome(cfg, missing)).withColumn(
        "evidence",
        F.transform(
            "_best",
            lambda e: F.struct(
                e["concept"].alias("concept"),
                e["comparator"].alias("comparator"),
                e["weight"].alias("weight"),
                round4(e["best"]["score"]).alias("score"),
                e["no"].alias("no"),
                (-e["best"]["na"]).alias("pos_a"),
                (-e["best"]["nb"]).alias("pos_b"),
            ),
        ),
    ).drop("_best", "_weighted")


def outcome(cfg, missing_required=None) -> Column:
    """PROPOSABLE, INSUFFICIENT_EVIDENCE or BELOW_THRESHOLD from the rounded score."""
    weak = (F.col("compared_weight") < per_group(cfg, lambda g: g.minimum_weight)) | (F.col("compared_weight") == 0)
    if missing_required is not None:
        weak = missing_required | weak
    return (
        F.when(weak, F.lit("INSUFFICIENT_EVIDENCE"))
        .when(F.col("score") >= per_group(cfg, lambda g: g.threshold), F.lit("PROPOSABLE"))
        .otherwise(F.lit("BELOW_THRESHOLD"))
    )
