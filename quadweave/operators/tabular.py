"""Matching of long entity tables (entity, property, value, typevalue) with equal weights."""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.dates import interval, interval_overlaps
from quadweave.functions.lcs import indel_ratio_lists
from quadweave.operators.similarity import equal_values, overlapping_dates, similar_strings
from quadweave.runtime import cut_lineage, skew_safe_join
from quadweave.vocab import RDF_TYPE

TYPE_PROPERTIES = ("rdf:type", RDF_TYPE)
RESOLVED = ("confirmed", "manual")
# Level of a property, of 100, from which its values alone tell pairs apart well.
USEFUL_LEVEL = 70.0


def pivot_multivalue(df, properties=None) -> DataFrame:
    """One row per entity: a list of distinct values and the first type for each property.

    Values are ordered by themselves; a pivot names its columns, so the property list is taken
    from the data unless given.
    """
    d = df.select(F.trim("entity").alias("entity"), F.trim("property").alias("property"), "value", "typevalue")
    cells = d.groupBy("entity", "property").agg(F.array_sort(F.collect_set("value")).alias("values"), F.min("typevalue").alias("type"))
    return cells.groupBy("entity").pivot("property", properties).agg(
        F.first("values").alias("values"), F.first("type").alias("type")).orderBy("entity")


def apply_prior_decisions(a, b, decisions):
    """(a, b, rejected): resolved entities leave both pools; rejected pairs are listed.

    ``decisions``: (entity, matched_with, status) of the first table's entities.
    """
    done = decisions.where(F.col("status").isin(*RESOLVED))
    left = a.join(done.select("entity").distinct(), "entity", "left_anti")
    right = b.join(done.select(F.col("matched_with").alias("entity")).where("entity is not null").distinct(), "entity", "left_anti")
    rejected = decisions.where("status = 'rejected' and matched_with is not null").select("entity", "matched_with").distinct()
    return left, right, rejected


def _groups(df, groups, side):
    """(entity, groups): groups whose types include every type of the entity, first one only."""
    spark = df.sparkSession
    rows = [(n, t) for n, types in enumerate(groups) for t in dict.fromkeys(types)]
    g = F.broadcast(spark.createDataFrame(rows, "g int, value string"))  # configured types
    t = df.where(F.col("property").isin(*TYPE_PROPERTIES)).select("entity", "value").distinct()
    n = t.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    inside = t.join(g, "value").groupBy("entity", "g").agg(F.count(F.lit(1)).alias("k"))
    first = inside.join(n, "entity").where("k = n").groupBy("entity").agg(F.min("g").alias("g"))
    return n.select("entity").join(first, "entity", "left").select(F.col("entity").alias(f"entity_{side}"), F.col("g").alias(f"g_{side}"), F.lit(True).alias(f"typed_{side}"))


def _near_groups(spark, groups):
    """(g_a, g_b, near): configured groups with a common type, every two of them looked at once."""
    common = [(i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if set(x) & set(y)]
    return F.broadcast(spark.createDataFrame(common, "g_a int, g_b int").withColumn("near", F.lit(True)))


def _may_meet():
    return F.col("typed_a").isNull() | F.col("typed_b").isNull() | F.col("near")


def _comparable(cells, side, groups, table):
    """(entity, sig, slot, v, t, start, end): comparable values; a slot is a kind and a property.

    ``cells``: (entity, property, kind, values). ``sig`` is shared by entities with the same slots and
    the same configured group: whatever decides, apart from values, with whom they are compared.
    """
    each = cells.select("entity", F.concat("kind", F.lit(":"), "property").alias("slot"), "kind", F.explode("values").alias("raw"))
    x, d = F.col("raw").try_cast("double"), F.col("d")
    each = each.withColumn("d", F.when(F.col("kind") == "date", _strict_date(F.col("raw"))))
    t = F.when(F.col("kind") == "string", F.lower("raw"))
    v = (F.when(F.col("kind") == "string", F.sha2(t, 256)).when(F.col("kind") == "number", (x + F.lit(0.0)).cast("string"))
         .otherwise(F.concat_ws("/", d["start"].cast("string"), d["end"].cast("string"))))
    known = F.when(F.col("kind") == "number", x.isNotNull()).when(F.col("kind") == "date", d["start"].isNotNull()).otherwise(True)
    each = cut_lineage(each.where(known).select("entity", "slot", v.alias("v"), t.alias("t"), d["start"].alias("start"), d["end"].alias("end")).distinct())
    inside = _groups(table, groups, side).withColumnRenamed(f"entity_{side}", "entity")
    own = each.groupBy("entity").agg(F.array_sort(F.collect_set("slot")).alias("slots")).join(inside, "entity", "left")
    sig = F.sha2(F.to_json(F.struct("slots", f"g_{side}", f"typed_{side}"), {"ignoreNullFields": "false"}), 256)
    own = cut_lineage(own.withColumn("sig", sig))
    kinds = own.select(F.col("sig").alias(f"sig_{side}"), f"g_{side}", f"typed_{side}", "slots").distinct()
    return cut_lineage(each.join(own.select("entity", "sig"), "entity")), kinds


def _wanted_levels(kinds_a, kinds_b, held, groups, threshold):
    """(sig_a, sig_b, slot, level, also): slots through which entities of two signatures have to meet.

    k compared slots with a mean of ``threshold`` miss k (100 - threshold) in all, hence the best of
    any m of them reaches 100 - k (100 - threshold) / m. The m most selective slots are taken, as few
    as keep that level useful; all k of them give the threshold itself. Where one is enough, every
    other slot reaches the level as well: ``also`` is the most selective one of numbers, which have to
    be equal then, if there is any.
    """
    repeats = held.groupBy("slot").agg((F.count(F.lit(1)) / F.count_distinct("v")).alias("repeats"))
    a, b = (k.withColumn("slot", F.explode("slots")).drop("slots") for k in (kinds_a, kinds_b))
    own = ["sig_a", "g_a", "typed_a", "sig_b", "g_b", "typed_b"]
    both = skew_safe_join(a, b, ["slot"], ["sig_a"], ["sig_b"]).join(repeats, "slot")
    both = both.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("repeats", "slot"))).alias("shared"))
    both = both.join(_near_groups(held.sparkSession, groups), ["g_a", "g_b"], "left").where(_may_meet())
    missing = F.size("shared") * F.lit(100.0 - threshold)
    m = F.least(F.size("shared"), F.greatest(F.lit(1), F.ceil(missing / (100.0 - min(threshold, USEFUL_LEVEL)) - 1e-9).cast("int")))
    level = (100.0 - missing / m - 1e-6).alias("level")
    equal = F.filter(F.slice("shared", 2, F.size("shared")), lambda x: x["slot"].startswith("number:"))
    also = F.when((m == 1) & (level > 0), F.get(equal, F.lit(0))["slot"]).alias("also")
    return both.select("sig_a", "sig_b", F.explode(F.transform(F.slice("shared", 1, m), lambda x: x["slot"])).alias("slot"), level, also)


def _boxed(held, wanted, side):
    """``held`` values in the slots that are asked for, with ``also`` and their ``box``: the slot, and the number that has to be equal."""
    asked = wanted.select(F.col(f"sig_{side}").alias("sig"), "slot", "also").distinct()
    met = held.join(asked, ["sig", "slot"])
    numbers = held.where(F.col("slot").startswith("number:")).select("entity", F.col("slot").alias("also"), F.col("v").alias("u"))
    box = F.to_json(F.struct("slot", "also", "u"))
    return cut_lineage(met.join(numbers, ["entity", "also"], "left").where("also is null or u is not null").withColumn("box", box).drop("u"))


def _candidates(left, other, a, b, groups, threshold):
    """(entity_a, entity_b): every pair that may reach ``threshold``, which is above 0, and few others."""
    held_a, kinds_a = _comparable(left.withColumnRenamed("va", "values"), "a", groups, a)
    forms = F.explode(F.array(F.lit("string"), F.lit("number"), F.lit("date")))
    held_b, kinds_b = _comparable(other.select("entity", "property", forms.alias("kind"), F.col("vb").alias("values")), "b", groups, b)
    wanted = cut_lineage(_wanted_levels(kinds_a, kinds_b, held_b, groups, threshold))
    held_a, held_b = _boxed(held_a, wanted, "a"), _boxed(held_b, wanted, "b")
    least = wanted.groupBy("slot", "also").agg(F.min("level").alias("level"))
    boxes = held_a.select("slot", "also", "box").distinct().join(held_b.select("box").distinct(), "box", "left_semi")
    levels = cut_lineage(boxes.join(least, (boxes["slot"] == least["slot"]) & boxes["also"].eqNullSafe(least["also"])).select(F.col("box").alias("slot"), "level"))

    def of_kind(held, kind, *cols):
        return held.where(F.col("slot").startswith(kind + ":")).select(F.col("box").alias("slot"), "v", *cols).distinct()

    close = similar_strings(of_kind(held_a, "string", "t"), of_kind(held_b, "string", "t"), levels)
    close = close.unionByName(overlapping_dates(of_kind(held_a, "date", "start", "end"), of_kind(held_b, "date", "start", "end")))
    close = close.unionByName(equal_values(of_kind(held_a, "number"), of_kind(held_b, "number"))).withColumnRenamed("slot", "box")
    a_side, b_side = (h.select("box", F.col("v").alias(f"v_{s}"), F.col("sig").alias(f"sig_{s}"), F.col("entity").alias(f"entity_{s}"), *(["slot", "also"] if s == "a" else []))
                      for h, s in ((held_a, "a"), (held_b, "b")))
    # Values meet per signature first: entities are listed only where their signatures ask for it.
    met = close.join(a_side.drop("entity_a").distinct(), ["box", "v_a"]).join(b_side.drop("entity_b").distinct(), ["box", "v_b"])
    asked = wanted.select("sig_a", "sig_b", "level", F.col("slot").alias("_slot"), F.col("also").alias("_also"))
    met = met.join(asked, ["sig_a", "sig_b"]).where("slot = _slot and also <=> _also and best >= level")
    met = cut_lineage(met.select("box", "v_a", "sig_a", "v_b", "sig_b").distinct())
    met = skew_safe_join(met, a_side.drop("slot", "also"), ["box", "v_a", "sig_a"], ["v_b", "sig_b"], ["entity_a"])
    met = skew_safe_join(met, b_side, ["box", "v_b", "sig_b"], ["entity_a"], ["entity_b"])
    return met.select("entity_a", "entity_b").distinct()


def _folded(cells, table, groups, side):
    """(cells of one entity for all that have the same ones and the same group, members): (entity, like) for each entity."""
    own = cells.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(*[c for c in cells.columns if c != "entity"]))).alias("cells"))
    own = own.join(_groups(table, groups, side).withColumnRenamed(f"entity_{side}", "entity"), "entity", "left")
    digest = F.sha2(F.to_json(F.struct("cells", f"g_{side}", f"typed_{side}"), {"ignoreNullFields": "false"}), 256)
    own = cut_lineage(own.select("entity", digest.alias("digest")))
    first = own.groupBy("digest").agg(F.min("entity").alias("like"))
    members = cut_lineage(own.join(first, "digest").select("entity", "like"))
    return cut_lineage(cells.join(members.where("entity = like").select("entity"), "entity", "left_semi")), members


def match_tables(a, b, groups, threshold=75, rejected=None) -> DataFrame:
    """(source_entity, target_entity, score): pairs scoring at least ``threshold`` of 100.

    Each property of the first table counts the same: strings by rounded indel ratio of lower-case
    text, numbers by equality, dates 100 for one day, 85 for an overlap. Typed entities must belong
    to groups with a common type; untyped ones are compared with all. Pairs are formed through
    values similar enough for the threshold, and compared in all common properties then, one pair for
    all entities that have the same values; at a
    threshold of 0 or less every pair with a common property qualifies and is formed. Rows without
    entity or property, and properties without a value that can be compared, count nowhere.
    """
    keep = ~F.col("property").isin(*TYPE_PROPERTIES) & F.col("entity").isNotNull()
    kinds = a.where(keep).groupBy("entity", "property").agg(F.min("typevalue").alias("kind"), F.array_sort(F.collect_set("value")).alias("va"))
    left = cut_lineage(kinds.where(F.col("kind").isin("string", "date", "number")))
    other = cut_lineage(b.where(keep).groupBy("entity", "property").agg(F.array_sort(F.collect_set("value")).alias("vb")))
    if threshold > 0:
        (left, members_a), (other, members_b) = _folded(left, a, groups, "a"), _folded(other, b, groups, "b")
    own, theirs = left.withColumnRenamed("entity", "entity_a"), other.withColumnRenamed("entity", "entity_b")
    if threshold > 0:
        met = cut_lineage(_candidates(left, other, a, b, groups, threshold)).join(own, "entity_a").join(theirs, ["entity_b", "property"])
    else:
        met = skew_safe_join(own, theirs, ["property"], ["entity_a"], ["entity_b"])
        met = met.join(_groups(a, groups, "a"), "entity_a", "left").join(_groups(b, groups, "b"), "entity_b", "left")
        met = met.join(_near_groups(a.sparkSession, groups), ["g_a", "g_b"], "left").where(_may_meet())
    combos = F.flatten(F.transform("va", lambda x: F.transform("vb", lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = met.withColumn("z", combos)
    text = F.col("kind") == "string"
    none = F.array().cast("array<string>")
    met = met.withColumn("ratio", indel_ratio_lists(
        F.when(text, F.transform("z", lambda z: F.lower(z["x"]))).otherwise(none),
        F.when(text, F.transform("z", lambda z: F.lower(z["y"]))).otherwise(none)))

    def number(z):
        p, q = z["x"].try_cast("double"), z["y"].try_cast("double")
        return F.when(p.isNotNull() & q.isNotNull(), F.when(p == q, 100.0).otherwise(0.0))

    def date(z):
        p, q = _strict_date(z["x"]), _strict_date(z["y"])
        exact = (p["start"] == p["end"]) & (q["start"] == q["end"]) & (p["start"] == q["start"])
        return F.when(p["start"].isNotNull() & q["start"].isNotNull(),
                      F.when(~interval_overlaps(p, q), 0.0).when(exact, 100.0).otherwise(85.0))

    scores = (
        F.when(text, F.transform("ratio", lambda r: F.round(r * 100).cast("double")))
        .when(F.col("kind") == "number", F.transform("z", number))
        .otherwise(F.transform("z", date))
    )
    met = met.withColumn("best", F.array_max(scores))
    scored = met.groupBy("entity_a", "entity_b").agg(F.avg("best").alias("score")).where(F.col("score") >= threshold)
    if threshold > 0:
        scored = cut_lineage(scored.withColumnsRenamed({"entity_a": "like_a", "entity_b": "like_b"}))
        for s, members in (("a", members_a), ("b", members_b)):
            named = members.select(F.col("like").alias(f"like_{s}"), F.col("entity").alias(f"entity_{s}"))
            scored = skew_safe_join(scored, named, [f"like_{s}"], ["like_b" if s == "a" else "entity_a"], [f"entity_{s}"])
    if rejected is not None:
        scored = scored.join(rejected.select(F.col("entity").alias("entity_a"), F.col("matched_with").alias("entity_b")), ["entity_a", "entity_b"], "left_anti")
    return scored.select(F.col("entity_a").alias("source_entity"), F.col("entity_b").alias("target_entity"), "score")


def _strict_date(raw):
    s = F.trim(raw)
    day = lambda t: F.try_to_date(t, "yyyy-MM-dd")
    month = day(F.rpad(s, 10, "-01"))
    return (
        F.when(s.rlike(r"^\d{4}$"), interval(day(F.rpad(s, 10, "-01-01")), day(F.rpad(s, 10, "-12-31")), False))
        .when(s.rlike(r"^\d{4}-\d{2}$"), interval(month, F.last_day(month), False))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), interval(day(s), day(s), True))
    )
