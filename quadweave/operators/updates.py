"""Changes to the quads of one source, as batch operators returning the new quad table."""

from pyspark.sql import DataFrame, functions as F

from quadweave.functions.iri import mint_iri
from quadweave.operators.patterns import data_quads
from quadweave.runtime import broadcast_if_small
from quadweave.vocab import CREATED, MODIFIED, QUAD_COLUMNS, RDF_TYPE, XSD, data_graph


def as_quads(rows, source) -> DataFrame:
    """(s, p, o, o_kind, o_datatype, o_lang) rows as quads of a data source."""
    have = dict(rows.dtypes)
    col = lambda c, default: F.col(c) if c in have else F.lit(default).cast("string")
    return rows.select(
        F.lit(source).alias("source"), F.lit(data_graph(source)).alias("graph"), F.lit("data").alias("graph_kind"),
        "s", F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), "p", "o",
        col("o_kind", "literal").alias("o_kind"), col("o_datatype", None).alias("o_datatype"), col("o_lang", None).alias("o_lang"))


def _stamp(subjects, source, predicate, at):
    return as_quads(subjects.select("s", F.lit(predicate).alias("p"), F.lit(at).alias("o"), F.lit("literal").alias("o_kind"),
                                    F.lit(XSD + "dateTime").alias("o_datatype")), source)


def create_entities(quads, new, source, at, prefix=None) -> DataFrame:
    """Add entities with types, properties and a creation date to a source.

    ``new``: (s or key, p, o, ...) statements; with ``prefix``, subjects are minted from ``key`` and
    the entity's type.
    """
    if prefix is not None:
        kind = new.where(F.col("p") == RDF_TYPE).groupBy("key").agg(F.min("o").alias("_t"))
        new = new.join(kind, "key").withColumn("s", mint_iri(F.lit(prefix), "_t", "key")).drop("_t", "key")
    made = as_quads(new, source)
    return quads.unionByName(made.unionByName(_stamp(made.select("s").distinct(), source, CREATED, at)).distinct())


def _replace(quads, source, changes):
    touched = broadcast_if_small(changes.select("s", "p").distinct())
    inside = F.col("source") == source
    kept = quads.where(inside).join(touched, ["s", "p"], "left_anti").select(*QUAD_COLUMNS)
    return quads.where(~inside).unionByName(kept)


def replace_properties(quads, changes, source, at) -> DataFrame:
    """Replace all values of each (s, p) of ``changes`` in a source and stamp the modification.

    A change with a null ``o`` clears the property. Other sources are untouched.
    """
    subjects = changes.select("s").distinct()
    stamps = subjects.withColumn("p", F.lit(MODIFIED))
    base = _replace(quads, source, changes.select("s", "p").unionByName(stamps.select("s", "p")))
    added = as_quads(changes.where("o is not null"), source).distinct()
    return base.unionByName(added).unionByName(_stamp(subjects, source, MODIFIED, at))


def add_values(quads, changes, source, at) -> DataFrame:
    """Add values to properties (set semantics) and stamp the modification."""
    subjects = changes.select("s").distinct()
    base = _replace(quads, source, subjects.withColumn("p", F.lit(MODIFIED)))
    inside = base.where(F.col("source") == source)
    added = as_quads(changes, source).distinct()
    keys = ["s", "p", "o", "o_kind"]
    same = [added[k].eqNullSafe(inside[k]) for k in keys] + [added["o_datatype"].eqNullSafe(inside["o_datatype"]), added["o_lang"].eqNullSafe(inside["o_lang"])]
    return base.unionByName(added.join(inside, same, "left_anti")).unionByName(_stamp(subjects, source, MODIFIED, at))


def set_values(quads, changes, source, at) -> DataFrame:
    """Set properties of entities to the given values (all previous values go)."""
    return replace_properties(quads, changes, source, at)


def rename(quads, names, source, at, predicate) -> DataFrame:
    """Replace the name of entities: ``names`` is (s, o)."""
    return replace_properties(quads, names.select("s", F.lit(predicate).alias("p"), "o", F.lit("literal").alias("o_kind")), source, at)


def delete_entities(quads, ids, source):
    """(quads, refused): remove entities as subject and as object within a source.

    Entities the source says nothing about are refused.
    """
    inside = F.col("source") == source
    own = quads.where(inside)
    known = ids.select("s").distinct().join(own.select("s").distinct(), "s", "left_semi")
    gone = broadcast_if_small(known)
    left = own.join(gone, "s", "left_anti").join(gone.select(F.col("s").alias("o"), F.lit("iri").alias("o_kind")), ["o", "o_kind"], "left_anti")
    return quads.where(~inside).unionByName(left.select(*QUAD_COLUMNS)), ids.select("s").distinct().join(known, "s", "left_anti")


def touched_subjects(before, after, source) -> DataFrame:
    """(s): subjects whose statements differ between two states of a source."""
    b = before.where(F.col("source") == source).select("s", "p", "o", "o_kind", "o_datatype", "o_lang")
    a = after.where(F.col("source") == source).select("s", "p", "o", "o_kind", "o_datatype", "o_lang")
    return a.exceptAll(b).select("s").union(b.exceptAll(a).select("s")).distinct()


def stamp_changes(before, after, source, at) -> DataFrame:
    """``after`` with creation and modification dates for what changed in a source.

    New typed subjects get a creation date unless they have one; existing ones a new modification
    date; deleted ones nothing.
    """
    touched = touched_subjects(before, after, source)
    inside = F.col("source") == source
    old = before.where(inside).select("s").distinct()
    now = after.where(inside)
    here = touched.join(now.select("s").distinct(), "s", "left_semi")
    changed = here.join(old, "s", "left_semi")
    fresh = (
        here.join(old, "s", "left_anti")
        .join(now.where(F.col("p") == RDF_TYPE).select("s").distinct(), "s", "left_semi")
        .join(now.where(F.col("p") == CREATED).select("s").distinct(), "s", "left_anti")
    )
    base = _replace(after, source, changed.withColumn("p", F.lit(MODIFIED)))
    return base.unionByName(_stamp(fresh, source, CREATED, at)).unionByName(_stamp(changed, source, MODIFIED, at))


def check_writes(changes, quads, internal_source) -> DataFrame:
    """(s, p, o, violation): changes outside the internal source, on bookkeeping, or on unknown subjects."""
    known = data_quads(quads).select("s").distinct().withColumn("known", F.lit(True))
    typed = changes.where(F.col("p") == RDF_TYPE).select("s").distinct().withColumn("created", F.lit(True))
    c = changes.join(known, "s", "left").join(typed, "s", "left")
    why = (
        F.when(F.col("source") != internal_source, "OUTSIDE_INTERNAL_SOURCE")
        .when(F.col("p").isin(CREATED, MODIFIED), "BOOKKEEPING_PREDICATE")
        .when(F.col("known").isNull() & F.col("created").isNull(), "UNKNOWN_SUBJECT")
    )
    return c.withColumn("violation", why).where("violation is not null").select("s", "p", "o", "violation")
