"""Matching configuration: reading, checks, and its small relational form.

A configuration is a document of a few groups and concepts written by hand, so it is handled on
the driver; what operators need of it becomes literals or frames of proven small size.
"""

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from quadweave.vocab import IMPLICIT_PREFIXES, LABEL_PREDICATES, RDF_TYPE

# Comparators and the options each one knows.
COMPARATORS = {
    "auto": {},
    "string": {},
    "name": {},
    "text": {},
    "exact": {"caseSensitive": "boolean"},
    "date": {"partialOverlapScore": "unit"},
    "number": {"tolerance": "non-negative"},
    "linkedEntity": {"labelFactor": "unit"},
}
BLOCKING_COMPARATORS = ("name", "string", "exact", "date", "auto")


@dataclass
class Concept:
    key: str
    predicates: list
    comparator: str = "auto"
    weight: float = 1.0
    blocking: bool = False
    options: dict = field(default_factory=dict)


@dataclass
class Group:
    id: str
    label: str
    types: list
    concepts: list
    required: list
    threshold: float
    minimum_weight: float
    own_threshold: float = None
    own_minimum_weight: float = None
    # "keys": entities meet through blocking keys; "all": every pair of the group.
    candidates: str = "keys"


@dataclass
class Config:
    groups: list
    prefixes: dict
    threshold: float = 0.75
    minimum_weight: float = 2.0
    max_proposals: int = 5
    compare_untyped: bool = False
    include_subclasses: bool = True
    # Characters beyond which "string" compares words instead of letters; None: never.
    long_text: int | None = None
    # Letters of the prefix keys beside the word keys; 0: none.
    prefix_key: int = 4

    def predicates(self):
        """Concept predicates in configuration order, without duplicates."""
        return list(dict.fromkeys(p for g in self.groups for c in g.concepts for p in c.predicates))

    def wanted_predicates(self):
        """What a profile reads: concept predicates and label predicates, never rdf:type."""
        wanted = dict.fromkeys(self.predicates() + LABEL_PREDICATES)
        wanted.pop(RDF_TYPE, None)
        return list(wanted)


def _fold(s):
    nfd = unicodedata.normalize("NFD", s or "")
    return "".join(c for c in nfd if unicodedata.category(c)[0] != "M").lower()


def slug_text(label):
    return re.sub(r"^-+|-+$", "", re.sub("[^a-z0-9]+", "-", _fold(label))) or "group"


def expand(name, prefixes):
    s = name.strip()
    if "://" in s or s.startswith("urn:"):
        return s
    prefix, colon, rest = s.partition(":")
    ns = {**IMPLICIT_PREFIXES, **prefixes}.get(prefix) if colon and prefix else None
    return s if ns is None else ns + rest


def _texts(node):
    values = [node] if isinstance(node, str) else node if isinstance(node, list) else []
    return [v for v in values if isinstance(v, str) and v.strip()]


def _concept(key, node, prefixes):
    spec = node if isinstance(node, dict) else {"predicates": node}
    weight = spec.get("weight")
    return Concept(
        key,
        [expand(p, prefixes) for p in _texts(spec.get("predicates"))],
        spec.get("comparator") or "auto",
        1.0 if weight is None else float(weight),
        bool(spec.get("blocking") or False),
        {k: v for k, v in (spec.get("options") or {}).items() if v is not None},
    )


def load_config(document):
    """Configuration from a JSON text or its parsed form; shorthands and CURIEs are resolved."""
    doc = json.loads(document) if isinstance(document, str) else document
    if not isinstance(doc, dict):
        raise ValueError("a matching configuration is a JSON object")
    prefixes = {k: v for k, v in (doc.get("prefixes") or {}).items() if isinstance(v, str)}
    given = {k: v for k, v in (doc.get("defaults") or {}).items() if v is not None}
    cfg = Config(
        [],
        prefixes,
        float(given.get("threshold", 0.75)),
        float(given.get("minimumComparedWeight", 2.0)),
        int(given.get("maxProposalsPerEntity", 5)),
        bool(given.get("compareUntypedEntities", False)),
        bool(given.get("includeSubclasses", True)),
        int(given["longText"]) if "longText" in given else None,
        int(given.get("prefixKey", 4)),
    )
    nodes = [g for g in doc.get("equivalentGroups") or [] if isinstance(g, dict)]
    taken = {g["id"] for g in nodes if (g.get("id") or "").strip()}
    for g in nodes:
        gid = g.get("id")
        if not (gid or "").strip():
            base = gid = slug_text(g.get("groupLabel"))
            n = 2
            while gid in taken:
                gid, n = f"{base}-{n}", n + 1
            taken.add(gid)
        own_t, own_w = g.get("threshold"), g.get("minimumComparedWeight")
        cfg.groups.append(
            Group(
                gid,
                g.get("groupLabel"),
                [expand(t, prefixes) for t in _texts(g.get("equivalentTypes"))],
                [_concept(k, v, prefixes) for k, v in (g.get("properties") or {}).items()],
                _texts(g.get("requiredConcepts")),
                cfg.threshold if own_t is None else float(own_t),
                cfg.minimum_weight if own_w is None else float(own_w),
                own_t,
                own_w,
                g.get("candidates") or "keys",
            )
        )
    return cfg


def as_document(cfg):
    """Canonical JSON form: every default spelled out, CURIEs expanded."""
    return {
        "prefixes": cfg.prefixes,
        "defaults": {
            "threshold": cfg.threshold,
            "minimumComparedWeight": cfg.minimum_weight,
            "maxProposalsPerEntity": cfg.max_proposals,
            "compareUntypedEntities": cfg.compare_untyped,
            "includeSubclasses": cfg.include_subclasses,
            "longText": cfg.long_text,
            "prefixKey": cfg.prefix_key,
        },
        "equivalentGroups": [
            {
                "id": g.id,
                "groupLabel": g.label,
                "equivalentTypes": g.types,
                "threshold": g.own_threshold,
                "minimumComparedWeight": g.own_minimum_weight,
                "candidates": g.candidates,
                "requiredConcepts": g.required,
                "properties": {
                    c.key: {
                        "predicates": c.predicates,
                        "comparator": c.comparator,
                        "weight": c.weight,
                        "blocking": c.blocking,
                        "options": c.options,
                    }
                    for c in g.concepts
                },
            }
            for g in cfg.groups
        ],
    }


def config_hash(cfg):
    text = json.dumps(as_document(cfg), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def _option_ok(kind, value):
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "boolean":
        return isinstance(value, bool)
    return number and value >= 0 and (kind == "non-negative" or value <= 1)


def validate_config(cfg):
    """Structural findings as (severity, path, code)."""
    found = []

    def error(path, code):
        found.append(("error", path, code))

    def unit(value, path):
        if value is not None and not 0 <= value <= 1:
            error(path, "OUT_OF_RANGE")

    unit(cfg.threshold, "defaults.threshold")
    if cfg.minimum_weight < 0:
        error("defaults.minimumComparedWeight", "OUT_OF_RANGE")
    if not 1 <= cfg.max_proposals <= 50:
        error("defaults.maxProposalsPerEntity", "OUT_OF_RANGE")
    if cfg.long_text is not None and cfg.long_text < 1:
        error("defaults.longText", "OUT_OF_RANGE")
    if cfg.prefix_key < 0:
        error("defaults.prefixKey", "OUT_OF_RANGE")
    seen = set()
    for i, g in enumerate(cfg.groups):
        at = f"equivalentGroups[{i}]"
        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", g.id or ""):
            error(at + ".id", "INVALID_ID")
        if g.id in seen:
            error(at + ".id", "DUPLICATE_ID")
        seen.add(g.id)
        if not (g.label or "").strip():
            error(at + ".groupLabel", "REQUIRED")
        if not g.types:
            error(at + ".equivalentTypes", "REQUIRED")
        if g.candidates not in ("keys", "all"):
            error(at + ".candidates", "UNKNOWN_VALUE")
        for t in g.types:
            if "://" not in t and not t.startswith("urn:"):
                error(at + ".equivalentTypes", "INVALID_IRI")
        unit(g.own_threshold, at + ".threshold")
        if g.own_minimum_weight is not None and g.own_minimum_weight < 0:
            error(at + ".minimumComparedWeight", "OUT_OF_RANGE")
        if not g.concepts:
            error(at + ".properties", "REQUIRED")
        keys = {c.key for c in g.concepts}
        for r in g.required:
            if r not in keys:
                error(at + ".requiredConcepts", "UNKNOWN_CONCEPT")
        for c in g.concepts:
            here = f"{at}.properties.{c.key}"
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", c.key):
                error(here, "INVALID_KEY")
            if not c.predicates:
                error(here + ".predicates", "REQUIRED")
            for p in c.predicates:
                if "://" not in p and not p.startswith("urn:"):
                    error(here + ".predicates", "INVALID_IRI")
            if c.comparator not in COMPARATORS:
                error(here + ".comparator", "UNKNOWN_COMPARATOR")
            else:
                for name, value in c.options.items():
                    kind = COMPARATORS[c.comparator].get(name)
                    if kind is None:
                        error(f"{here}.options.{name}", "UNKNOWN_OPTION")
                    elif not _option_ok(kind, value):
                        error(f"{here}.options.{name}", "INVALID_OPTION")
                if c.blocking and c.comparator in ("text", "linkedEntity"):
                    found.append(("warning", here + ".blocking", "BLOCKING_IGNORED"))
            if not 0 < c.weight <= 100:
                error(here + ".weight", "OUT_OF_RANGE")
        if g.concepts and g.minimum_weight > sum(c.weight for c in g.concepts):
            found.append(("warning", at + ".minimumComparedWeight", "UNREACHABLE_EVIDENCE"))
    return found


# --- relational form ------------------------------------------------------------------------


def group_types(spark, cfg):
    """(group_order, group_id, type): one row per configured type."""
    rows = [(i, g.id, t) for i, g in enumerate(cfg.groups) for t in dict.fromkeys(g.types)]
    return spark.createDataFrame(rows, "group_order int, group_id string, type string")


def concept_predicates(spark, cfg):
    """One row per (group, concept, predicate) with what reading and comparing need."""
    rows = []
    for i, g in enumerate(cfg.groups):
        for n, c in enumerate(g.concepts):
            keyed = c.blocking and c.comparator in BLOCKING_COMPARATORS
            for pos, p in enumerate(dict.fromkeys(c.predicates)):
                rows.append((i, g.id, n, c.key, c.comparator, keyed, pos, p))
    return spark.createDataFrame(
        rows,
        "group_order int, group_id string, concept_no int, concept string, comparator string, "
        "keyed boolean, predicate_pos int, p string",
    )


def concepts_of_group(cfg, group_order="group_order"):
    """Column: the concepts of a row's group, as a literal array per group."""
    out = None
    kind = (
        "array<struct<no:int,concept:string,comparator:string,weight:double,case_sensitive:boolean,"
        "partial:double,tolerance:double,label_factor:double>>"
    )
    for i, g in enumerate(cfg.groups):
        concepts = F.array(
            *[
                F.struct(
                    F.lit(n).alias("no"),
                    F.lit(c.key).alias("concept"),
                    F.lit(c.comparator).alias("comparator"),
                    F.lit(c.weight).alias("weight"),
                    F.lit(bool(c.options.get("caseSensitive", False))).alias("case_sensitive"),
                    F.lit(float(c.options.get("partialOverlapScore", 0.85))).alias("partial"),
                    F.lit(float(c.options.get("tolerance", 0))).alias("tolerance"),
                    F.lit(float(c.options.get("labelFactor", 0.9))).alias("label_factor"),
                )
                for n, c in enumerate(g.concepts)
            ]
        ).cast(kind)
        cond = F.col(group_order) == i
        out = F.when(cond, concepts) if out is None else out.when(cond, concepts)
    return out


def per_group(cfg, value, group_order="group_order"):
    """Column: ``value(group)`` of a row's group, as a literal."""
    out = None
    for i, g in enumerate(cfg.groups):
        v = value(g)
        v = F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
        out = F.when(F.col(group_order) == i, v) if out is None else out.when(F.col(group_order) == i, v)
    return out


def is_keyed_group(group):
    """Whether entities of the group meet through keys: a stated setting, whatever the group's size."""
    return group.candidates == "keys" and any(c.blocking and c.comparator in BLOCKING_COMPARATORS for c in group.concepts)
