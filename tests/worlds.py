"""Random worlds of sources, entities and links from a seed; tests work out what to expect by brute force."""

import random
import unicodedata
from dataclasses import dataclass, field

from quadweave.vocab import LINK_SCHEMA, QUAD_SCHEMA, RDF_TYPE, RDFS_LABEL, XSD, data_graph

LABEL, YEAR, CODE = RDFS_LABEL, "urn:p:year", "urn:p:code"


def quad(source, s, p, o, kind="literal", dtype=None, lang=None, graph_kind="data"):
    subject = "bnode" if s.startswith("_:") else "iri"
    return (source, data_graph(source), graph_kind, s, subject, p, o, kind, (XSD + dtype) if dtype else None, lang)


def typed(source, s, t):
    return quad(source, s, RDF_TYPE, t, "iri")


def link(lid, a, b, status, origin="ALGORITHM", score=None, types=None):
    """A link between two (source, iri) ends, the smaller source first."""
    (sa, ia), (sb, ib) = sorted((a, b))
    return (lid, sa, ia, None, types, sb, ib, None, types, status, origin, None, score, None, None, None, None, None, None)


def quads(spark, rows):
    return spark.createDataFrame(rows, QUAD_SCHEMA)


def links(spark, rows):
    return spark.createDataFrame(rows, LINK_SCHEMA)


@dataclass
class World:
    """Entities as {(source, iri): {"type", LABEL: [...], YEAR: [(text, datatype)], CODE: [...]}}."""

    seed: int
    sources: int = 3
    entities: int = 12
    types: int = 2
    words: int = 9
    shared: int = 2
    facts: dict = field(default_factory=dict)

    def __post_init__(self):
        rnd = random.Random(self.seed)
        pool = ["".join(rnd.choice("abcdefgilmnorstuéö") for _ in range(rnd.randrange(2, 8))) for _ in range(self.words)]
        for s in range(self.sources):
            for n in range(self.entities):
                # The first few IRIs are the same in every source that takes them.
                iri = f"urn:all:{n}" if n < self.shared and rnd.random() < 0.6 else f"urn:{s}:{n}"
                labels = sorted({" ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.choice([0, 1, 1, 1, 2, 3]))})
                year = rnd.randrange(1900, 1904)
                when = rnd.choice([[], [(str(year), "gYear")], [(f"{year}-{rnd.randrange(1, 13):02}-0{rnd.randrange(1, 9)}", "date")]])
                codes = [rnd.choice("xyz")] if rnd.random() < 0.3 else []
                self.facts[f"src{s}", iri] = {"type": f"urn:t:{rnd.randrange(self.types)}", LABEL: labels, YEAR: when, CODE: codes}

    def rows(self):
        for (source, iri), f in self.facts.items():
            yield typed(source, iri, f["type"])
            yield from (quad(source, iri, LABEL, v, dtype="string") for v in f[LABEL])
            yield from (quad(source, iri, YEAR, v, dtype=d) for v, d in f[YEAR])
            yield from (quad(source, iri, CODE, v, dtype="string") for v in f[CODE])

    def quads(self, spark):
        return quads(spark, list(self.rows()))

    def config(self, **defaults):
        group = lambda t: {
            "id": f"g{t}", "groupLabel": f"G{t}", "equivalentTypes": [f"urn:t:{t}"], "properties": {
                "label": {"predicates": [LABEL], "comparator": "name", "weight": 3},
                "year": {"predicates": [YEAR], "comparator": "date", "weight": 1},
                "code": {"predicates": [CODE], "comparator": "exact", "weight": 2}}}
        return {"defaults": {"threshold": 0.6, "minimumComparedWeight": 2.0, "maxProposalsPerEntity": 2} | defaults,
                "equivalentGroups": [group(t) for t in range(self.types)]}

    def identical(self):
        """IRIs held by several sources, with those sources."""
        held = {}
        for source, iri in self.facts:
            held.setdefault(iri, []).append(source)
        return {iri: sorted(s) for iri, s in held.items() if len(s) > 1}

    def random_links(self, n, statuses=("PROPOSED",), origins=("ALGORITHM",)):
        rnd, nodes, seen, out = random.Random(self.seed + 1), sorted(self.facts), set(), []
        while len(out) < n:
            a, b = sorted(rnd.sample(nodes, 2))
            if a[0] != b[0] and a[1] != b[1] and (a, b) not in seen:
                seen.add((a, b))
                out.append(link(f"l{len(out):04}", a, b, rnd.choice(statuses), rnd.choice(origins), score=round(rnd.random(), 2)))
        return out


def components(nodes, pairs):
    """{node: frozenset of its component} by repeated merging."""
    group = {n: {n} for n in nodes}
    for u, v in pairs:
        a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
        if a is not b:
            a |= b
            for n in b:
                group[n] = a
    return {n: frozenset(g) for n, g in group.items()}


# --- scores from their definitions ----------------------------------------------------------


def plain(s):
    nfd = unicodedata.normalize("NFD", s.lower())
    return " ".join("".join(c if c.isalnum() else " " for c in nfd if unicodedata.category(c)[0] != "M").split())


def ratio(a, b):
    """Twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def name_score(a, b):
    a, b = plain(a), plain(b)
    return max(ratio(a, b), ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


def date_score(a, b):
    """The same day 1, a year against itself or a day of it 0.85, else 0."""
    return 1.0 if a == b and len(a) > 4 else 0.85 if a[:4] == b[:4] and 4 in (len(a), len(b)) else 0.0


def score(f, g):
    """(score, compared weight) of two entities' facts; None without a concept in common."""
    parts = []
    for key, weight, of in ((LABEL, 3, name_score), (CODE, 2, lambda a, b: float(a == b))):
        if f[key] and g[key]:
            parts.append((weight, max(of(a, b) for a in f[key] for b in g[key])))
    if f[YEAR] and g[YEAR]:
        parts.append((1, max(date_score(a, b) for a, _ in f[YEAR] for b, _ in g[YEAR])))
    weight = sum(w for w, _ in parts)
    return (round(sum(w * s for w, s in parts) / weight, 4), weight) if parts else None


def proposals(world, a, b, links=(), threshold=0.6, least=2.0, most=2):
    """{(iri a, iri b): score} kept between two sources: the best of each side."""
    confirmed = [((x[1], x[2]), (x[5], x[6])) for x in links if x[9] in ("ACCEPTED", "MANUAL")]
    same = [((s, iri), (t, iri)) for iri, held in world.identical().items() for s, t in zip(held, held[1:])]
    group = components(world.facts, confirmed + same)
    apart = {frozenset(group[e] for e in ((x[1], x[2]), (x[5], x[6]))) for x in links if x[9] == "REJECTED"}
    found = []
    for x, f in world.facts.items():
        for y, g in world.facts.items():
            if (x[0], y[0]) != (a, b) or f["type"] != g["type"] or {s for s, _ in group[x]} & {s for s, _ in group[y]} or frozenset((group[x], group[y])) in apart:
                continue
            got = score(f, g)
            if got and got[1] >= least and got[0] >= threshold:
                found.append((-got[0], x[1], y[1]))
    kept, seen = {}, {}
    for s, x, y in sorted(found):
        for key in (("a", x), ("b", y)):
            seen[key] = seen.get(key, 0) + 1
        if min(seen["a", x], seen["b", y]) <= most:
            kept[x, y] = -s
    return kept
