"""The pipeline and the registered queries against straight versions on one machine."""

import itertools
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from quadweave.llm import mixture, pseudonyms, rules
from quadweave.llm.queries import ORACLES, QUERIES

from test_simhash import brute_classes, brute_fingerprint

SF = "/root/testdata/sf0.001"


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with copies, junk, personal data and a very long text."""
    rng, path = random.Random(6), str(tmp_path_factory.mktemp("pipeline"))
    rows = []
    for i in range(60):
        text = " ".join(f"w{rng.randrange(5_000)}ord" for _ in range(rng.randint(60, 300)))
        rows.append((i, text, "en", rng.choice("aabc"), len(text)))
    rows += [(100 + i, rows[3][1] + (" end" if i % 2 else ""), "en", "b", 1) for i in range(5)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "### " * 200, "en", "a", 800), (203, "too few words", "en", "a", 13)]
    rows += [(204, rows[5][1] + " card 4845168114407329 of 1985-03-12", "en", None, 1), (205, " ".join(f"long{i}" for i in range(30_000)), "en", "c", 1)]
    write(spark, rows, path)
    return path, rows


def test_stages_against_brute_force(spark, small):
    path, rows = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality", "near_dedup", "privacy", "mixture", "packing"]

    kept = stages["quality"](spark, docs, path)
    want = {r[0]: r[1] for r in rows if rules.first_rejection(rules.Text(r[1]), rules.RULES) is None}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == want and {200, 201, 202, 203}.isdisjoint(want)

    single = stages["near_dedup"](spark, kept, path)
    ids = sorted(want)
    low = brute_classes([brute_fingerprint(want[i]) for i in ids])
    first = {ids[c] for c in low}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(first) and not {101, 103} & first

    private = stages["privacy"](spark, single, path)
    permuter = pseudonyms.Permuter(pseudonyms.DEMO_KEY)
    hidden = {i: pseudonyms.pseudonymise(want[i], permuter)[0] for i in first}
    assert {r["doc_id"]: r["text"] for r in private.collect()} == hidden
    assert "4845168114407329" not in "".join(hidden.values())

    mixed = stages["mixture"](spark, private, path)
    assert mixed.columns == private.columns == docs.columns
    report = {r["doc_id"]: r["taken"] for r in mixture.mix_report(private).collect()}
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert dict(taken) == {k: v for k, v in report.items() if v}

    packed = stages["packing"](spark, mixed, path).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids_of = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
    pieces = Counter(
        (r["doc_id"], k // 4096, zlib.crc32(ids[k : k + 4096].tobytes())) for r in mixed.collect() for ids in [ids_of(r["text"])] for k in range(0, len(ids), 4096)
    )
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == pieces
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        assert sum(n for _, n in items) <= 4096
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(items)))


def test_run_is_its_stages(spark, small):
    path, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    same = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert same(corpus_pipeline.run(spark, path)) == same(docs)


def test_pipeline_on_nothing(spark, tmp_path):
    write(spark, [], str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    write(spark, [(1, None, None, None, None)], str(tmp_path / "none"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_nearest"])
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    rows = Counter(tuple(r[c] for c in want.columns) for r in got.collect())
    assert set(want.columns) == set(got.columns) and rows == Counter(want.fetchall())


def test_every_operator_has_its_query():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert QUERIES.items() <= __spark_entry__.queries().items()


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__spark_entry__.__file__).parent / "quadweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "quadweave.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()


def test_token_query_is_the_library(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, set()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        want.add((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op2_token_codes"](spark, SF).collect()} == want
