import corpus_pipeline
from cohortspark.llm import piece_sampling
from cohortspark.plans.compare import compare, duckdb_connect
from cohortspark.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_SMALL
from tests.llm import test_decontaminate, test_pieces, test_quality, test_secret_scan, test_simhash

import pytest


def test_stages_against_brute_force(spark, checkpoints, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF_SMALL)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        if k == 0:
            gone = {i for i, r in before.items() if test_quality.brute(r.text)[5]}
            assert not gone & set(after) and len(after) > len(before) / 2
        elif k == 1:
            prints = {i: test_simhash.brute_print(r.text) for i, r in before.items()}
            want = set()
            for group in test_simhash.groups_of(prints.values(), 3):
                want.add(min(i for i, p in prints.items() if p in group))
            assert set(after) == want
        elif k == 2:
            hits = test_decontaminate.brute([(i, r.text) for i, r in before.items()], items)
            assert set(after) == {h[0] for h in hits if not h[5]}
        elif k == 3:
            assert set(after) == set(before)
            for i, r in after.items():
                assert not test_secret_scan.brute(r.text) and r.n_chars == len(r.text)
                if not test_secret_scan.scanned(before[i].text):
                    assert r == before[i]
        else:
            assert set(after) == set(before) and all(r.lossless for r in after.values())
            back = piece_sampling.decode_pieces(docs, test_pieces.PATH).collect()
            assert all(r.text == before[r.doc_id].text for r in back)


def test_run_and_rows_without_ids(spark, checkpoints, tmp_path):
    text = " ".join(f"word{i} and{i} other{i}" for i in range(12))
    rows = [(None, text, "en", "s", len(text))] * 2 + [
        (1, text + " one", "en", "s", 1), (1, text + " one", "en", "s", 1), (2, None, None, None, 0),
        (None, A, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                "n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the near copy without an id goes, the other text without one stays
    assert sorted((str(r.doc_id), r.lossless) for r in got) == [("1", True), ("None", True)]
    assert piece_sampling.decode_pieces(spark.createDataFrame(got).filter("doc_id is null"),
                                        test_pieces.PATH).first().text == A


SCHEMA = "doc_id long, text string, lang string"
A, B = (" ".join(f"{p}{i * i % 89}" for i in range(60)) for p in "ab")


def stage_rows(spark, stage, given, sf_dir=SF_SMALL):
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    return sorted(map(tuple, stage(spark, docs, sf_dir).collect()), key=repr)


def test_near_dedup_keeps_texts_that_share_an_id(spark, checkpoints):
    stage = corpus_pipeline.near_dedup_stage
    assert stage_rows(spark, stage, [(0, B, "x"), (1, A, "x"), (1, B, "x")]) == [
        (0, B, "x"), (1, A, "x")]
    # one of each group, be its ids missing, shared or repeated
    assert stage_rows(spark, stage, [(None, A, "x"), (None, B, "x"), (4, B, "x"), (4, B, "x"),
                                     (None, A, "y")]) in (
        [(4, B, "x"), (None, A, "x")], [(4, B, "x"), (None, A, "y")])
    assert stage_rows(spark, stage, [(0, A, "x"), (0, B, "x")]) == [(0, A, "x"), (0, B, "x")]


def test_decontamination_judges_each_row(spark, checkpoints):
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    leak = "x " + items.first().text
    got = stage_rows(spark, corpus_pipeline.decontamination_stage, [
        (1, A, "x"), (1, leak, "x"), (None, leak, "x"), (None, B, "x"), (2, leak, "x"), (3, A, "x"),
        (3, A, "x")])
    assert got == sorted([(1, A, "x"), (None, B, "x"), (3, A, "x"), (3, A, "x")], key=repr)


def test_quality_judges_each_row(spark, checkpoints):
    bad = "spam spam spam spam spam spam " * 5
    got = stage_rows(spark, corpus_pipeline.quality_stage, [
        (1, A, "x"), (1, bad, "x"), (None, bad, "x"), (None, B, "x"), (None, None, None),
        (2, A, "x"), (2, A, None)])
    assert got == sorted([(1, A, "x"), (None, B, "x"), (2, A, "x"), (2, A, None)], key=repr)


def test_stages_on_edge_rows(edge_docs, no_docs, spark):
    """Every column stays, whatever its name; empty tables stay empty."""
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, edge_docs, SF_SMALL)
        assert out.columns == edge_docs.columns, name
        kept = out.select("doc_id", "text", "_text_hash", "row").collect()
        assert all(r["row"] == r["_text_hash"] for r in kept)
        ids = [r.doc_id for r in kept]
        if name == "quality rules":
            assert set(ids) <= {5, 6}
        elif name == "SimHash near-dedup":
            # one of each group; an id that is missing comes last
            assert sorted(ids, key=repr) == sorted([-7, 1, 2, 5, None], key=repr)
        else:
            assert len(ids) == edge_docs.count()
        assert stage(spark, no_docs, SF_SMALL).collect() == []


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracles(spark, checkpoints, key):
    con = duckdb_connect(SF_SMALL)
    ok, said = compare(QUERIES[key](spark, SF_SMALL).toPandas(), con.execute(ORACLES[key]).df())
    assert ok, said


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_return_every_row(spark, checkpoints, key):
    table = "pages" if key.startswith("op2_") else "documents"
    want = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
    assert QUERIES[key](spark, SF_SMALL).count() == want
