"""The pipeline's stages, each judged on its own input."""

from collections import defaultdict

import pytest

import corpus_pipeline as P
from catalith.llm import common, jaccard_join, mixing
from pyspark.sql import functions as F
from tests import oracle


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    home = tmp_path_factory.mktemp("pipeline")
    docs = common.documents(spark, sf)
    kept = [docs]
    for i, (_, fn) in enumerate(P.STAGES):
        fn(spark, kept[-1], sf).write.parquet(str(home / str(i)))
        kept.append(spark.read.parquet(str(home / str(i))))
    return kept


def test_columns(stages):
    assert len(P.STAGES) == 5 and all(s.columns == stages[0].columns for s in stages[1:5])
    assert stages[5].columns == [*stages[0].columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_language_keeps_all_texts_with_letters(stages):
    want = {r.doc_id for r in stages[0].collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_one_of_each_group_of_near_copies_stays(stages):
    linked = jaccard_join.link_components(stages[1]).collect()
    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r in linked if r.doc_id == r.component_id}


def test_leaks_go_and_nothing_else(spark, stages, sf):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2].collect() if not any(i in r.text for i in items)}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mixture_follows_what_the_mix_takes(stages):
    times = defaultdict(int)
    for r in stages[4].collect():
        times[r.doc_id] += 1
    for r in mixing.mix(stages[3]).collect():
        assert times[r.doc_id] == (2 * r.taken + r.size) // (2 * r.size)


def test_shards_hold_every_row(stages):
    assert stages[5].count() == stages[4].count() and stages[5].select("shard", "slot").distinct().count() == stages[4].count()


def test_run_gives_the_last_stage(spark, sf, stages):
    out = P.run(spark, sf)
    cols = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, stages[5].select(cols).collect()))


def test_awkward_rows_pass(spark, sf):
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 0), (None, "word " * 60, "en", None, 1), (4, "word " * 60, "en", "s", 1), (4, "word " * 60, "en", "s", 1), (6, "a" * 5000, None, "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, fn in P.STAGES:
        docs = common.checkpointed(fn(spark, docs, sf))
    assert {r.doc_id for r in docs.collect()} <= {None, 4, 6} and docs.where(F.col("size").isNull()).count() == 0


def test_join_matches_its_sql(spark, sf):
    oracle.same(spark, oracle.connect(sf), jaccard_join.op8_jaccard_join, jaccard_join.OP8_SQL, sf)
