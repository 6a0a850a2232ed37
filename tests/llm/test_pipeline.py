"""The pipeline's stages on a given table, each against its own brute force; the registered queries' SQL is tested with the others."""

import os
import re

import pytest

import corpus_pipeline
from kindred.llm import quality
from kindred.llm.queries import QUERIES
from kindred.session import cut

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], FOLDER), name))
    return docs


def test_stages_keep_the_columns(steps):
    assert len({tuple(d.columns) for d in steps[:-1]}) == 1


def test_quality_drops_what_the_classifier_rejects(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r["row"]["doc_id"]: r["score"] for r in quality.score(steps[0], quality.fit(steps[0], labels)).collect()}
    assert {r["doc_id"] for r in steps[1].collect()} == {i for i, s in scores.items() if s >= 0.5}


def test_one_document_of_each_group_stays(steps):
    """Groups by 5-word Jaccard of 0.8 or more, all pairs."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in steps[1].collect())
    units = {i: shingles(t) for i, t in rows}
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (i, _) in enumerate(rows):
        for j, _ in rows[:k]:
            a, b = units[i], units[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted({find(i) for i in group})


def shingles(text, k=5):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in re.split("[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def test_benchmark_passages_are_gone(spark, steps):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in steps[2].collect() if any(x in " ".join(r["text"].split()) for x in items)}
    assert {r["doc_id"] for r in steps[3].collect()} <= {r["doc_id"] for r in steps[2].collect()} - held


def test_mix_and_shards(steps):
    mixed, sharded = steps[4].collect(), steps[5].collect()
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in steps[3].collect()}
    assert sorted(r["doc_id"] for r in mixed) == sorted(r["doc_id"] for r in sharded)
    assert len({(r["shard"], r["slot"]) for r in sharded}) == len(sharded)


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, ties, and extra columns with the names the stages use inside."""
    good = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(6).collect()]
    rows = [(1, good[0], "a"), (1, good[0], "a"), (2, None, None), (3, "", "b"), (4, " \n\t", "b"), (None, good[1], "a"), (None, None, None),
            (5, " ".join(good * 40), "b"), (6, good[2], None), (7, good[2] + " more", "a")]
    columns = "doc_id long, text string, source string, row string, key long, name string, comp long, n int, score double, size long, word string"
    return spark.createDataFrame([(*r, "x", 1, "n", 2, 3, 0.1, 4, "w") for r in rows], columns)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, FOLDER)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    if name == "shard":
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in odd.collect())
        assert len({(r["shard"], r["slot"]) for r in rows}) == 10
    else:
        assert out.columns == odd.columns
        given = {(r["doc_id"], r["text"]) for r in odd.collect()}
        assert {(r["doc_id"], r["text"]) for r in rows} <= given
    if name == "near_duplicates":  # one of the empty texts, one of each other group
        assert sorted(map(str, ids)) == sorted(["1", "2", "None", "5", "6"])
    if name == "decontaminate":
        assert len(rows) == 10
    assert stage(spark, odd.where("false"), FOLDER).collect() == []
