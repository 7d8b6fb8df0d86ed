"""The pipeline against brute force of what each stage decides."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from screentime.llm import packing
from screentime.llm.queries import fold, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.table(stage(spark, kept[-1], SF), "stage"))
    return [df.toPandas() for df in kept]


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(list(df.columns) == list(corpus_pipeline.COLUMNS) for df in stages[:-1])


def test_quality_keeps_the_good_and_drops_the_bad(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("held", fold("doc_id", 4) == 2).toPandas()
    accepted = set(stages[1].doc_id)
    held = labels[labels.held]
    assert (held.doc_id.isin(accepted) == (held.quality == 1)).mean() > 0.9


def test_lines_near_copies_and_benchmark(spark, stages):
    _, good, cut, unique, clean, pieces = stages
    spread = {}
    for text, source in zip(good.text, good.source):
        for line in text.split("\n"):
            spread.setdefault(re.sub("^ +| +$", "", line.lower() if line.isascii() else line), set()).add(source)
    common = {line for line, sites in spread.items() if line and len(sites) > 8}
    was = dict(zip(good.doc_id, good.text))
    assert set(was) == set(cut.doc_id)
    for doc_id, text, n in zip(cut.doc_id, cut.text, cut.n_chars):
        gone = len(was[doc_id].split("\n")) - len(text.split("\n"))
        assert n == len(text) and (gone == 0 or any(line.strip(" ").lower() in common for line in was[doc_id].split("\n")))

    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in zip(cut.doc_id, cut.text)}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert set(unique.doc_id) == {i for i, g in group.items() if i == g}

    fold_words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").where(F.col("text").isNotNull()).collect():
        w = fold_words.findall(r.text.encode().lower())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    for doc_id, text in zip(unique.doc_id, unique.text):
        w = fold_words.findall(text.encode().lower())
        hit = {p for k in {len(x) for x in windows} for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in windows for p in range(i, i + k)}
        assert (doc_id in set(clean.doc_id)) == (not (hit and 20 * len(hit) >= len(w)))

    words = packing.WordTokens(tokenizer_path())
    want = {i: len(words.ids(t, 2)) // 4 for i, t in zip(clean.doc_id, clean.text)}
    assert pieces.groupby("doc_id").length.sum().to_dict() == want
    ends = pieces.groupby("sequence_id").length.sum()
    assert ends.max() <= 4096 and (4096 - ends).sum() < 4096


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start"]
    assert got.sort_values(key).values.tolist() == stages[-1].sort_values(key).values.tolist()
