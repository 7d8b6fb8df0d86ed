"""Blanks around lines, hot lines, rare labels, mixed keys, and base digests against a plain scan."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from screentime.llm import language_model, lines, quality, secrets
from screentime.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_carriage_returns_and_tabs_are_blanks(spark):
    rows = [(i, f"shared line\r\n\r\nown {i}\r\n\t \n\tSHARED too \r", f"s{i}") for i in range(12)]
    rows += [(20, "shared too", "t"), (21, "\x0bshared line\x0c", "t")]
    got = {r.video_id: r for r in lines.remove_site_boilerplate(spark.createDataFrame(rows, "video_id bigint, ocr_text string, channel string")).collect()}
    assert got[0].n_removed == 0 and got[0].kept_text == rows[0][1]
    assert all(got[i].kept_text == f"\r\nown {i}\r\n\t " and got[i].n_removed == 2 for i in range(1, 12))
    assert got[20].kept_text == got[21].kept_text == ""
    # one channel: the common line counts with and without a carriage return
    many = spark.createDataFrame([(i, "common words\r\n" * (i % 2) + " common words" + "\n" + f"w{i} " * 60, "c") for i in range(6)], "video_id bigint, ocr_text string, channel string")
    assert {r.n_common_words for r in lines.quality_rules(many, max_records=5).collect()} == {2, 4}


def test_a_line_in_every_record_is_dealt_out(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("video_id"), F.concat(F.lit("everywhere\nown "), F.col("id").cast("string")).alias("ocr_text"), (F.col("id") % 20).cast("string").alias("channel")
    )
    out = lines.remove_site_boilerplate(rows)
    assert out.where("n_removed = 1").count() == 5999 and out.where("n_removed = 0").first().video_id == 0
    # one more channel than the limit, estimated close to it, and exactly the limit
    for sites, removed in ((9, 1999), (8, 0)):
        near = rows.where("video_id < 2000").withColumn("channel", (F.col("video_id") % sites).cast("string"))
        assert lines.remove_site_boilerplate(near).agg(F.sum("n_removed")).first()[0] == removed


def keys(rng, n):
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def test_one_labelled_row_in_ten_thousand_trains_the_chain(spark):
    rng = random.Random(2)
    rows = [(i, f"plain words of row {i} and an ordinary_name_here") for i in range(20_000)]
    rows[7], rows[15_000] = (7, f"token='{keys(rng, 200)}'"), (15_000, f"password: {keys(rng, 200)}")
    model = secrets.train_secret_model(spark.createDataFrame(rows, "video_id bigint, ocr_text string"), sample_rows=50)
    empty = secrets.train_secret_model(spark.createDataFrame(rows[100:200], "video_id bigint, ocr_text string"))
    capitals = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    assert (model.ratio[:, capitals] != empty.ratio[:, capitals]).any()
    assert model.score(keys(rng, 40)) > 20 > 0 > model.score("an_ordinary_name_of_words_here")


def test_keys_that_reach_past_a_base_span(spark):
    rng = random.Random(3)
    head, tail = "Zq8Xw4Rt7Lp", "Kd93Jm"
    mixed = head + "0123456789abcdef" * 2 + tail
    rows = [(i, f"secret={keys(rng, 40)} is a thoroughly_ordinary_name") for i in range(50)]
    rows += [(100, f"x {mixed} y"), (101, f"x {'0a' * 20} y"), (102, f"my_token={keys(rng, 30)}")]
    rows = [*rows, rows[-3], rows[-3]]  # repeated rows
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "video_id bigint, ocr_text string, id string, n_hex int")
    got = {}
    for r in secrets.scan_secrets(df).collect():
        got.setdefault(r.video_id, []).append(r.spans)
    assert got[100] == [f"random:2:{2 + len(mixed)},hex:13:45"] * 3
    assert got[101] == ["hex:2:42"] and got[102] == ["assign:3:39"]


def test_base_spans_of_the_query_equal_a_plain_scan(spark):
    base = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    some = 0
    for r in QUERIES["op7_secret_scan"](spark, SF).collect():
        found = sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(base) for m in pattern.finditer(docs[r.doc_id]) if ok(m))
        told = ",".join(f"{base[k][0]}:{s}:{e}" for s, k, e in found)
        counts = tuple(sum(f[1] == k for f in found) for k in range(3))
        assert (r.n_assign, r.n_access, r.n_hex) == counts and r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
        some += len(found)
    assert some


def test_most_common_codes_are_broadcast_up_to_the_bound(spark):
    # none of the 400 keys holds a share of 1 / 300, yet 200 of them fit under that bound
    rows = spark.createDataFrame([(i, 9 if i < 200 else 3) for i in range(400)], "key bigint, n bigint")
    kept = {r.key for r in language_model.most_common(rows, "n", 300).collect()}
    assert kept == set(range(200))
    assert language_model.most_common(rows, "n", 400).count() == 400
    assert language_model.most_common(rows, "n", 0.5).count() == 0 and language_model.most_common(rows.limit(0), "n", 9).count() == 0


def test_token_hashes_tell_words_apart_and_know_the_ends():
    strings = [language_model.canonical(t)[1] for t in (b"", b"ab ba A b", b" ab\0 ab ", b"\xc3\xa9 a " + b"ab" * 40_000, b"b a")]
    hashes, sizes = language_model.token_hashes(strings)
    words = [w for s in strings for w in [*s.split(), b"\n"]]
    assert sizes.tolist() == [1, 5, 3, 4, 3] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert [s for part in language_model.blocks(strings) for s in part] == strings


def test_codes_by_doubling_hold_every_predecessor():
    strings = [b"abcdefghi\n", b"\n", b"xy z\n"]
    for depth in range(1, 8):
        codes, first = language_model.gram_codes(strings, depth)
        padded = [b"\n" * depth + s for s in strings]
        assert codes.tolist() == [int.from_bytes(s[i - depth : i + 1], "big") for s in padded for i in range(depth, len(s))]
        assert first.tolist() == [0, 10, 11]


def test_quality_sample_sends_word_ids_and_statistics_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 4000, 500)) if i else None, i % 2, float(i)) for i in range(60)]
    table = spark.createDataFrame(rows, "video_id bigint, ocr_text string, quality int, n_chars double")
    sent, whole = [], type(table).toArrow
    monkeypatch.setattr(type(table), "toArrow", lambda df: sent.append(whole(df)) or sent[-1])
    model = quality.train_quality_model(table.select("video_id", "ocr_text", "n_chars"), table.select("video_id", "quality"), metadata_cols=("n_chars",))
    words = sum(len(set((t or "").split())) for _, t, _, _ in rows)
    assert sent[0].nbytes < 5 * words + 60 * 200
    features = quality.Features(1 << 13, 1)
    whole = quality.FactorisationMachine(features.size, 6)
    whole.fit(*features.of([(t or "").encode() for _, t, _, _ in rows], np.array([[n] for *_, n in rows])), np.array([q for _, _, q, _ in rows], np.float64))
    assert model.bias == whole.bias and (model.linear == whole.linear).all() and (model.factors == whole.factors).all()
