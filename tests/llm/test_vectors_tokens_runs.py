"""Whitening, byte-level BPE and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screentime.llm import byte_pairs, periods, whitening
from screentime.llm.common import WordHashes
from screentime.llm.queries import QUERIES, looped, tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
RANKS = "byte_bpe_multi_50k.tiktoken"


def crops(spark, vectors, first_id=0):
    rows = [(first_id + i, v, "clash", 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, n int").repartition(3)


def whitened(df, dims, **options):
    found = whitening.whiten(df, **options).collect()
    out = {}
    for r in found:
        out.setdefault(r.vec_id, []).append((r.component, r))
    return found, {k: [r for _, r in sorted(v)] for k, v in out.items()}


def plain(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64).astype(object) + 1_000_000
    n, sums = len(x), x.sum(0)
    away = n * x - sums
    cov = (away.T @ away).astype(float) / float(n) ** 3
    return n, away, cov


def check_whitening(vectors, got, kept):
    n, away, cov = plain(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    for c in range(kept):
        mine = np.array([got[i][c].whitened for i in range(n)])
        other = (away.astype(float) / n) @ axes[:, c] / math.sqrt(values[c])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-6
        assert got[0][c].explained == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
    for i in range(n):
        exact = int((away[i] ** 2).sum())
        assert {r.deviation for r in got[i]} == {exact if exact < 1 << 63 else None}


def test_whitening_equals_the_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(200, 8)) * (5, 4, 3, 2, 1.5, 1, 0.7, 0.5)).astype(np.float32).tolist()
    found, got = whitened(crops(spark, vectors), 8)
    assert len(found) == 200 * 8 and {r.n for r in found} == {200}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    check_whitening(vectors, got, 8)


def test_whitening_of_skewed_scales_and_large_entries(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 4)) * (3e6, 4e3, 10, 1) + (1e7, 0, -50, 2)).astype(np.float32).tolist()
    found, got = whitened(crops(spark, vectors), 4)
    assert found[0].identity_error < 1e-4
    check_whitening(vectors, got, 4)


def test_whitening_with_bad_vectors_copies_and_flat_directions(spark):
    rng = np.random.default_rng(3)
    good = [[float(a), float(b), float(a + b), 1.0] for a, b in rng.integers(-9, 9, (50, 2))]
    good += [good[0]] * 100
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0, 0.0]]
    df = crops(spark, good).unionByName(crops(spark, bad, 1000))
    found, got = whitened(df, 4)
    assert sorted(got) == list(range(150)) and len(found) == 150 * 2
    assert found[0].identity_error < 1e-9
    check_whitening(good, got, 2)
    one, _ = whitened(df, 4, components=1)
    assert {r.component for r in one} == {1}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]])
def test_whitening_without_variance_gives_no_rows(spark, vectors):
    out = whitening.whiten(crops(spark, vectors))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not out.collect()


def test_factor_and_rotations():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(9, 5))
    matrix = base @ base.T
    factor, order = whitening.pivoted_cholesky(matrix)
    assert factor.shape == (9, 5) and np.allclose((factor @ factor.T).astype(float), matrix[np.ix_(order, order)])
    values, axes = whitening.principal_axes(matrix)
    assert np.allclose(values.astype(float), np.linalg.eigvalsh(matrix)[::-1][:5])
    assert np.allclose((axes.T @ axes).astype(float), np.eye(5), atol=1e-14)


def test_scatter_is_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 21), 1 << 21, (5000, 3))
    x[::7] *= 1 << 30
    assert (whitening.exact_scatter(x) == x.astype(object).T @ x.astype(object)).all()


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = byte_pairs.read_ranks(tokenizer_path(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    some = lambda: rng.choice([rng.randint(0, 127), rng.randint(128, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x10FFFF), 32, 10, 97, 0x85, 0x3000])
    texts = ["".join(chr(some()) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return [
        None, "", " ", "\n\n  x", "don't DON'T we'll", "<|endoftext|><unk>", "a" * 5000, "ab" * 20000 + "\n" * 999, "\U00032a44륻", "tail  ", *texts,
        "".join(rng.choice("abcde") for _ in range(50000)), "The quick brown fox.", "The quick brown fox.",
    ]


def test_tokens_equal_tiktoken_and_decode_to_the_text(spark):
    import public_tokenizers

    plain, texts = tiktoken_encoding(), odd_texts()
    rows = [(i if i % 50 else None, t, i, "clash", b"clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "video_id bigint, ocr_text string, at int, id string, tokens binary").repartition(2)
    tokens = byte_pairs.encode_texts(df, tokenizer_path(RANKS), public_tokenizers.PATTERN, id_col="at")
    out = byte_pairs.decode_tokens(tokens, tokenizer_path(RANKS), id_col="at", carry_cols=("n_tokens", "token_ids")).collect()
    assert len(out) == len(texts)
    for r in out:
        want = plain.encode_ordinary(texts[r["at"]] or "")
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == (texts[r["at"]] or "").encode()
    empty = byte_pairs.encode_texts(df.where("false"), tokenizer_path(RANKS), public_tokenizers.PATTERN)
    assert not empty.collect() and empty.columns == ["video_id", "n_tokens", "token_ids"]
    cut = spark.createDataFrame([(1, np.array([126], "<u4").tobytes()), (2, None)], "video_id int, token_ids binary")
    assert [r.decoded for r in byte_pairs.decode_tokens(cut, tokenizer_path(RANKS)).orderBy("video_id").collect()] == [plain.decode_single_token_bytes(126), b""]


def test_model_of_a_vocabulary_with_gaps(spark, tmp_path):
    import base64

    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"ab": 1000, b"abc": 900, b"bc": 2000, b" a": 5000}
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    df = spark.createDataFrame([(1, "abc abcd bcab")], "video_id int, ocr_text string")
    ids = byte_pairs.encode_texts(df, str(path), r" ?\S+|\s+").first().token_ids
    # "abc" is a token itself; " abcd" merges "ab" first, then "abc"
    assert np.frombuffer(ids, "<u4").tolist() == [900, 96, 900, 300, 96, 2000, 1000]
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary({b"a": 0})


def lyndon(w):
    n = len(w)
    return [next((j for j in range(i + 1, n) if w[j:] < w[i:]), n) - i for i in range(n)]


def test_grouping_gives_lyndon_arrays():
    rng = random.Random(5)
    for _ in range(400):
        n, a = rng.randint(1, 40), rng.randint(0, 4)
        w = [rng.randint(0, a) for _ in range(n)]
        heads = sorted({0, *(rng.randint(0, n - 1) for _ in range(rng.randint(0, 3)))})
        want = [x for b, e in zip(heads, [*heads[1:], n]) for x in lyndon(w[b:e])]
        assert periods.lyndon_lengths(np.array(w), np.array(heads)).tolist() == want


def plain_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q) and not any(w[i : i + length - x] == w[i + x : i + length] for x in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, a = rng.randint(0, 60), rng.choice([0, 1, 2, 20])
            w = [b"%d" % rng.randint(0, a) for _ in range(n)]
            if n and rng.random() < 0.5:
                i = rng.randrange(n)
                p = 1 + (n - i) // rng.randint(3, 9)
                w[i:] = [w[i + (k - i) % p] for k in range(i, n)]
            docs.append(w)
        runs, owner = periods.all_runs(docs, WordHashes(), least)
        for d, w in enumerate(docs):
            assert [tuple(r) for r in runs[owner == d].tolist()] == plain_runs(w, least)


def test_stretches_are_worked_on_in_chunks(monkeypatch):
    docs = [[b"%d" % (i % q) for i in range(30)] for q in (1, 2, 3, 4, 5)] * 3
    whole = periods.all_runs(docs, WordHashes(), 12)
    monkeypatch.setattr(periods, "CHUNK_WORDS", 40)
    for a, b in zip(whole, periods.all_runs(docs, WordHashes(), 12)):
        assert (a == b).all() and len(a) == 15


def test_runs_of_transcripts_with_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "Live now " * 9, "x " * 12, "x " * 11, "a b a b a b a b a b a b c", "a\tb\r\n" * 40000, "x " * 12, " ".join(map(str, range(500)))]
    rows = [(i if i != 3 else None, t, i, "clash", [1]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "video_id bigint, ocr_text string, at int, id string, runs array<int>").repartition(3)
    got = {r["at"]: r for r in periods.find_periodic_runs(df, id_col="at").collect()}
    assert {k: [tuple(x) for x in r.runs] for k, r in got.items() if r.runs} == {
        4: [(0, 18, 2)], 5: [(0, 12, 1)], 7: [(0, 12, 2)], 8: [(0, 80000, 2)], 9: [(0, 12, 1)],
    }
    assert [got[k].collapsed_text for k in (0, 1, 2, 3, 4, 5, 7, 8)] == ["", "", "", "one", "Live now", "x", "a b c", "a b"]
    assert got[6].n_words == 11 and got[0].n_words == 0
    assert not periods.find_periodic_runs(df.where("false")).collect()


def test_periodic_query_equals_its_contract(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    looping = 0
    for d in docs:
        w = WORDS.findall((d["text"] or "").encode())
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            looping += 1
        elif n > 1500:
            continue  # the plain version takes quadratic time
        runs = plain_runs(w, 12) if n <= 1500 else [tuple(x) for x in periods.all_runs([w], WordHashes(), 12)[0].tolist()]
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(),
        )
        assert tuple(got[d["doc_id"]])[1:] == want
    assert looping > 5


def test_looped_rows_keep_the_rest(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "one", "a b"] * 20)]
    df = spark.createDataFrame(rows, "video_id bigint, ocr_text string")
    assert looped(df).count() == 80 and looped(df).where(F.col("ocr_text").isNull()).count() == 20


def test_token_and_whitening_queries_return_whole_tables(spark):
    plain = tiktoken_encoding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_byte_pairs"](spark, SF).collect()}
    for d in docs:
        ids = plain.encode_ordinary(d.text or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
        assert tuple(got[d.doc_id])[1:] == want
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    out = QUERIES["op11_whitening"](spark, SF).collect()
    assert len(out) == 32 * len(vectors) and out[0].identity_error < 1e-4
    by_id = {}
    for r in sorted(out, key=lambda r: (r.vec_id, r.component)):
        by_id.setdefault(r.vec_id, []).append(r)
    assert [v.vec_id for v in vectors] == list(range(len(vectors)))
    check_whitening([v.embedding for v in vectors], by_id, 32)
