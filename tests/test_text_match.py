"""Text against dictionary: candidates lose no pair and stay few."""

import random
import time

import pytest
from pyspark.sql import functions as F

from screentime.functions import text as T
from screentime.operators import report as R


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spoilt(rng, word, times, letters="abcdé "):
    w = list(word)
    for _ in range(times):
        at = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(at, rng.choice(letters))
        elif w and kind == 1:
            w.pop(min(at, len(w) - 1))
        elif w:
            w[min(at, len(w) - 1)] = rng.choice(letters)
    return "".join(w)


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_near_keys_equal_all_pairs(spark, d):
    rng = random.Random(d)
    keys = ["", "a", "ab", "aaaaaaaaaaaa", "aaaaaaaaaaaaa"] + ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts = ["", "b", "ba"] + [spoilt(rng, rng.choice(keys), rng.randint(0, d + 1)) for _ in range(150)]
    left = spark.createDataFrame([(t,) for t in [*texts, texts[3], None]], "folded string")
    right = spark.createDataFrame([(k,) for k in [*keys, keys[7], None]], "key string")
    want = {(t, k, edits(t, k)) for t in texts for k in keys if edits(t, k) <= d}
    got = R.near_keys(left, right, d).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert R.near_keys(left.where("false"), right, d).count() == 0


def test_near_keys_of_a_large_dictionary(spark):
    # random names: nearly every candidate is a real match
    word = lambda seed, col: F.concat_ws(" ", F.substring(F.md5(F.concat(F.lit(seed), col.cast("string"))), 1, 9), F.substring(F.md5(col.cast("string")), 10, 8))
    keys = spark.range(10_000).select(word("k", F.col("id")).alias("key"))
    texts = spark.range(100_000).select(word("k", F.col("id")).alias("w"), "id").select(F.concat(F.substr("w", F.lit(1), F.lit(5)), F.lit("x"), F.substr("w", F.lit(7))).alias("folded"))
    begun = time.time()
    candidates = R.near_candidates(texts, keys, 2).count()
    assert 10_000 <= candidates < 20_000 and time.time() - begun < 120
    assert R.near_keys(texts, keys, 2).count() == 10_000


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cutoff", [80.0, 60.0])
def test_letter_bound_loses_no_pair(spark, cutoff):
    rng = random.Random(int(cutoff))
    keys = sorted({"".join(rng.choice("abcdefghijklmnopé ") for _ in range(rng.randint(1, 20))) for _ in range(80)})
    texts = sorted({spoilt(rng, rng.choice(keys), rng.randint(0, 5)) for _ in range(150)} - {""})
    left, right = (spark.createDataFrame([(v,) for v in values], f"{n} string") for n, values in (("a", texts), ("b", keys)))
    bound = T.may_reach(F.col("a"), T.letter_mask(F.col("a")), F.col("b"), T.letter_mask(F.col("b")), cutoff)
    got = {tuple(r) for r in left.crossJoin(right).filter(bound).collect()}
    assert {(a, b) for a in texts for b in keys if 200 * common(a, b) >= cutoff * (len(a) + len(b))} <= got
    assert len(got) < len(texts) * len(keys) / 2
