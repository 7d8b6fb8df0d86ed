"""OCR matching, the exposure report on stored rows, and prices."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from screentime.functions import text as T
from screentime.operators import report as R

# Stored rows of one run for four sponsors: time, sponsor, confidence, area, centre.
STORED = [
    (27.0, "FAIRWAY", 1.0, 0.187, 0.832, 0.227), (28.0, "FAIRWAY", 1.0, 0.214, 0.844, 0.218),
    (39.0, "FAIRWAY", 0.999, 0.172, 0.167, 0.193), (40.0, "FAIRWAY", 1.0, 0.182, 0.177, 0.204),
    (41.0, "FAIRWAY", 1.0, 0.215, 0.182, 0.219), (41.0, "FAIRWAY", 0.894, 1.264, 0.94, 0.264),
    (42.0, "FAIRWAY", 0.999, 0.249, 0.124, 0.252), (45.0, "FAIRWAY", 0.999, 0.197, 0.813, 0.329),
    (46.0, "FAIRWAY", 0.999, 0.185, 0.814, 0.326),
    (136.0, "ROMANTICA", 0.921, 0.221, 0.429, 0.551), (136.0, "ROMANTICA", 0.999, 0.174, 0.431, 0.552),
    (137.0, "ROMANTICA", 0.983, 0.295, 0.392, 0.653), (137.0, "ROMANTICA", 0.964, 0.218, 0.395, 0.654),
    (150.0, "ROMANTICA", 0.978, 0.971, 0.406, 0.761),
    (136.0, "ELLGREN", 1.0, 0.293, 0.498, 0.665), (136.0, "ELLGREN", 0.998, 0.304, 0.498, 0.664),
    (137.0, "ELLGREN", 0.984, 0.255, 0.459, 0.768), (137.0, "ELLGREN", 0.999, 0.295, 0.459, 0.773),
    (174.0, "ATM", 0.987, 0.09, 0.136, 0.08), (175.0, "ATM", 0.991, 0.139, 0.095, 0.056),
]
REPORT = {
    "FAIRWAY": (8.0, 3, 8, 0.331, 1.264, 2.65, 0.589, 0.252, 0.986, 27.0, 46.0),
    "ROMANTICA": (3.0, 2, 3, 0.496, 0.971, 1.49, 0.409, 0.655, 0.96, 136.0, 150.0),
    "ELLGREN": (2.0, 1, 2, 0.299, 0.304, 0.6, 0.479, 0.719, 0.998, 136.0, 137.0),
    "ATM": (2.0, 1, 2, 0.115, 0.139, 0.23, 0.115, 0.068, 0.989, 174.0, 175.0),
}


def stored(spark):
    return spark.createDataFrame(
        [(f"{i:03d}", *r) for i, r in enumerate(STORED)],
        "det_id string, time_s double, sponsor string, ocr_conf double, area_pct double, cx double, cy double",
    )


@pytest.mark.parametrize("chunk", [900.0, 3.0])
def test_report_equals_the_stored_one(spark, chunk):
    got = {r.sponsor: tuple(r)[1:] for r in R.present_report(R.exposure_report(stored(spark), ["sponsor"], chunk=chunk)).collect()}
    assert set(got) == set(REPORT)
    for sponsor, want in REPORT.items():
        exact = (0, 1, 2, 4, 9, 10)
        assert [got[sponsor][i] for i in exact] == [want[i] for i in exact]
        assert got[sponsor] == pytest.approx(want, abs=0.0011)


def test_report_counts_each_frame_once_but_pricing_counts_each_hit(spark):
    priced = R.pricing_agg(stored(spark).withColumn("video_id", F.lit(1)), ["video_id"])
    seconds = {r.sponsor: r.screen_time_s for r in priced.collect()}
    assert seconds["ELLGREN"] == 4.0
    assert {r.video_duration_s for r in priced.collect()} == {176.0}


def test_price_chain(spark):
    agg = spark.createDataFrame([(1, "a", 3.0, 0.009, 0.02), (1, "b", 1.0, 0.0, 0.0)], "video_id bigint, sponsor string, screen_time_s double, eff_area_sec double, raw_area_sec double")
    priced = R.emv_gbp(agg)
    got = rows(R.price_recommendation(priced, ["video_id"]), "sponsor")
    # 0.009 * 45 scales to 40.5 and goes to the even 40.
    assert got[0][3:] == (0.4, 0.3, 8.0, 1.33)
    assert got[1][3:] == (0.0, 0.0, 0.0, None)
    assert [r.quality_disc_pct for r in priced.orderBy("sponsor").collect()] == [55.6, None]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


WORDS = ["topnotch", "floor tonic", "klg", "aon", "mcp", "fairway", "", "am", "bartercard", "topn0tch", "aaaa", "romantica romantica"]


def test_ratio_is_the_indel_ratio(spark):
    pairs = [(a, b) for a in WORDS for b in WORDS]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    for r in df.select("a", "b", T.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.r == pytest.approx(ratio(r.a, r.b)), (r.a, r.b)


def test_match_is_the_best_of_the_whole_dictionary(spark):
    names = {"topnotch": "TOPNOTCH", "top notch": "TOPNOTCH", "floor tonic": "FLOOR TONIC", "klg": "KLG", "fairway": "FAIRWAY", "am": "AM"}
    texts = ["T0PNOTCH", "floortonic", "FLOOR TON1C", "k1g", "fairwayx", "zzzz", "a", "am", "fairw", "topnotchtopnotch"]

    def best(text):
        folded = text.strip().lower().translate(str.maketrans("01|58", "oiisb"))
        if len(folded) < 2:
            return None
        found = None
        for keys in (names, {k.replace(" ", ""): v for k, v in names.items()}):
            top = max(keys, key=lambda k: ratio(folded, k))
            if ratio(folded, top) >= 80 and (found is None or ratio(folded, top) > found[1]):
                found = (keys[top], ratio(folded, top))
        return found and (found[0], int(found[1]))

    dictionary = spark.createDataFrame(list(names.items()), "key string, sponsor string")
    got = {r.text: (r.sponsor, r.fuzzy) for r in R.match_sponsors(spark.createDataFrame([(x,) for x in texts], "text string"), dictionary).collect()}
    assert got == {x: best(x) for x in texts if best(x)}


def test_names_colours_and_clips(spark):
    df = spark.createDataFrame([("  Asc_Group_HOME ",), ("some-brand_x_away",)], "raw string")
    assert [r[0] for r in df.select(T.normalize_class(F.col("raw"))).collect()] == ["asc_group", "some-brand_x"]
    files = spark.createDataFrame([("/a/M01_white_1080p.mp4",), ("m2_pink_blue.mp4",), ("x.mp4",)], "f string")
    assert [r[0] for r in files.select(T.parse_color(F.col("f"))).collect()] == ["white", "blue", None]
    with pytest.raises(Exception, match="no colour"):
        files.select(T.require_color(F.col("f"))).collect()


def test_hash_words_cover_the_sign_bit(spark):
    a, b = "f" * 64, "7" + "f" * 62 + "e"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.hamming(T.hash_words(F.col("a")), T.hash_words(F.col("b")))).first()[0] == 2
