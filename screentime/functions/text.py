"""Names, labels, OCR text and hashes as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kit suffixes, OCR confusions, match cut-offs, colour names, and
# the brand names that plain capitalisation would not give.
KIT_SUFFIX = "_(home|away|alt|third)$"
OCR_FROM, OCR_TO = "01|58", "oiisb"
MIN_FUZZY = 80.0
MIN_OCR_CONF = 0.55
MIN_TEXT_LEN = 2
COLOR_NAMES = ("white", "black", "red", "blue", "yellow", "orange", "claret", "green")
DISPLAY_NAMES = {
    "asc_group": "ASC Group",
    "atm": "ATM Hospitality",
    "cch": "CCH",
    "em_workwear": "EM Workwear",
    "klg": "KLG",
    "mcp": "MCP",
    "mna_cladding": "MNA Cladding",
    "mna_support_service": "MNA Support Services",
    "paints_lacquers": "Paints & Lacquers",
}


def normalize_class(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), KIT_SUFFIX, "")


def title_name(key: Column) -> Column:
    """Title case: a letter after anything but a letter is a capital, as in ``7Up`` and ``O'Neil``."""
    pieces = F.split(F.lower(F.translate(key, "-_", "  ")), r"(?<=\P{L})(?=\p{L})", -1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def ocr_fold(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), OCR_FROM, OCR_TO)


def despace(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit(""))


def _common_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS lengths of two text columns, bit-parallel: one addition per character of ``a``."""
    masks: dict[str, dict[str, int]] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if y not in masks:
            places: dict[str, int] = {}
            for i, ch in enumerate(y):
                places[ch] = places.get(ch, 0) | 1 << i
            masks[y] = places
        places, full = masks[y], (1 << len(y)) - 1
        free = full
        for ch in x:
            hit = free & places.get(ch, 0)
            free = ((free + hit) | (free - hit)) & full
        out.append(len(y) - free.bit_count())
    return pd.Series(out, dtype="Int64")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; Arrow batches, as no SQL function has it. Null if either is."""
    return F.pandas_udf(_common_lengths, "bigint")(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (len a + len b); two empty strings are equal; null if either is."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.try_divide(lcs_length(a, b) * F.lit(200.0), total))


def letter_mask(text: Column) -> Column:
    """One bit per letter that occurs, by its code point modulo 64."""
    letters = F.array_distinct(F.split(text, ""))
    return F.aggregate(
        F.filter(letters, lambda x: x != ""), F.lit(0).cast("bigint"),
        lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(x) % 64)),
    )


def may_reach(a: Column, a_letters: Column, b: Column, b_letters: Column, cutoff: float) -> Column:
    """False only if the indel ratio of ``a`` and ``b`` cannot reach ``cutoff``: each letter that
    the other text lacks is missing from the common subsequence."""
    lacks = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    room = F.least(F.length(a) - lacks(a_letters, b_letters), F.length(b) - lacks(b_letters, a_letters))
    return room * F.lit(200.0) >= (F.length(a) + F.length(b)) * F.lit(float(cutoff)) - 1e-9


def parse_color(file_name: Column) -> Column:
    """Kit colour from ``m<no>_<colour>_...``, else the first colour name contained, else null."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    tagged = F.regexp_extract(stem, r"^m\d+_([a-z]+)_", 1)
    contained = [F.when(F.contains(stem, F.lit(c)), F.lit(c)) for c in COLOR_NAMES]
    return F.coalesce(F.when(tagged.isin(*COLOR_NAMES), tagged), *contained)


def require_color(file_name: Column) -> Column:
    return F.coalesce(parse_color(file_name), F.raise_error(F.concat(F.lit("no colour in "), file_name)).cast("string"))


def clip_key(file_name: Column) -> Column:
    clip = F.regexp_extract(file_name, r"^(clip_\d+)", 1)
    return F.when(clip == "", "other").otherwise(clip)


def hash_words(hex_hash: Column) -> Column:
    """A 256-bit hex hash as four signed 64-bit words."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(49), F.lit(16)),
        lambda i: F.conv(F.substring(hex_hash, i, F.lit(16)), 16, -10).cast("bigint"),
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of four words."""
    bits = [F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i))) for i in (1, 2, 3, 4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def bbox_string(*corners: Column) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in corners])


def bbox_struct(text: Column) -> Column:
    parts = F.split(text, ",")
    return F.struct(*[parts[i].cast("bigint").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
