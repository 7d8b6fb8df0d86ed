"""HTML extraction: the maximum-scoring subsequence of a page's words and tags."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import arrow_map, batch, broadcast, row_key, smallest_hashes, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|button|math|canvas|video|audio)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements that break a block, that hold a zone of the page, and names that hint at what a zone holds.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ZONES = frozenset("article aside body div fieldset footer form head header main menu nav section".split())
#: Elements that are never the article, and those that only mostly are not.
FIRM = frozenset("aside footer head menu nav".split())
SOFT = frozenset("fieldset form".split())
#: What people and sellers add to a page, and its furniture.
ADDED = re.compile(
    r"(?:ads?|advert\w*|comments?|consent|cookies?|discuss\w*|disqus|modal|newsletter|popup|promo\w*|replies|responses?|signup|sponsor\w*|subscribe)", re.I
)
FURNITURE = re.compile(
    r"(?:banner|breadcrumbs?|footer|header|menu|nav\w*|notice|pagination|related|share|sharing|sidebar|social|toolbar|widgets?)", re.I
)
# Class words that say how a page is laid out, and the wrappers that are never chrome by their names.
LAYOUT_NAMES = re.compile(r"(?:has|no|with|without|is|hide|show)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)", re.I)
WRAPPERS = frozenset("html body main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a start tag ends when it is the innermost open element, and end tags that reach past open zone elements.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
REACHING = BLOCKS - frozenset("p li dd dt option h1 h2 h3 h4 h5 h6".split())

_PARTS = re.compile(r"[-_\s\d]+")
_MARK = re.compile(r"[.,;:!?\u3002\uff0c\u0964](?:[\"')\]\u201d\u2019\u00bb]*)$")
WORD_LIMIT, TAG_LIMIT, SKIPPED_LIMIT = 4.0, 0.6, 0.4
FEATURES = ("base", "links", "marks", "length", "firm", "soft")
#: Weights before any labelled page is seen: the mean of the Gaussian prior that training starts from.
PRIOR = np.array([0.3, -3.5, 1.0, 0.7, -4.0, -2.5])
#: What being inside or outside of the element that a page labels as its article adds to a word.
INSIDE, OUTSIDE = 4.0, -3.0


def name_words(label: str) -> set[str]:
    """The parts of class, id and role values, without those that only say how a page is laid out."""
    return {part for w in label.split() if not LAYOUT_NAMES.fullmatch(w) for part in _PARTS.split(w) if part}


def name_prior(word: str) -> float:
    return -3.5 if ADDED.fullmatch(word) else -2.0 if FURNITURE.fullmatch(word) else 0.0


class Zone:
    """A part of a page: what it stands in, and counts over the words directly in it."""

    __slots__ = ("firm", "soft", "names", "article", "main", "words", "links", "marks", "blocks")

    def __init__(self, firm: bool, soft: bool, names: frozenset[str], article: bool, main: bool):
        self.firm, self.soft, self.names, self.article, self.main = firm, soft, names, article, main
        self.words = self.links = self.marks = self.blocks = 0

    @property
    def named(self) -> bool:
        """Whether a name around hints at something else than the article."""
        return any(name_prior(w) < 0 for w in self.names)

    def measures(self) -> tuple[float, float, float]:
        """Share of words in links, sentence marks (one in eight words is the most that counts), words a block; in steps."""
        n = max(1, self.words)
        length = min(1.0, math.log2(1 + n / max(1, self.blocks)) / 6)
        return round(self.links / n, 1), round(min(1.0, 8 * self.marks / n), 1), round(length, 1)


class _Open:
    """An open element and the zone it stands in, itself included."""

    __slots__ = ("name", "zone")

    def __init__(self, name: str, zone: Zone):
        self.name, self.zone = name, zone


def page_tokens(page: str) -> tuple[list[tuple[str, object, Zone]], list[Zone]]:
    """("tag", name, zone) and ("text", decoded text, zone) in page order, and the zones.

    A new zone starts at every zone element and at every element whose class, id or role
    hints at something else than the article; it keeps the hints of the zones around it.
    The first article or main of a page ends the hints of the elements around it, unless
    they are ``FIRM``: they only lay the page out. Unclosed elements end with their parent.
    """
    top = Zone(False, False, frozenset(), False, False)
    zones, stack, tokens = [top], [_Open("", top)], []
    reached = in_link = fresh = False

    def start(name: str, attributes: str) -> None:
        nonlocal reached
        around = stack[-1].zone
        values = [next((v for v in m.groups() if v), "").strip().lower() for m in _NAMED.finditer(attributes)] if "=" in attributes else []
        words = name_words(" ".join(values)) if values and name not in WRAPPERS else set()
        hinted = any(name_prior(w) < 0 for w in words)
        text = name in ("article", "main")
        if not (name in ZONES or hinted):
            stack.append(_Open(name, around))
            return
        firm, soft, names = around.firm, around.soft, around.names
        if text and not hinted and not reached and not firm:
            soft, names = False, frozenset()
        within = around.article or around.main
        names = names | words
        if name == "header" and not within:
            names = names | {"header"}
        firm, soft = firm or name in FIRM, soft or name in SOFT
        clear = not firm and not soft and not any(name_prior(w) < 0 for w in names)
        reached = reached or (text and clear)
        zone = Zone(firm, soft, names, clear and (around.article or name == "article"), clear and (around.main or name == "main"))
        zones.append(zone)
        stack.append(_Open(name, zone))

    def end(name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                del stack[i:]
                return
            if stack[i].name in ZONES and name not in REACHING:
                return

    def text(raw: str) -> None:
        nonlocal fresh
        value = html_lib.unescape(raw)
        words = value.split()
        zone = stack[-1].zone
        if words:
            zone.words += len(words)
            zone.marks += sum(1 for w in words if _MARK.search(w))
            zone.links += len(words) if in_link else 0
            zone.blocks += fresh or not zone.blocks
            fresh = False
        tokens.append(("text", (value, words), zone))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        tokens.append(("tag", name, stack[-1].zone))
        fresh = fresh or name in BLOCKS
        if name == "a":
            in_link = not m[2]
        if name in VOID:
            continue
        if m[2]:
            end(name)
        elif not m[4].endswith("/"):
            if name == "body":
                del stack[1:]
            if name in BLOCKS and stack[-1].name == "p":
                stack.pop()
            while stack[-1].name in ENDS.get(name, ()):
                stack.pop()
            start(name, m[4])
    if at < len(page):
        text(page[at:])
    return tokens, zones


class RegionWeights:
    """Scores of zones by what they hold and of tags by name, from pages that label their own article.

    ``rows`` are (links, marks, length, firm, soft, named, inside, words) of zones; the
    weights of ``FEATURES`` are their most likely values under a Gaussian prior around
    ``PRIOR``. ``names`` and ``tags`` are counts (inside, outside) by word of a name and
    by tag.
    """

    def __init__(self, rows: list[tuple], names: dict[str, tuple[int, int]], tags: dict[str, tuple[int, int]]):
        def odds(inside: int, outside: int) -> float:
            return math.log((inside + 5) / (outside + 5))

        self.weights = _fit(rows) if rows else PRIOR
        self.names = {w: name_prior(w) + max(-1.5, min(1.5, 0.25 * odds(*n))) for w, n in names.items()}
        self.tags = {t: max(-TAG_LIMIT, min(-0.02, 0.1 * odds(*n) - 0.1)) for t, n in tags.items()}

    def name(self, word: str) -> float:
        return self.names.get(word) if word in self.names else name_prior(word)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.1)

    def score(self, zones: list[Zone]) -> dict[int, float]:
        """Score of a word by the id of its zone.

        Hints by names and forms count by how much prose the page holds elsewhere: where
        all of it stands in such zones they are the article. Words outside the labelled
        article likewise lose by how much of the page it holds.
        """
        prose = [(z, z.words - z.links) for z in zones if not z.firm]
        hinted = sum(n for z, n in prose if z.soft or z.named)
        plain = sum(n for z, n in prose) - hinted
        elsewhere = plain / (plain + 0.1 * hinted + 1)
        label = "article" if any(n > 0 for z, n in prose if z.article) else "main"
        labelled = sum(n for z, n in prose if getattr(z, label))
        share = labelled / (labelled + 0.1 * (plain + hinted - labelled) + 1)
        scores = {}
        for z in zones:
            links, marks, length = z.measures()
            s = float(self.weights[:5] @ np.array([1.0, links, marks, length, z.firm])) + z.soft * self.weights[5] * elsewhere
            by_name = [self.name(w) for w in z.names]
            low, high = min(by_name, default=0.0), max(by_name, default=0.0)
            s += low * elsewhere if low < 0 else min(1.0, high)
            if getattr(z, label):
                s += INSIDE
            elif not (z.main and z.words):
                s += OUTSIDE * share
            scores[id(z)] = max(-WORD_LIMIT, min(WORD_LIMIT, s))
        return scores


def _fit(rows: list[tuple], rounds: int = 30, weight: float = 50.0) -> np.ndarray:
    """Logistic regression by Newton's method: rows count by their words, all together like ``weight`` words."""
    r = np.array(rows, float)
    r = r[r[:, 5] == 0]
    if not len(r):
        return PRIOR
    x, y, n = np.column_stack([np.ones(len(r)), r[:, :5]]), r[:, 6], r[:, 7]
    n = n * (weight / n.sum())
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - (w - PRIOR)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def extract_text(page: str, weights: RegionWeights) -> str:
    """Words of the best contiguous region, one block a line.

    One scan keeps the best region ending here and the best so far; words of zones that
    score below zero cost and are left out of the region.
    """
    tokens, zones = page_tokens(page)
    scores = weights.score(zones)
    blocks: list[list[tuple[int, str, bool]]] = []
    words: list[tuple[int, str, bool]] = []  # position, word, whether it goes on the word before
    score = best = 0.0
    start, position, best_start, best_end = 0, 0, 0, 0
    closed = True  # whether white space or a block end came last
    for kind, value, zone in tokens:
        if kind == "tag":
            if value in BLOCKS:
                closed = True
                if words:
                    blocks.append(words)
                    words = []
            # inside the labelled article tags hardly part its words
            score += weights.tag(value) * (0.1 if zone.article else 1.0)
        else:
            raw, found = value
            weight = scores[id(zone)]
            if weight > 0:
                for i, word in enumerate(found):
                    position += 1
                    if score <= 0:
                        start, score = position, 0.0
                    words.append((position, word, i == 0 and not closed and not raw[0].isspace()))
                    score += weight
                    if score > best:
                        best, best_start, best_end = score, start, position
            else:
                position += len(found)
                score += len(found) * max(-SKIPPED_LIMIT, 0.1 * weight)
            if raw:
                closed = raw[-1].isspace() if found else True
        score = max(score, 0.0)
    if words:
        blocks.append(words)
    lines = ("".join(w if glued else " " + w for n, w, glued in block if best_start <= n <= best_end).strip() for block in blocks)
    return "\n".join(line for line in lines if line)


def train_region_weights(pages: DataFrame, key_col: str = "page_id", html_col: str = "html", sample_rows: int = 1000) -> RegionWeights:
    """Counts over zones, names and tags inside and outside the article of self-labelled pages.

    Labelled pages are those with exactly one ``article`` or ``main`` element. The
    sample is the ``sample_rows`` of them with the smallest hash; without any, the
    priors stay. Measures of zones come in steps, so few rows reach the driver; of the names
    those ``sample_rows`` that the most words stand under are learned.
    """
    marked = F.size(F.split(F.lower(F.col(html_col)), r"<(article|main)\b")) == 2
    labelled = pages.where(F.col(html_col).isNotNull() & marked)
    sample = smallest_hashes(labelled, row_key(key_col, html_col), sample_rows).select(F.col(html_col).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                tokens, zones = page_tokens(page)
                for z in zones:
                    inside = z.article or z.main
                    if z.words:
                        measures = (*z.measures(), float(z.firm), float(z.soft), float(z.named))
                        seen["zone", "", measures, inside] += z.words
                        for w in z.names:
                            seen["name", w, None, inside] += z.words
                for kind, value, z in tokens:
                    if kind == "tag":
                        seen["tag", value, None, z.article or z.main] += 1
        rows = list(seen.items())
        yield batch(
            ["kind", "name", "measures", "inside", "n"],
            pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.list_(pa.float64())),
            pa.array([k[3] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64()),
        )

    counted = arrow_map(sample, count, "kind string, name string, measures array<double>, inside boolean, n bigint")
    summed = counted.groupBy("kind", "name", "measures").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside")
    )
    summed = table(summed, "region-counts")
    rows: list[tuple] = []
    for r in summed.where("kind = 'zone'").collect():
        rows += [(*r["measures"], y, n) for y, n in ((1.0, r["inside"]), (0.0, r["outside"])) if n]
    often = {
        kind: {r["name"]: (r["inside"], r["outside"]) for r in summed.where(F.col("kind") == kind).orderBy(F.desc(F.expr("inside + outside")), "name").limit(sample_rows).collect()}
        for kind in ("name", "tag")
    }
    return RegionWeights(rows, often["name"], often["tag"])


def extract_main_text(
    pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_rows: int = 1000
) -> DataFrame:
    """Main text of every web page: key_col, url_col, text, n_chars (code points).

    The library has no web records, so this operator is general. A page becomes a
    sequence of words and tags. Words score by what their zone holds (links, sentence
    marks, words a block), where it stands and, weakly, what it is called; tags are
    negative. The weights are learned on pages that label their own article
    (:func:`train_region_weights`); a linear scan finds the contiguous region of the
    greatest sum. Comments, scripts, styles and zones that score negative give no text.
    Character references are decoded, white space inside a block becomes one space,
    and blocks are joined by one newline. Null, empty and word-less pages give an empty
    text; repeated rows each get their row.
    """
    shared = broadcast(pages.sparkSession, train_region_weights(pages, key_col, html_col, sample_rows))
    rows = pages.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema[n].dataType.simpleString() for n in ("key", "url")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            text = [extract_text(page or "", weights) for page in b.column("html").to_pylist()]
            yield batch(
                ["key", "url", "text", "n_chars"],
                b.column("key"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
            )

    out = arrow_map(rows, extract, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.select(F.col("key").alias(key_col), F.col("url").alias(url_col), "text", "n_chars")
