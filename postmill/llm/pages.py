"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read as one sequence. Words score positive and tags negative; the best contiguous
stretch, found by one linear scan, is the content region. The weights are log-odds fitted on
pages that label themselves: an article or main element marks what is content. A word's
weight goes by the container it is in, so words of a container that is seldom content
score below zero, do not extend the region and are left out where the region spans them.
Elements that are no article text by their name, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are passed over before.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages the weights are fitted on: those of the smallest hashed ids.
SAMPLE = 4_000

# HTML element names
RAW = "script style noscript iframe title textarea".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg canvas object select math semantics mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover".split())
DEAD = set("head nav header footer aside form button dialog menu fieldset template svg canvas object select".split())
#: Elements of running text: their names must be a whole class or id to say what they are
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
CONTAINERS = set("article main section div aside nav header footer form body table".split())
LANDMARKS = ("article", "main")
DEAD_ROLES = set("navigation banner complementary contentinfo search form alert dialog alertdialog menu menubar toolbar status tooltip".split())
DEAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsbygoogle|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|social|related|recommend\w*|sidebar|widget|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|comments?|commentlist|disqus|respond|replies|"
    r"pagination|pager|toolbar|paywall|disclaimer|teaser|hidden)(?:$|[\s_-])", re.I,
)
#: Names that say what stands beside an element
LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_][\w-]+", re.I)
#: What a tag has after its name; quotes count only where a value begins
REST = r"(?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s<>\"'][^\s<>]*+)|[^<>])*+"
PIECE = re.compile(rf"<!--(?:.*?-->|.*\Z)|<({'|'.join(RAW)})(?=[\s/>]){REST}>(?:.*?</\1\s*>|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)({REST})>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Where no page labels itself
TAG, WORD, CHEAP = -2.5, 1.0, set("p h1 h2 h3 h4 h5 h6 br em strong b i blockquote pre".split())


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, container: str) -> float:
        return self.words.get(container, WORD)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.25 if name in CHEAP else TAG)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _says_dead(name: str, names: str) -> bool:
    """Whether a class or id tells that an element is no article text."""
    names = LAYOUT.sub("", names)
    return any(DEAD_NAMES.fullmatch(n) for n in names.split()) if name in PROSE else bool(DEAD_NAMES.search(names))


def _is_dead(name: str, raw: str) -> bool:
    if name in DEAD:
        return True
    if not raw or name in ("html", "body", *LANDMARKS):
        return False
    known = _attributes(raw)
    return "hidden" in known or known.get("aria-hidden", "").lower() == "true" or known.get("role", "").lower() in DEAD_ROLES or any(_says_dead(name, known.get(k, "")) for k in ("class", "id"))


#: The state outside all elements; inside a dead inline element words and tags count for nothing
NOWHERE = ("", False, "", False, False)


def read_page(page: str) -> list[tuple[str, str, str, bool, bool]]:
    """(kind, text or tag, container, whether in a landmark, whether dead) of a page's blocks and tags in order."""
    out: list[tuple[str, str, str, bool, bool]] = []
    stack: list[tuple[str, bool, str, bool, bool]] = []  # element, dead, container, in a landmark, in a dead inline element
    text: list[str] = []
    top = begun = NOWHERE

    def flush() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            out.append(("text", words, begun[2], begun[3], begun[1]))

    def feed(piece: str) -> None:
        nonlocal begun
        if piece and not top[4]:
            begun = begun if text else top
            text.append(piece)

    at = 0
    for m in PIECE.finditer(page):
        feed(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing, raw = bool(m[2]), m[4]
        if name in INLINE:
            # an inline element may be an advert or hidden too: the words in it, those of inner elements
            # of its name included, are passed over, and the block around it goes on
            open_ = name not in VOID and not raw.rstrip().endswith("/")
            if name == "br":
                feed(" ")
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if top[4] else None
                if depth is not None:
                    del stack[depth:]
            elif open_ and (any(s[0] == name for s in stack) if top[4] else not top[1] and _is_dead(name, raw)):
                stack.append((name, True, top[2], top[3], True))
            top = stack[-1] if stack else NOWHERE
            out.append(("tag", name, top[2], top[3], top[1])) if not text and not top[4] else None
            continue
        if not top[4]:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
        else:
            while stack and (stack[-1][0] == "p" or stack[-1][0] == name in ("li", "dt", "dd", "td", "tr", "option")):
                stack.pop()
            top = stack[-1] if stack else NOWHERE
            if name not in VOID and not raw.rstrip().endswith("/"):
                container = top[2]
                if name in CONTAINERS:
                    container = ".".join([name, *sorted(_attributes(raw).get("class", "").lower().split())[:2]])
                stack.append((name, top[1] or _is_dead(name, raw), container, top[3] or name in LANDMARKS, top[4]))
        top = stack[-1] if stack else NOWHERE
        if not top[4]:
            flush()
            out.append(("tag", name, top[2], top[3], top[1]))
    feed(page[at:])
    flush()
    return out


def region(items: list[tuple[float, bool]]) -> tuple[int, int]:
    """[start, end) of the best-scoring stretch of items; of equal ones the first, the shortest; (0, 0) if none is positive."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, (score, _) in enumerate(items):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def main_text(page: str | None, weights: Weights) -> str:
    """The live blocks of the content region, joined by line ends."""
    items, blocks = [], []
    for kind, what, container, _, dead in read_page(page or ""):
        if kind == "tag":
            items.append((weights.tag(what), False))
        else:
            score = min(-1.0, weights.word(container)) if dead else weights.word(container)
            items.append((score * (what.count(" ") + 1), not dead and score > 0))
        blocks.append(what)
    start, end = region(items)
    return "\n".join(b for b, (_, live) in zip(blocks[start:end], items[start:end]) if live)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights of all tags and containers of at most `sample` pages, of which those with a landmark count."""
    few = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).filter("html is not null").withColumn("h", F.xxhash64("page_id", F.length("html")))
    # the sample's ids are bounded by its size
    chosen = few.select("h").distinct().orderBy("h").limit(sample)
    few = few.join(F.broadcast(chosen), "h").select("html")

    def count(batches):
        seen = Counter()
        for batch in batches:
            for page in batch.column("html"):
                read = read_page(page.as_py())
                if any(inside for *_, inside, _ in read):
                    for kind, what, container, inside, dead in read:
                        key = (kind, what) if kind == "tag" else ("text", container)
                        seen[(*key, inside and not dead)] += 1 if kind == "tag" else what.count(" ") + 1
        rows = [(*k, n) for k, n in seen.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["kind", "what", "inside", "n"])

    counted = few.mapInArrow(count, "kind string, what string, inside boolean, n long").groupBy("kind", "what", "inside").agg(F.sum("n").alias("n"))
    seen = {(r.kind, r.what, r.inside): r.n for r in counted.collect()}
    weights = Weights()
    for kind, what in {k[:2] for k in seen}:
        odds = math.log((seen.get((kind, what, True), 0) + 1) / (seen.get((kind, what, False), 0) + 1))
        if kind == "tag":
            weights.tags[what] = -min(6.0, max(0.25, 1.0 - odds))
        else:
            weights.words[what] = max(-4.0, min(4.0, odds))
    return weights


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    The whole html is read; null and empty html give an empty text, as does a page without
    content. Repeated rows and rows with null ids or urls are kept as they are; an empty table
    gives no rows; other columns are not read.
    """

    def extract(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column("html")]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by weights of the pages that label themselves."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages, fit(pages))
