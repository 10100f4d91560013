"""Operator 7. Main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import others

#: Length in characters up to which a block is short, and from which one with enough stop words is good.
SHORT, LONG = 70, 140
#: Share of stop words of a good block and of a block that is nearly good; greatest share of linked characters.
STOP_HIGH, STOP_LOW, LINKS = 0.25, 0.12, 0.5

# Frequent function words of the languages served: a parameter of extract().
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was
    we were which with you aber als am an auch auf aus bei das dem den der des die ein eine einen einer es für hat ich im in ist mit nach
    nicht noch sich sie sind so über um und uns von vor war wie wird zu zum zur au aux avec ce ces cette dans de des du elle en est et il
    ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous al como con del el ella en es
    esta este ha la las lo los más no para pero por que se ser si sin son su sus un una y ya""".split()
)

# Elements without text of the page, those that stand apart from the article, and those that begin a block.
_SILENT = frozenset("script style noscript template svg math canvas object iframe audio video head select option datalist textarea button".split())
_APART = frozenset("nav header footer aside form dialog menu fieldset".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe title".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose open predecessor of the same kind they end.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id or role that mark what is not the article.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|header|masthead|comments?|respond|replies|disqus|share|sharing|social|related"
    r"|recommended|widget|toolbar|skip|search|form|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: What a class says an element goes with, not what it is.
_WITH = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[-_][^\s]*", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*$""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[^\W\d_]+")
#: Elements that an end of something inside of them does not reach over.
_PARTS = frozenset("article main body".split())
_FORMS = re.compile(r"<(/?)(form|article|main|h1)(?=[\s/>])", re.I)


@dataclass
class Block:
    text: str
    linked: int = 0
    heading: bool = False
    apart: bool = False
    section: int = 0  # number of the article or main element it is in; 0: none
    label: str = ""


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)}


def _wrapping_forms(html: str) -> set[int]:
    """Where forms begin that wrap the page: those that hold an article, a main element or a first heading."""
    found, open_ = set(), -1
    for m in _FORMS.finditer(html):
        if m[2].lower() == "form":
            open_ = -1 if m[1] else m.start() if open_ < 0 else open_  # forms do not nest
        elif open_ >= 0 and not m[1]:
            found.add(open_)
    return found


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order. Broken markup is taken as it comes: ends that match nothing are dropped."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, silent, apart, section
    parts: list[str] = []
    linked, anchors, sections, heading = 0, 0, 0, False
    where: dict[str, list[int]] = {}  # places in the stack, by name; of blocks and of parts too
    blocks, divided = where.setdefault("#block", []), where.setdefault("#part", [])
    wrapping, endless = _wrapping_forms(html), set()

    def kinds(name: str) -> list[list[int]]:
        return [where.setdefault(name, []), *[blocks] * (name in _BLOCK), *[divided] * (name in _PARTS)]

    def close() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            _, _, apart, section = stack[-1] if stack else ("", False, False, 0)
            found.append(Block(text, linked, heading, apart, section))
        parts.clear()
        linked, heading = 0, False

    def pop_to(at: int) -> None:
        nonlocal anchors
        if any(x[0] in _BLOCK for x in stack[at:]):
            close()
        anchors -= sum(x[0] == "a" for x in stack[at:])
        for x in stack[at:]:
            for places in kinds(x[0]):
                places.pop()
        del stack[at:]

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][1]):
            raw = unescape(raw)
            parts.append(raw)
            if anchors:
                linked += len("".join(raw.split()))

    at = 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        began, at = m.start(), m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            places = where.get(name)
            if name == "br" or name == "p" and not places:
                parts.append(" ") if name == "br" else close()
            elif places:
                i = places[-1]
                # An inline end does not reach over a block, nor a block's end over the part of the page it is in.
                over_block = name not in _BLOCK and blocks and blocks[-1] > i
                over_part = name not in _APART | _PARTS | {"html"} and divided and divided[-1] > i
                if not over_block and not over_part:
                    pop_to(i)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK and stack and stack[-1][1]:
            if where.get("head"):  # a block ends a head whose end is missing
                pop_to(where["head"][0])
        if name in _BLOCK:
            if blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in _ENDS.get(name, ())):
                pop_to(blocks[-1])
            close()
            heading = name in _HEADING
        elif name in ("img", "input", "wbr"):
            parts.append("" if name == "wbr" else " ")
        if name in _VOID or m[3].rstrip().endswith("/") and name not in _BLOCK:
            continue
        _, silent, apart, section = stack[-1] if stack else ("", False, False, 0)
        if name in ("article", "main") and not apart:
            sections += 1
            section = sections
        wraps = name == "form" and began in wrapping
        if m[3].strip() and name not in _PARTS and name != "html" and not wraps:
            own = _attributes(m[3])
            apart |= any(_MARKS.search(_WITH.sub("", own.get(k, ""))) is not None for k in ("class", "id", "role"))
            apart |= "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", "")) is not None
        if name in _RAW or name in _SILENT and name in ("svg", "math"):
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not end:
                endless.add(name)
            at = end.end() if end else len(html) if name in ("script", "style") else at
            if end:
                continue
            if name in ("script", "style"):
                break
        for places in kinds(name):
            places.append(len(stack))
        stack.append((name, silent or name in _SILENT, apart or name in _APART and not wraps, section))
        anchors += name == "a"
    close()
    return found


def classify(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> None:
    """Labels every block good or bad.

    First pass, from the block alone: what stands apart (navigation, header, footer,
    advert, form, comments) or is mostly links is bad; a long block with many stop
    words is good; the rest is ambiguous: short, or without many stop words. Second
    pass: an ambiguous block takes the label of the nearest decided block before and
    after it within its article, and good if these differ and one is as near as the
    other. An article without a decided block is good as a whole; outside of an article
    a block needs a decided neighbour, and blocks outside count only on pages without
    any article.
    """
    any_section = any(b.section and not b.apart for b in blocks)
    for b in blocks:
        size = len(b.text)
        words = _WORD.findall(b.text.lower())
        density = sum(w in stop_words for w in words) / len(words) if words else 0.0
        if b.apart or any_section and not b.section or b.linked > LINKS * size and (size <= SHORT or not b.section):
            b.label = "bad"
        elif size >= LONG and density >= STOP_HIGH or size > SHORT and density >= STOP_LOW:
            b.label = "good"
    decided = [i for i, b in enumerate(blocks) if b.label]
    labels: dict[int, str] = {}
    before: dict[int, int] = {}
    after = [-1] * len(blocks)
    nearest: dict[int, int] = {}
    for i in reversed(range(len(blocks))):
        after[i] = nearest.get(blocks[i].section, -1)
        if blocks[i].label and not blocks[i].apart:
            nearest[blocks[i].section] = i
    for i, b in enumerate(blocks):
        if b.label:
            if not b.apart:
                before[b.section] = i
            continue
        left, right = before.get(b.section, -1), after[i]
        if left < 0 and right < 0:
            labels[i] = "good" if b.section or not decided else "bad"
        elif left < 0 or right < 0:
            labels[i] = blocks[max(left, right)].label
        elif b.heading:  # a heading belongs to what follows it
            labels[i] = blocks[right].label
        elif blocks[left].label == blocks[right].label:
            labels[i] = blocks[left].label
        else:
            labels[i] = blocks[left].label if i - left < right - i else blocks[right].label if right - i < i - left else "good"
    for i, label in labels.items():
        blocks[i].label = label


def extract(html: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The main text of a page: its good blocks in page order, one line each. A null or empty page has none."""
    blocks = blocks_of(html or "")
    classify(blocks, stop_words)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(df: DataFrame, html: str, keep: list[str], stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """keep, text and n_chars (code points) of every row.

    A null or empty page gives an empty text; repeated rows stay; an empty table gives
    an empty one; columns not in keep, whatever their names, are not read, and text and
    n_chars in keep, in any case, are replaced. A page is taken whole, however long, in linear time.
    """
    keep = others(keep, "text", "n_chars")
    kept = df.select(*keep, html)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [extract(x, stop_words) for x in part.column(len(keep)).to_pylist()]
                columns = [*part.columns[: len(keep)], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[: len(keep)], "text", "n_chars"])

    return kept.mapInArrow(work, f"{head}, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", ["page_id", "url"])


QUERIES = {"op7_html": op7_html}
ORACLE_SQL: dict[str, str] = {}
