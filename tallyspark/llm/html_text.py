"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded_rows, slices, texts_of

# Frequent words of English, French, German and Spanish; extract adds those of the pages themselves.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not at are this have from or an which
    le la les de des du et en un une que est pour dans qui sur pas plus par au avec ce il
    der die das und zu den mit von ist im auf für eine ein als nicht auch es dem sich bei
    el y los se del las por con no su para al lo como más pero""".split()
)
TABLE_WORDS = 400  # most frequent words of a table of pages, by the blocks that hold them
WORD_CHARS = 40  # longer words are not counted for that
KNOWN_WORDS = 100_000  # words that a task counts before it passes its counts on
# Scripts that put no blanks between words: each character counts as a word.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
SHORT = 70  # characters below which a block decides nothing by its words
DENSE = 0.30  # share of stop words from which a block is running text
SPARSE = 0.10  # share below which it is not
LINKED = 0.5  # share of characters in links from which a block is a menu

SCRAP = (
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(script|style|noscript|template|svg|textarea|select|iframe|object|math|canvas)\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
)
TAG = r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)"""
MARKUP = re.compile(f"{SCRAP}|{TAG}", re.S | re.I)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav\w*|breadcrumbs?|footer|masthead|cookies?|consent|"
    r"notice|notification|alert|popup|modal|comments?|replies|discussion|respond|share|sharing|social|related|recommend\w*|"
    r"subscribe|newsletter|signup|login|search|toolbar|pagination|pager|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
CLUTTER_TAGS = frozenset("nav footer aside menu dialog button head".split())
MAIN_TAGS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead title tr ul""".split()
)


class Block:
    __slots__ = ("text", "linked", "clutter", "main")

    def __init__(self, text: str, linked: int, clutter: bool, main: int):
        self.text, self.linked, self.clutter, self.main = text, linked, clutter, main


def named_clutter(tag: str, names: str) -> bool:
    """Whether class, id or role mark an element as clutter. An article is marked by a whole name only ("comment"), as parts of
    longer names ("comments-open") tell what it offers, not what it is."""
    if tag in MAIN_TAGS:
        return any((m := CLUTTER.match(name)) and m.end() == len(name) for name in names.split())
    return tag not in ("body", "html") and bool(CLUTTER.search(names))


def blocks(page: str, names_inside: bool = True) -> list[Block]:
    """Blocks of text in page order, each with the characters that stand in links, whether a part like a menu, footer,
    advert, form or comment encloses it, and the number of the article it belongs to (0: none). A form around an article does
    not count. Without names_inside, class, id and role of parts of an article are not looked at."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, opens clutter, opens an article, forms open around it
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "clutter": 0, "forms": 0, "main": 0, "articles": 0, "broken": False}

    def close_block():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                main = state["articles"] if state["main"] else 0
                out.append(Block(text, state["linked"], state["clutter"] + state["forms"] > 0, main))
            parts.clear()
        state["linked"], state["broken"] = 0, False

    def pop():
        tag, clutter, main, forms = stack.pop()
        state["clutter"] -= clutter
        state["forms"] = forms
        state["main"] -= main
        state["links"] -= tag == "a"

    def add(text: str):
        parts.append(text)
        if state["links"]:
            state["linked"] += len(" ".join(html.unescape(text).split()))
        if state["broken"] and not text.isspace():
            state["broken"] = False

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            if state["broken"]:
                close_block()
            else:
                parts.append(" ")
                state["broken"] = True
            continue
        if tag in BLOCKS:
            close_block()
        if m[2]:
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in BLOCKS:  # an open paragraph ends where a block begins, and so do inline parts left open in it
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
            if depth >= 0 and stack[depth][0] == "p":
                while len(stack) > depth:
                    pop()
        names = " ".join(n.strip("\"'") for n in NAMES.findall(m[4])) if m[4] else ""
        inside = state["main"] > 0
        clutter = (
            tag in CLUTTER_TAGS
            or tag == "header" and not inside
            or bool(names) and (names_inside or not inside) and named_clutter(tag, names)
            or bool(m[4]) and bool(HIDDEN.search(m[4]))
        )
        main = tag in MAIN_TAGS and not clutter
        stack.append((tag, clutter, main, state["forms"]))
        state["clutter"] += clutter
        state["forms"] = 0 if main else state["forms"] + (tag == "form")
        state["links"] += tag == "a"
        if main:
            state["articles"] += not inside
            state["main"] += 1
    if at < len(page):
        add(page[at:])
    close_block()
    return out


def words_of(text: str) -> list[str]:
    if SPACELESS.search(text):
        text = SPACELESS.sub(r" \g<0> ", text)
    return [w.strip(".,;:!?…\"'()[]«»„“”").lower() for w in text.split()]


def is_menu(block: Block) -> bool:
    return block.clutter or block.linked > LINKED * len(block.text)


def judge(block: Block, stop_words: frozenset[str] = STOP_WORDS) -> bool | None:
    """First pass: True for text, False for clutter, None where the block alone doesn't decide. Inside an article every block
    that is long enough and neither clutter nor a menu is text; outside, running text needs stop words."""
    if is_menu(block):
        return False
    if len(block.text) < SHORT:
        return None
    if block.main:
        return True
    words = words_of(block.text)
    share = sum(w in stop_words for w in words) / len(words)
    if share >= DENSE:
        return True
    return None if share >= SPARSE else False


def labelled(found: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """Second pass: an undecided block takes the label of the nearest decided one; of two at the same distance, text wins.
    Articles are taken by themselves, and what bounds one counts as text; outside, the page's ends count as clutter."""
    first = [judge(b, stop_words) for b in found]
    labels = [bool(x) for x in first]
    runs: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not (b.main and b.clutter):
            runs.setdefault(b.main, []).append(i)
    for main, run in runs.items():
        edge = main > 0
        near: list[list[tuple[int, bool]]] = []
        for order in (range(len(run)), range(len(run) - 1, -1, -1)):
            last, seen = edge, 0
            side = [(0, edge)] * len(run)
            for k in order:
                seen += 1
                if first[run[k]] is not None:
                    last, seen = first[run[k]], 0
                side[k] = (seen, last)
            near.append(side)
        for k, i in enumerate(run):
            if first[i] is None:
                (a, left), (b, right) = near[0][k], near[1][k]
                labels[i] = left if a < b else right if b < a else left or right
    return labels


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The blocks of a page that count as text. Where none does, an article whose own parts bear names of clutter is judged
    by its words, links and tags alone."""

    def chosen(found: list[Block]) -> str:
        return "\n".join(b.text for b, good in zip(found, labelled(found, stop_words), strict=True) if good)

    found = blocks(page)
    return chosen(found) or (chosen(blocks(page, False)) if any(b.main and b.clutter for b in found) else "")


def frequent_words(pages: DataFrame, html_column: str = "html") -> frozenset[str]:
    """The words that stand in most blocks of a table of pages; clutter, menus and short blocks don't count. Tasks count
    within bounds and Spark sums, so the driver gets TABLE_WORDS rows."""

    def count(batches):
        counts: Counter[str] = Counter()

        def flush():
            made = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in slices(batches):
            for page in texts_of(batch.column(0)):
                for block in blocks(page):
                    if len(block.text) >= SHORT and not is_menu(block):
                        counts.update({w for w in words_of(block.text) if len(w) <= WORD_CHARS and any(map(str.isalpha, w))})
                if len(counts) > KNOWN_WORDS:
                    yield flush()
        yield flush()

    found = pages.select(html_column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(TABLE_WORDS)
    return frozenset(r["word"] for r in bounded_rows(top, TABLE_WORDS, "frequent words"))


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each page: the columns of keep, text and n_chars (code points). The whole page is read. A null or empty
    page, or one without text, gives an empty text; repeated rows repeat their result. Stop words are the fixed ones and the
    most frequent words of all pages, which are counted first."""
    stop_words = STOP_WORDS | frequent_words(pages, html_column)

    def work(batches):
        for batch in slices(batches):
            texts = [main_text(page, stop_words) for page in texts_of(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long"
    return pages.select(*keep, F.col(html_column).alias("_html")).mapInArrow(work, schema)
