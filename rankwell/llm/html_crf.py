"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into its leaf blocks (runs of text between block-level borders)
with the tags and class names of all ancestors.  The field labels the sequence
of blocks as main text or not: block features (ancestors, own tag, length, links,
punctuation) and transitions between neighbours.  It is trained on labelled pages
and decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import prepare
from rankwell.llm.html_training import labelled_pages
from rankwell.session import read_table

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas select datalist title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# What may stand in a head; foreign content, the tags that break out of it, and the elements in it that hold HTML.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
INTEGRATION = frozenset("foreignobject desc title annotation-xml".split())
#: Elements that a new one of the same group ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The search for an element to end stops at these.
SCOPE = frozenset("table ul ol dl article aside section main nav div body html".split())
_TOKEN = re.compile(r"[a-z]+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")


@dataclass
class Block:
    """Text of a leaf block with its ancestors, outermost first, as (tag, class and id names)."""

    text: str
    ancestors: tuple[tuple[str, tuple[str, ...]], ...]
    link_chars: int
    label: int | None = None


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...]
    label: int | None = field(default=None)  # its own mark or that of the nearest marked ancestor


class _Blocks(HTMLParser):
    """Open elements, with counts per tag and block ancestors beside, so that no step walks over unclosed inline tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()
        self.ancestors: list[tuple[str, tuple[str, ...]]] = []
        self.hiding: list[str] = []  # open hidden elements
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(Block(text, tuple(self.ancestors), self.links, self.stack[-1].label if self.stack else None))
        self.text, self.links = [], 0

    def _pop(self, n: int) -> None:
        gone = self.stack[n:]
        for e in gone:
            self.open[e.tag] -= 1
        del self.stack[n:]
        del self.ancestors[len(self.ancestors) - sum(e.tag in BLOCK for e in gone):]
        del self.hiding[len(self.hiding) - sum(e.tag in HIDDEN for e in gone):]

    def _pop_to(self, tags: frozenset[str]) -> None:
        """End the outermost open element of these tags."""
        if any(self.open[t] for t in tags):
            self._pop(next(i for i, e in enumerate(self.stack) if e.tag in tags))

    def _end_implied(self, tag: str) -> None:
        """Hidden elements that a start tag ends although no end tag did."""
        if tag == "body":
            self._pop_to(HIDDEN)
        elif self.hiding == ["head"] and tag not in IN_HEAD:
            self._pop_to(frozenset({"head"}))
        elif self.hiding and self.hiding[-1] in FOREIGN and tag in BREAKS_OUT and not any(self.open[t] for t in INTEGRATION):
            self._pop_to(FOREIGN)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hiding or tag == "body":
            if tag == "body":
                self.flush()
            self._end_implied(tag)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            ended = ENDS.get(tag, set())
            if self.open["p"] or any(self.open[t] for t in ended):
                for i in range(len(self.stack) - 1, -1, -1):
                    open_ = self.stack[i].tag
                    if open_ == "p" or open_ in ended:
                        self._pop(i)
                    elif open_ in SCOPE:
                        break
        names: list[str] = []
        label = self.stack[-1].label if self.stack else None
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop") and value:
                names += _TOKEN.findall(value.lower())
            elif key == "data-main" and value in ("0", "1"):
                label = int(value)
        self.stack.append(_Open(tag, tuple(dict.fromkeys(names)), label))
        self.open[tag] += 1
        if tag in BLOCK:
            self.ancestors.append((tag, self.stack[-1].names))
        if tag in HIDDEN:
            self.hiding.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.stack:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[i].tag == tag:
                self._pop(i)
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK and tag not in HIDDEN:
                break
        if tag in ("p", "br"):
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if self.hiding == ["head"] and self.stack[-1].tag == "head" and data.strip():
            self._pop_to(frozenset({"head"}))  # text may not stand in a head
        if not self.hiding:
            self.text.append(data)
            if self.open["a"] > 0:
                self.links += len(data)


def leaf_blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order; character references are decoded, comments and hidden elements left out."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    if _CUT_TAG.match(parser.rawdata):  # the page ends inside a tag
        parser.rawdata = ""
    parser.close()
    parser.flush()
    return parser.blocks


def block_features(block: Block) -> list[str]:
    """Names of the features that hold for a block."""
    text, out = block.text, ["bias"]
    tags = [t for t, _ in block.ancestors]
    own = tags[-1] if tags else "none"
    out.append(f"own={own}")
    if len(tags) > 1:
        out.append(f"parent={tags[-2]}")
    out += {f"in={t}" for t in tags} | {f"name={n}" for _, names in block.ancestors for n in names}
    if block.ancestors and block.ancestors[-1][1]:
        out += [f"ownname={n}" for n in block.ancestors[-1][1]]
    words = text.count(" ") + 1
    out.append(f"words={min(7, int(math.log2(words)))}")
    share = block.link_chars / max(1, len(text))
    out.append("links=none" if not share else f"links={min(3, int(share * 4))}")
    out.append(f"ends={'stop' if text[-1] in '.!?…:;\"”»' else 'other'}")
    if text[0].isupper():
        out.append("upper")
    if "©" in text or "·" in text:
        out.append("sign")
    return out


@dataclass
class Field:
    """Weights: (features x 2) for blocks, (2 x 2) for neighbours, 2 for the first block."""

    names: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels (Viterbi); unknown features count nothing."""
        if not blocks:
            return []
        get, emit = self.names.get, self.emit
        (a, b), (c, d) = self.step.tolist()
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for t, block in enumerate(blocks):
            e0, e1 = emit[[i for i in map(get, block_features(block)) if i is not None]].sum(axis=0).tolist()
            if t == 0:
                s0, s1 = self.start[0] + e0, self.start[1] + e1
            else:
                p0, p1 = (0 if s0 + a >= s1 + c else 1), (0 if s0 + b >= s1 + d else 1)
                s0, s1 = max(s0 + a, s1 + c) + e0, max(s0 + b, s1 + d) + e1
                back.append((p0, p1))
        labels = [0 if s0 >= s1 else 1]
        for p in reversed(back):
            labels.append(p[labels[-1]])
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html)
        return " ".join(b.text for b, y in zip(blocks, self.decode(blocks)) if y)


def train_field(pages: list[list[Block]], rounds: int = 150, ridge: float = 1e-3, rate: float = 0.1) -> Field:
    """Maximum conditional likelihood by full-batch gradient steps (Adam); pages are sequences of labelled blocks."""
    pages = [p for p in pages if p]
    named = [[block_features(b) for b in p] for p in pages]
    names: dict[str, int] = {}
    for p in named:
        for f in p:
            for n in f:
                names.setdefault(n, len(names))
    n_pages, longest = len(pages), max(map(len, pages))
    x = np.zeros((n_pages, longest, len(names)), np.float32)
    y = np.zeros((n_pages, longest), np.int64)
    mask = np.zeros((n_pages, longest), bool)
    for i, p in enumerate(named):
        for t, f in enumerate(p):
            x[i, t, [names[n] for n in f]] = 1
            y[i, t], mask[i, t] = pages[i][t].label, True
    flat = x.reshape(-1, len(names))
    gold = np.eye(2)[y] * mask[..., None]
    theta = np.zeros(2 * len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        emit, step, start = theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        e = (flat @ emit.astype(np.float32)).reshape(n_pages, longest, 2).astype(np.float64)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            a = np.logaddexp(alpha[:, t - 1, 0, None] + step[0], alpha[:, t - 1, 1, None] + step[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            right = e[:, t + 1] + beta[:, t + 1]
            b = np.logaddexp(step[:, 0] + right[:, 0, None], step[:, 1] + right[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], b, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gold_pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        grad = np.concatenate([(flat.T @ (p - gold).reshape(-1, 2).astype(np.float32)).ravel(), (pair - gold_pair).sum(axis=(0, 1)).ravel(), (p[:, 0] - gold[:, 0]).sum(axis=0)]) / n_pages + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    emit, step, start = theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
    return Field(names, emit.copy(), step.copy(), start.copy())


# Labels that pages give away: blocks in these elements are main text or are not.
_MAIN = frozenset(("article", "main"))
_NOT = frozenset("nav header footer aside form menu button label dialog".split())
_NOT_NAMES = frozenset("comment comments ad ads advert sidebar notice cookie banner menu related share promo newsletter".split())


def self_labelled(html: str) -> list[Block] | None:
    """Blocks of a page that marks its article itself, labelled by that; None if it does not."""
    blocks = leaf_blocks(html)
    if not any(t in _MAIN for b in blocks for t, _ in b.ancestors):
        return None
    for b in blocks:
        tags, names = {t for t, _ in b.ancestors}, {n for _, ns in b.ancestors for n in ns}
        inside = [i for i, (t, _) in enumerate(b.ancestors) if t in _MAIN]
        later = {t for t, _ in b.ancestors[inside[0] + 1 :]} if inside else tags
        b.label = int(bool(inside) and not (later & (_NOT - {"header"})) and not names & _NOT_NAMES)
    return blocks


def _unmarked(blocks: list[Block]) -> list[Block]:
    """The same blocks with the marking elements as plain div: the text features have to tell."""
    return [Block(b.text, tuple(("div" if t in _MAIN else t, ns) for t, ns in b.ancestors), b.link_chars, b.label) for b in blocks]


def _spread(blocks: list[Block], most: int) -> list[list[Block]]:
    """All blocks of a page, or runs from its beginning, middle and end with ``most`` blocks in all."""
    if len(blocks) <= most:
        return [blocks]
    n, middle = most // 3, (len(blocks) - most // 3) // 2
    return [blocks[:n], blocks[middle : middle + n], blocks[-n:]]


def train(pages: DataFrame | None = None, max_pages: int = 300, max_blocks: int = 60) -> Field:
    """Field from the labelled pages of ``html_training`` and up to ``max_pages`` rows of ``pages``.

    The rows (the first by a hash of page_id) serve if they mark their article
    themselves; every third is also used with the marks taken away.  Only
    training is bounded: of a page of more than ``max_blocks`` blocks a third of so
    many train from its beginning, its middle and its end each.
    """
    sequences = [leaf_blocks(h) for h in labelled_pages()]
    if pages is not None:
        # Ids are chosen first: only the chosen pages reach the driver, whatever the number of tasks.
        ids = pages.where("html is not null and page_id is not null").select(F.col("page_id").alias("t_id")).distinct().orderBy(F.xxhash64("t_id"), "t_id").limit(max_pages)
        chosen = pages.select("page_id", "html").where("html is not null").join(F.broadcast(ids), F.col("page_id") == F.col("t_id"))
        rows = chosen.groupBy("page_id").agg(F.min("html").alias("html")).collect()
        for i, r in enumerate(sorted(rows, key=lambda r: r["page_id"])):
            if found := self_labelled(r["html"]):
                for part in _spread(found, max_blocks):
                    sequences.append(part)
                    if i % 3 == 0:
                        sequences.append(_unmarked(part))
    return train_field(sequences)


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html).

    ``text`` is the main blocks in page order joined by one space, white space
    inside a block turned into one space; empty if html is null, empty or has no
    main block.  ``n_chars`` counts its code points.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = [crf.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
