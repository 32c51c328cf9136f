"""Problem 9: keyword-stuffed and link-list pages, by the shapes of their lines.

1.  A text is cut into lines, and running text into sentences.  Each piece is reduced to a shape: how many
    words it has, of what size its cells are between separators, whether it is links, hash tags or numbers,
    whether it begins with a capital and ends as a sentence.
2.  From the shapes of the whole crawl it is learnt which words prose is made of: those that are at least as
    frequent among pieces of sentence shape as among others (``prose_words``).  Keywords of any language
    are what they aren't, and function words of any language are among them.
3.  Pieces of one shape are grouped, so a page is a handful of groups with a share of its characters each.
    Shapes that are no sentences by themselves (links, hash tags, product cells) count as they are; shapes
    of words count where they are made of the few repeated words of the lines around them or, with next to
    no prose words, of words that the page repeats.
4.  A page is flagged if few such groups, the ``FEW`` largest, hold more than half of its characters.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages

#: Share of a page that makes it spam, and the largest groups that are counted for it.
SHARE, FEW = 0.5, 8
#: Share of prose words from which a piece is a sentence, however often its other words recur: of
#: one that begins with a capital and ends as a sentence, and of any other.
BOUND, LOOSE_BOUND = 0.36, 0.6
#: Words up to which a piece is short, and from which it is too long for a sentence.
SHORT, LONG = 7, 400
#: Content words of a window; a word is frequent by its share of the window, so that a page's length
#: doesn't raise the count it needs.
WINDOW = 600
#: Share of prose words under which a piece is bare, and the count on the page from which any of
#: its words is a repeated one, however many keywords there are.
BARE, REPEATS = 0.2, 3
#: Prose words occur in one of so many sentences of the crawl, at least; there are thus at most
#: LONG * RARE of them.
RARE = 2000

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_ANCHOR = re.compile(r"<a\s[^<>]*>(.*?)</a>|\[([^\[\]]*)\]\(([^()\s]*)\)", re.I | re.S)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_BREAK = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|h[1-6]|table)\b[^<>]*>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]*_]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CELLS = re.compile(r"\s*[|;\t•·]\s*|\s+/\s+")
_SEPARATOR = re.compile(r"[|;\t•·/]")
_CODE = re.compile(r"[A-Z]{2,}[-_ ]?\d{3,}")


def _bucket(n: int) -> int:
    """1, 2, 3-4, 5-8, 9-16, 17-32, ..."""
    return max(n - 1, 0).bit_length()


class _Piece:
    __slots__ = ("size", "shape", "words", "bound")

    def __init__(self, size: int, shape: tuple, words: list[str] = (), prose: frozenset = frozenset()):
        every = [w.lower() for w in words]
        self.size, self.shape, self.words = size, shape, [w for w in every if w not in prose]
        #: share of prose words
        self.bound = 1 - len(self.words) / len(every) if every else 0.0


def _urls(text: str) -> list[str]:
    return _URL.findall(text) if "://" in text or "www." in text.lower() else []


def _piece(text: str, links: int, link_size: int, prose: frozenset) -> _Piece:
    """The shape of a line, cell list or sentence: (kind, words, capital, end)."""
    size = len(text.strip())
    plain = _URL.sub(" ", text) if links else text
    words = _WORD.findall(plain)
    if links and (link_size * 2 >= size or len(words) <= 6 * links):
        return _Piece(size, ("links", _bucket(links)))
    if "#" in plain:
        tokens = plain.split()
        tags = sum(t[0] == "#" and len(t) > 1 for t in tokens)
        if tags >= 3 and tags * 2 >= len(tokens):
            return _Piece(size, ("tags", _bucket(tags)))
    if _SEPARATOR.search(plain):
        cells = [c for c in _CELLS.split(plain.strip()) if c]
        if len(cells) >= 3 and len(words) <= 6 * len(cells):
            figures = sum(any(ch.isdigit() for ch in c) for c in cells)
            if _CODE.search(cells[0]) and figures * 2 <= len(cells) + 1 and len(cells) >= 4:
                return _Piece(size, ("product", _bucket(len(cells))), words, prose)
            if figures * 2 >= len(cells):
                return _Piece(size, ("figures", _bucket(len(cells))))
            return _Piece(size, ("cells", _bucket(len(cells))), words, prose)
    first = text.lstrip()[:1]
    commas = plain.count(",")
    kind = "list" if commas >= 4 and len(words) <= 5 * (commas + 1) else "words"
    return _Piece(size, (kind, _bucket(len(words)), first.isupper(), text.rstrip()[-1:] in ".!?"), words, prose)


def _unwrapped(lines: list[str]) -> list[str]:
    """Lines without the empty ones; a line that goes on in small letters is joined with the next."""
    out: list[str] = []
    for line in filter(str.strip, lines):
        go_on = out and line.lstrip()[0].islower() and out[-1].rstrip()[-1] not in ".!?"
        if go_on and not any(_URL.search(x) or "|" in x or "#" in x or "](" in x for x in (out[-1][-200:], line)):
            out[-1] = f"{out[-1]} {line}"
        else:
            out.append(line)
    return out


def pieces(text: str, prose: frozenset = frozenset()) -> list[_Piece]:
    """Lines, and the sentences of lines of running text, with their shapes."""
    out = []
    text = html.unescape(text) if "&" in text else text
    text = _BREAK.sub("\n", text) if "<" in text else text
    for line in _unwrapped(text.splitlines()):
        links = [m for m in _ANCHOR.finditer(line)] if "<" in line or "](" in line else []
        n, size = len(links), sum(len(m[0]) for m in links)
        rest = _ANCHOR.sub(" ", line) if links else line
        urls = _urls(rest)
        n, size = n + len(urls), size + sum(map(len, urls))
        if n and size * 2 >= len(line.strip()):
            out.append(_Piece(len(line.strip()), ("links", _bucket(n))))
            continue
        line = _TAG.sub(" ", line) if "<" in line else line
        for s in _SENTENCE.split(line):
            if s.strip():
                urls = _urls(s)
                out.append(_piece(s, len(urls), sum(map(len, urls)), prose))
    return out


def _windows(parts: list[_Piece]) -> list[list[_Piece]]:
    """Pieces in order, in windows of ``WINDOW`` content words or little more; a short rest goes to the last one."""
    out: list[list[_Piece]] = [[]]
    n = 0
    for p in parts:
        if n >= WINDOW:
            out.append([])
            n = 0
        out[-1].append(p)
        n += len(p.words)
    if len(out) > 1 and n * 2 < WINDOW:
        rest = out.pop()
        out[-1] += rest
    return out


def spam_share(text: str | None, prose: frozenset = frozenset()) -> tuple[float, int, str]:
    """Share of a text's characters in its largest non-sentence groups, how many such groups, and the largest one's kind."""
    if not text or not text.strip():
        return 0.0, 0, ""
    parts = pieces(text, prose)
    total = sum(p.size for p in parts)
    if not total:
        return 0.0, 0, ""
    page = Counter()
    for p in parts:
        page.update(p.words)
    often = {w for w, c in page.items() if c >= REPEATS}
    groups: dict[tuple, int] = defaultdict(int)
    windows = _windows(parts)
    for window in windows:
        count = page
        if len(windows) > 1:
            count = Counter()
            for p in window:
                count.update(p.words)
        n = sum(count.values())
        hot_from, warm_from = max(3, 0.015 * n), max(2, 0.01 * n)
        hot = {w for w, c in count.items() if c >= hot_from}
        warm = {w for w, c in count.items() if c >= warm_from}
        for p in window:
            kind = p.shape[0]
            if kind in ("links", "tags", "product"):
                groups[p.shape] += p.size
            elif kind != "figures" and p.words:
                sentence = kind in ("words", "list") and p.shape[2] and p.shape[3] and len(p.words) / (1 - p.bound) > SHORT
                if p.bound >= (BOUND if sentence else LOOSE_BOUND):
                    continue
                few = hot if len(p.words) > SHORT else warm
                repeated = sum(w in few or (p.bound < BARE and w in often) for w in p.words)
                if repeated >= 0.7 * len(p.words):
                    groups["repeated", *p.shape[1:]] += p.size
    if not groups:
        return 0.0, 0, ""
    return sum(sorted(groups.values())[-FEW:]) / total, len(groups), max(groups, key=groups.get)[0]


def prose_words(texts: DataFrame, stages: Stages) -> frozenset[str]:
    """Words that are at least as frequent among pieces of sentence shape as among others, over all ``texts``.

    A piece has sentence shape if it begins with a capital, ends as a sentence and is neither short nor
    overlong.  A word counts once a piece.  Rare words say nothing, so no more than LONG * ``RARE`` come back.
    """
    line = texts.select(F.explode(F.split("text", "\\R")).alias("line"))
    piece = line.select(F.explode(F.transform(F.split("line", r"(?<=[.!?])\s+"), F.trim)).alias("piece")).filter("piece <> ''")
    # a leading separator leaves an empty word, which isn't counted
    piece = piece.select("piece", F.split(F.ltrim(F.lower("piece")), r"[^\p{L}'’-]+").alias("words")).filter("size(words) > 2")
    shape = F.col("piece").rlike(r"^\p{Lu}") & F.col("piece").rlike(r"[.!?]$") & F.size("words").between(SHORT + 1, LONG)
    piece = piece.select(shape.alias("prose"), F.array_distinct("words").alias("words"))
    # the empty word counts the pieces
    each = piece.select("prose", F.explode(F.array_distinct(F.array_append("words", F.lit("")))).alias("word"))
    counts = stages.write(each.groupBy("word").agg(F.count_if("prose").alias("s"), F.count_if(~F.col("prose")).alias("n")), "words")
    whole = counts.filter("word = ''").first()
    if whole is None or not whole["s"]:
        return frozenset()
    often = counts.filter((F.col("word") != "") & (F.col("s") * RARE >= whole["s"]) & (F.col("s") / whole["s"] >= (F.col("n") + 1) / (whole["n"] + 1)))
    return frozenset(r["word"] for r in often.select("word").toLocalIterator())


def _judge(prose: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [spam_share(t, prose) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in judged], pa.float64()), pa.array([x[1] for x in judged], pa.int32()), pa.array([x[2] for x in judged], pa.string())], ["doc_id", "spam_share", "n_shapes", "kind"])

    return run


def judged_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, spam_share, n_shapes, kind) of every document; null and empty texts have share 0.

    The prose words are learnt in a first pass; in a second one each text is judged by itself, so no text
    is shuffled and repeated rows stay repeated.
    """
    prose = prose_words(documents.select("text").filter("text is not null"), Stages(documents.sparkSession, "spam"))
    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_judge(prose), "doc_id long, spam_share double, n_shapes int, kind string")


def spam_pages(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id): documents of which more than ``share`` is repeated keywords, lists of links or product tags."""
    return judged_pages(documents).filter(f"spam_share > {share} and doc_id is not null").select("doc_id").distinct()
