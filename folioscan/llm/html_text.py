"""Main text of HTML pages from tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of HTML elements by their part in the page, and words in class or id of page furniture.
RAW = "script style noscript iframe template textarea select title object svg canvas math audio video".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = set("nav menu footer aside head button label fieldset dialog input".split())
FURNITURE_WORDS = set(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar menu navbar nav navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "signup login comment comments commentlist reply replies respond disqus share sharing social related recommended widget "
    "pagination pager toolbar skip warning "
    # the same in French, Spanish and German
    "publicite annonce annonces commentaire commentaires reponses partager avertissement bandeau inscription "
    "publicidad anuncio anuncios comentario comentarios respuestas compartir aviso suscripcion boletin patrocinado "
    "werbung anzeige anzeigen kommentar kommentare antworten teilen hinweis warnung seitenleiste fusszeile kopfzeile navigationsleiste".split()
)
# Class words of parts that hold articles which are not the page's own.
OTHERS_WORDS = set(
    "comment comments commentlist reply replies respond disqus related recommended "
    "commentaire commentaires reponses comentario comentarios respuestas kommentar kommentare antworten".split()
)
ARTICLE = {"article", "main"}
SECTIONS = {"article", "main", "section", "div", "body", "td", "th", "li", "blockquote", "figure"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:" + "|".join(RAW) + r")(?=[\s/])(?:[^>=\"'/]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=\s*+[^\s\"'>]++|[=\"']|/(?!>))*+/>"
    r"|<(" + "|".join(RAW) + r")(?=[\s/>])(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<[!?/][^>]*>"
    r"|([^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(
    r"""(?:^|\s)hidden(?=\s|$|=|/)|\bstyle\s*=\s*(?:"[^"]*(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)|'[^']*(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden))""",
    re.I,
)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
WORD = re.compile(r"[a-z]+")


def is_hidden(attributes: str) -> bool:
    """Whether an element is not shown: by the attribute, outside of other attributes' values, or by its own style."""
    found = HIDDEN.search(attributes) if "hidden" in (low := attributes.lower()) or "none" in low else None
    return found is not None and (found[0].strip().lower() != "hidden" or HIDDEN.search(QUOTED.sub('""', attributes)) is not None)


PUNCTUATION = re.compile(r"[.,;:!?…、。]")


class _Blocks:
    """Text blocks of a page in page order, each with its tag path, its link text, the marks of furniture around it and its depth in articles.

    The mark 0 stands for elements that are always furniture, such as ``nav``, and those that are not shown; others stand for one element each
    with a class word or of the name form, kept with its depth in articles and whether a word of it speaks of other articles.
    """

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.parents: list[int] = []
        self.labels: list[str] = []
        self.out: list[tuple[int, str, int, tuple[int, ...], int]] = []
        self.marks: list[tuple[int, bool]] = [(0, False)]
        self.parts: list[str] = []
        self.linked = 0
        # element, path, marks of furniture, depth in articles, inside a link, marks around the outermost header in an article
        self.stack: list[tuple[str, int, tuple[int, ...], int, bool, tuple[int, ...] | None]] = [("", self.path(-1, ""), (), 0, False, None)]
        self.at = self.stack[0]

    def path(self, parent: int, label: str) -> int:
        known = self.paths.setdefault((parent, label), len(self.parents))
        if known == len(self.parents):
            self.parents.append(parent)
            self.labels.append(label)
        return known

    def cut(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.out.append((self.at[1], text, self.linked, self.at[2], self.at[3]))
            self.parts, self.linked = [], 0

    def close(self, names: set[str], ends: set[str]) -> None:
        """End the innermost open element of these names, unless one of ``ends`` stands between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                if any(e[0] in BLOCK for e in self.stack[i:]):
                    self.cut()
                del self.stack[i:]
                return
            if self.stack[i][0] in ends:
                return

    def text(self, text: str) -> None:
        if self.stack[-1] is not self.at and not self.parts:
            self.at = self.stack[-1]
        self.parts.append(text)
        if self.stack[-1][4]:
            self.linked += len(text)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            if self.parts:
                self.parts.append(" ")
            return
        if name in BLOCK:
            self.cut()
            if name in CLOSED_BY:
                self.close(CLOSED_BY[name], ENDS[name])
            self.close({"p"}, SECTIONS | FURNITURE)
        if name in VOID:
            return
        _, parent, marks, article, link, before = self.stack[-1]
        label, words = name, set()
        for found in NAMED.finditer(attributes):
            words.update(WORD.findall((found[1] or found[2] or found[3] or "").lower()))
        if words:
            label += "." + "-".join(sorted(words))
        if attributes and is_hidden(attributes) and name not in ("body", "html"):
            marks, before = (*marks, 0), None
        if name == "header":
            if article and before is None:
                before = marks
            marks = (*marks, 0)
        elif name not in ARTICLE and name not in ("body", "html"):
            if name in HEADINGS and article and before is not None:
                marks = before
            if name in FURNITURE:
                marks = (*marks, 0)
            elif name == "form" or words & FURNITURE_WORDS:
                marks = (*marks, len(self.marks))
                self.marks.append((article, bool(words & OTHERS_WORDS)))
        article += name in ARTICLE
        # Inline elements stay on the path of their block, so a block counts once.
        path = self.path(parent, label) if name in BLOCK else parent
        self.stack.append((name, path, marks, article, link or name == "a", before))

    def content(self) -> list[tuple[int, str, int]]:
        """The blocks that are not page furniture.

        Class words and forms do not count on an element that holds an article or main element, or more than half of the
        text outside of elements that are always furniture. Where a word speaks of other articles, as those of
        comments do, the element must hold more than half, and all articles with text.
        """
        free = [b for b in self.out if 0 not in b[3]]
        chars, own = [0] * len(self.marks), [0] * len(self.marks)
        total = articles = 0
        for _, text, _, marks, depth in free:
            total += len(text)
            articles += len(text) if depth else 0
            for m in marks:
                chars[m] += len(text)
                own[m] += len(text) if depth > self.marks[m][0] else 0
        counts = [True] * len(self.marks)
        for m, (depth, others) in enumerate(self.marks):
            most = 2 * chars[m] > total
            counts[m] = not (most and (depth or own[m] == articles) if others else most or own[m])
        return [b[:3] for b in free if not any(counts[m] for m in b[3])]

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.cut()
        # An inline end tag does not end blocks, and no element ends the article around it.
        self.close({name}, set() if name in ARTICLE or name in ("body", "html") else (ARTICLE if name in BLOCK else BLOCK) - {name})


def blocks(page: str) -> _Blocks:
    found = _Blocks()
    for token in TOKEN.finditer(page):
        raw, slash, name, attributes, text = token.groups()
        if text:
            found.text(text)
        elif name:
            if slash:
                found.end(name.lower())
            else:
                found.start(name.lower(), attributes)
    found.cut()
    return found


def smoothed(values: np.ndarray) -> np.ndarray:
    """Weighted mean of each value and its two neighbours."""
    padded = np.pad(values, 1, mode="edge")
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def _below(parents: list[int], values: np.ndarray) -> np.ndarray:
    """Sum of each path's own value and those of all paths below it."""
    out = values.copy()
    for i in range(len(parents) - 1, 0, -1):  # children come after their parents
        out[parents[i]] += out[i]
    return out


def _reading(inner: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Whether the innermost article or main element of a path has chosen text of its own."""
    text = np.bincount(inner[inner >= 0], mass[inner >= 0], len(inner))
    return (inner >= 0) & (text[inner] > 0)


def main_blocks(page: str, spread: float = 0.5, cover: float = 0.8) -> list[str]:
    """The text blocks of the main content, in page order.

    Per tag path, text length and punctuation are summed and set in relation to its number of blocks. Both
    ratios, smoothed over the page, are fused by their product; paths under ``spread`` standard deviations
    below the mean of the page are left out. If the best path lies in an article or main element, and such elements hold the
    share ``cover`` of all chosen text, all their blocks are returned. Otherwise these are the blocks of the smallest element
    around the best path that holds all chosen text with its headings, without those that are mostly links. Links
    in an article or main element with chosen text are part of it.
    """
    found = blocks(page)
    kept = found.content()
    if not kept:
        return []
    path = np.array([b[0] for b in kept])
    chars = np.array([len(b[1]) for b in kept], float)
    links = np.minimum(np.array([b[2] for b in kept], float), chars)
    marks = np.array([len(PUNCTUATION.findall(b[1])) for b in kept], float)
    n_paths = len(found.parents)
    number_of = np.bincount(path, minlength=n_paths)
    number = np.maximum(number_of, 1)
    length_of, marks_of, links_of = (np.bincount(path, w, n_paths) for w in (chars, marks, links))
    own = np.log1p((length_of - links_of) / number)
    fused = smoothed(own[path]) * smoothed(np.log1p(1 + marks_of / number)[path])
    floor = fused.mean() - spread * fused.std()
    of_path = np.bincount(path, fused, n_paths) / number
    mass = np.where((of_path >= floor) & (links_of <= 0.5 * length_of), length_of, 0.0)
    if not mass.any():
        mass = length_of
    best = int(np.argmax(mass * of_path))
    label = [x.split(".")[0] for x in found.labels]
    outer, inner = np.full(n_paths, -1), np.full(n_paths, -1)  # outermost and innermost article or main element around a path
    for i in range(n_paths):  # children come after their parents
        up = found.parents[i]
        here = i if label[i] in ARTICLE else -1
        outer[i] = outer[up] if up >= 0 and outer[up] >= 0 else here
        inner[i] = here if here >= 0 or up < 0 else inner[up]
    if outer[best] >= 0 and mass[outer >= 0].sum() >= cover * mass.sum():
        inside = outer >= 0
    else:
        below = _below(found.parents, mass)
        wanted = mass > 0
        for i in range(n_paths):
            up = found.parents[i]
            wanted[i] |= number_of[i] > 0 and label[i] in HEADINGS and (label[i] == "h1" or (up >= 0 and below[up] > mass[i]))
        held = _below(found.parents, wanted.astype(float))
        top = best
        while found.parents[top] >= 0 and held[top] < held[0]:
            top = found.parents[top]
        inside = np.zeros(n_paths, bool)
        for i in range(n_paths):
            inside[i] = i == top or (found.parents[i] >= 0 and inside[found.parents[i]])
    linked = (links > 0.5 * chars) & (links_of[path] > 0.5 * length_of[path])
    choose = inside[path] & (~linked | _reading(inner, mass)[path])
    return [b[1] for b, yes in zip(kept, choose, strict=True) if yes]


def main_text(page: str | None) -> str:
    return "\n".join(main_blocks(page)) if page else ""


@F.pandas_udf(StringType())
def _texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text)


def extract_text(page: str | Column) -> Column:
    """Main text of a column of HTML pages: blocks in page order, joined by a line feed.

    Null and empty pages, and pages with furniture alone, give the empty string. Whole pages are read;
    every page stands for itself, so repeated pages give the same text. Unclosed elements, tags and
    comments end where their parent or the page ends. A line break element is white space.
    """
    return _texts(page)
