"""Analyzers: text to terms.

An analyzer is a function from a text ``Column`` to an ``array<string>`` column.
Word analyzers keep the place of each word, so stop words are dropped by the
caller after numbering (``operators.postings``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The word grammars.
WORD_PATTERN = r"[\p{L}\p{N}]+"
LETTER_PATTERN = r"\p{L}+"

Analyzer = Callable[[Column], Column]

_PATTERNS = {"standard": WORD_PATTERN, "stop": LETTER_PATTERN, "simple": LETTER_PATTERN}
_DROPS_STOP_WORDS = {"standard", "stop"}
WHOLE_VALUE = {"keyword", "lowercase_keyword"}
_custom: dict[str, Analyzer] = {}
_not_for_queries: set[str] = set()


def register_analyzer(name: str, analyzer: Analyzer, for_queries: bool = True) -> None:
    """Give a name to a function from a text column to an array of terms (null for a dropped one).

    Without ``for_queries`` it runs on documents alone, and search text of its fields is analysed as if they had none.
    """
    _custom[name] = analyzer
    (_not_for_queries.discard if for_queries else _not_for_queries.add)(name)


def is_for_queries(name: str) -> bool:
    return name not in _not_for_queries


def is_registered(name: str) -> bool:
    return name in _custom


def word_pattern(mode: str) -> str | None:
    return _PATTERNS.get(mode)


def drops_stop_words(mode: str) -> bool:
    return mode in _DROPS_STOP_WORDS


def is_whole_value(mode: str) -> bool:
    return mode in WHOLE_VALUE


def words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """The words of a text as written, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lowered_words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """The words of a text in lower case, without a lambda: words hold no blank, so joining is safe."""
    return F.array_remove(F.split(F.lower(F.array_join(words(text, pattern), " ")), " "), "")


def analyze(text: Column, mode: str) -> Column:
    """All terms of a text, stop words included; the empty text has no term."""
    if mode in _custom:
        return _custom[mode](text)
    if mode in _PATTERNS:
        return lowered_words(text, _PATTERNS[mode])
    if mode not in WHOLE_VALUE:
        raise ValueError(f"unknown analyzer {mode!r}")
    term = F.lower(text) if mode == "lowercase_keyword" else text
    return F.when(text != "", F.array(term)).otherwise(F.array().cast("array<string>"))


def placed_terms(text: Column, mode: str, stop_words: tuple[str, ...]) -> Column:
    """The searchable terms of a text, each in its place; a dropped stop word leaves a null."""
    terms = analyze(text, mode)
    if not drops_stop_words(mode) or not stop_words:
        return terms
    return F.transform(terms, lambda t: F.when(~t.isin(*stop_words), t))


def query_terms(text: str, mode: str, stop_words: tuple[str, ...] = ()) -> list[tuple[int, str]]:
    """Analyse search text when the query is built: (position, term) pairs."""
    if mode in WHOLE_VALUE:
        term = text.lower() if mode == "lowercase_keyword" else text
        return [(0, term)] if term else []
    if mode in _custom:
        terms = SparkSession.active().range(1).select(_custom[mode](F.lit(text))).first()[0]
        return [(i, t) for i, t in enumerate(terms or []) if t is not None]
    if mode not in _PATTERNS:
        raise ValueError(f"search text cannot be analysed with {mode!r} before the query runs")
    classes = "LN" if _PATTERNS[mode] == WORD_PATTERN else "L"
    kept = "".join(c if unicodedata.category(c)[0] in classes else " " for c in text)
    dropped = stop_words if drops_stop_words(mode) else ()
    return [(i, w) for i, w in enumerate(kept.lower().split()) if w not in dropped]


# Values per block when running sums are taken; keeps the work per value constant.
_BLOCK = 16


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column, levels: int = 2) -> Column:
    """Running sums of an int array.

    Sums are taken in blocks: the running total at the end of each block, then short
    sums inside the block. The block totals are summed the same way, so the work stays
    near linear for very long arrays.
    """
    zero = F.lit(0)

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda t, x: t + x)

    if levels == 0:
        sums = F.aggregate(
            values, F.array().cast("array<int>"), lambda s, x: F.array_append(s, F.coalesce(F.get(s, F.size(s) - 1), zero) + x)
        )
        return sums

    def in_blocks(v: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        block_totals = F.transform(blocks, lambda b: total(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))

        def fill(ends: Column) -> Column:
            def inside(b: Column) -> Column:
                before = F.array(F.coalesce(F.get(ends, b - 1), zero))
                block = F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))
                sums = F.aggregate(block, before, lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
                return F.slice(sums, F.lit(2), F.lit(_BLOCK))

            return F.flatten(F.transform(blocks, inside))

        return bind(running_sums(block_totals, levels - 1), fill)

    return bind(values, in_blocks)


def located_words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """Words with offsets in characters: ``array<struct<word, start_off, end_off>>``.

    A word starts after all earlier words and gaps, so starts are running sums of
    their lengths.
    """

    def locate(parts: Column) -> Column:
        before = F.concat(F.array(F.lit("")), parts["words"])
        steps = F.zip_with(parts["gaps"], before, lambda gap, word: F.length(gap) + F.length(word))
        starts = F.slice(running_sums(steps), F.lit(1), F.size(parts["words"]))
        return F.zip_with(
            parts["words"],
            starts,
            lambda w, s: F.struct(w.alias("word"), s.alias("start_off"), (s + F.length(w)).alias("end_off")),
        )

    return bind(F.struct(words(text, pattern).alias("words"), F.split(text, pattern, -1).alias("gaps")), locate)
