"""Search predicates: boolean columns over a wide document table.

A ``SearchField`` names a search column and how its text was analysed. Search text is
analysed when the query is built, so a predicate holds literals only and simple ones
(equality, prefix, range) reach the file scan.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.definition import NULL_TERM, STOP_WORDS, IndexDefinition
from folioscan.functions import analysis
from folioscan.functions.literals import Number, decode, is_typed

# Bounds that mean "no bound", as written in search text.
OPEN_BOUNDS = (None, "NULL", "*")


@dataclass(frozen=True)
class SearchField:
    """A search column: ``multi`` when it is an ``array<string>`` of terms (nulls are dropped stop words)."""

    name: str
    mode: str = "lowercase_keyword"
    multi: bool = False
    stop_words: tuple[str, ...] = STOP_WORDS

    @property
    def column(self) -> Column:
        return F.col(self.name)

    def any_term(self, test) -> Column:
        """True when some term of the field passes the test; never null."""
        matched = F.exists(self.column, test) if self.multi else test(self.column)
        return F.coalesce(matched, F.lit(False)) if self.multi else matched & self.column.isNotNull()

    def analyze(self, text: str) -> list[tuple[int, str]]:
        return analysis.query_terms(text, self.mode, self.stop_words)

    def single_term(self, text: str, kind: str) -> str:
        terms = self.analyze(text)
        if len(terms) != 1:
            raise ValueError(f"a {kind} clause on {self.name!r} needs text of one term, got {terms!r} from {text!r}")
        return terms[0][1]


def search_field(definition: IndexDefinition, name: str) -> SearchField:
    """How a definition's field is searched: its search text may run another analyzer than its documents did."""
    multi = not analysis.is_whole_value(definition.analyzer_of(name))
    return SearchField(name, definition.analyzer_of(name, querying=True), multi, definition.stop_words)


# --- boolean combination ---------------------------------------------------------------------


def must(*clauses: Column) -> Column:
    """All clauses; none at all match every document."""
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)


def should(*clauses: Column) -> Column:
    """Any clause; none at all match no document."""
    return reduce(lambda a, b: a | b, clauses) if clauses else F.lit(False)


def must_not(clause: Column) -> Column:
    """Documents the clause does not match, those without the field among them."""
    return ~F.coalesce(clause, F.lit(False))


def match_all() -> Column:
    return F.lit(True)


def match_none() -> Column:
    return F.lit(False)


# --- terms -----------------------------------------------------------------------------------


def term(field: SearchField, value: str) -> Column:
    """The exact term, not analysed."""
    if field.multi:
        return F.coalesce(F.array_contains(field.column, value), F.lit(False))
    return field.column == value


def any_of_terms(field: SearchField, values: Iterable[str]) -> Column:
    """Any of the exact terms, however many; a table of values is met by ``matching_values``."""
    wanted = sorted(set(values))
    return field.any_term(lambda t: t.isin(*wanted))


def matching_values(docs: DataFrame, field: SearchField, values: DataFrame, value: str = "value", doc_id: str = "doc_id") -> DataFrame:
    """Documents whose term is in a table of exact values of any size.

    For a field of several terms the terms are met first, and documents are kept by their ``doc_id``.
    """
    wanted = values.select(F.col(value).alias("_wanted")).distinct()
    if field.multi:
        terms = docs.select(F.col(doc_id).alias("_id"), F.explode(F.array_distinct(field.column)).alias("_term"))
        found = terms.join(wanted, F.col("_term") == F.col("_wanted"), "left_semi").select("_id").distinct()
        return docs.join(found, F.col(doc_id) == F.col("_id"), "left_semi")
    return docs.join(wanted, field.column == F.col("_wanted"), "left_semi")


def exists(field: SearchField) -> Column:
    """Any term at all; the null and empty sentinels are terms."""
    if field.multi:
        return F.coalesce(F.exists(field.column, lambda t: t.isNotNull()), F.lit(False))
    return field.column.isNotNull() & (field.column != "")


def is_null(field: SearchField) -> Column:
    return term(field, NULL_TERM)


class LiteralTerms:
    """Values that search text may name without being analysed.

    ``register`` hands out an opaque token that stands for a value; ``leave_alone``
    lists text that is to be matched as written.
    """

    def __init__(self) -> None:
        self._tokens: dict[tuple[str, str], str] = {}
        self._as_written: set[tuple[str, str]] = set()

    def register(self, field: str, value: str) -> str:
        token = uuid.uuid4().hex
        self._tokens[field, token] = value
        return token

    def leave_alone(self, field: str, value: str) -> None:
        self._as_written.add((field, value))

    def lookup(self, field: str, text: str) -> str | None:
        if (field, text) in self._tokens:
            return self._tokens[field, text]
        return text if (field, text) in self._as_written else None


def field_text(field: SearchField, text: str, literals: LiteralTerms | None = None) -> Column:
    """Free text on a field: nothing, a term, a phrase, or a prefix when it ends in ``*`` and holds a blank."""
    literal = literals.lookup(field.name, text) if literals else None
    if literal is not None:
        return term(field, literal)
    terms = field.analyze(text)
    if not terms:
        return match_none()
    if len(terms) > 1:
        return phrase(field, terms)
    if text.endswith("*") and not text.endswith("\\*") and " " in text:
        return phrase_prefix(field, text)
    return term(field, terms[0][1])


# --- multi-term patterns ---------------------------------------------------------------------


def prefix(field: SearchField, text: str) -> Column:
    start = field.single_term(text, "prefix")
    return field.any_term(lambda t: t.startswith(start))


def phrase_prefix(field: SearchField, text: str) -> Column:
    start = " ".join(t for _, t in field.analyze(text.removesuffix("*")))
    return field.any_term(lambda t: t.startswith(start))


def wildcard_regex(pattern: str) -> str:
    parts = re.split(r"([*?])", pattern)
    body = "".join({"*": ".*", "?": "."}.get(p, _quoted(p)) for p in parts if p)
    return f"(?s)^{body}$"


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 or c in " _" else "\\" + c for c in text)


def wildcard(field: SearchField, pattern: str) -> Column:
    """``*`` is any run of characters and ``?`` any one; a lone ``*`` asks for any term."""
    if pattern == "*":
        return exists(field)
    if field.mode in ("keyword", "lowercase_keyword"):
        text = field.single_term(pattern, "wildcard")
    else:
        # A word analyzer would strip the wildcards: patterns are per term, lowered only.
        if len(pattern.split()) != 1:
            raise ValueError(f"a wildcard clause on {field.name!r} needs text of one term, got {pattern!r}")
        text = pattern.lower()
    head = text.rstrip("*")
    if not re.search(r"[*?]", head):
        return field.any_term(lambda t: t.startswith(head) if head != text else t == text)
    regex = wildcard_regex(text)
    return field.any_term(lambda t: t.rlike(regex))


def fuzzy_term(found: Column, wanted: str, min_similarity: float, prefix_length: int = 0) -> Column:
    """Terms more similar than the minimum, sharing the first ``prefix_length`` characters.

    Similarity is 1 minus the edit distance over the shorter length. Lengths are
    compared first, as a term cannot be closer than its length allows, and distances
    beyond the greatest that could pass are not worked out (Spark returns -1).
    """
    size = F.length(found)
    shorter = F.least(size, F.lit(len(wanted)))
    possible = (size > 0) & (F.abs(size - len(wanted)) < F.lit(1.0 - min_similarity) * shorter)
    distance = F.levenshtein(found, F.lit(wanted), ceil((1.0 - min_similarity) * len(wanted)))
    near = possible & (distance >= 0) & (F.lit(1.0) - distance / shorter > F.lit(min_similarity))
    return found.startswith(wanted[:prefix_length]) & near if prefix_length else near


def fuzzy(field: SearchField, text: str, min_similarity: float = 0.5, prefix_length: int = 0) -> Column:
    if not 0 <= min_similarity < 1:
        raise ValueError("the minimum similarity lies in [0, 1)")
    wanted = field.single_term(text, "fuzzy")
    return field.any_term(lambda t: fuzzy_term(t, wanted, min_similarity, prefix_length))


def fuzzy_documents(
    postings: DataFrame, wanted: str, min_similarity: float = 0.5, prefix_length: int = 0, terms: DataFrame | None = None
) -> DataFrame:
    """Documents of a postings table with a similar term.

    With a dictionary (``terms``) each distinct term is compared once and the postings of those near are
    looked up; without one every posting is compared.
    """
    near = fuzzy_term(F.col("term"), wanted, min_similarity, prefix_length)
    if terms is None:
        return postings.filter(near).select("doc_id").distinct()
    return postings.join(terms.filter(near).select("term"), "term", "left_semi").select("doc_id").distinct()


# --- phrases ---------------------------------------------------------------------------------


# Stands between the words of a joined array; no analyzer of this library puts it in a term.
_BETWEEN = "\x01"


def phrase(field: SearchField, terms: list[tuple[int, str]]) -> Column:
    """Adjacent terms; ``terms`` are (position, term) pairs and gaps are dropped stop words.

    On a word field array places are positions, so the words are joined and the phrase
    is looked for as text. On a single-term field a phrase cannot match.
    """
    if not field.multi:
        return match_none()
    joined = F.concat(F.lit(_BETWEEN), F.array_join(field.column, _BETWEEN, ""), F.lit(_BETWEEN))
    steps = [after - before for (before, _), (after, _) in zip(terms, terms[1:])]
    words = [t for _, t in terms]
    if all(step == 1 for step in steps):
        found = F.contains(joined, F.lit(_BETWEEN + _BETWEEN.join(words) + _BETWEEN))
    else:
        skips = ["".join([_BETWEEN, f"[^{_BETWEEN}]*"] * (step - 1)) + _BETWEEN for step in steps]
        pattern = "".join(s + _quoted(w) for s, w in zip([_BETWEEN, *skips], words)) + _BETWEEN
        found = joined.rlike(pattern)
    return F.coalesce(found, F.lit(False))


# --- ranges ----------------------------------------------------------------------------------


def between(value: Column, low, high, inclusive: bool = True) -> Column:
    """A range with one flag for both ends; a bound of None is open and the value must exist."""
    tests = [value.isNotNull()]
    if low is not None:
        tests.append(value >= low if inclusive else value > low)
    if high is not None:
        tests.append(value <= high if inclusive else value < high)
    return must(*tests)


_SPARK_TYPES = {"int": "int", "long": "bigint", "float": "float", "double": "double"}
# An open end stands for the least or greatest number of the type.
_LIMITS = {
    "int": (-(2**31), 2**31 - 1),
    "long": (-(2**63), 2**63 - 1),
    "float": (-3.4028234663852886e38, 3.4028234663852886e38),
    "double": (-1.7976931348623157e308, 1.7976931348623157e308),
}


def number_range(value: Column, kind: str, low, high, inclusive: bool = True) -> Column:
    """A typed range; an open end is the type's own limit, which an exclusive range leaves out."""
    least, greatest = _LIMITS[kind]
    spark_type = _SPARK_TYPES[kind]
    ends = [F.lit(least if low is None else low).cast(spark_type), F.lit(greatest if high is None else high).cast(spark_type)]
    return between(value, *ends, inclusive)


def text_range(field: SearchField, low: str | None, high: str | None, inclusive: bool = True) -> Column:
    """A range of terms in binary order."""
    return field.any_term(lambda t: between(t, low, high, inclusive))


def range_clause(
    field: SearchField, low: str | None, high: str | None, inclusive: bool = True, companion: str | None = None
) -> Column:
    """A range in search-text form: typed bounds (``Lx5``) look at the numeric column, others at the terms."""
    low = None if low in OPEN_BOUNDS else low
    high = None if high in OPEN_BOUNDS else high
    bounds = [b for b in (low, high) if b is not None]
    if not any(is_typed(b) for b in bounds):
        return text_range(field, low, high, inclusive)
    numbers: list[Number | None] = [decode(low), decode(high)]
    kinds = {n.kind for n in numbers if n is not None}
    if len(kinds) != 1:
        raise ValueError(f"range bounds of different types: {low!r}, {high!r}")
    ends = [None if n is None else n.value for n in numbers]
    kind, values = kinds.pop(), F.col(companion or field.name)
    if field.multi:  # a number for each item of the field
        return F.coalesce(F.exists(values, lambda v: number_range(v, kind, *ends, inclusive)), F.lit(False))
    return number_range(values, kind, *ends, inclusive)
