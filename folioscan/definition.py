"""Index definitions: which fields are searchable, stored, sorted, and how."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession

# Names that appear in the data.
ALL_FIELDS = "__all_fields"
DOCUMENT_ID = "__document_id"
RANGE_SUFFIX = "_Range"
ARRAY_SUFFIX = "_IsArray"
JSON_SUFFIX = "_ConvertToJson"
NULL_TERM = "NULL_VALUE"
EMPTY_TERM = "EMPTY_STRING"

# The resolved index modes.
NOT_INDEXED = "NO"
ANALYZED = "ANALYZED"
ANALYZED_NO_NORMS = "ANALYZED_NO_NORMS"
NOT_ANALYZED_NO_NORMS = "NOT_ANALYZED_NO_NORMS"

# The usual short English stop list.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was",
    "will", "with",
)


# The choices of each policy.
class Indexing(str, Enum):
    NO = "No"
    ANALYZED = "Analyzed"
    NOT_ANALYZED = "NotAnalyzed"
    DEFAULT = "Default"


class Storage(str, Enum):
    YES = "Yes"
    NO = "No"


class Sort(str, Enum):
    NONE = "None"
    STRING = "String"
    INT = "Int"
    FLOAT = "Float"
    LONG = "Long"
    DOUBLE = "Double"
    SHORT = "Short"
    CUSTOM = "Custom"
    BYTE = "Byte"
    STRING_VAL = "StringVal"


# The resolved mode of an explicit policy; ``Default`` leaves the choice to the caller.
INDEXING_MODES = {
    Indexing.NO: NOT_INDEXED,
    Indexing.ANALYZED: ANALYZED_NO_NORMS,
    Indexing.NOT_ANALYZED: NOT_ANALYZED_NO_NORMS,
}


@dataclass(frozen=True)
class IndexDefinition:
    """Per-field policies; the ``__all_fields`` entry of a mapping is its fallback."""

    name: str
    indexing: Mapping[str, Indexing] = field(default_factory=dict)
    storage: Mapping[str, Storage] = field(default_factory=dict)
    sorting: Mapping[str, Sort] = field(default_factory=dict)
    analyzers: Mapping[str, str] = field(default_factory=dict)
    stop_words: tuple[str, ...] = STOP_WORDS

    def index_mode(self, name: str, default: str = ANALYZED_NO_NORMS) -> str:
        policy = self.indexing.get(name, self.indexing.get(ALL_FIELDS))
        if policy is not None:
            return INDEXING_MODES.get(policy, default)
        has_analyzer = not {name, ALL_FIELDS}.isdisjoint(self.analyzers)
        return ANALYZED if has_analyzer else default

    def is_stored(self, name: str, default: Storage = Storage.NO) -> bool:
        return self.storage.get(name, self.storage.get(ALL_FIELDS, default)) is Storage.YES

    def sort_of(self, name: str) -> Sort:
        candidates = (name, ALL_FIELDS, name.removesuffix(RANGE_SUFFIX))
        return next((self.sorting[c] for c in candidates if c in self.sorting), Sort.NONE)

    def analyzer_of(self, name: str, querying: bool = False) -> str:
        """The analyzer run on an analysed field, or on search text for it.

        Only an entry for the field itself chooses the keyword or the word
        analyzer; fields that are analysed through ``__all_fields`` and fields
        with a custom name run the lowercase keyword analyzer, unless a custom
        analyzer of that name has been registered. One that is not for queries is
        passed over for search text, which then runs the lowercase keyword analyzer.
        """
        from folioscan.functions.analysis import is_for_queries, is_registered

        custom = self.analyzers.get(name)
        if custom is not None and is_registered(custom) and (not querying or is_for_queries(custom)):
            return custom
        own = self.indexing.get(name)
        if own is Indexing.NOT_ANALYZED:
            return "keyword"
        if own is Indexing.ANALYZED and custom is None:
            return "standard"
        return "lowercase_keyword"

    def policy_rows(self) -> list[tuple[str, str | None, str | None, str | None, bool]]:
        names = sorted({*self.indexing, *self.storage, *self.sorting, *self.analyzers} - {ALL_FIELDS})
        return [
            (
                n,
                self.indexing[n].value if n in self.indexing else None,
                self.storage[n].value if n in self.storage else None,
                self.sorting[n].value if n in self.sorting else None,
                n in self.analyzers,
            )
            for n in names
        ]

    def policy_frame(self, spark: SparkSession) -> DataFrame:
        """One row per field named in the definition (``__all_fields`` is kept out)."""
        schema = "field string, indexing string, storage string, sort string, has_analyzer boolean"
        return spark.createDataFrame(self.policy_rows(), schema)
