"""Tables made of a dictionary that find its terms by pattern or by likeness without reading all of it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.predicates import fuzzy_term, wildcard_regex
from folioscan.session import written

# They stand before the first and after the last letter of a term; no analyzer puts them in one.
FIRST, LAST = "\x02", "\x03"
GRAM = 3
# Rows of a table that a task sorts.
RANGE_ROWS = 4_000_000


def _sorted(rows: DataFrame, path: str, *order: str, partitions: int | None = None) -> None:
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    ranged.write.mode("errorifexists").parquet(path)


def _known(terms: DataFrame) -> tuple[DataFrame, int]:
    """The distinct terms, written once, as finding ranges reads them twice; and ranges enough for a row a letter."""
    known = written(terms.select("term").filter("term is not null and term != ''").distinct(), "terms")
    letters = known.agg(F.sum(F.length("term"))).first()[0] or 0
    return known, max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(letters / RANGE_ROWS))


def term_grams(term: Column) -> Column:
    """The distinct letter triples of a term with a mark before and after it."""
    marked = F.concat(F.lit(FIRST), term, F.lit(LAST))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.substring(marked, i, F.lit(GRAM))))


def pattern_grams(pattern: str) -> list[str]:
    """The triples that every term of a pattern with ``*`` and ``?`` must have; none if the pattern leaves no three letters together."""
    runs = re.split(r"[*?]", f"{FIRST}{pattern}{LAST}")
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


@dataclass(frozen=True)
class GramTable:
    """(gram, term) of each distinct term, sorted by gram, so that a triple's terms lie in few row groups."""

    spark: SparkSession
    path: str

    def write(self, terms: DataFrame, partitions: int | None = None) -> GramTable:
        """Make the table from the ``term`` column of a dictionary. Null and empty terms have no triples."""
        known, ranges = _known(terms)
        _sorted(known.select(F.explode(term_grams(F.col("term"))).alias("gram"), "term"), self.path, "gram", "term", partitions=partitions or ranges)
        return self

    def matching(self, pattern: str, terms: DataFrame | None = None) -> DataFrame:
        """(term) of all terms that match a pattern of ``*`` and ``?``, wherever these stand.

        Candidates have all triples of the pattern; the pattern decides. One without three letters together
        (start and end of the term count as a letter) needs the dictionary, ``terms``, all of which is read.
        """
        wanted, rows = pattern_grams(pattern), self.spark.read.schema("gram string, term string").parquet(self.path)
        if wanted:
            found = rows.filter(F.col("gram").isin(*wanted)).groupBy("term").agg(F.count("*").alias("grams"))
            candidates = found.filter(F.col("grams") == len(wanted)).select("term")
        elif terms is None:
            raise ValueError(f"pattern {pattern!r} has no three letters together: give the dictionary")
        else:
            candidates = terms.select("term").distinct()
        return candidates.filter(F.col("term").rlike(wildcard_regex(pattern)))


def shortened(term: Column, letters: int) -> Column:
    """All texts that a term becomes when up to some of its letters are left out, itself included."""

    def without_one(text: Column) -> Column:
        places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))

    found, last = F.array(term), F.array(term)
    for _ in range(letters):
        last = F.array_distinct(F.flatten(F.transform(last, without_one)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def shortened_text(text: str, letters: int) -> set[str]:
    """The same for one text, on the driver."""
    return {"".join(c for i, c in enumerate(text) if i not in gone) for n in range(min(letters, len(text)) + 1) for gone in combinations(range(len(text)), n)}


def halves(term: Column) -> list[Column]:
    """The two halves of a term; the second has the odd letter."""
    middle = F.floor(F.length(term) / 2).cast("int")
    return [F.substring(term, F.lit(1), middle), F.substring(term, middle + 1, F.length(term))]


def half_texts(wanted: str, edits: int, left_out: int, longest: int) -> set[tuple[int, int, str]]:
    """(half, length of the term, text) that a term within some edits may share with a text: one half has at most half of the edits."""
    out = set()
    for length in range(max(1, len(wanted) - edits), min(longest, len(wanted) + edits) + 1):
        for cut in range(max(0, length // 2 - edits), min(len(wanted), length // 2 + edits) + 1):
            for half, part in enumerate((wanted[:cut], wanted[cut:])):
                out |= {(half, length, text) for text in shortened_text(part, left_out)}
    return out


@dataclass(frozen=True)
class VariantTable:
    """(variant, term): hashes of what each half of a term becomes when letters are left out, sorted by hash.

    Of two terms within ``letters`` edits, one half has at most half of the edits, so it is enough to leave so many letters out of
    each half: a row or so a letter, where leaving two out of whole terms makes some fifty rows a term. Terms
    that share half, length and what is left are compared. Terms of more than ``longest`` letters have one row
    with a null hash and are compared one by one.
    """

    spark: SparkSession
    path: str
    letters: int = 2
    longest: int = 32

    @staticmethod
    def _marked(half: int):
        return lambda text: F.struct(F.lit(half).alias("half"), F.length("term").alias("length"), text.alias("text"))

    def write(self, terms: DataFrame, partitions: int | None = None) -> VariantTable:
        known, ranges = _known(terms)
        short = F.length("term") <= self.longest
        texts = [F.transform(shortened(part, self.letters // 2), self._marked(half)) for half, part in enumerate(halves(F.col("term")))]
        hashed = known.filter(short).select(F.explode(F.concat(*texts)).alias("m"), "term")
        rows = hashed.select(F.xxhash64("m.half", "m.length", "m.text").alias("variant"), "term")
        rows = rows.unionByName(known.filter(~short).select(F.lit(None).cast("bigint").alias("variant"), "term"))
        _sorted(rows, self.path, "variant", "term", partitions=partitions or ranges)
        return self

    def near(self, wanted: str, min_similarity: float = 0.5, prefix_length: int = 0, terms: DataFrame | None = None) -> DataFrame:
        """(term) of all terms that ``predicates.fuzzy_term`` finds like ``wanted``.

        A similarity that admits more edits than the table is made for needs the dictionary, ``terms``, all of which is read.
        """
        rule = fuzzy_term(F.col("term"), wanted, min_similarity, prefix_length)
        # The distance must lie below the share of the shorter term that may differ.
        edits = max(0, ceil((1.0 - min_similarity) * len(wanted)) - 1)
        if edits > self.letters:
            if terms is None:
                raise ValueError(f"{edits} edits are more than the {self.letters} that the table is made for: give the dictionary")
            return terms.select("term").distinct().filter(rule)
        rows = self.spark.read.schema("variant bigint, term string").parquet(self.path)
        meets = F.col("variant").isNull()
        if len(wanted) <= self.longest + edits:
            shared = sorted(half_texts(wanted, edits, self.letters // 2, self.longest))
            texts = self.spark.createDataFrame(shared, "half int, length int, text string")
            hashes = [r[0] for r in texts.select(F.xxhash64("half", "length", "text")).collect()]
            meets = F.col("variant").isin(*hashes) | meets if len(wanted) + edits > self.longest else F.col("variant").isin(*hashes)
        return rows.filter(meets).filter(rule).select("term").distinct()


def documents_with(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id) of documents that have any of some terms."""
    return postings.join(terms, "term", "left_semi").select("doc_id").distinct()
