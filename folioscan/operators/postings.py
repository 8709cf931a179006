"""Postings: one row per term occurrence, and term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.definition import STOP_WORDS, IndexDefinition
from folioscan.functions import analysis
from folioscan.operators.fields import searchable

POSTING_COLUMNS = ("doc_id", "field", "pos", "start_off", "end_off", "term")


def text_postings(
    df: DataFrame,
    doc_id: Column,
    field: str,
    text: Column,
    mode: str,
    stop_words: tuple[str, ...] = STOP_WORDS,
    offsets: bool = True,
) -> DataFrame:
    """Postings of one text column under one analyzer.

    Positions of dropped stop words stay counted. ``offsets=False`` leaves the two
    offset columns out, which saves their computation for word analyzers.
    """
    base = df.select(doc_id.cast("string").alias("doc_id"), F.lit(field).alias("field"), text.alias("text"))
    pattern = analysis.word_pattern(mode)
    if pattern is None:
        rows = base.filter(F.col("text") != "").select(
            "doc_id",
            "field",
            F.lit(0).alias("pos"),
            F.lit(0).alias("start_off"),
            F.length("text").alias("end_off"),
            (F.lower("text") if mode == "lowercase_keyword" else F.col("text")).alias("term"),
        )
        return rows if offsets else rows.drop("start_off", "end_off")
    if offsets:
        located = base.select("doc_id", "field", F.posexplode(analysis.located_words(F.col("text"), pattern)))
        rows = located.select(
            "doc_id", "field", "pos", "col.start_off", "col.end_off", F.lower("col.word").alias("term")
        )
    else:
        found = base.select("doc_id", "field", F.posexplode(analysis.words(F.col("text"), pattern)))
        rows = found.select("doc_id", "field", "pos", F.lower("col").alias("term"))
    return rows.filter(~F.col("term").isin(*stop_words)) if analysis.drops_stop_words(mode) and stop_words else rows


def _tokens(mode: str, text: Column) -> Column:
    """Tokens of one field row as ``array<struct<pos, start_off, end_off, term>>``."""
    pattern = analysis.word_pattern(mode)
    if pattern is not None:
        return F.transform(
            analysis.located_words(text, pattern),
            lambda w, i: F.struct(
                i.alias("pos"),
                w["start_off"].alias("start_off"),
                w["end_off"].alias("end_off"),
                F.lower(w["word"]).alias("term"),
            ),
        )
    if analysis.is_registered(mode):
        return F.transform(
            analysis.analyze(text, mode),
            lambda t, i: F.struct(
                i.alias("pos"),
                F.lit(None).cast("int").alias("start_off"),
                F.lit(None).cast("int").alias("end_off"),
                t.alias("term"),
            ),
        )
    term = F.lower(text) if mode == "lowercase_keyword" else text
    return F.array(
        F.struct(
            F.lit(0).alias("pos"),
            F.lit(0).alias("start_off"),
            F.length(text).alias("end_off"),
            term.alias("term"),
        )
    )


_TOKEN_TYPE = "array<struct<pos:int,start_off:int,end_off:int,term:string>>"


def field_postings(fields: DataFrame, definition: IndexDefinition) -> DataFrame:
    """Postings of a long field table; each row's ``mode`` chooses its analyzer.

    Positions run on through the values of a multi-valued field; offsets are those
    inside the value, and ``ord`` tells the values apart.
    """
    names = {"keyword", "lowercase_keyword", *definition.analyzers.values()}
    names |= {definition.analyzer_of(f) for f in {*definition.indexing, *definition.analyzers}}
    known = sorted(n for n in names if analysis.is_whole_value(n) or analysis.word_pattern(n) or analysis.is_registered(n))
    tokens = F.when(F.lit(False), F.array().cast(_TOKEN_TYPE))
    for mode in known:
        tokens = tokens.when(F.col("mode") == mode, _tokens(mode, F.col("term")).cast(_TOKEN_TYPE))
    rows = searchable(fields).select("doc_id", "field", "ord", "first_pos", "mode", F.explode(tokens).alias("t"))
    stops = F.col("t.term").isin(*definition.stop_words) if definition.stop_words else F.lit(False)
    dropped = F.col("mode").isin("standard", "stop") & stops
    position = (F.col("first_pos") + F.col("t.pos")).alias("pos")
    return rows.filter(~dropped).select("doc_id", "field", "ord", position, "t.start_off", "t.end_off", "t.term")


def posting_term_stats(postings: DataFrame) -> DataFrame:
    """``doc_freq`` and ``total_freq`` per (field, term) of a postings table.

    Occurrences are first counted per document, so a frequent term is spread over its
    documents and arrives at the second step as partial counts.
    """
    per_document = postings.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))
    return per_document.groupBy("field", "term").agg(
        F.count("*").alias("doc_freq"), F.sum("tf").alias("total_freq")
    )


def text_term_stats(
    df: DataFrame, field: str, text: Column, mode: str = "standard", stop_words: tuple[str, ...] = STOP_WORDS
) -> DataFrame:
    """The same statistics straight from documents (one row each), in a single shuffle.

    Each document gives its terms once with and once without repeats; the two are
    counted apart. Documents need not be grouped, and counts are partial before the
    shuffle.
    """
    terms = df.select(analysis.analyze(text, mode).alias("terms"))
    twice = F.array(
        F.struct(F.lit(False).alias("once"), F.col("terms").alias("terms")),
        F.struct(F.lit(True).alias("once"), F.array_distinct("terms").alias("terms")),
    )
    rows = terms.select(F.inline(twice)).select("once", F.explode("terms").alias("term"))
    if analysis.drops_stop_words(mode) and stop_words:
        rows = rows.filter(~F.col("term").isin(*stop_words))
    stats = rows.groupBy("term").agg(
        F.count_if(F.col("once")).alias("doc_freq"), F.count_if(~F.col("once")).alias("total_freq")
    )
    return stats.select(F.lit(field).alias("field"), "term", "doc_freq", "total_freq")


def phrase_documents(postings: DataFrame, phrase: list[tuple[int, str]]) -> DataFrame:
    """Documents of a one-field postings table that hold the phrase.

    Each occurrence of a phrase term votes for the position its phrase would start at;
    a start with a vote for every place is a match, repeated postings or not. This is one grouping over the
    phrase's own postings, keyed by document and start, with no self-join.
    """
    if not phrase:
        return postings.select("doc_id").limit(0)
    offsets: dict[str, list[int]] = {}
    for pos, term in phrase:
        offsets.setdefault(term, []).append(pos)
    shifts = F.when(F.lit(False), F.array().cast("array<int>"))
    for term, places in offsets.items():
        shifts = shifts.when(F.col("term") == term, F.array(*[F.lit(p) for p in places]))
    votes = (
        postings.filter(F.col("term").isin(*offsets))
        .select("doc_id", "pos", F.explode(shifts).alias("place"))
        .groupBy("doc_id", (F.col("pos") - F.col("place")).alias("start"))
        .agg(F.count_distinct("place").alias("votes"))
    )
    return votes.filter(F.col("votes") == len(phrase)).select("doc_id").distinct()
