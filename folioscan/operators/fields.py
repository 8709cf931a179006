"""Values to fields: the long field table and the wide document table.

Both shapes follow the same per-value rules. All fields of a row are built in one
projection, so a source table is read once however many fields it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.definition import (
    ALL_FIELDS,
    ANALYZED,
    ANALYZED_NO_NORMS,
    ARRAY_SUFFIX,
    EMPTY_TERM,
    INDEXING_MODES,
    JSON_SUFFIX,
    NOT_ANALYZED_NO_NORMS,
    NOT_INDEXED,
    NULL_TERM,
    RANGE_SUFFIX,
    IndexDefinition,
    Indexing,
    Sort,
    Storage,
)
from folioscan.functions import analysis
from folioscan.functions.values import kind_of, value_text

FIELD_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("first_pos", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("range_type", T.StringType()),
        T.StructField("num_long", T.LongType()),
        T.StructField("num_double", T.DoubleType()),
        T.StructField("stored", T.BooleanType()),
        T.StructField("indexed", T.BooleanType()),
    ]
)


def document_id(value: Column) -> Column:
    return F.lower(value.cast("string"))


# --- names -----------------------------------------------------------------------------------


def is_valid_name(name: Column) -> Column:
    """False for a null, empty or blank field name."""
    return F.coalesce(name.rlike(r"\S"), F.lit(False))


def prefixed_name(name: Column) -> Column:
    """Names that start with neither a letter nor ``_`` get a leading ``_``."""
    return F.when(name.rlike(r"^[\p{L}_]"), name).otherwise(F.concat(F.lit("_"), name))


def field_name(name: str) -> str:
    """The same two rules for a column name, when the plan is built."""
    if not name or not name.strip():
        raise ValueError("a field name must not be empty or blank")
    return name if name[0].isalpha() or name[0] == "_" else "_" + name


# --- policies --------------------------------------------------------------------------------


def with_policy(fields: DataFrame, definition: IndexDefinition, name: str = "field") -> DataFrame:
    """Join the definition's entries to a table with a field-name column."""
    spark = fields.sparkSession
    policy = definition.policy_frame(spark).withColumnRenamed("field", "_policy_field")
    return fields.join(policy, F.col(name) == F.col("_policy_field"), "left").drop("_policy_field")


def _fallback(entries, value):
    return F.lit(entries[ALL_FIELDS].value if ALL_FIELDS in entries else value).cast("string")


def resolve_indexing(
    fields: DataFrame, definition: IndexDefinition, default: str = ANALYZED_NO_NORMS, name: str = "field"
) -> DataFrame:
    """Add ``index_mode``: the field's own entry, then ``__all_fields``, then an analyzer, then the default."""
    joined = with_policy(fields, definition, name)
    policy = F.coalesce(F.col("indexing"), _fallback(definition.indexing, None))
    has_analyzer = F.coalesce(F.col("has_analyzer"), F.lit(False)) | F.lit(ALL_FIELDS in definition.analyzers)
    mode = F.when(policy == Indexing.DEFAULT.value, F.lit(default))
    for entry, resolved in INDEXING_MODES.items():
        mode = mode.when(policy == entry.value, F.lit(resolved))
    mode = mode.when(has_analyzer, F.lit(ANALYZED)).otherwise(F.lit(default))
    return joined.select(*fields.columns, mode.alias("index_mode"))


def resolve_storage(
    fields: DataFrame, definition: IndexDefinition, default: Storage = Storage.NO, name: str = "field"
) -> DataFrame:
    """Add ``stored`` (boolean)."""
    joined = with_policy(fields, definition, name)
    storage = F.coalesce(F.col("storage"), _fallback(definition.storage, default.value))
    return joined.select(*fields.columns, (storage == Storage.YES.value).alias("stored"))


def resolve_sort(fields: DataFrame, definition: IndexDefinition, name: str = "field") -> DataFrame:
    """Add ``sort``; a ``_Range`` companion without an entry takes that of its field."""
    base = F.regexp_replace(F.col(name), RANGE_SUFFIX + "$", "")
    own = with_policy(fields, definition, name).select(*fields.columns, F.col("sort").alias("_own_sort"))
    # The suffix can only matter when __all_fields has no entry.
    if ALL_FIELDS in definition.sorting:
        sort = F.coalesce(F.col("_own_sort"), _fallback(definition.sorting, None))
        return own.select(*fields.columns, sort.alias("sort"))
    both = with_policy(own.withColumn("_base", base), definition, "_base")
    sort = F.coalesce(F.col("_own_sort"), F.col("sort"), F.lit(Sort.NONE.value))
    return both.select(*fields.columns, sort.alias("sort"))


# --- value rules -----------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldRule:
    """What a definition says about one column, settled when the plan is built."""

    column: str
    name: str
    dtype: T.DataType  # of the items, for arrays
    depth: int  # levels of array nesting
    is_raw: bool  # explicitly not analysed
    drops_nulls: bool  # null items of arrays
    index_mode: str
    mode: str  # analyzer of ordinary values; "none" when not searchable
    stored: bool
    range_type: str | None

    @property
    def kind(self) -> str:
        kind = kind_of(self.dtype)
        return "text" if self.is_raw and kind != "date" else kind


def _item_type(dtype: T.DataType) -> tuple[T.DataType, int]:
    depth = 0
    while isinstance(dtype, T.ArrayType):
        dtype, depth = dtype.elementType, depth + 1
    return dtype, depth


def range_type_of(dtype: T.DataType, sort: Sort) -> str | None:
    """The type of the numeric companion; bytes and shorts have none."""
    if isinstance(dtype, T.IntegerType):
        return "long" if sort is Sort.LONG else "int"
    if isinstance(dtype, T.FloatType):
        return "double" if sort is Sort.DOUBLE else "float"
    if isinstance(dtype, T.LongType):
        return "long"
    return "double" if isinstance(dtype, (T.DecimalType, T.DoubleType)) else None


def field_rule(column: str, dtype: T.DataType, definition: IndexDefinition) -> FieldRule:
    name = field_name(column)
    item, depth = _item_type(dtype)
    kind = kind_of(item)
    plain_mode = definition.index_mode(name)
    is_raw = plain_mode == NOT_ANALYZED_NO_NORMS
    index_mode = definition.index_mode(name, ANALYZED if kind == "text" else NOT_ANALYZED_NO_NORMS)
    if index_mode == NOT_INDEXED:
        mode = "none"
    elif index_mode == NOT_ANALYZED_NO_NORMS:
        mode = "keyword"
    else:
        mode = definition.analyzer_of(name)
    return FieldRule(
        column=column,
        name=name,
        dtype=item,
        depth=depth,
        is_raw=is_raw,
        drops_nulls=plain_mode in (ANALYZED, ANALYZED_NO_NORMS),
        index_mode=index_mode,
        mode=mode,
        stored=definition.is_stored(name),
        range_type=None if is_raw else range_type_of(item, definition.sort_of(name)),
    )


def field_rules(df: DataFrame, definition: IndexDefinition, skip: tuple[str, ...] = ()) -> list[FieldRule]:
    return [field_rule(f.name, f.dataType, definition) for f in df.schema.fields if f.name not in skip]


def items_of(rule: FieldRule, value: Column) -> Column:
    """The items of an array column, nested arrays flattened, null items dropped or kept by policy."""

    def without_nulls(array: Column) -> Column:
        return F.filter(array, lambda x: x.isNotNull())

    def with_null_item(array_type: T.DataType):
        return lambda x: F.coalesce(x, F.array(F.lit(None)).cast(array_type))

    items = value
    item_types = [rule.dtype]
    for _ in range(rule.depth - 1):
        item_types.append(T.ArrayType(item_types[-1]))
    for inner in reversed(item_types[1:]):
        # A null inner array is one null item.
        items = F.flatten(without_nulls(items) if rule.drops_nulls else F.transform(items, with_null_item(inner)))
    return without_nulls(items) if rule.drops_nulls else items


def is_sentinel(rule: FieldRule, value: Column) -> tuple[Column, Column]:
    empty = value == "" if isinstance(rule.dtype, T.StringType) else F.lit(False)
    return value.isNull(), empty


def source_term(rule: FieldRule, value: Column) -> Column:
    """The text handed to the index for one value, sentinels included."""
    absent, empty = is_sentinel(rule, value)
    text = value_text(value, rule.dtype, analyzed=not rule.is_raw) if rule.kind != "null" else F.lit(None)
    return F.when(absent, F.lit(NULL_TERM)).when(empty, F.lit(EMPTY_TERM)).otherwise(text)


def _entry(rule: FieldRule, value: Column, ordinal: Column, first_pos: Column) -> Column:
    absent, empty = is_sentinel(rule, value)
    sentinel = absent | empty
    number = F.lit(None).cast("double")
    whole = F.lit(None).cast("bigint")
    if rule.range_type in ("int", "long"):
        whole = value.cast("bigint")
    elif rule.range_type:
        number = value.cast(rule.range_type).cast("double")
    return F.struct(
        F.lit(rule.name).alias("field"),
        ordinal.cast("int").alias("ord"),
        first_pos.cast("int").alias("first_pos"),
        source_term(rule, value).alias("term"),
        F.when(absent, "null").when(empty, "empty").otherwise(F.lit(rule.kind)).alias("kind"),
        F.when(sentinel, "keyword").otherwise(F.lit(rule.mode)).alias("mode"),
        F.when(~sentinel, F.lit(rule.range_type).cast("string")).alias("range_type"),
        whole.alias("num_long"),
        number.alias("num_double"),
        F.lit(rule.stored).alias("stored"),
        (sentinel | F.lit(rule.mode != "none")).alias("indexed"),
    )


def _marker(name: str, ordinal: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("field"),
        ordinal.cast("int").alias("ord"),
        F.lit(0).alias("first_pos"),
        F.lit("true").alias("term"),
        F.lit("marker").alias("kind"),
        F.lit("keyword").alias("mode"),
        none.cast("string").alias("range_type"),
        none.cast("bigint").alias("num_long"),
        none.cast("double").alias("num_double"),
        F.lit(True).alias("stored"),
        F.lit(True).alias("indexed"),
    )


_ENTRIES = T.ArrayType(T.StructType(FIELD_SCHEMA.fields[1:]))


def _no_entries() -> Column:
    return F.array().cast(_ENTRIES)


def _first_positions(rule: FieldRule, items: Column) -> Column:
    """Where each item's terms start when the terms of all items are counted through."""

    def terms_of(item: Column) -> Column:
        absent, empty = is_sentinel(rule, item)
        found = F.size(analysis.analyze(source_term(rule, item), rule.mode))
        return F.when(absent | empty, 1).otherwise(found)

    counts = F.transform(items, terms_of)
    return F.concat(F.array(F.lit(0)), analysis.running_sums(counts))


def _value_entries(rule: FieldRule, value: Column, ordinal: Column, first_pos: Column) -> Column:
    """The rows of one value: itself, after a marker when it is an object."""
    entry = F.array(_entry(rule, value, ordinal, first_pos)).cast(_ENTRIES)
    if rule.kind != "json":
        return entry
    marker = F.when(value.isNotNull(), F.array(_marker(rule.name + JSON_SUFFIX, ordinal)))
    return F.concat(F.coalesce(marker, _no_entries()), entry).cast(_ENTRIES)


def field_entries(rule: FieldRule, value: Column) -> Column:
    """All field rows of one column value, as an array of structs."""
    if not rule.depth:
        return _value_entries(rule, value, F.lit(1), F.lit(0))
    if rule.kind == "json":
        items = F.flatten(F.transform(items_of(rule, value), lambda x, i: _value_entries(rule, x, i + 1, i)))
    elif rule.mode in ("none", "keyword", "lowercase_keyword"):
        items = F.transform(items_of(rule, value), lambda x, i: _entry(rule, x, i + 1, i))
    else:
        items = analysis.bind(
            items_of(rule, value),
            lambda found: F.transform(
                F.arrays_zip(found.alias("item"), F.slice(_first_positions(rule, found), F.lit(1), F.size(found)).alias("first")),
                lambda x, i: _entry(rule, x["item"], i + 1, x["first"]),
            ),
        )
    if rule.stored:
        marker = F.when(F.size(value) > 0, F.array(_marker(rule.name + ARRAY_SUFFIX, F.lit(1))))
        items = F.concat(F.coalesce(marker, _no_entries()), items)
    missing = F.array(_entry(rule, F.lit(None).cast(rule.dtype), F.lit(1), F.lit(0)))
    return F.when(value.isNull(), missing).otherwise(items).cast(_ENTRIES)


def all_entries(df: DataFrame, definition: IndexDefinition, skip: tuple[str, ...] = ()) -> Column:
    rules = field_rules(df, definition, skip)
    return F.concat(*[field_entries(r, F.col(f"`{r.column}`")) for r in rules])


def field_rows(df: DataFrame, doc_id: str, definition: IndexDefinition) -> DataFrame:
    """The long field table of a source table (schema ``FIELD_SCHEMA``)."""
    entries = all_entries(df, definition, skip=(doc_id,))
    rows = df.select(document_id(F.col(doc_id)).alias("doc_id"), F.explode(entries).alias("e"))
    return rows.select("doc_id", "e.*")


def with_ready_rows(fields: DataFrame, ready: DataFrame) -> DataFrame:
    """Add field rows the caller has shaped; they go in as they are."""
    return fields.unionByName(ready.select(*FIELD_SCHEMA.fieldNames()))


def searchable(fields: DataFrame) -> DataFrame:
    """Rows that may be searched: a policy of No leaves only the null and empty sentinels."""
    return fields.filter(F.col("indexed") & ((F.col("mode") != "none") | F.col("kind").isin("null", "empty")))


# --- wide documents --------------------------------------------------------------------------


def search_column(rule: FieldRule, definition: IndexDefinition) -> Column:
    """The normalised, searchable form of a column: text, or ``array<string>`` when it has several terms.

    Arrays of words hold each word in its place, with a null for a dropped stop word.
    """
    value = F.col(f"`{rule.column}`")

    def terms(x: Column) -> Column:
        text = source_term(rule, x)
        absent, empty = is_sentinel(rule, x)
        if rule.mode == "none":
            return F.when(absent | empty, text)
        if rule.mode == "keyword":
            return text
        if rule.mode == "lowercase_keyword":
            return F.when(absent | empty, text).otherwise(F.lower(text))
        found = analysis.placed_terms(text, rule.mode, definition.stop_words)
        return F.when(absent | empty, F.array(text)).otherwise(found)

    if not rule.depth:
        return terms(value)
    missing = F.array(F.lit(NULL_TERM))
    per_item = F.transform(items_of(rule, value), terms)
    whole_value = rule.mode in ("none", "keyword", "lowercase_keyword")
    flat = F.filter(per_item, lambda t: t.isNotNull()) if whole_value else F.flatten(per_item)
    return F.when(value.isNull(), missing).otherwise(flat)


def range_column(rule: FieldRule) -> Column | None:
    if rule.range_type is None:
        return None
    value = F.col(f"`{rule.column}`")
    target = {"int": "int", "long": "bigint", "float": "float", "double": "double"}[rule.range_type]
    if rule.depth:
        return F.transform(items_of(rule, value), lambda x: x.cast(target))
    return value.cast(target)


def document_table(df: DataFrame, doc_id: str, definition: IndexDefinition) -> DataFrame:
    """One row per document: ``doc_id``, search columns, ``_Range`` companions and ``stored_`` values."""
    columns = [document_id(F.col(doc_id)).alias("doc_id")]
    for rule in field_rules(df, definition, skip=(doc_id,)):
        columns.append(search_column(rule, definition).alias(rule.name))
        companion = range_column(rule)
        if companion is not None:
            columns.append(companion.alias(rule.name + RANGE_SUFFIX))
        if rule.stored:
            columns.append(F.col(f"`{rule.column}`").alias("stored_" + rule.name))
    documents = df.select(*columns)
    names = [c.lower() for c in documents.columns]
    repeated = sorted({c for c in names if names.count(c) > 1})
    if repeated:
        raise ValueError(f"several columns would be called {', '.join(repeated)}")
    return documents


def stored_fields(hits: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """The stored values of the documents that were hit."""
    wanted = documents.select("doc_id", *[F.col("stored_" + f).alias(f) for f in fields])
    return wanted.join(hits.select("doc_id"), "doc_id", "left_semi")


def document_dump(df: DataFrame, doc_id: str, definition: IndexDefinition) -> DataFrame:
    """A text block per document: each field's name, ``I``/``-``, ``S``/``-`` and value, one per line."""

    def line(name: Column, indexed: Column, stored: Column, text: Column) -> Column:
        flags = F.concat(F.when(indexed, "I").otherwise("-"), F.when(stored, "S").otherwise("-"))
        return F.concat(F.lit("\t"), name, F.lit(" "), flags, F.lit(": "), text, F.lit("\n"))

    def lines(e: Column) -> Column:
        number = F.coalesce(e["num_long"].cast("string"), value_text(e["num_double"], T.DoubleType()))
        companion = line(F.concat(e["field"], F.lit(RANGE_SUFFIX)), F.lit(True), e["stored"], number)
        own = line(e["field"], e["indexed"], e["stored"], e["term"])
        return F.when(e["range_type"].isNotNull(), F.concat(own, companion)).otherwise(own)

    entries = all_entries(df, definition, skip=(doc_id,))
    key = document_id(F.col(doc_id))
    head = line(F.lit("__document_id"), F.lit(True), F.lit(True), key)
    body = F.array_join(F.transform(entries, lines), "")
    return df.select(key.alias("doc_id"), F.concat(head, body).alias("dump"))
