"""An index as a folder of Parquet tables: documents, fields, postings, terms, bounds and what later versions replaced.

A write or a delete adds a ``version`` folder to each table and replaces nothing. Readers take the state of one
version, so a change is seen whole or not at all. Each version also writes down which live documents it takes the place
of or removes, and in which version they stood (``left``); a row is live unless it is listed there. The dictionary
adds up what versions bring and take away. ``compact`` rewrites the live rows as a new first version.

Postings and ``left`` are bucketed by document, so that dead postings are left out, and terms counted, bucket by bucket
without a shuffle. Spark knows buckets from its catalog only: the tables are registered there under names made from
the folder's path, by the session that writes or reads them, and hold no data of their own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.definition import IndexDefinition
from folioscan.functions import analysis
from folioscan.operators.fields import FIELD_SCHEMA, FieldRule, document_id, document_table, field_rows, field_rules, items_of, source_term
from folioscan.operators.postings import field_postings
from folioscan.operators.upsert import latest
from folioscan.session import settings, written

# Types in which a column may grow from version to version.
_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]

POSTING_ORDER = ["term", "rng", "doc_id", "ord", "pos"]
# Postings of a bucket, more or less: a task sorts and counts so many in memory.
BUCKET_POSTINGS = 2_000_000
# Bytes of text for each word of it, the blank after it included; a low guess makes more buckets.
WORD_BYTES = 6
# Bytes of a row group of fields; a task holds one for each of its open files.
FIELD_BLOCK = 4 << 20
# Files that a task holds open at once, one for each field; with more fields Spark sorts the rows instead.
OPEN_FILES = 64
# Bytes of a method that Java still compiles. Fields and tokens of a row are made by more code than that in one stage, which
# would be interpreted row by row; beyond the limit Spark runs the operators of the stage one after the other.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Of what an index keeps; about a fourth smaller than Spark's default.
COMPRESSION = "zstd"
POSTING_SCHEMA = "doc_id string, ord int, pos int, start_off int, end_off int, term string, rng int, field string"
TERM_SCHEMA = "term string, doc_freq bigint, total_freq bigint, field string, version int"
SUMMED = ("documents", "fields", "postings", "terms", "bounds")
BOUND_SCHEMA = "term string, rng int, most bigint, docs bigint, total bigint, field string, version int"


def merged_type(a: T.DataType, b: T.DataType, name: str) -> T.DataType:
    """The type of a column in two versions: the same, or the wider whole number, also within arrays."""
    if a == b:
        return a
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType, name))
    raise ValueError(f"column {name!r} is {a.simpleString()} in one version and {b.simpleString()} in another")


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    types: dict[str, T.DataType] = {}
    for field in (f for schema in schemas for f in schema):
        types[field.name] = merged_type(types[field.name], field.dataType, field.name) if field.name in types else field.dataType
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def sum_of_hashes(values: Column) -> Column:
    """The exact sum of longs, as a decimal; three sums of 22 bits or less each, as sums of decimals are slow by the row."""
    low = F.lit((1 << 22) - 1)
    parts = [F.sum(values.bitwiseAND(low)), F.sum(F.shiftright(values, 22).bitwiseAND(low)), F.sum(F.shiftright(values, 44))]
    whole = [part.cast("decimal(20,0)") * F.lit(1 << 22 * i).cast("decimal(15,0)") for i, part in enumerate(parts)]
    return reduce(lambda a, b: a + b, whole).cast("decimal(38,0)")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class IndexFolder:
    """``buckets`` and ``ranges`` (of documents in each bucket) are set by the first version written; later ones keep them."""

    spark: SparkSession
    path: str
    definition: IndexDefinition
    buckets: int | None = None
    ranges: int = 64

    # --- places ------------------------------------------------------------------------------

    def _table(self, name: str, version: int | None = None) -> str:
        base = f"{self.path.rstrip('/')}/{name}"
        return base if version is None else f"{base}/version={version}"

    def _folders(self, path: str) -> list[str]:
        """Names of the folders in a folder; none if it is not there."""
        paths = self.spark._jvm.org.apache.hadoop.fs
        root = paths.Path(path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()) if files.exists(root) else []

    def _of_table(self, name: str) -> list[int]:
        """The versions that a table has a folder of."""
        return sorted(int(f.removeprefix("version=")) for f in self._folders(self._table(name)) if f.startswith("version="))

    def versions(self) -> list[int]:
        """The versions whose documents have been written to the end."""
        paths = self.spark._jvm.org.apache.hadoop.fs
        files = paths.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [v for v in self._of_table("documents") if files.exists(paths.Path(self._table("documents", v), "_SUCCESS"))]

    def _catalog_name(self, name: str) -> str:
        return f"folioscan_{hashlib.md5(self.path.rstrip('/').encode()).hexdigest()[:16]}_{name}"

    def _layout(self) -> tuple[int, int] | None:
        """(buckets, ranges) of the index; None before the first version and for an index written without buckets."""
        for version in self.versions()[:1]:
            row = self._batch(version)
            if row is not None and "buckets" in row:
                return row["buckets"], row["ranges"]
            return None
        return None

    def _batch(self, version: int):
        try:
            return self.spark.read.parquet(self._table("batches", version)).first()
        except AnalysisException:  # written without one
            return None

    # --- writing -----------------------------------------------------------------------------

    def write(
        self, source: DataFrame, doc_id: str, version: int, seq: str | list[str] | None = None, batch_id: str | None = None, partitions: int | None = None
    ) -> bool:
        """Index a batch of source rows under a new version; with ``seq`` the last row of an id wins.

        Documents are written last: they are what makes a version visible. An attempt
        that failed half-way is overwritten by the next one for the same version. A
        version that is there already is refused, unless it is the same batch once more, by its
        ``batch_id`` or else by a hash of its rows; then, and for an empty batch, nothing is written and
        the answer is False. Ids must not be null, and without ``seq`` they must be
        unique. A column may be new, or a wider whole number than before; other changes
        of type are refused. ``partitions`` is the number of buckets, for the first version only; without it there
        are as many as the session's shuffles have partitions, or more for a large batch (``BUCKET_POSTINGS``).
        """
        with settings(self.spark, COMPILED):
            return self._write(source, doc_id, version, seq, batch_id, partitions)

    def _write(self, source: DataFrame, doc_id: str, version: int, seq: str | list[str] | None, batch_id: str | None, partitions: int | None) -> bool:
        id_ = F.lower(F.col(doc_id).cast("string"))
        # One pass over the source; what follows looks at ids, hashes and numbers of postings alone.
        about = [id_.alias("doc_id"), F.xxhash64(F.to_json(F.struct(*source.columns))).alias("hash"), self._posting_count(source, doc_id).alias("postings")]
        ids = written(source.select(*about), "ids")
        rows, null_ids, content, postings = ids.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), sum_of_hashes(F.col("hash")), F.sum("postings")).first()
        batch_id = batch_id or f"{rows} rows, {content}"
        if not rows or self._is_written(version, batch_id):
            return False
        if null_ids:
            raise ValueError(f"{null_ids} rows have a null id")
        if seq is None and (twice := ids.groupBy("doc_id").count().filter("count > 1").head()):
            raise ValueError(f"several rows of id {twice.doc_id!r}: give seq")
        if done := self.versions():
            merged_schema([*[self._schema("documents", v) for v in done], document_table(source, doc_id, self.definition).schema])
        batch, added = source, rows
        if seq is not None:
            # Written once, as both the fields and the documents are made from it.
            batch = written(latest(source.withColumn(doc_id, F.lower(F.col(doc_id).cast("string"))), doc_id, seq), "batch")
            added = batch.count()
        buckets, ranges = self._layout() or (partitions or self.buckets or self._buckets_for(postings), self.ranges)
        # Rows of the source are dealt to the buckets of their documents once, before fields and words are made of them: they
        # are fewer than their fields, and smaller than their postings.
        stored = self._write_fields(self._dealt(batch, doc_id, buckets), doc_id, version, buckets)
        with settings(self.spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
            # A task of the write reads a bucket; Spark would else cut the files as it likes.
            self._write_postings(field_postings(stored, self.definition), version, buckets, ranges, dealt=True)
        self._write_left(ids.select("doc_id"), version, buckets)
        self._write_terms(version, buckets)
        self._write_batch(version, batch_id, buckets, ranges, added)
        documents = document_table(batch, doc_id, self.definition)
        documents.write.mode("overwrite").option("compression", COMPRESSION).parquet(self._table("documents", version))
        self.write_sums(version)
        return True

    def delete(self, ids: DataFrame, doc_id: str, version: int, batch_id: str | None = None) -> bool:
        """Remove the live documents of some ids under a new version; a later version may write them again.

        Null, unknown and repeated ids are no matter. The same rules hold for a version that is there already. If no document
        is live under any of the ids, nothing is written and the answer is False.
        """
        wanted = ids.select(F.lower(F.col(doc_id).cast("string")).alias("doc_id")).filter(F.col("doc_id").isNotNull()).distinct()
        wanted = written(wanted, "ids")
        rows, content = wanted.agg(F.count("*"), sum_of_hashes(F.xxhash64("doc_id"))).first()
        batch_id = batch_id or f"{rows} deleted, {content}"
        if not rows or self._is_written(version, batch_id):
            return False
        layout = self._layout()
        if layout is None:
            raise ValueError("compact an index without buckets before deleting from it")
        self._write_left(wanted, version, layout[0])
        if not self._folders(self._table("left", version)):
            return False
        self._write_terms(version, layout[0])
        self._write_batch(version, batch_id, *layout, 0)
        schema = merged_schema([self._schema("documents", v) for v in self.versions()])
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self._table("documents", version))
        self.write_sums(version)
        return True

    def _is_written(self, version: int, batch_id: str) -> bool:
        done = self.versions()
        if version in done:
            row = self._batch(version)
            if row is not None and row["batch_id"] == batch_id:
                return True
            raise ValueError(f"version {version} is already written")
        if done and version < done[-1]:
            raise ValueError(f"version {version} is older than version {done[-1]}")
        return False

    def _write_batch(self, version: int, batch_id: str, buckets: int, ranges: int, added: int) -> None:
        """What a version is, and by how much it changes the number of live documents."""
        taken = [self._left(was, [version], buckets) for was in self._left_of([version])]
        gained = added - (union_all(taken).count() if taken else 0)
        row = [F.lit(batch_id).alias("batch_id"), F.lit(buckets).alias("buckets"), F.lit(ranges).alias("ranges"), F.lit(gained).cast("bigint").alias("gained")]
        self.spark.range(1).select(*row).write.mode("overwrite").parquet(self._table("batches", version))

    def _shuffle_partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _posting_count(self, source: DataFrame, doc_id: str) -> Column:
        """About how many postings a row of the source makes, one at least for each field."""

        def count(rule: FieldRule) -> Column:
            value = F.col(f"`{rule.column}`")
            items = items_of(rule, value) if rule.depth else F.array(value)
            if rule.mode in ("none", *analysis.WHOLE_VALUE):
                return F.greatest(F.size(items), F.lit(1)).cast("double") if rule.depth else F.lit(1.0)
            words = F.transform(items, lambda x: F.octet_length(source_term(rule, x)) / WORD_BYTES + 1)
            return F.coalesce(F.aggregate(words, F.lit(0.0), lambda total, x: total + x), F.lit(1.0))

        return reduce(lambda a, b: a + b, [F.lit(0.0), *[count(r) for r in field_rules(source, self.definition, skip=(doc_id,))]])

    def _buckets_for(self, postings: float | None) -> int:
        """Buckets for a first version: no fewer than shuffles have partitions, and enough that each can be sorted in memory."""
        return max(self._shuffle_partitions(), ceil((postings or 0) / BUCKET_POSTINGS))

    @staticmethod
    def _dealt(batch: DataFrame, doc_id: str, buckets: int) -> DataFrame:
        """Rows of the source in the buckets of their documents."""
        return batch.repartition(buckets, document_id(F.col(doc_id)))

    def _write_fields(self, dealt: DataFrame, doc_id: str, version: int, buckets: int) -> DataFrame:
        """Write the fields of dealt rows as they come, a file for each field and bucket, and read them back by bucket."""
        writer = field_rows(dealt, doc_id, self.definition).write.mode("overwrite").format("parquet").partitionBy("field").bucketBy(buckets, "doc_id")
        writer = writer.options(compression=COMPRESSION, **{"parquet.block.size": FIELD_BLOCK}).option("path", self._table("fields", version))
        with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
            writer.saveAsTable(self._catalog_name(f"fields_{version}"))
        return self.spark.table(self._catalog_name(f"fields_{version}"))

    def _save(self, rows: DataFrame, name: str, version: int, buckets: int, partition: str, order: list[str], dealt: bool = False) -> None:
        """Write rows in buckets of documents, each sorted; ``dealt`` rows lie by bucket already. The write itself asks Spark for the sort."""
        writer = (rows if dealt else rows.repartition(buckets, "doc_id")).write.mode("overwrite").format("parquet").partitionBy(partition)
        writer = writer.bucketBy(buckets, "doc_id").sortBy(*order).options(compression=COMPRESSION, path=self._table(name, version))
        writer.saveAsTable(self._catalog_name(f"{name}_{version}"))

    def _write_postings(self, postings: DataFrame, version: int, buckets: int, ranges: int, dealt: bool = False) -> None:
        # The bucket that the write chooses, and a range of its documents.
        bucket = F.pmod(F.hash("doc_id"), F.lit(buckets))
        rng = bucket * ranges + F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")
        self._save(postings.withColumn("rng", rng), "postings", version, buckets, "field", POSTING_ORDER, dealt)

    def _write_left(self, ids: DataFrame, version: int, buckets: int) -> None:
        """Write down which live documents of earlier versions have these ids, and the version of each."""
        if not self.versions():
            return
        live = self._live("documents", None).select("doc_id", F.col("version").alias("was"))
        self._save(live.join(ids, "doc_id", "left_semi"), "left", version, buckets, "was", ["doc_id"])

    def _frequencies(self, version: int, buckets: int) -> DataFrame:
        """How often each document of a version has each term; counted within buckets."""
        return self._bucketed_postings(version, buckets).groupBy("field", "term", "rng", "doc_id").agg(F.count("*").alias("tf"))

    def term_bounds(self, version: int, buckets: int) -> DataFrame:
        """(field, term, rng, most, docs, total): the greatest frequency of a term in a range of documents, its documents and occurrences there."""
        counts = [F.max("tf").alias("most"), F.count("*").alias("docs"), F.sum("tf").alias("total")]
        found, keys = self._frequencies(version, buckets), ["field", "term", "rng"]
        if buckets > self._shuffle_partitions():
            # Too much for the session's number of partitions; a range has too few documents for a hot key.
            found = found.select(*keys, "tf").repartition(buckets, *keys)
        return found.groupBy(*keys).agg(*counts)

    def term_changes(self, version: int, buckets: int, bounds: DataFrame | None = None) -> DataFrame:
        """(field, term, doc_freq, total_freq): what a version adds to the dictionary, less what it takes from it.

        What it adds is counted from its postings, or added up from the ``bounds`` of the version, if given.
        """
        signed = []
        if bounds is not None:
            signed.append(bounds.select("field", "term", F.col("docs").alias("doc_freq"), F.col("total").alias("total_freq")))
        elif version in self._of_table("postings"):
            added = self._frequencies(version, buckets)
            signed.append(added.select("field", "term", F.lit(1).cast("bigint").alias("doc_freq"), F.col("tf").alias("total_freq")))
        for was in self._left_of([version]):
            # The ids of a bucket are looked up; a merge would sort all postings of the earlier version.
            gone = self._bucketed_postings(was, buckets).join(self._left(was, [version], buckets).hint("shuffle_hash"), "doc_id", "left_semi")
            taken = gone.groupBy("field", "term", "rng", "doc_id").agg(F.count("*").alias("tf"))
            signed.append(taken.select("field", "term", F.lit(-1).cast("bigint").alias("doc_freq"), (-F.col("tf")).alias("total_freq")))
        stats = union_all(signed).groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_freq").alias("total_freq"))
        return stats.filter("doc_freq != 0 or total_freq != 0")

    def _write_terms(self, version: int, buckets: int) -> None:
        """Bounds from the postings, in one pass over them, and the dictionary from the bounds."""
        bounds = None
        if version in self._of_table("postings"):
            self._write_by_field(self.term_bounds(version, buckets), "bounds", version, ["term", "rng"])
            bounds = self.spark.read.schema(self._stored_schema("bounds")).parquet(self._table("bounds")).filter(F.col("version") == version)
        self._write_by_field(self.term_changes(version, buckets, bounds), "terms", version, ["term"])

    def _write_by_field(self, rows: DataFrame, name: str, version: int, order: list[str]) -> None:
        """Write counts as their grouping has dealt them."""
        ordered = rows.sortWithinPartitions("field", *order)
        ordered.write.mode("overwrite").option("compression", COMPRESSION).partitionBy("field").parquet(self._table(name, version))

    def content_sums(self, name: str, versions: list[int]) -> DataFrame:
        """(version, name, field, rows, content) of stored rows, in any order of them: a sum of hashes for each version and field."""
        if name == "documents":
            # Each version has columns of its own.
            return union_all([self._sums(self.spark.read.parquet(self._table(name, v)).withColumns({"version": F.lit(v), "field": F.lit("")}), name) for v in versions])
        rows = self.spark.read.schema(self._stored_schema(name)).parquet(self._table(name))
        return self._sums(rows.filter(F.col("version").isin(*versions)), name)

    def _sums(self, rows: DataFrame, name: str) -> DataFrame:
        columns = sorted(c for c in rows.columns if c != "version")
        sums = [F.count("*").alias("rows"), sum_of_hashes(F.xxhash64(*columns)).alias("content")]
        return rows.groupBy("version", F.lit(name).alias("name"), "field").agg(*sums)

    def _stored_schema(self, name: str) -> T.StructType:
        """Columns of a table whose fields lie in folders; the type of a field's name is not for Spark to guess."""
        known = {"fields": FIELD_SCHEMA, "postings": POSTING_SCHEMA, "terms": TERM_SCHEMA, "bounds": BOUND_SCHEMA}[name]
        schema = known if isinstance(known, T.StructType) else T.StructType.fromDDL(known)
        return schema if "version" in schema.names else T.StructType([*schema, T.StructField("version", T.IntegerType())])

    def write_sums(self, version: int) -> None:
        """Keep the content sums of a version beside it, for ``index_check``; documents' columns are summed as they are stored."""
        sums = [self.content_sums(name, [version]) for name in SUMMED if version in self._of_table(name)]
        union_all(sums).drop("version").coalesce(1).write.mode("overwrite").parquet(self._table("sums", version))

    # --- reading -----------------------------------------------------------------------------

    def _schema(self, name: str, version: int) -> T.StructType:
        schema = self.spark.read.parquet(self._table(name, version)).schema
        return T.StructType([T.StructField("field", T.StringType()) if f.name == "field" and name != "documents" else f for f in schema])

    def _registered(self, name: str, path: str, columns: str, partitions: str, buckets: int, again: bool = False) -> DataFrame:
        """A bucketed table by way of the catalog; ``again`` looks for new folders."""
        table = self._catalog_name(name)
        known = self.spark.catalog.tableExists(table)
        if not known:
            quoted = path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({partitions}) CLUSTERED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{quoted}'")
        if again or not known:
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return self.spark.table(table)

    def _bucketed_postings(self, version: int, buckets: int) -> DataFrame:
        return self._registered(f"postings_{version}", self._table("postings", version), POSTING_SCHEMA, "field", buckets)

    def _left_of(self, by: list[int]) -> dict[int, list[int]]:
        """version -> the versions, among some, that took the place of documents of it."""
        out: dict[int, list[int]] = {}
        for version in by:
            for folder in self._folders(self._table("left", version)):
                if folder.startswith("was="):
                    out.setdefault(int(folder.removeprefix("was=")), []).append(version)
        return out

    def _left(self, was: int, by: list[int], buckets: int) -> DataFrame:
        """Ids of documents of a version that some later versions replaced or removed."""
        rows = self._registered("left", self._table("left"), "doc_id string, version int, was int", "version, was", buckets, again=True)
        return rows.filter((F.col("was") == was) & F.col("version").isin(*by)).select("doc_id")

    def _live(self, name: str, version: int | None) -> DataFrame:
        """The live rows of a table; filters on them reach the scan.

        Versions from which nothing was taken are read as they are. For the others, dead documents are left out: postings
        version by version, bucket to bucket, other tables by a join on document and version.
        """
        done = [v for v in self.versions() if version is None or v <= version]
        there = set(self._of_table(name))
        seen = [v for v in done if v in there]
        # The columns of all versions; a version without one of them reads as nulls.
        known = merged_schema([self._schema(name, v) for v in seen])
        rows = self.spark.read.schema(T.StructType([*known, T.StructField("version", T.IntegerType())])).parquet(self._table(name)).filter(F.col("version").isin(*seen))
        if len(done) < 2:
            return rows
        layout = self._layout()
        if layout is None:
            return self._live_without_buckets(rows, seen)
        buckets = layout[0]
        taken = {was: by for was, by in self._left_of(done).items() if was in seen}
        if not taken:
            return rows
        if name == "postings":
            parts = [self._bucketed_postings(w, buckets).withColumn("version", F.lit(w)).join(self._left(w, by, buckets), "doc_id", "left_anti") for w, by in taken.items()]
            clean = [v for v in seen if v not in taken]
            return union_all([rows.filter(F.col("version").isin(*clean)), *parts] if clean else parts).select(*rows.columns)
        gone = union_all([self._left(w, by, buckets).withColumn("was", F.lit(w)) for w, by in taken.items()]).withColumnRenamed("doc_id", "_id")
        return rows.join(gone, (rows["doc_id"] == gone["_id"]) & (rows["version"] == gone["was"]), "left_anti")

    def _live_without_buckets(self, rows: DataFrame, seen: list[int]) -> DataFrame:
        """Of an index written before versions told what they replace: a row is live unless a later version holds its document."""
        log = self.spark.read.parquet(self._table("documents"))
        later = log.filter(F.col("version").isin(*seen[1:])).groupBy(F.col("doc_id").alias("_id"))
        newest = later.agg(F.max("version").alias("_newest"))
        return rows.join(newest, (rows["doc_id"] == newest["_id"]) & (rows["version"] < newest["_newest"]), "left_anti")

    def documents(self, version: int | None = None) -> DataFrame:
        """Current documents, or those of an earlier version."""
        return self._live("documents", version)

    def document_count(self, version: int | None = None) -> int:
        """How many documents are live, from what the versions say; no document is read."""
        seen = [v for v in self.versions() if version is None or v <= version]
        if self._layout() is None:
            return self.documents(version).count() if seen else 0
        told = self.spark.read.schema("gained bigint, version int").parquet(self._table("batches")).filter(F.col("version").isin(*seen))
        return told.agg(F.sum("gained")).first()[0]

    def fields(self, version: int | None = None) -> DataFrame:
        return self._live("fields", version)

    def postings(self, field: str | None = None, version: int | None = None) -> DataFrame:
        """Postings of live documents; naming the field prunes the scan to its folder."""
        rows = self._live("postings", version)
        return rows if field is None else rows.filter(F.col("field") == field)

    def terms(self, field: str | None = None, version: int | None = None) -> DataFrame:
        """The dictionary of the live documents: (field, term, doc_freq, total_freq)."""
        seen = [v for v in self.versions() if version is None or v <= version]
        rows = self.spark.read.schema(TERM_SCHEMA).parquet(self._table("terms")).filter(F.col("version").isin(*seen))
        rows = rows if field is None else rows.filter(F.col("field") == field)
        counts = rows.groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_freq").alias("total_freq"))
        return counts.filter("doc_freq > 0")

    def replaced(self, after: int) -> DataFrame | None:
        """(doc_id, was): documents that versions after one took the place of or removed; None if there are none."""
        taken = self._left_of([v for v in self.versions() if v > after])
        if not taken:
            return None
        buckets = self._layout()[0]
        return union_all([self._left(w, by, buckets).withColumn("was", F.lit(w)) for w, by in taken.items()])

    def bounds(self, field: str) -> DataFrame:
        """(term, rng, most): no document of the range has the term more often. Replaced documents may have had it as often."""
        rows = self.spark.read.schema(BOUND_SCHEMA).parquet(self._table("bounds"))
        return rows.filter(F.col("version").isin(*self.versions()) & (F.col("field") == field)).groupBy("term", "rng").agg(F.max("most").alias("most"))

    def _live_by_bucket(self, buckets: int) -> DataFrame:
        """Live postings of all versions read and sifted by bucket, so that a task has all of a bucket."""
        done = self.versions()
        rows = self._registered("postings", self._table("postings"), f"{POSTING_SCHEMA}, version int", "version, field", buckets, again=True)
        rows = rows.filter(F.col("version").isin(*done))
        if self._left_of(done):
            gone = self._registered("left", self._table("left"), "doc_id string, version int, was int", "version, was", buckets, again=True)
            gone = gone.filter(F.col("version").isin(*done)).select(F.col("doc_id").alias("_id"), "was").hint("shuffle_hash")
            # An equality of versions would be a second key, for which Spark deals both sides anew.
            rows = rows.join(gone, (rows["doc_id"] == gone["_id"]) & (rows["version"] - gone["was"] == 0), "left_anti")
        return rows.drop("version")

    def compact(self, path: str, version: int = 0) -> IndexFolder:
        """Rewrite the live rows of all versions as the first version of another folder."""
        target = IndexFolder(self.spark, path, self.definition, self.buckets, self.ranges)
        buckets = self.buckets or (self._layout() or (int(self.spark.conf.get("spark.sql.shuffle.partitions")), 0))[0]
        # Rows are written as they are read, without a shuffle: a task reads as many small files as make a large one.
        fields = self.fields().drop("version")
        with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
            fields.write.mode("overwrite").option("compression", COMPRESSION).partitionBy("field").parquet(target._table("fields", version))
        with settings(self.spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}):
            dealt = (self._layout() or (0, 0))[0] == buckets
            postings = self._live_by_bucket(buckets) if dealt else self.postings().drop("version")
            target._write_postings(postings, version, buckets, self.ranges, dealt)
        target._write_terms(version, buckets)
        target._write_batch(version, "compacted", buckets, self.ranges, self.document_count())
        self.documents().drop("version").write.mode("overwrite").option("compression", COMPRESSION).parquet(target._table("documents", version))
        target.write_sums(version)
        return target
