"""A sorted search that is asked again and again while an index grows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.index_store import IndexFolder
from folioscan.session import written


@dataclass
class IndexPoll:
    """The first ``size`` hits by ``order``, kept from poll to poll and merged with what new versions bring.

    ``order`` lists columns of the documents, ascending with nulls first or, after a minus sign, descending with nulls last; ties
    go to the lesser id. A poll reads the documents of new versions only. Kept hits that were replaced or deleted go; if fewer
    rows are left before the place where the last kept hit stood, older documents may move up, and the index is searched whole.
    """

    index: IndexFolder
    clause: Column
    order: list[str]
    size: int = 50
    columns: list[str] = field(default_factory=list)
    version: int | None = None
    kept: DataFrame | None = None
    searches: int = 0

    def _sorted(self, hits: DataFrame) -> DataFrame:
        keys = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in self.order]
        return hits.orderBy(*keys, "doc_id")

    def _hits(self, documents: DataFrame) -> DataFrame:
        ordered_by = [c.removeprefix("-") for c in self.order]
        return documents.filter(self.clause).select("doc_id", *dict.fromkeys([*ordered_by, *self.columns]), "version")

    def _search(self) -> DataFrame:
        self.searches += 1
        return self._sorted(self._hits(self.index.documents(self.version))).limit(self.size)

    def _merged(self, before: int) -> DataFrame | None:
        """Kept and new hits in order, or None if hits that are not kept may stand among them."""
        new = self._hits(self.index.documents(self.version).filter(F.col("version") > before))
        replaced = self.index.replaced(before)
        alive = self.kept.withColumn("_gone", F.lit(False))
        if replaced is not None:
            lost = self.kept.join(replaced, (self.kept["doc_id"] == replaced["doc_id"]) & (self.kept["version"] == replaced["was"]), "left_semi")
            gone = lost.select("doc_id", F.lit(True).alias("_lost"))
            alive = self.kept.join(F.broadcast(gone), "doc_id", "left").select(*self.kept.columns, F.coalesce("_lost", F.lit(False)).alias("_gone"))
        # Lost hits stay in line to show where they stood; at most ``size`` of them.
        line = written(self._sorted(alive.unionByName(new.withColumn("_gone", F.lit(False)))).limit(2 * self.size), "poll-line")
        rows = self._sorted(line).select("doc_id", "version", "_gone").collect()
        was_full, lost = self.kept.count() == self.size, any(r["_gone"] for r in rows)
        if was_full and lost:
            last = self._sorted(self.kept).tail(1)[0]
            ahead = 0
            for r in rows:
                if (r["doc_id"], r["version"]) == (last["doc_id"], last["version"]):
                    ahead += not r["_gone"]
                    break
                ahead += not r["_gone"]
            if ahead < self.size:
                return None
        return self._sorted(line.filter(~F.col("_gone")).drop("_gone")).limit(self.size)

    def poll(self) -> DataFrame:
        """The hits now, in order: (doc_id, the columns ordered by, further ``columns``)."""
        versions = self.index.versions()
        if versions and self.version != versions[-1]:
            before, self.version = self.version, versions[-1]
            merged = None if self.kept is None else self._merged(before)
            self.kept = written(self._search() if merged is None else merged, "poll")
        if self.kept is None:
            raise ValueError("the index has no version yet")
        return self._sorted(self.kept).drop("version")
