from folioscan import IndexDefinition
from folioscan.operators.index_store import IndexFolder


def test_rows_are_made_by_code_that_java_compiles(spark, tmp_path, monkeypatch):
    """One method for all fields of a row is too large to be compiled; the session's own limit is put back."""
    limit, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, write_fields = spark.conf.get(limit), IndexFolder._write_fields

    def write(self, *args):
        seen.append(int(spark.conf.get(limit)))
        return write_fields(self, *args)

    monkeypatch.setattr(IndexFolder, "_write_fields", write)
    index = IndexFolder(spark, f"{tmp_path}/index", IndexDefinition("Odd"))
    rows = spark.createDataFrame([("A", "x y", None), ("b", "", 3)], "id string, t string, n int")
    assert index.write(rows, "id", 1, partitions=2)
    assert seen == [8000] and spark.conf.get(limit) == before
    found = {(r.doc_id, r.field, r.term) for r in index.postings().collect()}
    assert found == {("a", "t", "x y"), ("a", "n", "NULL_VALUE"), ("b", "t", "EMPTY_STRING"), ("b", "n", "3")}
