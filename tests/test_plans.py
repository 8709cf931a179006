"""What the plans of the registered queries hold, and do not hold."""

import re

import pytest

from folioscan.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas", "FlatMapGroups")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_and_no_python(spark, plan, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not [node for node in UNWANTED if node in text]


def test_only_needed_columns_are_read(spark, plan):
    text = plan(QUERIES["q_nested"](spark, FOLDER))
    [columns] = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert {c.split(":")[0] for c in columns.split(",")} == {"event_id", "ts", "event_type", "props"}
    assert "Not(EqualTo(event_type,signup))" in text


@pytest.mark.parametrize(
    ("name", "most"),
    [("q_nested", 0), ("topk_sorted", 0), ("fields_fanout", 1), ("q_phrase_words", 1), ("term_stats", 2), ("upsert_last_wins", 3)],
)
def test_shuffles(spark, plan, name, most):
    """One exchange may be the spreading of a small input; an upsert groups the table, the batch and the batch's keys."""
    text = plan(QUERIES[name](spark, FOLDER))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) <= most


@pytest.mark.parametrize("name", ["topk_score", "filter_arg", "sort_with_scores"])
def test_rarity_comes_from_the_dictionary(spark, plan, name):
    """Documents are read for hits only: terms are looked up in the dictionary, and the number of documents needs no column."""
    text = plan(QUERIES[name](spark, FOLDER))
    scans = re.findall(r"Location: InMemoryFileIndex \[[^\]]*/(\w+)\].*?ReadSchema: struct<([^>]*)>", text, re.S)
    assert {folder for folder, _ in scans} == {"documents", "terms"}
    assert all("doc_freq" in columns for folder, columns in scans if folder == "terms")
    assert "PushedFilters: [In(term, [42,7,error,purchase])]" in text and "events.parquet" not in text
    wide = [columns for folder, columns in scans if folder == "documents" and columns]
    assert len(wide) == (1 if name != "sort_with_scores" else 2)
