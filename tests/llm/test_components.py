import random

import pandas as pd

from folioscan.llm import components as module
from folioscan.llm import ngram_join
from folioscan.session import gathered


def slow_roots(links):
    least = {n: n for link in links for n in link}

    def find(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        least[y] = x
    return {n: find(n) for n in least if find(n) != n}


def roots(spark, links, parts):
    rows = spark.createDataFrame(links, "a string, b string").repartition(parts)
    return [tuple(r) for r in module.components(rows, "a", "b").collect()]


def named(numbers):
    return [(f"{a:05d}", f"{b:05d}") for a, b in numbers]


def test_paths_trees_and_repeats_in_many_tasks(spark):
    draw = random.Random(3)
    order = draw.sample(range(300), 300)
    links = named([*zip(order[:150], order[1:150], strict=False), *[(order[i], order[draw.randrange(150, i)]) for i in range(151, 260)], (order[0], order[0])])
    links += [(b, a) for a, b in links[:40]]
    found = roots(spark, links, 7)
    assert len(found) == len(set(found)) == len(dict(found))
    assert dict(found) == slow_roots(links)


def test_links_of_a_task_become_stars():
    draw = random.Random(4)
    links = named([(draw.randrange(400), draw.randrange(400)) for _ in range(350)])
    out = module._star_links(pd.DataFrame(links, columns=["u", "v"]))
    assert dict(zip(out["u"], out["v"], strict=True)) == slow_roots(links)
    numbers = module._star_links(pd.DataFrame({"u": [5, -2, 9], "v": [-7, 5, 9]}))
    assert numbers.to_numpy().tolist() == [[-2, -7], [5, -7]]


def test_stars_take_no_round_and_no_links_none(spark, monkeypatch):
    """A round shuffles the links six times; it was also made to see that nothing changes."""

    def no_round(*_):
        raise AssertionError("a round over links that are stars")

    monkeypatch.setattr(module, "_to_least", no_round)
    assert sorted(roots(spark, named([(i, 0) for i in range(1, 20)]), 1)) == named([(i, 0) for i in range(1, 20)])
    assert roots(spark, [], 3) == []


def test_texts_without_pairs_cut_no_sets(spark, monkeypatch):
    """Without pairs to count no text is read again, and small outcomes are not spread over all partitions."""
    labels, written = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, label: labels.append(label) or written(df, label))
    rows = spark.createDataFrame([(i, f"only text number {i} of {i} by {i * i}") for i in range(30)], "doc_id long, text string")
    assert sorted(r[2] for r in ngram_join.linked_documents(rows).collect()) == list(range(30))
    assert "ngram-segments" not in labels and "ngram-nodes" not in labels


def test_gathered_keeps_the_cores_and_grows_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(cores + 40)
    assert gathered(wide, 100).rdd.getNumPartitions() == cores
    assert gathered(wide, 250_000 * (cores + 5)).rdd.getNumPartitions() == cores + 5
