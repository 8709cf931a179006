import random
import re

from pyspark.sql import functions as F

from folioscan.llm.queries import RULES
from folioscan.llm.url_rules import build_cascade, judge_urls, listed_in

SCHEMA = "page_id long, url string, host string, keys string, key string"


def brute(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def judged(table, urls, rules):
    found = judge_urls(table([(i, u, "x", "y", "z") for i, u in enumerate(urls)], SCHEMA), rules)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(tuple(r) for r in found.collect())


def test_rules_against_brute_force(table):
    rng = random.Random(8)
    names, paths = ["example", "net", "com", "org", "a", "b", "EN"], ["/", "/en/", "/en", "/de/x", "", "/fr/", "/fr/é?x=/", "#/en/", "/en/://"]
    urls = ["http://" + ".".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + rng.choice(paths) for _ in range(400)]
    urls += [None, "", "net/", "://", "://net", "://net/", "HTTP://EXAMPLE.NET/en/", "http://xnet/", "http://.net/", "a://net?x://org/fr/", "x" * 50_000, "http://" + "a." * 20_000 + "net/en/"] + urls[:20]
    for rules in (RULES, [("block", "net", "/"), ("allow", "net", "/e"), ("allow", "b.net", ""), ("block", "a.b", "/en/")], [("allow", "com", "")], []):
        assert judged(table, urls, rules) == [(i, *brute(u, rules)) for i, u in enumerate(urls)]
    assert judged(table, [], RULES) == []


def test_null_ids_and_clashing_columns(table):
    rows = judge_urls(table([(None, "http://a.net/x", "", "", "")] * 2, SCHEMA), RULES).collect()
    assert [tuple(r) for r in rows] == [(None, "a.net", "/x", "net/", "block")] * 2


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key-"), "id").alias("key"))
    listed = universe.filter("hash(key) % 10 = 0").unionByName(spark.range(50).select(F.concat(F.lit("other-"), "id").alias("key")))
    levels = build_cascade(listed, universe, 20_000)
    assert len(levels) > 2 and sum(level.bits for level in levels) < 20_000 * 3
    wrong = universe.filter(listed_in(F.col("key"), levels) != F.expr("hash(key) % 10 = 0")).count()
    assert wrong == 0 and listed.filter(~listed_in(F.col("key"), levels)).count() == 0


def test_no_python_in_the_plan(spark, plan):
    text = plan(judge_urls(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), RULES))
    assert "Python" not in text and "Join" not in text
