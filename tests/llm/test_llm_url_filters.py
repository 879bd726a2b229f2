import random
import re

from pyspark.sql import functions as F

from larder.llm.url_filters import GLOBS, RULES, Automaton, Glob, Rule, judge_urls

URLS = [
    None, "", "no-scheme.com/x", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/1?a=/b", "http://www.example.com/en/",
    "http://sub.WWW.example.com/en/x#y", "x://a.net/es/", "x://net/fr/q", "x://a.net/es", "x://notcom/", "http://a.org/b.com/", "http://a.com?x",
    "http://casino.org", "http://a.b.casino-win.org/p/q", "http://ÄX.com/ü", "a://b.com/://c", "http://a.com/" + "x" * 5000, "http://a.net\n/es/",
]


def brute(url):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else "block" if "casino" in host else "allow"


def test_rules_on_odd_urls(spark):
    rows = [(n, u, "mine") for n, u in enumerate([*URLS, *URLS])]
    pages = spark.createDataFrame(rows, "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES, GLOBS).collect()}
    assert got == {n: brute(u) for n, u, _ in rows}


def test_empty_table_and_no_rules(spark):
    assert judge_urls(spark.createDataFrame([], "page_id int, url string"), RULES).collect() == []
    one = judge_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id int, url string"), []).first()
    assert (one.rule, one.verdict) == (None, "allow")


def test_automaton_equals_regular_expressions():
    rnd = random.Random(4)
    patterns = ["".join(rnd.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(rnd.randint(0, 6))).replace("***", "**") for _ in range(150)]
    machine = Automaton.of(patterns)
    assert len(machine.start) > 1  # several words
    texts = [bytes(rnd.choice(b"ab/") for _ in range(rnd.randint(0, 8))) for _ in range(200)]
    kinds = {"**": b"[^~]*", "*": b"[^/]*", "?": b"."}
    compiled = [re.compile(b"".join(kinds.get(t, t.encode()) for t in re.findall(r"\*\*|.", p)), re.S) for p in patterns]
    fits = machine.fits(texts)
    assert all(fits[i, j] == bool(c.fullmatch(t)) for i, t in enumerate(texts) for j, c in enumerate(compiled))


def test_nothing_is_shuffled(spark):
    pages = spark.range(10).select(F.col("id").alias("page_id"), F.lit("http://a.com/").alias("url"))
    plan = judge_urls(pages, [Rule("block", "com", "/")], [Glob("allow", "**")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
