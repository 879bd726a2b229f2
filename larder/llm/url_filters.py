"""URL filters: glob rules packed into one bit-parallel automaton.

Every rule becomes glob patterns over a canonical address (host in lower case, then the path). The
positions of all patterns lie side by side in the bits of a few 64-bit words; one shift and a few
masks advance every pattern by one byte, for a whole column of addresses at once (Shift-And with
self-loops for wildcards).

Globs: `?` is any one byte, `*` any run without `/`, `**` any run. A pattern fits a whole address.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Allow or block a host, all its subdomains, and the paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, ...]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


class Glob(NamedTuple):
    """A bare pattern; counts only where no Rule fits."""

    verdict: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    @property
    def globs(self) -> tuple[str, ...]:
        return (self.pattern,)


def _tokens(pattern: str) -> Iterator[str | int]:
    """Literal bytes as numbers, wildcards as `?`, `*` and `**`."""
    raw, at = pattern.encode(), 0
    while at < len(raw):
        if raw[at : at + 2] == b"**":
            yield "**"
            at += 2
        else:
            yield {42: "*", 63: "?"}.get(raw[at], raw[at])
            at += 1


@dataclass
class Automaton:
    """step[c]: bits that byte c may move into; loop[c]: bits that byte c may stay in."""

    step: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    ends: list[int]

    @classmethod
    def of(cls, patterns: Sequence[str]) -> Automaton:
        parsed = [list(_tokens(p)) for p in patterns]
        size = sum(1 + sum(t not in ("*", "**") for t in tokens) for tokens in parsed)
        words = max(1, -(-size // 64))
        step, loop = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        start, ends, bit = np.zeros(words, np.uint64), [], 0
        for tokens in parsed:
            start[bit // 64] |= np.uint64(1 << bit % 64)
            for token in tokens:
                if token in ("*", "**"):  # the state reached so far stays alive
                    keep = np.ones(256, bool)
                    keep[ord("/")] = token == "**"
                    loop[keep, bit // 64] |= np.uint64(1 << bit % 64)
                    continue
                bit += 1
                rows = slice(None) if token == "?" else token
                step[rows, bit // 64] |= np.uint64(1 << bit % 64)
            ends.append(bit)
            bit += 1
        return cls(step, loop, start, ends)

    def fits(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row per text, a column per pattern: whether the pattern fits the whole text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")  # long ones first: those still running are a prefix
        buffer = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        running = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at, n in enumerate(running):
            now, c = state[:n], buffer[begins[:n] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.step[c]) | (now & self.loop[c])
        found = np.empty((len(texts), len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return found


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], globs: Sequence[Glob] = (), url: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    The longest fitting Rule decides. Where none fits, the longest fitting Glob gives the verdict and
    rule is null; else `otherwise`. Rows are neither dropped nor moved, so nothing is shuffled.

    Null urls and those without `://` have an empty host and path, and fit no Rule. Input columns
    named like an added one are replaced. An empty table gives an empty result.
    """
    ranked = sorted(globs, key=lambda r: (len(r.name), r.name)) + sorted(rules, key=lambda r: (len(r.name), r.name))
    patterns = [(p, k) for k, rule in enumerate(ranked) for p in rule.globs]
    machine, rank = Automaton.of([p for p, _ in patterns]), np.array([k for _, k in patterns], np.int32)

    @F.pandas_udf("int")
    def winner(addresses: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in addresses:
            if not rank.size or not len(series):
                yield pd.Series(np.full(len(series), -1, np.int32))
                continue
            fits = machine.fits([s.encode() for s in series])
            yield pd.Series(np.where(fits, rank, -1).max(axis=1).astype(np.int32))

    verdicts = F.array(*[F.lit(r.verdict) for r in ranked]) if ranked else F.array(F.lit(otherwise))
    names = F.array(*[F.lit(r.name if isinstance(r, Rule) else None).cast("string") for r in ranked]) if ranked else F.array(F.lit(None).cast("string"))
    address, won = "__address", "__won"
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*[pages[c] for c in kept], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    judged = judged.withColumn(address, F.concat("host", "path")).withColumn(won, winner(address))
    fitted = F.when(F.col(won) >= 0, F.col(won) + 1)
    return judged.select(
        *kept,
        "host",
        "path",
        F.try_element_at(names, fitted).alias("rule"),
        F.coalesce(F.try_element_at(verdicts, fitted), F.lit(otherwise)).alias("verdict"),
    )


#: The rules of the registered query, and patterns for addresses that none of them fits.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
GLOBS = [Glob("block", "*casino*/**"), Glob("block", "*casino*")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, GLOBS).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filters": op1_url_filters}

SQL = {
    "op1_url_filters": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), part AS (
  SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), listed AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(verdict, domain, prefix)
)
SELECT p.page_id, p.host, p.path, arg_max(l.domain || l.prefix, length(l.domain || l.prefix)) AS rule,
       coalesce(arg_max(l.verdict, length(l.domain || l.prefix)), CASE WHEN contains(p.host, 'casino') THEN 'block' ELSE 'allow' END) AS verdict
FROM part p LEFT JOIN listed l
  ON (p.host = l.domain OR ends_with(p.host, '.' || l.domain)) AND starts_with(p.path, l.prefix)
GROUP BY p.page_id, p.host, p.path
"""
}
