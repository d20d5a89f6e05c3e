"""URL filters: a trie over reversed host labels and path segments.

Rules are a list handed in by the caller, so the trie is bounded by that list; it travels to the executors with the
function that walks it. A walk goes down the host labels from the top domain and, at every label, down the path
segments; the deepest rule met wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # verdict, host, path
#: Rules of the check, as (verdict, host, path).
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Trie:
    """Nodes are dicts. A host node holds child labels and, under "/", its path node; a path node holds child
    segments, and under None the rules that end inside a segment, as (start of that segment, rule)."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, part = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            # of equal rules the block wins
            ends = node.setdefault(None, {})
            if part not in ends or verdict == "block":
                ends[part] = (verdict, f"{host}{path}")

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits: longest host first, then longest path."""
        if not host:
            return None
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            best = self._under(node.get("/"), segments) or best
        return best

    @staticmethod
    def _under(node: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node is None:
                return best
            fits = [p for p in node.get(None, ()) if segment.startswith(p)]
            if fits:
                best = node[None][max(fits, key=len)]
            node = node.get(segment)
        return best


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_homepages(coins: DataFrame, rules: list[Rule], key: str = "coin_id", url: str = "homepage", default: str = "allow") -> DataFrame:
    """`<key>`, host, path, rule, verdict of every coin's homepage.

    A rule fits its host and all subdomains of it if the path starts with the rule's path; the longest host, then the
    longest path, wins, and `block` wins between equal rules. Without a rule `rule` is null and the verdict `default`.
    A null address, or one without `://`, has an empty host and path and fits no rule. Repeated rows are judged each by itself;
    other columns are ignored.
    """
    trie = Trie(rules)

    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"verdict": [f[0] if f else default for f in found], "rule": [f[1] if f else None for f in found]})

    judged = F.pandas_udf(walk, "verdict string, rule string")
    parts = coins.select(F.col(f"`{key}`").alias("id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    return parts.withColumn("found", judged("host", "path")).select(F.col("id").alias(key), "host", "path", "found.rule", "found.verdict")
