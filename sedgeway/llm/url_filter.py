"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule names a host and a path prefix. It fits its host and every subdomain if the URL's path starts
with the rule's. Of the rules that fit, the one with the most host labels, then the longest path, wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path, and no rule fits it.
Ports and user names are part of the host text, as written. Repeated rows are judged alike; an empty table
gives no rows. Equal rules with both actions: block wins. Input columns pass through; ``host``, ``path``, ``rule`` and ``verdict``
replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeway.llm.common import map_arrow

#: Rules that are broadcast at most; a larger list is refused, not cut.
MAX_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: The production rules. Fixed values.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_END = ""


class UrlTrie:
    """Host labels from the right, then path segments; the last piece of a rule's path may be a part of a segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(("label", label), {})
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("segment", segment), {})
            tails = node.setdefault("tails", {})
            if tail not in tails or rule.action == "block":
                tails[tail] = (rule.action, rule.text)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Action and text of the winning rule."""
        found = None
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(("label", label))
            if node is None:
                break
            found = self._path(node, path) or found
        return found

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        found = None
        segments = path.split("/")
        for i in range(len(segments)):
            if tails := node.get("tails"):
                rest = "/".join(segments[i:])
                best = max((t for t in tails if rest.startswith(t)), key=len, default=None)
                if best is not None:
                    found = tails[best]
            if i == len(segments) - 1 or (node := node.get(("segment", segments[i]))) is None:
                break
        return found


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (ASCII letters in lower case) and ``path``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def filter_urls(df: DataFrame, rules: Iterable[Rule] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``; ``default`` is the verdict where no rule fits."""
    rules = tuple(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    added = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def make():
        find = trie.value.find

        def work(batch: pa.RecordBatch) -> dict:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [find(h, p) for h, p in zip(hosts, paths)]
            return {"rule": [f and f[1] for f in found], "verdict": [f[0] if f else default for f in found]}

        return work

    return map_arrow(with_host_path(df, url), "path", make, added)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    from sedgeway.runtime import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM cut
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hits AS (
  SELECT page_id, action, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM parts, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.action, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.k = 1
"""
