"""URL filters: a trie over reversed host labels and path segments, broadcast, longest match first."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydf.llm import common

#: Rules of one broadcast trie, so its size has a proven bound; more rules are dealt out to several, used one after the other.
MAX_RULES = 1_000_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and all its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
    or the end. Null, or no ``://``: both empty."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    before = rest.partition("#")[0].partition("?")[0]
    host, slash, path = before.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Two levels of one trie: reversed host labels lead to a node, whose path part goes down segment by segment.

    The last segment of a rule's path is a prefix of the url's segment (``/en`` fits ``/english``), as a plain prefix test
    would have it. Among the rules that fit, the one with the longest ``host + path`` wins, then the longer host, then
    the rule given first.
    """

    def __init__(self, rules: list[Rule], first: int = 0):
        """first: the number of the first rule among all rules, if these are a part."""
        self.root: dict = {}
        for at, rule in enumerate(rules, first):
            node = self.root
            for label in reversed(rule.host.lower().split(".")) if rule.host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, last = rule.path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            size = (len(rule.name), len(rule.host), -at)
            ends = node.setdefault("ends", {})
            # only the lengths that rules end with are tried on a segment, short ones first
            if last not in ends:
                node["lengths"] = sorted({len(last), *node.get("lengths", ())})
            if last not in ends or ends[last][0] < size:
                ends[last] = (size, rule)

    @staticmethod
    def _down(node: dict, segments: list[str], best):
        for segment in segments:
            if ends := node.get("ends"):
                for stop in node["lengths"]:
                    if stop > len(segment):
                        break
                    if (hit := ends.get(segment[:stop])) and (best is None or hit[0] > best[0]):
                        best = hit
            node = node.get("next", {}).get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> Rule | None:
        """The rule that wins, None if none fits."""
        best = self.best(host, path)
        return best[1] if best else None

    def best(self, host: str, path: str):
        """The rule that wins, after the numbers by which it does: length, length of the host, and minus its place; None if none fits."""
        segments, best, node = path.split("/"), None, self.root
        if "paths" in node:
            best = self._down(node["paths"], segments, best)
        for label in reversed(host.split(".")) if host else ():
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._down(node["paths"], segments, best)
        return best


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` (the rule's, else ``default``).

    Row by row and without a shuffle, in time that grows with a url's length; columns of those names are replaced, all others stay.
    Null urls, urls without ``://`` and empty hosts fit only rules with an empty host. Urls are judged whole, however long.
    Repeated rows get equal results; an empty table stays empty. Beyond ``MAX_RULES`` rules each part of them has a trie of its
    own, and the longest match of all parts wins.
    """
    spark = df.sparkSession
    common.ship(spark)
    held, keep = common.fresh(df, "judged"), [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = F.arrow_udf(lambda urls: _structs([host_and_path(u) for u in urls.to_pylist()], ["host", "path"], [pa.string()] * 2), "struct<host: string, path: string>")

    def judged(trie):
        def run(hosts: pa.Array, paths: pa.Array) -> pa.Array:
            seen, out = trie.value, []
            for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
                hit = seen.best(host, path)
                out.append((*hit[0], hit[1].name, hit[1].verdict) if hit else (None,) * 5)
            return _structs(out, ["size", "host_size", "order", "rule", "verdict"], [pa.int64()] * 3 + [pa.string()] * 2)

        return F.arrow_udf(run, "struct<size: long, host_size: long, order: long, rule: string, verdict: string>")

    parts = [rules[at : at + MAX_RULES] for at in range(0, max(1, len(rules)), MAX_RULES)]
    tries = [spark.sparkContext.broadcast(UrlTrie(part, k * MAX_RULES)) for k, part in enumerate(parts)]
    cut = df.withColumn(held, split(F.col(f"`{url}`").cast("string")))
    hits = [judged(trie)(F.col(held)["host"], F.col(held)["path"]) for trie in tries]
    hit = common.fresh(cut, "hit")
    best = hits[0] if len(hits) == 1 else F.array_max(F.filter(F.array(*hits), lambda h: h["size"].isNotNull()))
    out = cut.withColumn(hit, best)
    return out.select(*keep, F.col(held)["host"].alias("host"), F.col(held)["path"].alias("path"), F.col(hit)["rule"].alias("rule"), F.coalesce(F.col(hit)["verdict"], F.lit(default)).alias("verdict"))


def _structs(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    """Rows as an array of structs."""
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


RULES = [
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op10_url_filters(spark, sf_dir):
    """Judge every url of ``pages``."""
    pages = common.only(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM a
), c AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM b
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hits AS (
  SELECT c.page_id, c.host, c.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM c LEFT JOIN rules ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits
"""
