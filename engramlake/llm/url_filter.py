"""Operator 3: allow and block entries in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import materialize, table
from engramlake.session import ship

Rule = tuple[str, str, str]  # verdict, host, path

RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DEFAULT_VERDICT = "allow"
#: Bytes of rule text that are broadcast as one trie (many times that in memory); beyond it the rules are joined.
MAX_TRIE_BYTES = 2 << 20

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class UrlTrie:
    """Nodes are dictionaries.  A host walk goes label by label from the top-level domain, empty labels like any other; at
    each host node with entries hangs a path trie over whole segments, whose last, possibly partial segment is found
    among the node's prefixes, longest first."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for verdict, host, path in checked(rules):
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("h", label), {})
            *whole, last = path.split("/")
            node = node.setdefault("p", {})
            for segment in whole:
                node = node.setdefault(("s", segment), {})
            node.setdefault("e", {})[last] = (host + path, verdict)
            node["n"] = tuple(sorted({*node.get("n", ()), len(last)}, reverse=True))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The entry with the longest host, then the longest path."""
        best, node, segments = None, self.root, None
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.get(("h", label))
            if node is None:
                break
            if "p" in node:
                segments = path.split("/") if segments is None else segments
                at, found = node["p"], None
                for segment in segments:
                    for n in at.get("n", ()):
                        if n <= len(segment) and segment[:n] in at["e"]:
                            found = at["e"][segment[:n]]
                            break
                    at = at.get(("s", segment))
                    if at is None:
                        break
                best = found or best
        return best


def checked(rules: list[Rule]) -> list[Rule]:
    """The rules with hosts in lower case (A-Z), each entry once: one listed both ways blocks."""
    found: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        key = (host.translate(_UPPER), path)
        found[key] = max(verdict, found.get(key, verdict))
    return [(v, h, p) for (h, p), v in found.items()]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null or where ``://`` is missing."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    for cut in "?#":
        rest = rest.partition(cut)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row for each row: ``key``, host, path, rule (null if none fits) and verdict.

    An entry fits its host and all subdomains where the path starts with the entry's path; an entry without a host
    fits any.  Labels are compared as they stand, so a host that ends in a dot is another host.  The longest host
    wins, then the longest path; an entry listed both ways blocks.  Null urls and urls without ``://`` have an
    empty host and path and meet only entries without a host.  Other columns are ignored; very long urls cost their length.
    Rules of up to ``MAX_TRIE_BYTES`` of text are broadcast as one trie; longer lists go through
    :func:`judge_by_join`, with the same results.
    """
    if sum(len(h) + len(p) for _, h, p in rules) > MAX_TRIE_BYTES:
        return judge_by_join(pages, rules, key, url, default)
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shared.value.match
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [match(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([x and x[0] for x in found], pa.string()),
                    pa.array([x[1] if x else default for x in found], pa.string()),
                ],
                names=["key", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string")
    return found.toDF(key, "host", "path", "rule", "verdict")


def judge_by_join(pages: DataFrame, rules: list[Rule], key: str, url: str, default: str) -> DataFrame:
    """The same result for lists too long to broadcast: every suffix of a host's labels, up to the length of the longest
    rule's host, meets the rules of that host in an equi-join, and the longest that fits stays."""
    ship(pages.sparkSession)
    spark = pages.sparkSession
    listed = spark.createDataFrame(checked(rules), "r_verdict string, r_host string, r_path string")
    longest = max((len(h) for _, h, _ in rules), default=0)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            suffixes = []
            for host, _ in parts:
                own, at = {"", host}, len(host)
                while at > 0 and len(host) - at <= longest:
                    at = host.rfind(".", 0, at)
                    own.add(host[at + 1 :])
                suffixes.append(sorted(x for x in own if len(x) <= longest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(suffixes, pa.list_(pa.string()))],
                names=["k", "host", "path", "suffixes"])

    kind = pages.schema[key].dataType.simpleString()
    split = pages.select(F.col(key).alias("k"), F.col(url).alias("url")).mapInArrow(walk, f"k {kind}, host string, path string, suffixes array<string>")
    split = materialize(split.withColumn("row", F.monotonically_increasing_id()), "urls")
    walked = split.select("row", "path", F.explode("suffixes").alias("r_host"))
    order = F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), F.concat("r_host", "r_path").alias("rule"), "r_verdict")
    best = walked.join(listed, "r_host").where("startswith(path, r_path)").groupBy("row").agg(F.max(order).alias("m"))
    return split.join(best, "row", "left").select(
        F.col("k").alias(key), "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.r_verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def oracle() -> str:
    fits = {r: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for r in RULES for _, h, p in [r]}
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), -len(r[2])))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[1]}{r[2]}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[0]}'" for r in ordered) + f" ELSE '{DEFAULT_VERDICT}' END"
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0
                       THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
  FROM u
)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM p"""
