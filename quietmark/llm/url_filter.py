"""URL filter: a trie over reversed host labels and path segments.

A rule is a host and a path with a verdict; it fits its host and all subdomains
where the url's path starts with the rule's.  The trie is walked from the last
host label down, then along path segments (the last segment of a rule is a
prefix of the url's).  Of the rules that fit, the one with the longest host
wins, then the one with the longest path; of equal rules ``block`` wins.

The trie is sent to the tasks.  Its size is bounded: a longer rule list is cut
into blocks of ``RULES_BLOCK`` rules, one narrow pass each, and the passes' best
rules are compared by the same order, so the result does not depend on it.

Null url or no ``://``: host and path are empty, no rule fits, and the verdict
is the default.  An empty table gives an empty result; all input columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.llm.common import fresh

RULES_BLOCK = 200_000
Rule = tuple[str, str, str]  # host, path, verdict


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the right, then whole path segments, then the rules' last segments."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(("label", label), {})
        *segments, last = path.split("/")
        node = node.setdefault("paths", {})
        for segment in segments:
            node = node.setdefault(("segment", segment), {})
        ends = node.setdefault("ends", {})
        if ends.get(last, (None,))[0] != "block":
            ends[last] = (verdict, f"{host}{path}", len(path))
    return root


def _in_paths(place: dict | None, segments: list[str]) -> tuple[str, str, int] | None:
    """The end with the longest path along ``segments``; the ends' last segments are prefixes of the url's."""
    best = None
    for segment in segments:
        if place is None:
            break
        ends = place.get("ends", {})
        for n in range(len(segment) + 1 if ends else 0):
            best = ends.get(segment[:n], best)
        place = place.get(("segment", segment))
    return best


def longest(trie: dict, host: str, path: str) -> tuple[int, int, str, str] | None:
    """``(host labels, path length, verdict, rule)`` of the winning rule."""
    best, node, segments = None, trie, path.split("/")
    for depth, label in enumerate(reversed(host.split(".")), 1):
        node = node.get(("label", label))
        if node is None:
            break
        found = _in_paths(node.get("paths"), segments)
        if found:
            verdict, rule, length = found
            best = (depth, length, verdict, rule)
    return best


BEST = "struct<labels:int,length:int,verdict:string,rule:string>"


def _look_up(shared):
    kind = pa.struct([("labels", pa.int32()), ("length", pa.int32()), ("verdict", pa.string()), ("rule", pa.string())])
    names = [f.name for f in kind]

    @F.arrow_udf(BEST)
    def look_up(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [longest(shared.value, h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        return pa.array([f and dict(zip(names, f)) for f in found], kind)

    return look_up


def judge(urls: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``; such input columns are replaced."""
    host, path, best, new = (fresh(c) for c in ("host", "path", "best", "new"))
    out = urls.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col)), best: F.lit(None).cast(BEST)})
    rank = lambda c: F.struct(F.col(f"{c}.labels"), F.col(f"{c}.length"), F.col(f"{c}.verdict") == "block")
    for lo in range(0, len(rules), RULES_BLOCK):
        shared = urls.sparkSession.sparkContext.broadcast(build_trie(rules[lo : lo + RULES_BLOCK]))
        better = F.col(best).isNull() | (F.col(new).isNotNull() & (rank(new) > rank(best)))
        out = out.withColumn(new, _look_up(shared)(host, path)).withColumn(best, F.when(better, F.col(new)).otherwise(F.col(best)))
    final = {"host": F.col(host), "path": F.col(path), "rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}
    return out.withColumns(final).drop(host, path, best, new)
