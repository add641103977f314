"""URL filters: a trie over reversed host labels and path segments.

The rules become one nested dictionary that is broadcast. A URL walks it from the last
host label to the first; of the rules met whose path begins the URL's path, the longest
(host and path together) decides, and of equally long ones that with the longer host. Rules are a list that the caller holds in memory, so what is
broadcast has the size of that argument and never grows with the pages.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no
rule; an empty path fits only rules with an empty path; of rules with the same host and
path, a block wins. All other columns of the input are kept; columns of the same names as
the new ones, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logtable.llm.common import ascii_lower, unused

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path)
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Sequence[Rule]) -> dict:
    """Host labels from the right lead to ``paths``, a trie over path segments.

    The last segment of a rule's path may go on in the URL, so it is kept as a tail of
    the node before it: ``/en/`` is the segments ``""``, ``en`` and the tail ``""``.
    """
    root: dict = {"next": {}}
    for verdict, host, path in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule allows or blocks: {verdict!r}")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node["next"].setdefault(label, {"next": {}})
        node = node.setdefault("paths", {"next": {}, "tails": {}})
        *segments, tail = path.split("/")
        for segment in segments:
            node = node["next"].setdefault(segment, {"next": {}, "tails": {}})
        if node["tails"].get(tail, ("", ALLOW))[1] != BLOCK:
            node["tails"][tail] = (host.lower() + path, verdict)
    return root


def _best_path(node: dict, path: str) -> tuple[str, str] | None:
    """The longest rule path of a host that begins ``path``."""
    best = None
    for segment in path.split("/"):
        for tail in sorted(node["tails"], key=len, reverse=True):
            if segment.startswith(tail):
                best = node["tails"][tail]
                break
        node = node["next"].get(segment)
        if node is None:
            break
    return best


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node["next"].get(label)
        if node is None:
            break
        if "paths" in node:
            found = _best_path(node["paths"], path)
            if found is not None and (best is None or len(found[0]) >= len(best[0])):
                best = found
    return best


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``."""
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("struct<rule string, verdict string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [look_up(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    (judged,) = unused(pages.columns, "found")
    with_parts = pages.select(*kept, url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    return with_parts.withColumn(judged, judge("host", "path")).select(
        *kept, "host", "path", F.col(f"{judged}.rule").alias("rule"), F.col(f"{judged}.verdict").alias("verdict")
    )
