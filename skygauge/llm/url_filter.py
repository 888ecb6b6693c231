"""URL filters: a trie over reversed host labels and path segments; the longest rule that fits decides.

Rules are `(host, path, verdict)`. A rule fits its host and all subdomains if the path of the URL starts
with the path of the rule. More host labels win over fewer, then more characters of path; of two equal
rules the blocking one holds. Rule lists are cut into blocks of `BLOCK_RULES`, so that what is broadcast
has a bound; each block is one trie, and the longest match over all blocks counts.

Defined cases: a null URL, or one without `://`, has empty host and path and fits no rule; an empty table
gives an empty result; repeated rows are judged each; further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_RULES = 1_000_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Rule = tuple[str, str, str]


def host(url: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 1)
    return F.translate(found, UPPER, UPPER.lower())


def path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 2)


def trie(rules: Sequence[Rule]) -> dict:
    """Nodes are dicts: a label leads to a child, key `/` to the node's path trie, `!` to its rules.

    A path trie has segments that end in `/` as keys. The last piece of a rule's path need not be a whole
    segment; such ends are kept in `!` as piece -> verdict, whole ones with an empty piece.
    """
    root: dict = {}
    for name, start, verdict in rules:
        node = root
        for label in reversed(name.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *segments, rest = start.split("/")
        for segment in segments:
            node = node.setdefault(segment + "/", {})
        ends = node.setdefault("!", {})
        if ends.get(rest) != "block":
            ends[rest] = verdict
    return root


def longest(root: dict, name: str, start: str) -> tuple[int, int, str, str] | None:
    """(labels, path characters, rule, verdict) of the longest rule that fits."""
    best, node, labels = None, root, name.split(".")
    for depth, label in enumerate(reversed(labels), 1):
        node = node.get(label)
        if node is None:
            break
        if "/" in node and (end := _longest_path(node["/"], start)):
            best = (depth, len(end[0]), ".".join(labels[-depth:]) + end[0], end[1])
    return best


def _longest_path(node: dict, start: str) -> tuple[str, str] | None:
    best, done = None, 0
    while True:
        for piece, verdict in node.get("!", {}).items():
            if start.startswith(piece, done) and (best is None or done + len(piece) >= len(best[0])):
                best = (start[: done + len(piece)], verdict)
        cut = start.find("/", done)
        node = node.get(start[done : cut + 1]) if cut >= 0 else None
        if node is None:
            return best
        done = cut + 1


def _matcher(shared: Broadcast):
    @F.pandas_udf("struct<labels:int,chars:int,blocks:boolean,rule:string,verdict:string>")
    def match(names: pd.Series, starts: pd.Series) -> pd.DataFrame:
        root = shared.value
        found = [longest(root, n, s) or (None, None, None, None) for n, s in zip(names, starts)]
        out = pd.DataFrame(found, columns=["labels", "chars", "rule", "verdict"], dtype=object)
        out.insert(2, "blocks", [None if v is None else v == "block" for v in out["verdict"]])
        return out

    return match


def judge(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES
) -> DataFrame:
    """`pages` with `host`, `path`, `rule` (null if none fits) and `verdict` (`default` if none fits).

    Columns of these names are replaced.
    """
    best = None
    for at in range(0, max(1, len(rules)), block_rules):
        shared = pages.sparkSession.sparkContext.broadcast(trie(rules[at : at + block_rules]))
        one = _matcher(shared)(F.col("host"), F.col("path"))
        one = F.when(one["rule"].isNotNull(), one)
        best = one if best is None else F.greatest(best, one)
    judged = pages.withColumn("host", host(url)).withColumn("path", path(url))
    name = "_match"
    while name in judged.columns:
        name = "_" + name
    judged = judged.withColumn(name, best)
    return (
        judged.withColumn("rule", F.col(name)["rule"])
        .withColumn("verdict", F.coalesce(F.col(name)["verdict"], F.lit(default)))
        .drop(name)
    )
