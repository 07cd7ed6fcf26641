"""URL filter: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule names a host and the beginning of a path. It fits the host and all its subdomains. Walking a URL's
labels from the right visits exactly the rules whose host it has; the walk goes on over path segments, where
the last segment of a rule need only be the beginning of the URL's. Among the rules that fit, the one with
most host labels wins, then the one with the longest path; of two equal rules, block wins.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean
from peerscope.staging import staged

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of one broadcast trie; a longer list is split.
RULES_PER_TRIE = 100_000
#: A pickled trie over this size is split further before it is broadcast.
TRIE_BYTES = 64 << 20


def cleaned(rule: tuple[str, str, str]) -> tuple[str, str, str]:
    """A rule as it is compared: the host's A-Z lower-cased, the path empty or with a slash in front."""
    host, path, verdict = rule[0] or "", rule[1] or "", rule[2]
    if verdict not in (ALLOW, BLOCK):
        raise ValueError(f"a rule's verdict is {ALLOW} or {BLOCK}, not {verdict!r}")
    return host.translate(str.maketrans(UPPER, LOWER)), path if path.startswith("/") or not path else "/" + path, verdict


class UrlTrie:
    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in map(cleaned, rules):
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, last = path.split("/")[1:] if path else [None]
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            own = node.setdefault("ends", {})
            if own.get(last, (host, path, ALLOW))[2] != BLOCK:
                own[last] = (host, path, verdict)

    @staticmethod
    def longest_path(paths: dict, segments: list[str]) -> tuple[str, str, str] | None:
        best, node = paths.get("ends", {}).get(None), paths
        for segment in segments:
            ends = node.get("ends", {})
            if ends:
                for size in range(len(segment), -1, -1):
                    if (found := ends.get(segment[:size])) is not None:
                        best = found
                        break
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str, str] | None:
        """The winning rule as (host, path, verdict)."""
        segments = path.split("/")[1:]
        node, best = self.root, None
        for label in ["", *reversed(host.split("."))] if host else [""]:
            node = node if node is self.root and label == "" else node.get("labels", {}).get(label)
            if node is None:
                break
            best = self.longest_path(node["paths"], segments) or best if "paths" in node else best
        return best


def tries(rules: list[tuple[str, str, str]], most: int = RULES_PER_TRIE) -> list[UrlTrie]:
    """Tries that hold all rules, each below the size that may be broadcast."""
    trie = UrlTrie(rules)
    if len(rules) > 1 and (len(rules) > most or len(pickle.dumps(trie)) > TRIE_BYTES):
        half = len(rules) // 2
        return tries(rules[:half], most) + tries(rules[half:], most)
    return [trie]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after.substr(F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = ALLOW, id_column: str = "page_id", url_column: str = "url", rules_per_trie: int = RULES_PER_TRIE) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``; no rule fits: null and ``default``.

    A null or malformed URL has empty host and path, which only a rule with an empty host fits. Repeated rows and null
    ids are judged each; URLs may be of any length; other columns are left out; an empty table gives no rows; an empty
    rule list gives ``default`` everywhere. A rule's host counts in lower case, and a path that lacks its first slash
    gets one; a null host or path is empty.
    """
    host, path = host_and_path(F.col(url_column).cast("string"))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()
    rank = lambda rule: (len(rule[0].split(".")) if rule[0] else 0, len(rule[1]), rule[2] == BLOCK)
    every = tries(rules, rules_per_trie)
    for number, trie in enumerate(every):
        shared = pages.sparkSession.sparkContext.broadcast(trie)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first: bool = number == 0) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                best: list[tuple[str, str, str] | None] = [None] * batch.num_rows
                if not first:
                    best = [x and (x["host"], x["path"], x["verdict"]) for x in batch.column("best").to_pylist()]
                for k, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                    found = own.find(h, p)
                    if found is not None and (best[k] is None or rank(found) > rank(best[k])):
                        best[k] = found
                won = pa.array([x and dict(zip(("host", "path", "verdict"), x, strict=True)) for x in best], pa.struct([(k, pa.string()) for k in ("host", "path", "verdict")]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("page_id", "host", "path")), won], ["page_id", "host", "path", "best"])

        rows = rows.mapInArrow(lean(run), f"page_id {kind}, host string, path string, best struct<host:string,path:string,verdict:string>")
        if number + 1 < len(every):
            rows = staged(rows, "judged")
            shared.unpersist()
    rule = F.concat("best.host", "best.path")  # null where none fits
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
