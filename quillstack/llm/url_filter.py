"""Allow and block rules over urls: a trie over reversed host labels and path segments, broadcast.

A rule is a host and the beginning of a path. It fits its host and all subdomains, where the url's path begins with the
rule's. The longest fit wins: more host labels first, then the longer path; a rule that is listed both ways blocks. Urls
that no rule fits get the verdict of the method, `default`.

The trie is walked from the last host label on; a host's node holds a second trie over whole path segments, whose nodes
hold the beginnings of a last segment, tried from the longest down. One url costs its labels and segments, whatever the
number of rules. Up to MOST_RULES rules go to every task; of more, the tries of as many blocks follow each other, each
step written to the shared folder, and the longer fit stays: the same rows, in bounded memory.

Defined results: a null url, or one without `://`, has an empty host and path, which only a rule without a host fits; of
a host, A-Z are lower-cased and nothing else is changed (ports and user names stay, and are part of a label); rules with a null host, path or verdict count
for nothing; repeated rows and other columns stay, but columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import save

MOST_RULES = 100_000
NAMES = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "_fit struct<labels: int, length: int, rule: string, verdict: string>"


class Node:
    """Of both tries. ends: verdicts by the beginning of a last segment, tried by size, the longest first."""

    __slots__ = ("below", "ends", "paths", "sizes")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.paths: Node | None = None
        self.ends: dict[str, str] = {}
        self.sizes: list[int] = []


def add(root: Node, host: str, path: str, verdict: str) -> None:
    node = root
    for label in reversed(host.split(".")) if host else ():
        node = node.below.setdefault(label, Node())
    node.paths = node.paths or Node()
    node = node.paths
    *whole, last = path.split("/")
    for segment in whole:
        node = node.below.setdefault(segment, Node())
    if node.ends.get(last) != "block":
        node.ends[last] = verdict
    node.sizes = sorted({len(x) for x in node.ends}, reverse=True)


def fit(paths: Node, path: str) -> tuple[int, str] | None:
    """(length, verdict) of the longest beginning of the path; each character is looked at once or so, whatever its segments."""
    node, at, found = paths, 0, None
    while True:
        for size in node.sizes:
            end = at + size
            if end <= len(path) and (verdict := node.ends.get(path[at:end])) is not None:
                found = end, verdict  # a later segment is longer
                break
        cut = path.find("/", at) if node.below else -1
        if cut < 0 or (below := node.below.get(path[at:cut])) is None:
            return found
        node, at = below, cut + 1


def judge(root: Node, host: str, path: str) -> tuple[int, int, str, str] | None:
    """(labels, length of the path, rule, verdict) of the longest rule that fits."""
    node, labels, end, kept = root, 0, len(host) + 1, []
    if root.paths:
        kept.append((0, "", root.paths))
    while node.below and end > 0:
        start = host.rfind(".", 0, max(0, end - 1)) + 1
        node = node.below.get(host[start : end - 1])
        if node is None or not host:
            break
        labels, end = labels + 1, start
        if node.paths:
            kept.append((labels, host[start:], node.paths))
    for count, name, paths in reversed(kept):
        if found := fit(paths, path):
            return count, found[0], name + path[: found[0]], found[1]
    return None


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def filter_urls(rows: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """rows with host, path, rule (host and path, or null) and verdict. rules: (host, path, verdict allow or block)."""
    host, path = url_parts(F.col(url))
    taken = {c: f"_kept_{c}" for c in rows.columns if c.lower() in NAMES and c != url}
    out = rows.drop(*taken).withColumns({"host": host, "path": path, "_fit": F.lit(None).cast(FOUND.split(" ", 1)[1])})
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", F.lower("verdict").alias("verdict")).where("host is not null and path is not null and verdict in ('allow', 'block')")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    blocks = clean.count() // MOST_RULES + 1
    if blocks > 1:
        clean = save(clean.withColumn("block", F.pmod(F.xxhash64("host", "path"), F.lit(blocks))), "rules")
    for block in range(blocks):
        part = clean.where(F.col("block") == block) if blocks > 1 else clean
        out = walked(out, [tuple(r) for r in part.select("host", "path", "verdict").collect()])  # about MOST_RULES rows
        if block + 1 < blocks:
            out = save(out, "urls")
    return out.withColumns({"rule": F.col("_fit.rule"), "verdict": F.coalesce("_fit.verdict", F.lit(default))}).drop("_fit")


def walked(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows with the longer of the fit that they have and that of these rules."""
    shared = rows.sparkSession.sparkContext.broadcast(rules)
    columns = rows.columns
    at_host, at_path, at_fit = (columns.index(c) for c in ("host", "path", "_fit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node()
        for rule in shared.value:
            add(root, *rule)
        for batch in batches:
            found = []
            for host, path, old in zip(batch.column(at_host).to_pylist(), batch.column(at_path).to_pylist(), batch.column(at_fit).to_pylist()):
                new = judge(root, host, path)
                keep = new is None or old is not None and (old["labels"], old["length"]) >= new[:2]
                found.append(old if keep else dict(zip(("labels", "length", "rule", "verdict"), new)))
            kept = [batch.column(i) for i in range(len(columns))]
            kept[at_fit] = pa.array(found, batch.schema.field(at_fit).type)
            yield pa.RecordBatch.from_arrays(kept, columns)

    return rows.mapInArrow(run, rows.schema)
