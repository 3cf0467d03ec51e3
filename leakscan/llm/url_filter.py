"""URL filters as a sort-merge range join.

A host written from its last label to its first (net!example!blog!) turns 'this host and all its
subdomains' into an interval of keys: everything that begins with the rule's key. Rules and urls
are range-partitioned and sorted together by that key, so a host with a third of all urls spreads
over tasks. Each task sweeps its rows once with a stack of the nested rule hosts that are active;
each entry of the stack holds that host's path rules. A task's stack starts with the rules that
enclose its first key: at most as many hosts as that key has labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscan.llm.common import shared_dir

#: Verdict where no rule fits.
DEFAULT = "allow"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "!"), F.lit("!"))


def _better(a: tuple[str, str, str], b: tuple[str, str, str] | None) -> bool:
    """Longest rule wins; of equally long ones that with the longer host, then the smaller verdict."""
    return b is None or (-len(a[0] + a[1]), -len(a[0]), a[2]) < (-len(b[0] + b[1]), -len(b[0]), b[2])


def _sweep(start: dict[int, list[tuple[str, str, str, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str, str]], list[int]]] | None = None

        def push(key: str, host: str, path: str, verdict: str) -> None:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            _, paths, lens = stack[-1]
            rule = (host, path, verdict)
            if path not in paths or _better(rule, paths[path]):
                paths[path] = rule
            if len(path) not in lens:
                lens.append(len(path))

        for b in batches:
            out: list[tuple] = []
            for part, key, page, host, path, verdict in zip(*(b.column(c).to_pylist() for c in ("part", "key", "page_id", "host", "path", "verdict")), strict=True):
                if stack is None:
                    stack = []
                    for rule in sorted(start.get(part, [])):
                        push(*rule)
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    push(key, host, path, verdict)
                    continue
                best = None
                for _, paths, lens in stack:
                    for n in lens:
                        rule = paths.get(path[:n]) if len(path) >= n else None
                        if rule and _better(rule, best):
                            best = rule
                out.append((page, host, path, best[0] + best[1] if best else None, best[2] if best else DEFAULT))
            names = ["page_id", "host", "path", "rule", "verdict"]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n != "page_id" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that wins for every url: page_id, host, path, rule (null if none fits), verdict.

    pages: page_id, url. rules: host, path, verdict ('allow' or 'block'). A rule fits its host and
    all subdomains if the url's path starts with the rule's path; the longest rule (host and path
    together) wins. A url without path fits only rules with an empty path. Null urls and urls
    without '://' have an empty host, which no rule fits; null and repeated page_ids are kept.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(F.lit(None).cast("long").alias("page_id"), lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where("host <> '' AND verdict IS NOT NULL").withColumn("key", host_key(F.col("host")))
    rows = rules.unionByName(urls.withColumn("key", host_key(F.col("host"))).withColumn("verdict", F.lit(None).cast("string")))
    by = [F.col("key"), F.col("verdict").isNull(), F.col("path"), F.col("page_id")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    shared_dir(spark)
    # a reliable checkpoint keeps the partitions, so that their first keys stay true
    rows = rows.withColumn("part", F.spark_partition_id()).checkpoint()
    heads = F.expr("transform(sequence(1, greatest(size(split(first, '!')) - 1, 1)), n -> concat(substring_index(first, '!', n), '!'))")
    first = rows.groupBy("part").agg(F.min("key").alias("first")).select("part", F.explode(heads).alias("key"))
    # by partition: the rules of at most as many hosts as its first key has labels
    start: dict[int, list[tuple[str, str, str, str]]] = {}
    for r in first.join(rules.select("key", "host", "path", "verdict"), "key").collect():
        start.setdefault(r.part, []).append((r.key, r.host, r.path, r.verdict))
    return rows.mapInArrow(_sweep(start), "page_id long, host string, path string, rule string, verdict string")
