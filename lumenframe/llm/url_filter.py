"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

``example.net/en/`` becomes net > example > / > en/; a url walks the trie by its host's labels from the right and then
by its path's segments, and the deepest rule that it passes wins, allow or block. A rule fits its host and all
subdomains; its path must be the start of the url's (the last segment of a rule may be the start of one).

Up to ``max_broadcast_rules`` the trie is sent to the tasks. A larger table of rules stays distributed: each rule is
keyed by its host and its path's whole segments, each distinct url (host and path) by all nodes of the trie it passes
(bounded by its labels times its segments), and the longest rule of the join wins. Equal urls are merged first and the
join's keys of a single label are dealt over ``SALTS``, so a common host or a rule for a whole top-level domain does not
land in one task.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; such and unmatched urls
get the default verdict; of equal rules the block entry wins; repeated rows get equal verdicts; an empty table gives an
empty result. Input columns other than the id and the url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import q, raw

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


_STARTS = ""  # no label or segment of a trie is empty
SALTS = 16


class RuleTrie:
    """Nodes are dicts: child by label or segment (a segment keeps its closing slash), ``None`` holds (rule, verdict)."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        self.rules = 0
        for host, path, verdict in sorted(rules, key=lambda r: r[2] != "block", reverse=True):  # block last: it wins ties
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {}) if path else node
            *whole, part = path.split("/")
            for segment in whole:
                node = node.setdefault(segment + "/", {})
            if part:  # the start of a segment: leaves by their length, apart from the whole segments
                node = node.setdefault(_STARTS, {}).setdefault(len(part), {}).setdefault(part, {})
            node[None] = (host + path, verdict)
            self.rules += 1

    def longest(self, host: str, path: str) -> tuple[str, str, int] | None:
        """(rule, verdict, depth) of the deepest rule that fits."""
        best = None

        def see(node, depth):
            nonlocal best
            if None in node and (best is None or depth >= best[2]):
                best = (*node[None], depth)

        node = self.root
        depth = 0
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                return best
            depth += 1 << 20
            see(node, depth)
            if path and "/" in node:
                self._paths(node["/"], path, depth, see)
        return best

    @staticmethod
    def _paths(node, path, depth, see):
        at = 0
        while True:
            for size, leaves in node.get(_STARTS, {}).items():
                if (leaf := leaves.get(path[at : at + size])) is not None:
                    see(leaf, depth + at + size)
            end = path.find("/", at)
            if end < 0 or (node := node.get(path[at : end + 1])) is None:
                return
            at = end + 1
            see(node, depth + at)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
                max_broadcast_rules: int = 200_000) -> DataFrame:
    """(id, host, path, rule, verdict) for each row; ``rules``: (host, path, "allow" or "block") as a list or a table."""
    spark = pages.sparkSession
    host, path = host_and_path(q(url_col))
    out = pages.select(q(id_col), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        head = [tuple(r) for r in rules.limit(max_broadcast_rules + 1).collect()]
        if len(head) > max_broadcast_rules:
            return _joined(out, rules.toDF("h", "p", "v"), default, id_col)
        rules = head
    elif len(rules) > max_broadcast_rules:
        return _joined(out, spark.createDataFrame(rules, "h string, p string, v string"), default, id_col)
    if not rules:
        return out.select(q(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shared = spark.sparkContext.broadcast(RuleTrie(rules))

    @F.arrow_udf("rule string, verdict string")
    def match(hosts, paths):
        import pyarrow as pa

        trie = shared.value
        hits = [trie.longest(h.decode(), p.decode()) if h else None for h, p in zip(raw(hosts), raw(paths), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x and x[0] for x in hits], pa.string()), pa.array([x and x[1] for x in hits], pa.string())], names=["rule", "verdict"])

    best = match("host", "path")
    return out.withColumn("__lf_best", best).select(q(id_col), "host", "path", F.col("__lf_best.rule").alias("rule"), F.coalesce("__lf_best.verdict", F.lit(default)).alias("verdict"))


def _joined(urls: DataFrame, rules: DataFrame, default: str, id_col: str) -> DataFrame:
    """The same verdicts with the rules left distributed."""
    whole = F.regexp_extract("p", r"(?s)^(.*/)", 1)
    salt = F.when(F.contains("node", F.lit(".")), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    table = (
        rules.where("h is not null and p is not null and v is not null").withColumn("h", F.translate("h", _UPPER, _LOWER))
        .groupBy("h", "p").agg(F.max("v").alias("v"))  # block wins ties
        .select(F.concat("h", whole).alias("node"), F.concat("h", "p").alias("rule"), "p", (F.length("h").cast("long") * (1 << 20) + F.length("p")).alias("size"), "v")
        .withColumn("salt", F.explode(salt))
    )
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    parts = F.split("path", "/")
    starts = F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    distinct = urls.where("host <> ''").select("host", "path").distinct()
    nodes = distinct.select("host", "path", F.explode(hosts).alias("h")).withColumn("dir", F.explode(starts)).select("host", "path", F.concat("h", "dir").alias("node"))
    nodes = nodes.withColumn("salt", F.when(F.contains("node", F.lit(".")), F.lit(0)).otherwise(F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")))
    best = nodes.join(table, ["node", "salt"]).where(F.startswith("path", "p")).groupBy("host", "path").agg(F.max(F.struct("size", "rule", "v")).alias("best"))
    joined = urls.join(best, ["host", "path"], "left")
    return joined.select(q(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
