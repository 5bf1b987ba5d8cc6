"""URL filters from a path-template tree, with DataFrame functions only.

Rules say block or allow for a host, its subdomains and a start of the path; the longest that fits wins. Other URLs are judged by
their template. Per host, path segments form a tree: runs of digits are generalised, a node with many children for its URLs gets one
wildcard child, and sibling branches that are statistically alike merge: those whose labelled shares do not differ significantly from
their parent's into one, of the others those above it that do not differ from each other's pooled share into one, and so below it. A
template's share of bad labels is smoothed towards its host's, and that towards all hosts'; templates at `reject` or more are blocked.
The tree is as deep as the paths are: wildcards are sought level by level while a node has enough leaves for one, branches merge on all
levels at once. Segments that look like the tree's own marks (`*`, `~`) get a backslash before.

The tree is built over distinct generalised paths, so a host with many pages is added up before it is shuffled.

Defined results: a null url, or one without `://`, has an empty host and path, and is judged like any host; URLs without labelled
relatives get the smoothed share of all; labels of one page are taken as bad if any is, those of a null page_id are no page's; repeated
rows each get their result; of rules that fit equally long the last by code point wins, a share just at `reject` is blocked; very long
URLs have as many levels as segments; an empty table gives no rows. Columns other than page_id and url are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import join_facts, settled, staged

#: Verdict, host and start of path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones win
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        rule, verdict = F.when(fits, f"{of}{start}").otherwise(rule), F.when(fits, told).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The generalised segments of a path, however many; those that could be taken for marks of the tree are escaped."""
    general = F.regexp_replace(F.regexp_replace(path, r"[0-9]+", "#"), r"/(?=[*~\\])", r"/\\")
    return F.filter(F.split(general, "/"), lambda s: s != "")


def grown(leaves: DataFrame, most_children: int, share: float) -> DataFrame:
    """leaf, host, n, labelled, bad, and place: the host and the segments, variable ones as wildcards, from the top down."""
    tree, done, i = leaves.withColumn("node", F.col("host")), [], 0
    own, deeper = F.col("parts"), F.size("parts")
    while True:
        # a node of few leaves has no more children further down: its leaves' segments stay as they are
        children = tree.where(deeper > i).groupBy("node", F.get(own, F.lit(i)).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
        nodes = children.groupBy("node").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("k") > most_children)
        nodes = staged(nodes.select("node", "k", ((F.col("c") > most_children) & (F.col("c") >= share * F.col("n"))).alias("wild")), "wildcards")
        rest = F.concat_ws("/", "node", F.slice(own, F.lit(i + 1), F.greatest(deeper - i, F.lit(0))))
        if nodes.isEmpty():
            return reduce(DataFrame.union, [*done, tree.select("leaf", "host", "n", "labelled", "bad", rest.alias("place"))])
        live = F.col("wild").isNotNull() & (deeper > i)
        step = F.concat_ws("/", "node", F.when(F.col("wild"), "*").otherwise(F.get(own, F.lit(i))))
        told = join_facts(tree, nodes, "node", "k").withColumn("place", F.when(~live, rest)).withColumn("node", F.when(live, step)).drop("wild")
        told = staged(told, "tree")
        done.append(told.where("place is not null").select("leaf", "host", "n", "labelled", "bad", "place"))
        tree, i = told.where("place is null").drop("place"), i + 1


def apart(l: Column, b: Column, of_l: Column, of_b: Column, z: float) -> Column:  # noqa: E741
    """Does a share of b in l differ significantly from that of of_b in of_l, whose part it is."""
    p, p_all = F.try_divide(b, l), F.try_divide(of_b, of_l)
    return F.coalesce(F.try_divide(F.abs(p - p_all), F.sqrt(F.try_divide(p_all * (1 - p_all), l))) >= z, F.lit(False))


def merged(branch: DataFrame, z: float) -> DataFrame:
    """node, n, mark: the branches (node, level, l, b, n) that do not merge with what is like their parent. Branches above or below
    it that are alike have the same mark, + or -, those like no other have none."""
    up = F.expr("substring_index(node, '/', level)")
    parent = branch.select(F.col("node").alias("up"), F.col("l").alias("l_all"), F.col("b").alias("b_all"))
    told = branch.where("level > 0 and l > 0").withColumn("up", up)
    kids = told.groupBy("up").agg(F.count("*").alias("kids"))
    both = join_facts(told, staged(parent.join(kids, "up"), "parents"), "up", "kids", "inner")
    off = staged(both.where(apart(F.col("l"), F.col("b"), F.col("l_all"), F.col("b_all"), z)).withColumn("mark",
        F.when(F.col("b") * F.col("l_all") > F.col("b_all") * F.col("l"), "+").otherwise("-")), "apart")
    side = F.concat("up", F.lit("/~"), "mark")
    pools = off.groupBy(side.alias("side")).agg(F.sum("l").alias("l_side"), F.sum("b").alias("b_side"), F.count("*").alias("kids"))
    pooled = join_facts(off.withColumn("side", side), staged(pools, "sides"), "side", "kids", "inner")
    alike = ~apart(F.col("l"), F.col("b"), F.col("l_side"), F.col("b_side"), z)
    return staged(pooled.select("node", "n", F.when(alike, F.col("mark")).alias("mark")), "merged")


def templates(leaves: DataFrame, most_children: int, share: float, z: float, weight: float) -> DataFrame:
    """leaf, template and the template's smoothed share of bad labels. leaves: leaf, host, parts, n, labelled, bad."""
    tree = grown(leaves, most_children, share)
    of = staged(tree.groupBy("host", "place").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("leaves")), "grown")
    # branches that are alike merge, all levels at once; sums go by hash, as a parent may have many branches
    steps = F.split("place", "/")
    within = of.select("place", "labelled", "bad", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda j: F.array_join(F.slice(steps,
        F.lit(1), j), "/"))).alias("level", "node"))
    branch = staged(within.groupBy("node", "level").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.count("*").alias("n")), "sums")
    found = join_facts(within.select("place", "level", "node"), merged(branch, z), "node", "n", "inner")
    levels = found.groupBy("place").agg(F.map_from_entries(F.collect_set(F.struct("level", F.coalesce("mark", F.lit("")).alias("mark")))).alias("marks"))
    step = lambda s, i: F.when((i == 0) | (F.element_at("marks", i) == ""),
        s).otherwise(F.concat(F.lit("~"), F.coalesce(F.element_at("marks", i), F.lit(""))))
    template = F.concat_ws("/", F.transform(steps, step))
    of = staged(of.join(levels, "place", "left").withColumn("marks", F.coalesce("marks", F.expr("cast(map() as map<int, string>)"))).select("host",
        "place", "leaves", "labelled", "bad", template.alias("template")), "branches")
    total = of.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.count("*").alias("places"))
    hosts = of.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"), F.count_distinct("template").alias("templates"))
    all_ = hosts.agg(F.sum("hl").alias("gl"), F.sum("hb").alias("gb"))  # one row
    prior = (F.col("hb") + weight * F.coalesce((F.col("gb") + 1) / (F.col("gl") + 2), F.lit(0.5))) / (F.col("hl") + weight)
    hosts = staged(hosts.join(F.broadcast(all_)).select("host", "templates", prior.alias("prior")), "hosts")
    told = join_facts(total, hosts, "host", "templates", "inner").select("template", "places",
        ((F.col("b") + weight * F.col("prior")) / (F.col("l") + weight)).alias("purity"))
    told = join_facts(of.select("place", "leaves", "template"), staged(told, "purities"), "template", "places", "inner")
    return join_facts(tree, staged(told, "templates"), "place", "leaves", "inner").select("leaf", "n", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject: float = 0.5, most_children: int = 8,
    share: float = 0.05, z: float = 1.96, weight: float = 10.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template_share of every page. labels: page_id, bad (boolean)."""
    host, path = host_and_path(F.col("url"))
    parts = segments(F.col("path"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", F.concat_ws("/", "host", parts).alias("leaf"))
    bad = labels.where("page_id is not null").groupBy(F.col("page_id").alias("labelled_id")).agg(F.max(F.coalesce("bad", F.lit(False)).cast("int")).alias("bad"))
    seen = rows.where("page_id is not null").join(bad, F.col("page_id") == F.col("labelled_id"), "left").drop("labelled_id")
    seen = seen.union(rows.where("page_id is null").withColumn("bad", F.lit(None).cast("int")))
    leaves = seen.groupBy("leaf", "host", parts.alias("parts")).agg(F.count("*").alias("n"), F.count("bad").alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = templates(staged(leaves, "leaves"), most_children, share, z, weight).where(F.col("purity") >= reject)
    blocked = staged(blocked.select("leaf", "n", F.col("purity").alias("template_share")), "blocked")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("template_share").isNotNull(), "block").otherwise("allow")
    return join_facts(rows, blocked, "leaf", "n").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template_share")


@settled
def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 or toxic = 1").alias("bad"))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
