"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with the
rule's path; the longest fitting rule decides. For the other urls every host gets two scores:
personalised PageRank from trusted hosts along links, and the same from blocked hosts against
the links (who links to a blocked host is distrusted). Seeds come from the rules: a host is
trusted if allowing rules decide more of its pages than blocking ones, and blocked if blocking
rules decide more than half of all its pages. A host is blocked if its distrust, as a share of
both scores, is over the threshold; a host that neither reaches is allowed. Rounds go on until
the hosts reached and their scores settle, however far a host is from the seeds.

Links are absolute links in the pages' html, and the step between a host and the domain above
it. A null url, and one without ``://``, has an empty host and path: no rule fits, and it is
allowed. Null html has no links. Repeated pages count as often as they stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flaskmill.llm.texts import shared_rows

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Rounds between two tables that cut the lineage; rounds end with a block that reached no new
#: host and moved the scores of a kind (which sum to 1) by no more than SETTLED in all.
CUT = 5
SETTLED = 1e-3
BLOCK_OVER = 0.5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def above(host: Column) -> Column:
    """The domains a host lies in, itself first; none for the empty host."""
    labels = F.split(host, r"\.")
    cut = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(host != "", cut).otherwise(F.array().cast("array<string>"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules that fit the host, longest first."""
    fit = (
        hosts.select("host", F.explode(above(F.col("host"))).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.length(F.concat("rule_host", "rule_path")).alias("size"),
                        F.length("rule_host").alias("host_size"),
                        (F.col("verdict") == "block").alias("block"),
                        F.concat("rule_host", "rule_path").alias("rule"),
                        F.col("rule_path").alias("path"),
                        "verdict",
                    )
                ),
                asc=False,
            ).alias("rules")
        )
    )
    return hosts.select("host").join(fit, "host", "left")


def fitting(rules: Column, path: Column) -> Column:
    """The first of the host's rules whose path the url's path starts with."""
    return F.get(F.filter(rules, lambda r: path.startswith(r["path"])), F.lit(0))


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, counted before they are shuffled."""
    links = (
        pages.select("host", F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("to"))
        .where((F.col("host") != "") & (F.size("to") > 0))
        .select(F.col("host").alias("src"), F.explode("to").alias("dst"))
        .withColumn("dst", lower_ascii(F.col("dst")))
    )
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _moved(before: DataFrame, after: DataFrame) -> tuple[int, float]:
    """New hosts, and the change of the scores in all."""
    both = after.join(before.withColumnRenamed("score", "was"), ["kind", "host"], "left")
    change = F.abs(F.col("score") - F.coalesce("was", F.lit(0.0)))
    row = both.agg(F.count_if(F.col("was").isNull()).alias("new"), F.sum(change).alias("change")).first()
    return row["new"], row["change"] or 0.0


def propagate(seeds: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """kind, host, score: personalised PageRank of each kind, until it settles or for ``rounds``.

    ``seeds``: kind, host, share (shares of a kind sum to 1). ``links``: kind, src, dst, share
    (shares of a source sum to 1). What reaches a host without links ends there. Each round is a
    join with one row per host and a sum that is combined before its shuffle.
    """
    start = seeds.select("kind", "host", (F.col("share") * (1 - DAMPING)).alias("score"))
    score, turn = start, 0
    while rounds is None or turn < rounds:
        before = score
        for _ in range(CUT if rounds is None else min(CUT, rounds - turn)):
            moved = score.withColumnRenamed("host", "src").join(links, ["kind", "src"])
            gain = F.col("score") * F.col("share") * DAMPING
            moved = moved.select("kind", F.col("dst").alias("host"), gain.alias("score"))
            score = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            turn += 1
        score = shared_rows(score)
        if rounds is None:
            new, change = _moved(before, score)
            if not new and change <= SETTLED:
                break
    return score


def judge(pages: DataFrame, rules=RULES, rounds: int | None = None, block_over: float = BLOCK_OVER) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (of the host) of every page.

    ``rules``: (verdict, host, path) rows, or a DataFrame verdict, rule_host, rule_path.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    host, path = url_parts(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    urls = read.select("page_id", "host", "path")
    counted = shared_rows(host_rules(urls.select("host").distinct(), rules))
    ruled = urls.join(counted, "host").withColumn("hit", fitting(F.col("rules"), F.col("path")))
    votes = (
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("hit.verdict") == "allow").alias("allowed"),
            F.count_if(F.col("hit.verdict") == "block").alias("blocked"),
        )
    )
    votes = shared_rows(votes)
    trusted = votes.where("allowed > blocked").select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("n"))
    blocked = votes.where("2 * blocked > n").select(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("n"))
    seeds = trusted.unionByName(blocked)
    total = seeds.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    seeds = shared_rows(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("share")))

    found = host_links(read)
    step = votes.select(F.col("host").alias("src"), F.get(above(F.col("host")), F.lit(1)).alias("dst"))
    step = step.where(F.col("dst").contains("."))
    step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = found.unionByName(step.withColumn("n", F.lit(1))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    both = shared_rows(both)
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    both = shared_rows(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))

    score = propagate(seeds, both, rounds)
    scores = shared_rows(
        score.groupBy("host").agg(
            F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
            F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"),
        )
    )
    info = counted.join(scores, "host", "left").select(
        "host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
    hit = fitting(F.col("rules"), F.col("path"))
    both_scores = F.col("trust") + F.col("distrust")
    bad = (both_scores > 0) & (F.col("distrust") > block_over * both_scores)
    return (
        urls.join(info, "host")
        .withColumn("hit", hit)
        .select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce("hit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
            "trust", "distrust",
        )
    )
