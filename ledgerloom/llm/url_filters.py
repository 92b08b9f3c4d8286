"""URL filters: explicit rules first, then trust and distrust propagated over the link graph of hosts.

All of it is DataFrame expressions and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, stage

#: The rules of the query, as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Masses change by DAMPING times as much in each round as in the one before, so ROUNDS leave less than TOLERANCE of all mass to move.
DAMPING, TOLERANCE = 0.85, 0.01
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: A host is blocked when its distrust exceeds its trust by this factor.
FACTOR = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative link targets in HTML; group 1 is the host.
LINK = r"""(?i)href\s{0,8}=\s{0,8}["']?(?:https?:)?//([^/?#"'\s<>\\]+)"""


#: What follows the first "://" of column _url.
REST = "substring(_url, locate('://', _url) + 3)"


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """`pages` with host and path of the url.

    The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path goes on
    up to "?", "#" or the end.  Both are empty without "://".
    """
    held = pages.withColumn("_url", F.coalesce(pages[url_col].cast("string"), F.lit("")))
    part = lambda pattern: F.when(F.col("_url").contains("://"), F.regexp_extract(F.expr(REST), pattern, 1)).otherwise("")
    held = held.withColumn("host", F.translate(part(r"^([^/?#]*)"), UPPER, LOWER))
    return held.withColumn("path", part(r"^[^/?#]*([^?#]*)")).drop("_url")


def matched(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits `host` and `path`, of equally long ones the first; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def node_of(host: Column) -> Column:
    """The graph's name of a host: without user and port, in lower case."""
    return F.translate(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), UPPER, LOWER)


def rank(edges: DataFrame, hosts: DataFrame, seed: str, damping: float, rounds: int) -> DataFrame:
    """Personalised PageRank of (host, mass) from the seed masses in column `seed` of `hosts`; masses sum to 1, or all are 0.

    `edges` has src, dst and share (of src's outgoing weight).  Mass of hosts without links returns to the seeds;
    that only multiplies all masses, so it is done once, at the end, by dividing them by their sum.
    """
    total = hosts.agg(F.sum(seed)).first()[0] or 0.0
    start = hosts.select("host", (F.col(seed) / total if total else F.lit(0.0)).alias("seed"))
    now = start.select("host", F.col("seed").alias("mass"))
    if not total:
        return now
    fan = stage(edges.groupBy("src").agg(F.count("*").alias("n")), "fan")
    for k in range(rounds):
        masses = now.filter("mass > 0").join(fan, now["host"] == fan["src"]).select("src", "mass", "n")
        flow = attach(edges, masses, "src", "n").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("flow"))
        moved = start.join(flow, "host", "left").select("host", ((1 - damping) * F.col("seed") + damping * F.coalesce("flow", F.lit(0.0))).alias("mass"))
        moved = stage(moved, f"rank-{k}")
        change = moved.join(now.withColumnRenamed("mass", "was"), "host").agg(F.sum(F.abs(F.col("mass") - F.col("was")))).first()[0]
        now = moved
        if change < 1e-12:
            break
    held = now.agg(F.sum("mass")).first()[0]
    return now.select("host", (F.col("mass") / held).alias("mass"))


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    factor: float = FACTOR,
) -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits decides.  Other pages take their host's verdict: hosts whose pages rules allow
    are seeds of trust, those whose pages rules block are seeds of distrust, each by its number of such pages.
    Trust follows links between hosts (personalised PageRank); distrust follows them backwards, so who links to
    blocked hosts is distrusted.  Both sum to 1 over all hosts (with dangling mass returned to the seeds).  A host
    is blocked when its distrust is more than `factor` times its trust, and allowed otherwise, also when both are
    equal and when no link and no seed says anything of it.  In the graph a host goes without user and port.

    Links are the absolute and scheme-relative targets in the HTML; links to the own host count for nothing.
    Null or odd urls have an empty host and path and belong to the host "".  Repeated rows repeat their results
    and weigh twice; an empty table gives an empty result; other columns are not read.  Page rows are reduced
    to counts by host before any shuffle, and hosts with a large share of pages are joined by broadcast.
    """
    rules = RULES if rules is None else rules
    pages = pages.select(*(pages[c] for c in dict.fromkeys((id_col, url_col, html_col))))
    picked = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    rule, verdict = matched(rules)
    parts = with_parts(picked, "url").withColumn("rule", rule).withColumn("verdict", verdict)
    parts = parts.withColumn("node", node_of(F.col("host")))
    rows = parts.select("page_id", "host", "node", "path", "rule", "verdict")
    links = parts.select("node", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    edges = links.select(F.col("node").alias("src"), node_of(F.col("to")).alias("dst")).filter("src <> dst and dst <> '' and src <> ''")
    edges = stage(edges.groupBy("src", "dst").agg(F.count("*").alias("w")), "edges")
    seeds = rows.groupBy(F.col("node").alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    seeds = stage(seeds, "hosts")
    far = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = stage(far.join(seeds, "host", "full").select("host", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("good", "bad"))), "seeds")
    out_w, in_w = edges.groupBy("src").agg(F.sum("w").alias("t"), F.count("*").alias("n")), edges.groupBy("dst").agg(F.sum("w").alias("t"), F.count("*").alias("n"))
    empty = edges.isEmpty()
    if empty:  # no links: the seeds are all there is
        scale = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
        score = hosts.select("host", (F.col("good") / (scale["g"] or 1.0)).alias("trust"), (F.col("bad") / (scale["b"] or 1.0)).alias("distrust"))
    else:
        forth = attach(edges, out_w, "src", "n").select("src", "dst", (F.col("w") / F.col("t")).alias("share"))
        back = attach(edges, in_w, "dst", "n").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / F.col("t")).alias("share"))
        trust = rank(stage(forth, "forth"), hosts, "good", damping, rounds).withColumnRenamed("mass", "trust")
        distrust = rank(stage(back, "back"), hosts, "bad", damping, rounds).withColumnRenamed("mass", "distrust")
        score = trust.join(distrust, "host")
    judged = seeds.select("host", "n").join(score, "host")
    out = attach(rows, stage(judged.withColumnRenamed("host", "node"), "judged"), "node", "n")
    own = F.when(F.col("distrust") > factor * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust", "distrust")


def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op5_sql(rules: list[tuple[str, str, str]] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, factor: float = FACTOR) -> str:
    """The same judgement in DuckDB, with one common table expression for each round."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in ordered) + " END"
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    rest = "substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3)"
    has = "contains(coalesce(url, ''), '://')"
    steps = []
    for name, src, dst, seed in (("t", "src", "dst", "good"), ("d", "dst", "src", "bad")):
        steps.append(f"{name}0 AS MATERIALIZED (SELECT host, {seed} / greatest((SELECT sum({seed}) FROM hosts), 1) AS seed, {seed} / greatest((SELECT sum({seed}) FROM hosts), 1) AS mass FROM hosts)")
        for k in range(rounds):
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT p.host, p.seed, {1 - damping} * p.seed + {damping} * coalesce(f.flow, 0) AS mass FROM {name}{k} p LEFT JOIN "
                f"(SELECT e.{dst} AS host, sum(m.mass * e.w / o.t) AS flow FROM edges e JOIN {name}{k} m ON m.host = e.{src} "
                f"JOIN (SELECT {src} AS h, sum(w) AS t FROM edges GROUP BY 1) o ON o.h = e.{src} GROUP BY 1) f USING (host))"
            )
    last = f"(SELECT t.host, CASE WHEN (SELECT count(*) FROM edges) = 0 THEN t.seed ELSE t.mass / (SELECT greatest(sum(mass), 1e-300) FROM t{rounds}) END AS trust, CASE WHEN (SELECT count(*) FROM edges) = 0 THEN d.seed ELSE d.mass / (SELECT greatest(sum(mass), 1e-300) FROM d{rounds}) END AS distrust FROM t{rounds} t JOIN d{rounds} d USING (host))"
    pattern = LINK.replace("'", "''").replace("(?i)", "")
    return f"""
WITH parts AS (
  SELECT page_id, html, CASE WHEN {has} THEN {lower.format(f"regexp_extract({rest}, '^([^/?#]*)', 1)")} ELSE '' END AS host,
         CASE WHEN {has} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), ruled AS (SELECT page_id, html, host, {lower.format("regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')")} AS node, path, {rule} AS rule, {verdict} AS verdict FROM parts),
links AS (SELECT node AS src, unnest(regexp_extract_all(html, '{pattern}', 1, 'i')) AS raw FROM ruled),
ends AS (SELECT src, {lower.format("regexp_replace(regexp_replace(raw, '^.*@', ''), ':[0-9]*$', '')")} AS dst FROM links),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM ends WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
counted AS (SELECT node AS host, count_if(verdict = 'allow')::DOUBLE AS good, count_if(verdict = 'block')::DOUBLE AS bad FROM ruled GROUP BY 1),
hosts AS (SELECT host, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM counted) LEFT JOIN counted USING (host)),
{", ".join(steps)}
SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN s.distrust > {factor} * s.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN {last} s ON s.host = r.node
"""


OP5_SQL = op5_sql()
