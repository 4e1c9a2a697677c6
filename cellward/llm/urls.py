r"""URL filters: rules by host and path, and a verdict for the rest from the hosts' link graph.

All work is column expressions, joins and grouped sums.  Edges between hosts are the pages' absolute links, and what
the hosts' names tell: a host and the name above it (without the first label) are linked both ways, with the weight
of the host's pages, if that name has pages too or at least SITE labels.  (Shorter names without pages may be
registries, under which strangers stand side by side.)  Names without pages are nodes without seeds.

Trust starts at hosts in the share of their pages that rules allow and flows along the edges (personalised PageRank);
distrust starts in the share that rules block and flows against them.  A full seed alone scores 1.  Rounds go on until
no score changes by SETTLED, however many it takes.  A page that no rule fits is blocked if its host's distrust is
over THRESHOLD and over its trust, else allowed.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: on up to ``?``, ``#``
or the end.  A null url or one without ``://`` has both empty, is in no graph and is allowed.  Null html has
no links; a null page_id is kept; repeated pages count and are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.sparkops import cut, salted_join, table

#: (verdict, host, start of the path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, SETTLED, THRESHOLD = 0.85, 1e-5, 0.5
#: Labels of a name above a host that count as a site; rounds between two cuts of the lineage.
SITE, STEP = 3, 6
#: Edges in one task, and hosts whose scores are broadcast (60 MB at most); beyond, rounds join by shuffle.
DEAL, SENT = 200_000, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'> \t\r\n]+)"""


def split_url(df: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    df = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    return df.withColumn("host", F.translate("__host", _UPPER, _LOWER)).withColumn("path", F.regexp_extract(F.expr("substr(__rest, length(__host) + 1)"), "^[^?#]*", 0)).drop("__rest", "__host")


def rule_for(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, f"{host}{path}").otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def edges(pages: DataFrame, site: int = SITE) -> DataFrame:
    """(src, dst, forth, back): links between different hosts, with their share of the source's links out and of the target's links in."""
    out = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    out = out.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    up = hosts.select("host", "n", F.expr("substr(host, instr(host, '.') + 1)").alias("above")).where("instr(host, '.') > 0")
    served = hosts.select(F.col("host").alias("above"), F.lit(True).alias("served"))
    up = up.join(served, "above", "left").where(F.col("served") | (F.size(F.split("above", "[.]")) >= site))
    found = out.union(up.select("host", "above", "n")).union(up.select("above", "host", "n")).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    found = cut(found)
    sums = lambda end, name: found.groupBy(end).agg(F.sum("n").alias(name))  # noqa: E731
    return found.join(sums("src", "n_out"), "src").join(sums("dst", "n_in"), "dst").select("src", "dst", (F.col("n") / F.col("n_out")).alias("forth"), (F.col("n") / F.col("n_in")).alias("back"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, settled: float = SETTLED, sent: int = SENT) -> DataFrame:
    """(host, trust, distrust) from (host, good, bad) and the edges; hosts that are only linked to have no seed."""
    none = F.lit(0.0)
    forth = links.select(F.col("src").alias("from"), F.col("dst").alias("host"), F.col("forth").alias("t"), none.alias("d"))
    back = links.select(F.col("dst").alias("from"), F.col("src").alias("host"), none.alias("t"), F.col("back").alias("d"))
    flows = cut(forth.union(back).groupBy("from", "host").agg((damping * F.sum("t")).alias("t"), (damping * F.sum("d")).alias("d")))
    start = cut(seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")))
    few = max(1, flows.count() // DEAL)
    flows, scores = flows.coalesce(few), start.coalesce(few)
    start, small = scores, start.count() + flows.select("host").distinct().count() <= sent
    while True:
        for _ in range(STEP):
            before = scores
            now = before.withColumnRenamed("host", "from")
            came = flows.join(F.broadcast(now) if small else now, "from").select("host", (F.col("t") * F.col("trust")).alias("trust"), (F.col("d") * F.col("distrust")).alias("distrust"))
            scores = came.union(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        change = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        # scores only grow, as the flows add to the seeds
        change = scores.join(F.broadcast(change) if small else change, "host", "left").withColumn("change", F.greatest(F.col("trust") - F.coalesce("t", none), F.col("distrust") - F.coalesce("d", none)))
        now = cut(change.drop("t", "d").coalesce(few))
        scores = now.select("host", "trust", "distrust")
        if (now.agg(F.max("change")).first()[0] or 0.0) < settled:
            return scores


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (null for an empty host)."""
    rows = split_url(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    rule, verdict = rule_for(rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    share = lambda what: F.avg(F.when(F.col("ruled") == what, 1.0).otherwise(0.0))  # noqa: E731
    seeds = cut(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"), F.count(F.lit(1)).alias("n")))
    scores = propagate(seeds, edges(rows)).join(seeds, "host").select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), "n")
    bad = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    out = salted_join(rows.select("page_id", "host", "path", "rule", "ruled"), cut(scores), "host", "n", ["page_id", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The same with 120 rounds of a recursive table; rules and constants are written out.
OP2_SQL = r"""
WITH RECURSIVE a AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
v(verdict, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
r AS (SELECT page_id, html, host, path, (SELECT max_by(struct_pack(rule := h || s, verdict := v.verdict), length(h || s)) FROM v WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, s)) AS hit FROM p),
seeds AS (SELECT host, avg(CASE WHEN hit.verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good, avg(CASE WHEN hit.verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad, count(*) AS n FROM r WHERE host <> '' GROUP BY 1),
l AS (SELECT host AS src, lower(unnest(regexp_extract_all(coalesce(html, ''), '(?i)href[ 	
]*=[ 	
]*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''> 	
]+)', 1))) AS dst FROM r),
up AS (SELECT host, substr(host, strpos(host, '.') + 1) AS above, n FROM seeds WHERE strpos(host, '.') > 0),
u AS (SELECT * FROM up WHERE above IN (SELECT host FROM seeds) OR len(string_split(above, '.')) >= 3),
e AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, 1 AS n FROM l WHERE src <> '' AND src <> dst UNION ALL SELECT host, above, n FROM u UNION ALL SELECT above, host, n FROM u) GROUP BY 1, 2),
w AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM e),
f AS (SELECT a, b, sum(t) AS t, sum(d) AS d FROM (SELECT src AS a, dst AS b, 0.85 * forth AS t, 0.0 AS d FROM w UNION ALL SELECT dst, src, 0.0, 0.85 * back FROM w) GROUP BY 1, 2),
sc AS (SELECT 0 AS round, host, good AS trust, bad AS distrust FROM seeds
 UNION ALL SELECT any_value(round) + 1, host, sum(t), sum(d) FROM (SELECT sc.round, b AS host, f.t * sc.trust AS t, f.d * sc.distrust AS d FROM sc JOIN f ON f.a = sc.host UNION ALL SELECT k.round, host, good, bad FROM seeds CROSS JOIN (SELECT DISTINCT round FROM sc) k) x WHERE round < 120 GROUP BY host)
SELECT page_id, r.host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN distrust > 0.5 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN (SELECT * FROM sc WHERE round = 120) z ON z.host = r.host
"""
