"""URL verdicts: host rules, else a tree of path templates with smoothed purity of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.common import query, table
from lexigrain.session import persisted

#: Verdict, host and path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: So many segments below a node, each with at most so many different urls, become one wildcard.
#: A node with fewer different urls than ``LEAST_KINDS`` is not split further.
LEAST_KINDS, URLS_PER_KIND = 5, 2
#: Sibling branches with so many labelled urls are tested for merging; the factor of Hoeffding's
#: bound at a confidence of 95 %, ``sqrt(ln(2 / 0.05) / 2)``.
LEAST_LABELLED, CONFIDENCE = 5, 1.36
#: Weight of the corpus's share of blocked urls in a purity, and the purity that is rejected.
PRIOR_WEIGHT, REJECTED = 4, 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; rules are a short list."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, value(rule)).otherwise(out)
    return out


def _sign(x: Column, of: Column, all_x: Column, all_of: Column) -> Column:
    """Whether the share ``x / of`` is above (1) or below (-1) the others' by Hoeffding's bound."""
    others = all_of - of
    share, rest = x / of, F.try_divide(all_x - x, others)
    bound = CONFIDENCE * (F.sqrt(1.0 / of) + F.sqrt(F.try_divide(F.lit(1.0), others)))
    return F.when(share - rest > bound, 1).when(rest - share > bound, -1).otherwise(0)


def _compared(branches: DataFrame, *keys: str) -> DataFrame:
    """Each branch against the others of its keys: signs of blocked share and of ended share."""
    pool = branches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), *(F.sum(c).alias(f"all_{c}") for c in "nmbe")
    )
    c = F.col
    return branches.join(pool, list(keys)).select(
        *branches.columns, "members",
        _sign(c("b"), c("m"), c("all_b"), c("all_m")).alias("purer"),
        _sign(c("e"), c("n"), c("all_e"), c("all_n")).alias("ends"),
    )


def branches_of(tree: DataFrame) -> DataFrame:
    """How the next segment of each url is named: ``host, node, s, branch, large``.

    ``tree`` has a row per different url: ``host, node, rest, ruled``. Segments with few urls become
    ``*`` where there are enough of them. Branches with enough labels are held against their
    siblings, by share of blocked and by share of urls that end there; those with the same outcome
    merge, unless a second comparison inside the merged branch tells them apart.
    """
    urls = tree.select("host", "node", F.get("rest", F.lit(0)).alias("s"), "ruled", F.size("rest").alias("left"))
    found = urls.groupBy("host", "node", "s").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ruled").alias("m"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("b"),
        F.count(F.when(F.col("left") == 1, 1)).alias("e"),
    )
    rare = F.col("n") <= URLS_PER_KIND
    found = persisted(found, "url-branches")
    wild = persisted(
        found.filter(rare)
        .groupBy("host", "node")
        .agg(F.count(F.lit(1)).alias("kinds"))
        .filter(F.col("kinds") >= LEAST_KINDS)
        .select("host", "node", F.lit("*").alias("wild")),
        "url-wild",
    )
    named = found.join(wild, ["host", "node"], "left").withColumn(
        "name", F.coalesce(F.when(rare, F.col("wild")), F.col("s"))
    )
    groups = named.groupBy("host", "node", "name").agg(*(F.sum(c).alias(c) for c in "nmbe"))
    groups = persisted(groups, "url-groups")
    tested = _compared(groups.filter(F.col("m") >= LEAST_LABELLED), "host", "node")
    outcome = F.concat_ws("", F.lit("~"), *(F.element_at(F.array(*map(F.lit, "-=+")), F.col(c) + 2) for c in ("purer", "ends")))
    alike = _compared(tested.withColumn("merged", outcome).drop("members", "purer", "ends"), "host", "node", "merged")
    merged = alike.filter("members > 1 AND purer = 0 AND ends = 0").select("host", "node", "name", "merged")
    large = F.col("merged").isNotNull() | (F.col("n") >= LEAST_KINDS)
    final = groups.join(merged, ["host", "node", "name"], "left").select(
        "host", "node", "name", F.coalesce("merged", "name").alias("branch"), large.alias("large")
    )
    return named.select("host", "node", "s", "name").join(final, ["host", "node", "name"]).drop("name")


def _past_common(tree: DataFrame) -> DataFrame:
    """Move nodes that go on in one way to where their urls part: no level for each such segment.

    The first and the last rest of a node share exactly the segments that all of its urls share.
    """
    same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False).cast("int")
    run = F.when(first == 0, F.size(same)).otherwise(first - 1)
    spans = persisted(
        tree.groupBy("host", "node")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        .filter(F.col("n") >= LEAST_KINDS)
        .select("host", "node", run.alias("run"))
        .filter("run > 0"),
        "url-spans",
    )
    shared = F.array_join(F.expr("slice(rest, 1, run)"), "/")
    return tree.join(spans, ["host", "node"], "left").select(
        "host", "path", "ruled",
        F.when(F.col("run").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), shared)).alias("node"),
        F.expr("IF(run IS NULL, rest, slice(rest, run + 1, size(rest)))").alias("rest"),
    )


def templates(urls: DataFrame) -> DataFrame:
    """The template of each different url: ``host, path, ruled, template``.

    ``urls`` has ``host, path, ruled`` without repeats. The tree of a host is walked to its whole
    depth, all hosts at once. A node with fewer than ``LEAST_KINDS`` urls ends there as ``/**``.
    A segment that is itself ``*`` counts with the wildcard.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "").alias("rest")
    tree = persisted(urls.select("host", "path", "ruled", F.lit("").alias("node"), segments), "url-tree")
    done = []
    while True:
        tree = persisted(_past_common(tree), "url-tree")
        done.append(tree.filter(F.size("rest") == 0).select("host", "path", "ruled", F.col("node").alias("template")))
        going = tree.filter(F.size("rest") > 0)
        if going.isEmpty():
            break
        step = going.withColumn("s", F.get("rest", F.lit(0))).join(branches_of(going), ["host", "node", "s"])
        moved = persisted(
            step.select(
                "host", "path", "ruled", "large", F.concat("node", F.lit("/"), "branch").alias("node"),
                F.expr("slice(rest, 2, size(rest))").alias("rest"),
            ),
            "url-tree",
        )
        tail = F.when(F.size("rest") > 0, F.lit("/**")).otherwise("")
        done.append(moved.filter("NOT large").select("host", "path", "ruled", F.concat("node", tail).alias("template")))
        tree = moved.filter("large").drop("large")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def judge(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Verdict on every url: ``page_id, host, path, rule, verdict, template, purity``.

    The longest fitting rule decides. Urls that a rule decides are also the labels of the method
    for the others, which asks for the ``templates`` of each host: a template is rejected when its
    share of blocked among its labelled urls, smoothed by the corpus's share, reaches ``REJECTED``.
    Different urls count, not pages, so no verdict changes when pages recur.

    Columns and aggregates only. Pages whose template has no label are allowed. A url that is null
    or has no ``://`` has an empty host and path and no rule. Repeated rows and null ids each give a
    row; an empty table gives none. Only the two named columns are read. Counts combine before each
    shuffle; joins are with one row per url or branch, so they can be split where a host is hot. A
    very long url costs no levels of its own: there is one for each place where five urls part.
    """
    host, path = parts(F.col(url))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = persisted(
        parsed.select(
            "page_id", "host", "path",
            rule_of(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[1] + r[2])).alias("rule"),
            rule_of(F.col("host"), F.col("path"), rules, lambda r: F.lit(r[0])).alias("ruled"),
        ),
        "urls",
    )
    found = persisted(templates(parsed.select("host", "path", "ruled").distinct()), "url-templates")
    counts = found.groupBy("host", "template").agg(
        F.count(F.when(F.col("ruled") == "block", 1)).alias("b"), F.count("ruled").alias("m")
    )
    counts = persisted(counts, "url-counts")
    total = counts.agg(F.sum("b").alias("b"), F.sum("m").alias("m")).first()
    prior = ((total["b"] or 0) + 1.0) / ((total["m"] or 0) + 2.0)
    purity = (F.col("b") + PRIOR_WEIGHT * prior) / (F.col("m") + PRIOR_WEIGHT)
    method = F.when((F.col("m") > 0) & (purity >= REJECTED), F.lit("block")).otherwise(F.lit("allow"))
    judged = counts.select("host", "template", purity.alias("purity"), method.alias("method"))
    of_url = persisted(found.drop("ruled").join(judged, ["host", "template"]), "url-verdicts")
    return parsed.join(of_url, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict"),
        "template", "purity",
    )


def _case(of: int | None) -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    lines = [
        f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') "
        f"THEN '{r[0] if of == 0 else r[1] + r[2]}'"
        for r in rules
    ]
    return "CASE " + " ".join(lines) + " END"


#: Levels that the SQL check spells out, more than the urls of the given tables have.
_SQL_LEVELS = 6


def _sign_sql(x: str, of: str, keys: str) -> str:
    others = f"nullif(sum({of}) OVER (PARTITION BY {keys}) - {of}, 0)::DOUBLE"
    rest = f"((sum({x}) OVER (PARTITION BY {keys}) - {x})::DOUBLE / {others})"
    bound = f"({CONFIDENCE}::DOUBLE * (sqrt(1.0::DOUBLE / {of}) + sqrt(1.0::DOUBLE / {others})))"
    share = f"({x}::DOUBLE / {of})"
    return f"CASE WHEN {share} - {rest} > {bound} THEN '+' WHEN {rest} - {share} > {bound} THEN '-' ELSE '=' END"


def _levels() -> str:
    out = []
    for i in range(1, _SQL_LEVELS + 1):
        out.append(f"""
b{i} AS MATERIALIZED (
  SELECT *, CASE WHEN n <= {URLS_PER_KIND} AND count(*) FILTER (n <= {URLS_PER_KIND})
                      OVER (PARTITION BY host, node) >= {LEAST_KINDS} THEN '*' ELSE s END AS name
  FROM (SELECT host, node, segments[{i}] AS s, count(*) AS n, count(ruled) AS m,
               count(*) FILTER (ruled = 'block') AS b, count(*) FILTER (len(segments) = {i}) AS e
        FROM l{i - 1} WHERE large AND len(segments) >= {i} GROUP BY ALL)),
g{i} AS MATERIALIZED (
  SELECT host, node, name, sum(n) AS n, sum(m) AS m, sum(b) AS b, sum(e) AS e FROM b{i} GROUP BY ALL),
c{i} AS (
  SELECT *, '~' || {_sign_sql("b", "m", "host, node")} || {_sign_sql("e", "n", "host, node")} AS merged
  FROM g{i} WHERE m >= {LEAST_LABELLED}),
d{i} AS (
  SELECT *, {_sign_sql("b", "m", "host, node, merged")} || {_sign_sql("e", "n", "host, node, merged")} AS inner_test,
         count(*) OVER (PARTITION BY host, node, merged) AS members FROM c{i}),
m{i} AS MATERIALIZED (
  SELECT b.host, b.node, b.s, coalesce(d.merged, b.name) AS branch,
         d.merged IS NOT NULL OR g.n >= {LEAST_KINDS} AS large
  FROM b{i} b JOIN g{i} g ON b.host = g.host AND b.node = g.node AND b.name = g.name
  LEFT JOIN (SELECT * FROM d{i} WHERE members > 1 AND inner_test = '==') d
    ON b.host = d.host AND b.node = d.node AND b.name = d.name),
l{i} AS MATERIALIZED (
  SELECT l.host, path, ruled, segments, CASE WHEN s IS NULL THEN l.node ELSE l.node || '/' || branch END AS node,
         CASE WHEN s IS NULL THEN false ELSE m.large END AS large, depth + CASE WHEN s IS NULL THEN 0 ELSE 1 END AS depth
  FROM l{i - 1} l LEFT JOIN m{i} m ON l.large AND l.host = m.host AND l.node = m.node AND segments[{i}] = s),""")
    return "".join(out)


@query(
    rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END
         AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {_case(1)} AS rule, {_case(0)} AS ruled FROM parsed),
l0 AS (
  SELECT DISTINCT host, path, ruled, [s for s in string_split(path, '/') if s <> ''] AS segments,
         '' AS node, true AS large, 0 AS depth FROM ruled),
{_levels()}
named AS (
  SELECT *, node || CASE WHEN depth < len(segments) THEN '/**' ELSE '' END AS template FROM l{_SQL_LEVELS}),
counts AS (
  SELECT host, template, count(*) FILTER (ruled = 'block') AS b, count(ruled) AS m FROM named GROUP BY ALL),
prior AS (
  SELECT {PRIOR_WEIGHT} * ((coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(m), 0) + 2.0::DOUBLE))
         AS p FROM counts)
SELECT page_id, r.host, r.path, rule, n.template,
       coalesce(r.ruled, CASE WHEN m > 0 AND (b + p) / (m + {PRIOR_WEIGHT}) >= {REJECTED}
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN named n ON r.host = n.host AND r.path = n.path
JOIN counts c ON n.host = c.host AND n.template = c.template, prior
"""
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return judge(table(spark, sf_dir, "pages")).drop("purity")
