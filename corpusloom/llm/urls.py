"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import FID, ROW, anchored, named, small_side, stable_rows

#: Hex digits of a digest that rules and URLs are joined on.
PREFIX_HEX = 8
#: The default rules: a host, or host and path, and what to do. A rule covers all hosts below its own and all paths that it is a prefix of.
RULES: list[tuple[str, str]] = [
    *((f"{name}.example.{top}/", "block") for name in ("adult-x", "casino-win", "cheap-pills", "spam-farm") for top in ("com", "net", "org")),
    *((f"{name}.example.{top}/en/1/", "allow") for name in ("casino-win", "cheap-pills") for top in ("com", "net", "org")),
    ("example.org/private/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "expression string, action string")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Canonical host, path and query of a URL; an empty host where there is none.

    Blanks around, tabs, newlines, the fragment, the scheme, user and port go; the host is in lower case without
    outer or repeated dots, the path percent-decoded once, if it can be, with single slashes.
    """
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"[\t\r\n]", ""), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "")
    authority = F.regexp_extract(u, r"^[^/?]*", 0)
    rest = F.substr(u, F.length(authority) + 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+", "."), r"^\.|\.$", "")
    path, query = F.regexp_extract(rest, r"^[^?]*", 0), F.regexp_extract(rest, r"\?.*$", 0)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return host, F.regexp_replace(F.concat(F.lit("/"), plain), r"/+", "/"), query


def expressions(host: Column, path: Column, query: Column, labels: list[int], depths: list[int]) -> Column:
    """The host's suffixes and the path's prefixes that a rule can be, as (expression, host length, path length).

    Suffixes have one of the numbers of labels, two at least, or are the host itself, whatever it is; each comes with the
    path and query, the path, and the prefixes that end in a slash and have one of the numbers of slashes.
    """
    parts, steps = F.split(host, r"\."), F.split(path, "/")
    number = F.regexp_like(host, F.lit(r"^[0-9.]+$")) | F.contains(host, F.lit(":"))
    own = [F.lit(n) for n in labels if n > 1]
    fits = F.filter(F.array(*own).cast("array<int>"), lambda n: (n < F.size(parts)) & ~number)
    hosts = F.concat(F.array(host), F.transform(fits, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")))
    deep = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda k: k < F.size(steps))
    prefixes = F.transform(deep, lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))
    paths = F.array_distinct(F.concat(prefixes, F.array(path), F.array(F.concat(path, query))))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(F.concat(h, p).alias("expression"), F.length(h).alias("h"), F.length(p).alias("p")))))


def shapes(rules: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels and of slashes that the rules have: as many at most as the longest rule has."""
    slash = F.instr("expression", "/")
    host = F.when(slash > 0, F.substring("expression", 1, slash - 1)).otherwise(F.col("expression"))

    def many(c: Column, sign: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))

    found = rules.agg(F.collect_set(many(host, ".") + 1).alias("labels"), F.collect_set(F.when(F.endswith("expression", F.lit("/")), many(F.col("expression"), "/"))).alias("depths")).first()
    return sorted(found.labels), sorted(found.depths)


def filtered(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, rule, action`` for every row: the rule that decides, or a null rule and "keep".

    Of several rules the one with the longest host decides, then the longest path, then "allow" over any other
    action, then the least action by name. A null URL, or one without a host, matches no rule. Rules with a null
    are left out, repeated rules count once. Repeated rows are decided each. Other columns are ignored, whatever
    their names. An empty table gives an empty result. Full digests are compared, so two expressions of one hash
    prefix aren't mixed up. Of a URL only what has the shape of a rule is expanded. Rules are counted, and broadcast only if they are few.
    """
    pages, url = anchored(pages), F.col(named(url_col))
    host, path, query = parts(url)
    rows = stable_rows(pages, F.col(named(id_col)).alias("page_id"), url.alias("url"))
    rules = rules.select("expression", "action").where("expression is not null and action is not null").distinct()
    labels, depths = shapes(rules)
    cut = stable_rows(pages.where(url.isNotNull()), host.alias("host"), path.alias("path"), query.alias("query")).where("host <> ''")
    each = cut.select(FID, ROW, F.explode(expressions(F.col("host"), F.col("path"), F.col("query"), labels, depths)).alias("e"))
    each = each.select(FID, ROW, "e.*").withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    known = rules.select(F.col("expression").alias("rule"), "action", F.sha2("expression", 256).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    hits = each.join(small_side(known, known.count()), "short").where("digest = full")
    first = F.struct(F.col("h"), F.col("p"), (F.col("action") == "allow").alias("allow"), F.expr("transform(split(action, ''), c -> -ascii(c))").alias("least"), "rule", "action")
    best = hits.groupBy(FID, ROW).agg(F.max(first).alias("b")).select(FID, ROW, "b.rule", "b.action")
    joined = rows.join(best, [FID, ROW], "left")
    return joined.select("page_id", "url", "rule", F.coalesce("action", F.lit("keep")).alias("action"))


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL for ``filtered`` over pages, with the rules written out; it compares expressions, without hashes."""
    values = ", ".join(f"('{e}', '{a}')" for e, a in rules)
    return rf"""
    WITH rules(rule, action) AS (VALUES {values}),
    a AS (SELECT row_number() OVER () AS n, page_id, url,
                 regexp_replace(regexp_replace(regexp_replace(trim(url), '[\t\r\n]', '', 'g'), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:/*', '') AS u FROM pages),
    b AS (SELECT *, regexp_extract(u, '^[^/?]*') AS authority FROM a),
    c AS (SELECT *, substr(u, length(authority) + 1) AS rest,
                 regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '\.+', '.', 'g'), '^\.|\.$', '', 'g') AS host FROM b),
    d AS (SELECT *, regexp_replace('/' || url_decode(replace(regexp_extract(rest, '^[^?]*'), '+', '%2B')), '/+', '/', 'g') AS path, regexp_extract(rest, '\?.*$') AS query FROM c WHERE host <> ''),
    e AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS steps FROM d),
    h AS (SELECT *, unnest(range(0, CASE WHEN regexp_matches(host, '^[0-9.]+$') OR contains(host, ':') THEN 1 ELSE greatest(len(labels) - 2, 0) + 1 END)) AS k FROM e),
    p AS (SELECT n, array_to_string(labels[k + 1:], '.') AS hs,
                 unnest(list_distinct(list_concat(list_transform(range(1, len(steps)), lambda i: array_to_string(steps[1:i], '/') || '/'), [path, path || query]))) AS ps FROM h),
    m AS (SELECT n, rule, action, row_number() OVER (PARTITION BY n ORDER BY length(hs) DESC, length(ps) DESC, action = 'allow' DESC, action) AS r
          FROM p JOIN (SELECT DISTINCT * FROM rules) ON rule = hs || ps)
    SELECT page_id, url, rule, coalesce(action, 'keep') AS action FROM a LEFT JOIN m ON m.n = a.n AND r = 1"""
