"""URL filters by rules and empirical-Bayes host reputation (operator 4).

Labelled page outcomes (bad or not) are counted by host, registered domain (its last two labels) and suffix (its last
label). Each level is a beta-binomial: a unit's prior has the posterior mean of the unit above it, and one strength for the
level, found by moments from how much more the units differ than chance allows. A host without labels has its domain's
posterior, and so on up to the whole corpus. An url is blocked if even the lower bound of its host's bad rate is over the
limit; rules, of which the longest that fits wins, decide first.

Null urls and those without ``://`` have an empty host and path and are judged as the corpus is. Outcomes with null are left
out; of several of one page the bad one counts. Repeated rows are judged each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut

#: Contract rules: action, host, beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LIMIT = 0.2
Z = 1.6448536269514722
#: Bounds of a level's strength, in pseudo-counts.
WEAKEST, STRONGEST = 1.0, 1000.0
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEVELS = ("suffix", "domain", "host")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its action; null without any."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def with_levels(df: DataFrame) -> DataFrame:
    return df.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})


def reputation(outcomes: DataFrame) -> dict[str, DataFrame]:
    """For each level the posterior ``a, b`` of each unit with outcomes (``host``, ``bad`` 0 or 1), and ``corpus`` for all."""
    # one row for each host; written, as each level below is, for the next ones use it several times
    hosts = cut(with_levels(outcomes).groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("k")))
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    above = whole.select((F.col("k") + 0.5).alias("a"), (F.col("n") - F.col("k") + 0.5).alias("b"))
    found = {"corpus": above}
    upper: str | None = None
    for level in LEVELS:
        keys = [level] if upper is None else [level, upper]
        units = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        mean = above.select(*([upper] if upper else []), (F.col("a") / (F.col("a") + F.col("b"))).alias("p"))
        units = units.join(mean, upper) if upper else units.crossJoin(F.broadcast(mean))  # one row
        spread = F.col("n") * F.col("p") * (1 - F.col("p"))
        moments = units.agg(
            F.sum(F.pow(F.col("k") - F.col("n") * F.col("p"), F.lit(2.0)) - spread).alias("over"), F.sum((F.col("n") - 1) * spread).alias("room")
        )
        rho = F.when(F.col("room") > 0, F.col("over") / F.col("room")).otherwise(F.lit(0.0))
        strength = moments.select(F.least(F.greatest(F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST)).alias("s"))
        above = units.crossJoin(F.broadcast(strength)).select(  # one row
            level, (F.col("s") * F.col("p") + F.col("k")).alias("a"), (F.col("s") * (1 - F.col("p")) + F.col("n") - F.col("k")).alias("b")
        )
        found[level] = above = cut(above)
        upper = level
    return found


def lower_bound(a: Column, b: Column) -> Column:
    mean = a / (a + b)
    return mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row; ``outcomes`` has ``key`` and ``bad``."""
    host, path = parts(F.col(url))
    seen = pages.select(key, host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).groupBy(key).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = seen.select(key, "host").distinct().join(known, key).select("host", "bad")
    levels = reputation(labelled)
    hosts = with_levels(seen.select("host").distinct())
    for level in LEVELS[::-1]:
        hosts = hosts.join(levels[level].select(level, F.struct("a", "b").alias(f"of_{level}")), level, "left")
    hosts = hosts.crossJoin(F.broadcast(levels["corpus"].select(F.struct("a", "b").alias("of_corpus"))))  # one row
    best = F.coalesce(*[F.col(f"of_{x}") for x in (*LEVELS[::-1], "corpus")])
    verdicts = hosts.select("host", F.when(lower_bound(best["a"], best["b"]) > limit, "block").otherwise("allow").alias("learned"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    out = seen.join(verdicts, "host").withColumns({"rule": rule, "verdict": F.coalesce(action, "learned")})
    return out.select(key, "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """DuckDB SQL for ``judged(pages, labels' quality by page_id)``."""
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in ordered) + " END"
    strength = lambda t: f"(SELECT least(greatest(CASE WHEN over_ > 0 AND room > 0 THEN room / over_ - 1 ELSE {STRONGEST} END, {WEAKEST}), {STRONGEST}) FROM (SELECT sum((k - n * p) ** 2 - n * p * (1 - p)) AS over_, sum((n - 1) * n * p * (1 - p)) AS room FROM {t}))"
    ctes, upper = [], None
    for level in LEVELS:
        mean = "(SELECT a / (a + b) FROM corpus)" if upper is None else "any_value(u.a / (u.a + u.b))"
        join = "" if upper is None else f" JOIN {upper}_post u ON u.{upper} = h.{upper}"
        ctes.append(f"{level}_units AS (SELECT h.{level}, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, {mean} AS p FROM hosts h{join} GROUP BY h.{level})")
        ctes.append(f"{level}_post AS (SELECT {level}, s * p + k AS a, s * (1 - p) + n - k AS b FROM {level}_units, (SELECT {strength(level + '_units')} AS s))")
        upper = level
    coalesced = lambda c: f"coalesce(h.{c}, d.{c}, s.{c}, c.{c})"
    return f"""
    WITH seen AS (SELECT page_id, translate(regexp_extract(u, '{URL[4:]}', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(u, '{URL[4:]}', 2, 's') AS path FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
    known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    levels AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM seen),
    hosts AS (SELECT l.host, l.domain, l.suffix, count(*) AS n, sum(bad) AS k
        FROM (SELECT DISTINCT page_id, host FROM seen) s JOIN known USING (page_id) JOIN levels l ON l.host = s.host GROUP BY ALL),
    corpus AS (SELECT coalesce(sum(k), 0) + 0.5::DOUBLE AS a, coalesce(sum(n), 0) - coalesce(sum(k), 0) + 0.5::DOUBLE AS b FROM hosts),
    {", ".join(ctes)},
    best AS (SELECT l.host, {coalesced("a")} AS a, {coalesced("b")} AS b FROM levels l LEFT JOIN host_post h ON h.host = l.host
        LEFT JOIN domain_post d ON d.domain = l.domain LEFT JOIN suffix_post s ON s.suffix = l.suffix, corpus c),
    learned AS (SELECT host, CASE WHEN a / (a + b) - {Z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS learned FROM best)
    SELECT page_id, host, path, {rule} AS rule, coalesce({action}, learned) AS verdict FROM seen JOIN learned USING (host)
    """
