"""Secret scans over an incremental ledger of blobs (operator 5), with DataFrame functions alone.

Every version of every path is content-addressed (SHA-256 of its text). A ledger says which rules, by version, each blob
has been scanned with and what they found; only unseen pairs of blob and rule version are scanned, each once however
many paths hold the blob, and findings are joined back to all paths.

A null text is an empty one and has no findings. Repeated rows are repeated in the result. An empty table gives no rows.
Offsets count code points, end exclusive; the matches of one rule never overlap, those of different rules may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java's syntax; a match counts if its ``group`` has ``least`` letters. ``hint``: no match without it."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base rules (the first three) and further formats of well-known credentials; fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, least=12, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", least=16),  # a run of hex digits is one match: [0-9a-f]+ of 16 or more
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
BASE = ("assign", "access", "hex")
#: Places at which the paths of one blob meet its findings.
SALTS = 8
SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def found_by(text: Column, rule: Rule, place: int) -> Column:
    """Spans of one rule: texts between matches and the matches themselves, measured one after the other."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    both = F.arrays_zip(hits.alias("hit"), F.slice(between, F.lit(1), F.size(hits)).alias("before"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        value = F.regexp_extract(x["hit"], rule.pattern, rule.group) if rule.group else x["hit"]
        kept = F.when(F.length(value) >= rule.least, F.array(span)).otherwise(F.array().cast(SPANS))
        return F.struct(end.alias("at"), F.concat(acc["spans"], kept).alias("spans"))

    spans = F.aggregate(both, start, step, lambda acc: acc["spans"])
    there = F.contains(text, F.lit(rule.hint)) if rule.hint else F.lit(True)
    return F.when(there & text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows ``blob, rules, spans``: for each blob the rule versions run now and all that they found."""
    blobs = (
        versions.select(F.coalesce(F.col(text), F.lit("")).alias("body"))
        .select(F.sha2("body", 256).alias("blob"), "body")
        .groupBy("blob")
        .agg(F.any_value("body").alias("body"))
    )
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("rules", every)
    else:  # one short list of rule names a blob
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("rules") > 0)
    nothing = F.array().cast(SPANS)
    spans = [
        found_by(F.col("body"), r, k) if ledger is None else F.when(F.array_contains("rules", r.name), found_by(F.col("body"), r, k)).otherwise(nothing)
        for k, r in enumerate(rules)
    ]
    return todo.select("blob", "rules", F.concat(*spans).alias("spans"))


def advance(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger with what is new in ``versions``; write it where the cluster keeps tables and hand it in next time."""
    new = scan_unseen(versions, ledger, rules, text)
    return new if ledger is None else ledger.select("blob", "rules", "spans").unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All paths of ``versions`` with ``secret_spans``: what rules of the given versions found in their blob, in order. A
    column of that name is replaced."""
    versions = versions.drop("secret_spans")
    names = [r.kind for r in rules]
    wanted = F.array(*[F.lit(x) for x in names])
    some = ledger.where(F.size("spans") > 0).select("blob", "spans")
    some = some.select("blob", F.filter("spans", lambda s: F.array_contains(wanted, s["kind"])).alias("spans"))
    some = some.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("secret_spans"))
    # a blob that very many paths hold is met in several places; findings are few and are sent to each
    others = [c for c in versions.columns if c != text] or [F.rand(0)]
    paths = versions.withColumns({"__blob": F.sha2(F.coalesce(F.col(text), F.lit("")), 256), "__salt": F.pmod(F.xxhash64(*others), F.lit(SALTS))})
    some = some.withColumnRenamed("blob", "__blob").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return paths.join(some, ["__blob", "__salt"], "left").select(*versions.columns, F.coalesce("secret_spans", F.array().cast(SPANS)).alias("secret_spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        key,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("secret_spans")).alias("spans"),
    )


def redacted(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Texts with each found span, overlapping ones together, replaced by ``mark``; ``secret_spans`` goes."""
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    new = F.aggregate("secret_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, new).otherwise(F.col(text))).drop("secret_spans")


def scanned(versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``versions`` with ``secret_spans``, from an empty ledger."""
    return findings(versions, advance(versions, None, rules, text), rules, text)


def _kind_sql(place: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    value = f"regexp_extract(m.hit, '{p}', {r.group})" if r.group else "m.hit"
    return f"""
    SELECT doc_id, {place} AS place, '{r.kind}' AS kind, m.start::BIGINT AS s, (m.start + length(m.hit))::BIGINT AS e
    FROM (SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'hit': hits[i], 'start':
            list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)}})) AS m
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS parts
            FROM d WHERE regexp_matches(t, '{p}')))
    WHERE length({value}) >= {r.least}
    """


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``digest(scanned(documents))``."""
    spans = " UNION ALL ".join(_kind_sql(k, r) for k, r in enumerate(RULES))
    say = "kind || ':' || s || ':' || e"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans}),
    g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
        coalesce(string_agg({say}, ',' ORDER BY s, place) FILTER ({base}), '') AS base,
        string_agg({say}, ',' ORDER BY s, place) AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id
    """
