"""URL filtering by rules and by empirical-Bayes host reputation.

Labelled pages (bad or not) are counted by host, registered domain and suffix. Each
level's rate gets a beta prior centred on the posterior mean of the level above it: the
global rate over the suffix, the suffix over the registered domain, that over the host.
A prior's strength is fitted per level by moments of the beta-binomial from the counts of
all groups of that level. A page whose url no rule fits is blocked if the lower bound of
its host's posterior (mean less `z` standard deviations) is above `most_bad`: a host with
few labels is drawn to its domain and suffix, and is not blocked on a bare suspicion.

Rules are (host, path, verdict): a rule fits its host and all subdomains if the url's path
starts with the rule's; the longest rule wins, of equally long ones the first by text.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: what
follows up to `?`, `#` or the end. Registered domain: the last two labels (three under the
second-level suffixes given), suffix: what follows its first label.

Counts by host are grouped with map-side sums; levels above the host have fewer rows.
Pages meet their host's posterior in a join that Spark may split where a host is hot.

Defined results: a url that is null or has no `://` has empty host and path; such pages
share one group. Pages without a label, or with several (repeated label rows), count as
their label rows say: none, or each. Without any label no page is blocked by reputation.
Repeated page rows each get a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Some suffixes of two labels under which domains are registered
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*second_level), F.substring_index(host, ".", -3)).otherwise(two)


def suffix(domain: Column) -> Column:
    return F.regexp_replace(domain, r"^[^.]*\.", "")


def rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The rule that fits, and its verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def fitted(groups: DataFrame) -> DataFrame:
    """One row: a level's rate over all, and its prior strength by moments of the beta-binomial.

    With rate m and between-group variance v of the true rates, the strength is m(1-m)/v - 1, within [1, 1e6].
    """
    sums = groups.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("S"))
    m = F.try_divide("B", "N")
    within = F.col("S") - F.col("N") * m * m  # sum over groups of n (rate - m)^2
    spread = F.try_divide(within - (F.col("k") - 1) * m * (1 - m), F.col("N") - F.try_divide("N2", "N"))  # null for a single group
    raw = F.when((spread > 0) & (m > 0) & (m < 1), m * (1 - m) / spread - 1).otherwise(F.lit(1e6))
    return sums.select(F.least(F.greatest(raw, F.lit(1.0)), F.lit(1e6)).alias("strength"), F.coalesce(m, F.lit(0.0)).alias("rate"))


def posteriors(outcomes: DataFrame, z: float = 2.0) -> DataFrame:
    """From rows (host, domain, suffix, n, bad), one a host: host with mean, low and high of its posterior bad rate."""
    levels = {c: outcomes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) for c, keys in (("suffix", ["suffix"]), ("domain", ["domain", "suffix"]), ("host", ["host", "domain", "suffix"]))}
    fits = {c: fitted(x.where("n > 0")).first() for c, x in levels.items()}  # three rows of two numbers
    rate, below = fits["suffix"]["rate"], None
    for c, x in levels.items():
        s = F.lit(float(fits[c]["strength"] if fits[c]["strength"] is not None else 1e6))
        if below is None:
            x = x.withColumn("prior", F.lit(float(rate or 0.0)))
        else:
            on = "suffix" if c == "domain" else "domain"
            x = x.join(below, on)
        total = s + F.col("n")
        mean = (s * F.col("prior") + F.col("bad")) / total
        x = x.withColumn("mean", mean).withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1)))
        below = x.select(F.col(c), F.col("mean").alias("prior"))
        if c == "host":
            return x.select("host", F.col("n").alias("labelled"), F.col("mean").alias("bad_mean"), (F.col("mean") - z * F.col("sd")).alias("bad_low"), (F.col("mean") + z * F.col("sd")).alias("bad_high"))
    raise AssertionError


def judge(pages: DataFrame, outcomes: DataFrame, id_: str = "page_id", url: str = "url", rules: tuple = RULES, z: float = 2.0, most_bad: float = 0.35) -> DataFrame:
    """For each page: id, host, path, rule, verdict, and its host's posterior (bad_mean, bad_low, bad_high, labelled).

    outcomes: rows (id, bad) of labelled pages, bad 0 or 1.
    """
    own = pages.select(F.col(id_).alias("_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    seen = outcomes.select(F.col(id_).alias("_labelled"), F.col("bad").cast("bigint").alias("bad")).where("bad is not null")
    counted = own.join(seen, F.col("_id") == F.col("_labelled"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counted = counted.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("domain")))
    known = posteriors(counted, z)
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    out = own.join(known, "host", "left")
    learned = F.when(F.col("bad_low") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("_id").alias(id_), "host", "path", name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "labelled", "bad_mean", "bad_low", "bad_high")


def report(pages: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """judge() with a page's outcome from the quality label of the same id: bad where quality is 0 or the page is toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
    return judge(pages, outcomes, **options).select("page_id", "host", "path", "rule", "verdict", "labelled", F.round("bad_mean", 6).alias("bad_mean"))


def _oracle(rules: tuple = RULES, z: float = 2.0, most_bad: float = 0.35) -> str:
    """DuckDB's equivalent of report() over pages and labels."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ordered]
    name = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True))
    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    three = "array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')"

    def fitted(level: str) -> str:
        m = "(sum(bad) / sum(n))"
        spread = f"((sum(bad * bad / n) - sum(n) * {m} * {m}) - (count(*) - 1) * {m} * (1 - {m})) / (sum(n) - sum(n * n) / sum(n))"
        return f"SELECT least(greatest(CASE WHEN {spread} > 0 AND {m} > 0 AND {m} < 1 THEN {m} * (1 - {m}) / ({spread}) - 1 ELSE 1e6 END, 1.0), 1e6) AS s, {m} AS rate FROM {level} WHERE n > 0"

    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT doc_id, CAST(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 AS INTEGER) AS b FROM labels),
h0 AS (SELECT host, CAST(count(b) AS DOUBLE) AS n, CAST(coalesce(sum(b), 0) AS DOUBLE) AS bad FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, CASE WHEN {two} IN ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) THEN {three} ELSE {two} END AS domain FROM h0),
h AS (SELECT *, regexp_replace(domain, '^[^.]*\.', '') AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
fx AS ({fitted("x")}), fd AS ({fitted("d")}), fh AS ({fitted("h")}),
px AS (SELECT suffix, (fx.s * coalesce(fx.rate, 0) + bad) / (fx.s + n) AS m FROM x, fx),
pd AS (SELECT domain, (fd.s * px.m + bad) / (fd.s + n) AS m FROM d JOIN px USING (suffix), fd),
ph AS (SELECT host, n, (fh.s * pd.m + bad) / (fh.s + n) AS m, fh.s + n AS total FROM h JOIN pd USING (domain), fh)
SELECT page_id, p.host, path, CASE {name} END AS rule,
  coalesce(CASE {verdict} END, CASE WHEN m - {z} * sqrt(m * (1 - m) / (total + 1)) > {most_bad} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n AS BIGINT) AS labelled, round(m, 6) AS bad_mean
FROM p JOIN ph USING (host)
""".replace("(host = '", "(p.host = '").replace("ends_with(host", "ends_with(p.host")


ORACLE = _oracle()
