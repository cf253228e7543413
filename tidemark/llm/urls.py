"""URL filter: hand-written rules first, else an empirical-Bayes reputation of the host.

Each labelled page is a trial that ends well or badly. Its outcomes are counted per host, and the
badness of a host is shrunk to that of its registered domain, that to the public suffix, that to
all pages. The strength of each prior is estimated from the spread of the groups under it (method of moments for
the beta-binomial). A host is blocked when the lower bound of its posterior badness exceeds a
limit, so a host without many bad pages is let through. A host without labelled pages has the mean of its domain, else of
its suffix, else of all pages, with the strength of the prior that has this mean.

Labels name documents; a page is taken to be labelled by the row with its own id (``doc_id = page_id``).

Null urls and urls without ``://`` have an empty host and path. Repeated pages count once for each
row, repeated labels of a page as one (bad if any is). Without labels nothing is blocked but by rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import require
from tidemark.plans.stage import stored

# Second labels that countries register domains under.
SECOND_LEVEL = "ac co com edu go gob gov ltd me mil ne net nom or org plc sch".split()

#: A public suffix of two labels: such a second label under a country's two letters.
TWO_LABELS = rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and all paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user part, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?\.?$", "")


def suffix_of(bare: Column) -> Column:
    last_two = F.substring_index(bare, ".", -2)
    return F.when(F.rlike(last_two, F.lit(TWO_LABELS)), last_two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(bare: Column) -> Column:
    last_two = F.substring_index(bare, ".", -2)
    return F.when(F.rlike(last_two, F.lit(TWO_LABELS)), F.substring_index(bare, ".", -3)).otherwise(last_two)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls. ``rules`` is a short list."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, suffix, domain, n, bad`` of every host: labelled pages and the bad ones among them."""
    judged = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(((F.coalesce("toxic", F.lit(0)) > 0) | (F.coalesce("quality", F.lit(1)) == 0)).cast("long")).alias("bad")
    )
    bare = bare_host(F.col("host"))
    return (
        pages.select("page_id", host_of(F.col("url")).alias("host"))
        .join(judged, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"suffix": suffix_of(bare), "domain": domain_of(bare)})
    )


def _shrink(groups: DataFrame, mean: Column, level: str) -> DataFrame:
    """Adds ``{level}_mean`` and ``{level}_strength`` to groups that carry ``n, bad`` and the mean above them.

    Groups without labels add nothing to the strength and get the mean above them.
    """
    v = mean * (1 - mean)
    # One number; joining it as a row would be a nested loop.
    rho = groups.agg(
        (F.sum((F.col("bad") - F.col("n") * mean) ** 2) - F.sum(F.col("n") * v)) / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * v), F.lit(0.0))
    ).first()[0]
    s = F.lit(1 / min(max(0.01 if rho is None else rho, 0.01), 0.99) - 1)
    return groups.withColumn(f"{level}_strength", s).withColumn(f"{level}_mean", (s * mean + F.col("bad")) / (s + F.col("n")))


def reputations(pages: DataFrame, labels: DataFrame, z: float = 1.645) -> DataFrame:
    """``host, n, bad, bound``: the posterior lower bound of badness of each host."""
    hosts = stored(outcomes(pages, labels), "hosts")
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrink(suffixes, F.lit(((bad or 0) + 1) / ((n or 0) + 2)), "suffix")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    above = suffixes.select("suffix", "suffix_mean", "suffix_strength", F.col("n").alias("suffix_n"))
    domains = _shrink(domains.join(above, "suffix"), F.col("suffix_mean"), "domain")
    above = domains.select("domain", "domain_mean", "domain_strength", "suffix_strength", "suffix_n", F.col("n").alias("domain_n"))
    final = _shrink(hosts.join(above, "domain"), F.col("domain_mean"), "host")
    strength = F.when(F.col("domain_n") > 0, F.col("host_strength")).when(F.col("suffix_n") > 0, F.col("domain_strength"))
    strength = strength.otherwise(F.col("suffix_strength"))
    a = strength * F.col("domain_mean") + F.col("bad")
    both = strength + F.col("n")
    mean = a / both
    bound = mean - z * F.sqrt(mean * (1 - mean) / (both + 1))
    return final.select("host", "n", "bad", F.round(bound, 4).alias("bound"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    limit: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bound`` for every page."""
    require(pages, "page_id", "url")
    require(labels, "doc_id", "quality", "toxic")
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return seen.join(reputations(pages, labels).select("host", "bound"), "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bound"
    )


_TWO = f"regexp_matches(two, '{TWO_LABELS}')"


def _level(name: str, source: str, above: str) -> str:
    v = f"{above} * (1 - {above})"
    return f"""{name}_s AS (SELECT 1 / least(greatest(COALESCE((sum((bad - n * {above}) ** 2) - sum(n * {v}))
  / NULLIF(sum(n * (n - 1) * {v}), 0), 0.01), 0.01), 0.99) - 1 AS s FROM {source}),
{name}_p AS (SELECT t.*, z.s AS {name}_strength, (z.s * {above} + bad) / (z.s + n) AS {name}_mean
  FROM {source} t, {name}_s z)"""


#: DuckDB SQL of the registered query.
SQL = f"""WITH p AS (SELECT page_id, translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
  COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN COALESCE(toxic, 0) > 0 OR COALESCE(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(COALESCE(sum(bad), 0) AS DOUBLE) AS bad FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY 1),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\\.?$', '') AS bare FROM h0),
h2 AS (SELECT *, regexp_extract(bare, '[^.]*\\.?[^.]*$') AS two FROM h1),
h AS (SELECT host, n, bad, CASE WHEN {_TWO} THEN two ELSE regexp_extract(bare, '[^.]*$') END AS suffix,
  CASE WHEN {_TWO} THEN regexp_extract(bare, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE two END AS domain FROM h2),
t AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS all_mean FROM h),
x1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(all_mean) AS all_mean FROM h, t GROUP BY 1),
{_level("suffix", "x1", "all_mean")},
x2 AS (SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(suffix_mean) AS suffix_mean
  FROM h JOIN suffix_p USING (suffix) GROUP BY 1, 2),
{_level("domain", "x2", "suffix_mean")},
x3 AS (SELECT h.*, domain_mean, domain_strength, domain_p.n AS domain_n, suffix_strength, suffix_p.n AS suffix_n
  FROM h JOIN domain_p ON h.domain = domain_p.domain JOIN suffix_p ON h.suffix = suffix_p.suffix),
{_level("host", "x3", "domain_mean")},
x4 AS (SELECT *, CASE WHEN domain_n > 0 THEN host_strength WHEN suffix_n > 0 THEN domain_strength ELSE suffix_strength END AS strength FROM host_p),
post AS (SELECT host, (strength * domain_mean + bad) / (strength + n) AS m, strength + n AS ab FROM x4),
bounds AS (SELECT host, round(m - 1.645 * sqrt(m * (1 - m) / (ab + 1)), 4) AS bound FROM post),
r AS (SELECT p.*, bound, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p LEFT JOIN bounds USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, bound FROM r"""
