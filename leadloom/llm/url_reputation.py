"""URL filtering: allow and block rules, then an empirical-Bayes reputation of the host."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and the path up to ``?`` or ``#``; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    value = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(value, pattern, 1), UPPER, LOWER), F.regexp_extract(value, pattern, 2)


def matching_rule(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, as struct(rule, verdict); null when none does.

    ``rules`` is an argument of the job, so it becomes part of the plan.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _concentration(children: DataFrame, most: float) -> DataFrame:
    """Prior strength from the spread of the children's rates (moments of the beta-binomial), one row.

    Sums are of whole numbers or ratios of them; the strength lies in 1..``most``,
    and is ``most`` where the rates spread no more than chance would have it.
    """
    with_data = children.filter("n > 0")
    s = with_data.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"),
                      F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    n, k, m = F.col("n").cast("double"), F.col("k").cast("double"), F.col("m").cast("double")
    p = k / n
    spread, chance = F.col("kk") - k * p, p * (1 - p)
    bottom = chance * (n - F.col("nn") / n - (m - 1))
    rho = F.when(bottom > 0, (spread - chance * (m - 1)) / bottom)
    strength = F.when(rho > 1 / (most + 1), F.greatest(F.lit(1.0), 1 / rho - 1)).otherwise(F.lit(most))
    return s.select(F.coalesce(strength, F.lit(float(most))).alias("strength"))


def reputation(outcomes: DataFrame, two_label_suffixes: tuple[str, ...] = ("co.uk", "com.au", "co.jp", "com.br"),
               z: float = 1.645, most: float = 1000.0) -> DataFrame:
    """One row per host of ``outcomes`` (host string, bad boolean or null): host, domain, suffix, n_pages, n, k, mean, lower, upper.

    n and k count labelled and bad pages.  A host's bad rate is a beta posterior
    whose prior is its registered domain's posterior mean, which has the
    suffix's for prior, which has the overall rate; each level's strength is
    estimated from the spread of its children.  ``lower`` and ``upper`` are the
    posterior mean less and plus ``z`` standard deviations.  Hosts without any
    label take their domain's mean.  No labels at all give a mean of one half.
    """
    labels = F.split("host", r"\.")
    n_suffix = F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(*two_label_suffixes), 2).otherwise(1) if two_label_suffixes else F.lit(1)
    tail = lambda n: F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")).otherwise(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"),
                                         F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    hosts = hosts.withColumn("suffix", F.when(n_suffix == 2, tail(2)).otherwise(tail(1))) \
                 .withColumn("domain", F.when(n_suffix == 2, tail(3)).otherwise(tail(2)))
    total = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("suffix", "domain").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    overall = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("p"))

    def shrink(prior: Column, strength: DataFrame) -> Column:
        return (F.col("k") + strength.scalar() * prior) / (F.col("n") + strength.scalar())

    at_suffix = suffixes.select("suffix", shrink(overall.scalar(), _concentration(suffixes, most)).alias("suffix_mean"))
    at_domain = domains.join(at_suffix, "suffix").select("domain", shrink(F.col("suffix_mean"), _concentration(domains, most)).alias("domain_mean"))
    strength = _concentration(hosts, most).scalar()
    out = hosts.join(at_domain, "domain")
    a, b = F.col("k") + strength * F.col("domain_mean"), F.col("n") - F.col("k") + strength * (1 - F.col("domain_mean"))
    out = out.withColumn("mean", a / (a + b)).withColumn("_sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (a + b + 1)))
    return out.select("host", "domain", "suffix", "n_pages", "n", "k", "mean",
                      (F.col("mean") - z * F.col("_sd")).alias("lower"), (F.col("mean") + z * F.col("_sd")).alias("upper"))


def judge(pages: DataFrame, rules: list[Rule], id: str = "page_id", url: str = "url", bad: str | None = None,
          block_above: float = 0.5, hot_share: int = 1000, **options) -> DataFrame:
    """One row per page: id, url, host, path, rule, verdict, posterior mean and bounds.

    The longest fitting rule decides; otherwise a page is blocked when the lower
    bound of its host's bad rate is above ``block_above``, so a host goes only
    on evidence.  Labelled outcomes are the boolean column ``bad``, or, without
    one, the verdicts of the rules on the pages that they fit: hosts are judged
    by their other pages.  Null or odd urls have host and path '' and are judged
    as that host.  Repeated rows are judged alike, and count as outcomes each.

    Hosts with more than 1/``hot_share`` of all pages (fewer than ``hot_share``
    rows, hence the broadcast) are joined map-side; the other pages are joined
    by host, which no longer skews.  ``html`` is never read.
    """
    host, path = host_and_path(url)
    outcome = F.col(bad).cast("boolean") if bad else F.lit(None).cast("boolean")
    rows = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"), outcome.alias("_bad"))
    rows = rows.withColumn("_rule", matching_rule(rules))
    label = F.col("_bad") if bad else (F.col("_rule.verdict") == "block")
    known = reputation(rows.select("host", label.alias("bad")), **options)
    facts = F.struct("mean", "lower", "upper")
    total = rows.agg(F.count("*")).scalar()
    hot = known.filter(F.col("n_pages") > total / hot_share).select("host", facts.alias("_hot"))
    cold = known.filter(F.col("n_pages") <= total / hot_share).select(F.col("host").alias("_key"), facts.alias("_cold"))
    joined = rows.join(F.broadcast(hot), "host", "left")
    apart = F.concat(F.lit("://"), F.xxhash64("_id", "_url").cast("string"))  # no host has a slash
    joined = joined.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("host")).otherwise(apart)).join(cold, "_key", "left")
    joined = joined.withColumn("_facts", F.coalesce("_hot", "_cold"))
    method = F.when(F.col("_facts.lower") > block_above, "block").otherwise("allow")
    return joined.select(F.col("_id").alias(id), F.col("_url").alias(url), "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce(F.col("_rule.verdict"), method).alias("verdict"),
                         F.col("_facts.mean").alias("bad_rate"), F.col("_facts.lower").alias("bad_rate_lower"),
                         F.col("_facts.upper").alias("bad_rate_upper"))
