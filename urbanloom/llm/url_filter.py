"""URL filter: rules by host and path, then an empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the registered query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labels under a country's that are suffixes with it.
GENERAL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end. Both empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def first_rule(host: Column, path: Column, rules: tuple) -> Column:
    """The longest fitting rule as struct(long, rule, verdict), or null: it fits its host and all subdomains, if the path starts with its own."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("long"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def name_levels(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host, without user names and ports.

    The suffix is the last label, or the last two where a country's label follows a general one (``co.uk``); the domain
    is the suffix with the label before it. Addresses of numbers are their own domain under the suffix ``ip``.
    """
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, "[.]")
    n = F.size(labels)
    general = (n >= 3) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, n - 2).isin(*GENERAL)
    of = F.when(general, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    address = name.rlike(r"^[0-9.]+$") | name.startswith("[")
    return F.when(address, "ip").otherwise(last(of)), F.when(address, name).otherwise(last(of + 1))


def _strengths(units: DataFrame) -> DataFrame:
    """One row ``m``: for each level the mean of its units' rates and the strength of their beta prior, by the moments of the beta-binomial."""
    n, y = F.col("n"), F.col("bad")
    total = units.groupBy("level").agg(F.sum(n).alias("sn"), F.sum(y).alias("sy"), F.sum(n * n).alias("snn"), F.sum(y * y / n).alias("syy"), F.count(F.lit(1)).alias("k"))
    p = F.try_divide("sy", "sn")
    noise = p * (1 - p)
    spread = F.col("syy") - F.col("sn") * p * p
    rho = F.try_divide(spread - noise * (F.col("k") - 1), noise * (F.col("sn") - F.try_divide("snn", "sn") - F.col("k") + 1))
    rho = F.least(F.greatest(F.coalesce(F.nanvl(rho, F.lit(0.01)), F.lit(0.01)), F.lit(0.005)), F.lit(0.9))
    return total.agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct((1 / rho - 1).alias("strength"), F.coalesce(p, F.lit(0.0)).alias("mean"))))).alias("m"))


def host_reputation(hosts: DataFrame, bound: float = 1.645, limit: float = 0.35) -> DataFrame:
    """(host, rate, lower, blocked) of each distinct host from (host, n, bad), n its labelled pages, bad those labelled 0.

    The rate of each suffix is shrunk to the rate of all pages, that of each registered domain to its suffix, that of
    each host to its domain, each through a beta prior whose strength the moments of that level give. A host is blocked
    if its posterior mean less ``bound`` standard deviations is over ``limit``. Without any labelled page nothing is.
    """
    suffix, domain = name_levels(F.col("host"))
    h = hosts.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain"))
    level = lambda name, unit, above: F.struct(F.lit(name).alias("level"), F.col(unit).alias("unit"), above.alias("above"))
    each = F.explode(F.array(level("suffix", "suffix", F.lit("")), level("domain", "domain", F.col("suffix")), level("host", "host", F.col("domain"))))
    units = h.where("n > 0").select(each.alias("u"), "n", "bad").groupBy("u.level", "u.unit", "u.above").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    model = _strengths(units).scalar()
    strength = lambda name: F.coalesce(F.try_element_at(model, F.lit(name)).strength, F.lit(1.0))
    base = F.coalesce(F.try_element_at(model, F.lit("suffix")).mean, F.lit(0.0))
    shrunk = lambda name, prior: (F.col("bad") + strength(name) * prior) / (F.col("n") + strength(name))
    suffixes = units.where("level = 'suffix'").select(F.col("unit").alias("suffix"), shrunk("suffix", base).alias("suffix_rate"))
    domains = units.where("level = 'domain'").withColumnRenamed("above", "suffix").join(suffixes, "suffix").select(F.col("unit").alias("domain"), shrunk("domain", F.col("suffix_rate")).alias("domain_rate"))
    rated = h.join(suffixes, "suffix", "left").join(domains, "domain", "left").withColumn("prior", F.coalesce("domain_rate", "suffix_rate", base))
    rated = rated.select("host", shrunk("host", F.col("prior")).alias("rate"), (F.col("n") + strength("host")).alias("weight"))
    lower = F.col("rate") - bound * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return rated.select("host", "rate", lower.alias("lower"), (lower > limit).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url: str = "url", outcome_id: str = "doc_id", outcome: str = "quality") -> DataFrame:
    """(id, host, path, rule, verdict) of every page: the longest fitting rule's verdict, else the reputation's.

    ``outcomes`` are labelled pages (``outcome_id`` equals the page's id; 1 good, 0 bad; null is no outcome; repeated
    ones count each). Pages without a host, or with a host of which nothing is known, are judged by the prior of the
    level above. Repeated pages stay; of rules as long as each other the later by name wins; urls of any length are taken
    whole; only the named columns are read; an empty table gives no rows.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("_rule", first_rule(F.col("host"), F.col("path"), rules))
    known = outcomes.where(F.col(outcome).isNotNull()).select(F.col(outcome_id).alias(id_col), (1 - F.col(outcome)).alias("_bad"))
    evidence = rows.join(known, id_col).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(evidence, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    judged = host_reputation(hosts).select("host", F.when(F.col("blocked"), "block").otherwise("allow").alias("_judged"))
    return rows.join(judged, "host", "left").select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.col("_judged"), F.lit("allow")).alias("verdict"))
