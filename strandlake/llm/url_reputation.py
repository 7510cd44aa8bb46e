"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are shrunk through beta-binomial priors from
suffix to registered domain to host: at each level the prior's mean is the
parent's posterior mean and its strength is estimated from how much the rates of
the children differ (method of moments). A page is blocked if the lower bound of
its host's posterior rate is above a limit, so hosts with few outcomes follow
their domain and nothing is blocked on thin evidence.

All in DataFrame expressions. Outcomes are counted per host by partial
aggregation before any shuffle, so a host with a third of all pages costs one
row per task, and its pages are dealt out when bounds are looked up. Rules are a
given list, applied as one expression.

Suffixes follow a rule instead of a list of thousands: a generic label under a
country's two letters (``co.uk``, ``com.mx``) and domains whose subdomains belong
to different people (``github.io``) are suffixes, else the last label is. User
names and ports are no part of a domain; an address of numbers is its own domain
under the suffix ``ip``.

Null urls and urls without ``://`` have an empty host and path and are allowed
unless a rule says otherwise. Repeated rows, and rows of a null page_id, are
judged alike, and count as outcomes each. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.lineage import cut
from strandlake.plans.skew import lookup

# Rules as (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Labels that are generic under a country's suffix, and domains whose subdomains belong to different people
GENERIC = tuple("ac art asn co com ed edu gen go gob gouv gov govt gv id in info int ltd me mil ne net nom nhs nic nt oop or org plc pro res sch web".split())
SHARED = (
    "altervista.org", "appspot.com", "azurewebsites.net", "bitbucket.io", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev",
    "free.fr", "github.io", "gitlab.io", "glitch.me", "herokuapp.com", "livejournal.com", "neocities.org", "netlify.app", "onrender.com",
    "pages.dev", "readthedocs.io", "sourceforge.io", "surge.sh", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com",
    "wordpress.com", "workers.dev",
)

#: Block from this lower bound of the bad rate; standard deviations below the posterior mean; bounds of a prior's strength.
LIMIT, DEVIATIONS, WEAKEST, STRONGEST = 0.5, 2.0, 2.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path of a url column."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return pages.withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn(
        "path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    name = verdict = None
    for decision, rule in ordered:
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit(f".{of_host}"))) & F.startswith(path, F.lit(f"/{of_path}"))
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def with_domains(df: DataFrame) -> DataFrame:
    """Adds suffix and registered domain of a host column."""
    plain = F.regexp_replace("host", r"^.*@|:[0-9]*$|\.+$", "")
    labels = F.split(plain, r"\.")
    last, before = F.element_at(labels, -1), F.get(labels, F.size(labels) - 2)
    two = F.concat_ws(".", before, last)
    deep = (last.rlike("^[a-z]{2}$") & F.coalesce(before.isin(*GENERIC), F.lit(False))) | two.isin(*SHARED)
    wide = F.when(deep, 3).otherwise(2)
    numbers = plain.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    return df.withColumns({
        "suffix": F.when(numbers, "ip").when(deep, two).otherwise(last),
        "domain": F.when(numbers, plain).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - wide + 1, F.lit(1)), wide), ".")),
    })


def _shrunk(counts: DataFrame, prior: str | float) -> DataFrame:
    """Adds rate (posterior mean) and sure (posterior strength) from n, bad and the parent's mean ``prior``.

    The strength is k = m (1 - m) / v - 1 with m the mean and v the variance
    between children beyond what chance gives, weighted by outcomes. Only these
    sums, one row, reach the driver.
    """
    given = F.col(prior) if isinstance(prior, str) else F.lit(prior)
    m = F.greatest(F.least(given, F.lit(1 - 1e-6)), F.lit(1e-6))
    sums = counts.where("n > 1").agg(
        F.sum("n"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - m) ** 2), F.sum(m * (1 - m)), F.sum(F.col("n") * m * (1 - m))
    ).first()
    k = STRONGEST
    if sums[0]:
        between = (sums[1] - sums[2]) / sums[0]
        if between > 0:
            k = min(max(sums[3] / sums[0] / between - 1, WEAKEST), STRONGEST)
    rate = (F.col("bad") + k * given) / (F.col("n") + k)
    return counts.withColumn("rate", rate).withColumn("sure", F.col("n") + k)


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound) from outcomes (host, bad as 0 or 1; null is unlabelled)."""
    hosts = outcomes.where("host <> ''").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
    )
    hosts = cut(with_domains(hosts))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("bad"), F.sum("n")).first()
    p0 = ((whole[0] or 0) + 0.5) / ((whole[1] or 0) + 1)
    top = _shrunk(suffixes, p0).select("suffix", F.col("rate").alias("p1"))
    mid = _shrunk(domains.join(top, "suffix"), "p1").select("suffix", "domain", F.col("rate").alias("p2"))
    low = _shrunk(hosts.join(mid, ["suffix", "domain"]), "p2")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("sure") + 1))
    return low.select("host", "n", "bad", "rate", (F.col("rate") - DEVIATIONS * spread).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """Verdict of every row of ``pages`` (page_id, url).

    Returns page_id, url, host, path, rule, verdict and bound (of the host's bad
    rate; null without host). ``outcomes`` has host and bad.
    """
    rows = with_host(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    known = reputation(outcomes).select("host", "bound")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return lookup(rows, known, "host").select(
        "page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound"
    )


def content_outcomes(pages: DataFrame) -> DataFrame:
    """(host, bad) of every page, from its content: bad if its visible text is mostly signs, or hardly has letters of any script.

    Scripts, styles, tags and character references are removed; of the remaining
    characters that aren't white space, bad is a share of ``#*$%&|<>!`` above 8
    in 100 or fewer than 10 letters. The patterns stop at the next ``<``, so
    broken markup takes no more time than its length.
    """
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    visible = F.regexp_replace(page, r"(?is)<(?:script|style)\b[^<>]*>.*?(?:</(?:script|style)|\z)", " ")
    visible = F.regexp_replace(F.regexp_replace(visible, r"<[^<>]*>", " "), r"&#?[A-Za-z0-9]{1,31};", " ")
    rows = with_host(pages).select("host", visible.alias("v"), F.regexp_replace(visible, r"\p{L}+", "").alias("m"))
    letters = F.length("v") - F.length("m")
    signs = F.length("m") - F.length(F.regexp_replace("m", r"[#*$%&|<>!]+", ""))
    solid = F.length(F.regexp_replace("m", r"[\x20\x09-\x0D]+", "")) + letters
    bad = (letters < 10) | (100 * signs > 8 * solid)
    return rows.select("host", bad.cast("int").alias("bad"))
