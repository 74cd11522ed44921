"""Allowing and blocking IRIs by rules and by the reputation of their hosts.

Reputation is an empirical-Bayes estimate. Labelled IRIs of a host are successes or failures of a binomial whose
rate comes from a beta prior around the rate of its registered domain, which in turn comes from one around its suffix, and
that from one around all labelled IRIs. How strongly a level holds its members together (the prior's weight) is measured per level by
the method of moments. A host is blocked if even the optimistic end of its posterior is bad: mean - z * deviation > limit.

Only DataFrame functions; nothing is collected.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.plans.support import cut_lineage

LIMIT = 0.5
Z = 1.6448536269514722
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Suffixes of several labels under which anyone can register. Not the whole public list, which changes; a parameter of the operators. Other hosts
# end in a suffix of one label.
SUFFIXES = tuple(f"{kind}.{land}" for land, kinds in {
    "uk": "co org me ltd plc net sch ac gov nhs", "au": "com net org edu gov id asn", "nz": "co net org ac govt geek school", "jp": "co ne or ac go ad ed gr lg",
    "kr": "co ne or re pe go ac", "br": "com net org gov edu art blog", "ar": "com net org gob edu", "mx": "com net org gob edu", "co": "com net org gov edu",
    "za": "co net org gov ac web", "in": "co net org gen firm ind ac gov nic", "cn": "com net org gov edu ac", "hk": "com net org gov edu idv", "tw": "com net org gov edu idv",
    "sg": "com net org gov edu per", "my": "com net org gov edu", "th": "co in or go ac net", "id": "co or go ac web my sch", "vn": "com net org gov edu", "ph": "com net org gov edu",
    "tr": "com net org gov edu gen bel", "il": "co org net ac gov muni", "ua": "com net org gov edu in", "pl": "com net org gov edu waw", "ru": "com msk spb",
    "pt": "com org gov edu", "es": "com nom org gob edu", "gr": "com net org gov edu", "at": "co or ac gv", "hu": "co org", "ke": "co or go ac", "ng": "com org gov edu", "eg": "com org gov edu",
    "pe": "com net org gob edu", "ve": "com net org gob", "ec": "com net org gob"}.items() for kind in kinds.split()) + tuple(
    "github.io gitlab.io blogspot.com wordpress.com tumblr.com herokuapp.com netlify.app vercel.app pages.dev workers.dev web.app firebaseapp.com appspot.com azurewebsites.net cloudfront.net".split())

Rule = tuple[str, str]  # text such as ``example.com/en/`` and ``allow`` or ``block``


def iri_host(iri: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A to Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(iri, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def iri_path(iri: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(iri, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, NULL if none does.

    A rule is a host, which stands for all its subdomains too, and the beginning of a path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, begin = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _levels(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain (the suffix and one label more) and suffix (the longest of ``suffixes`` that fits, else the last label)."""
    domain, suffix = F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)
    by_labels: dict[int, list[str]] = {}
    for s in suffixes:
        by_labels.setdefault(s.count(".") + 1, []).append(s)
    for n, own in sorted(by_labels.items()):
        tail = F.substring_index(host, ".", -n)
        listed = tail.isin(own)
        domain, suffix = F.when(listed, F.substring_index(host, ".", -n - 1)).otherwise(domain), F.when(listed, tail).otherwise(suffix)
    return domain, suffix


def _weight(rows: DataFrame, by: str, own: str) -> DataFrame:
    """Per parent ``by``: the rate of its labelled IRIs and the weight of the beta prior that its members come from.

    Moments: with member rates r_i = b_i / n_i, mean m, N = sum n_i, K members and S = sum n_i (r_i - m)^2, the share of variance
    between members is v = (S - (K - 1) m (1 - m)) / ((N - sum n_i^2 / N - K + 1) m (1 - m)), and the weight is 1 / v - 1.
    """
    sums = rows.groupBy(by).agg(F.sum("bad").alias("B"), F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"),
                                F.sum(F.col("n") * F.col("n")).alias("N2"),
                                F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("Q"))
    m = F.col("B") / F.col("N")
    spread = F.col("Q") - F.col("B") * m
    noise = m * (1 - m)
    free = F.col("N") - F.col("N2") / F.col("N") - F.col("K") + 1
    v = F.when((noise > 0) & (free > 1e-9), (spread - (F.col("K") - 1) * noise) / (free * noise))
    weight = F.when(v.isNull(), 2.0).otherwise(1 / F.least(F.greatest(v, F.lit(0.001)), F.lit(0.9)) - 1)
    return sums.select(by, F.col("B").alias(f"{own}_bad"), F.col("N").alias(f"{own}_n"), weight.alias(f"{own}_weight"))


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Per host with labelled IRIs, and per domain and suffix: ``level``, ``name``, ``n``, ``mean``, ``bound``.

    ``outcomes`` has ``o`` (an IRI) and ``bad`` (0 or 1). ``mean`` is the posterior share of bad IRIs and ``bound`` its lower end. NULL
    outcomes are passed over; IRIs without a host are a host of their own (the empty one). Repeats count.
    ``suffixes`` are those of several labels, in lower case.
    """
    host = iri_host(F.col("o").cast("string"))
    hosts = outcomes.where("bad is not null").select(host.alias("host"), F.col("bad").cast("int").alias("bad")).groupBy("host").agg(
        F.sum("bad").cast("double").alias("bad"), F.count(F.lit(1)).cast("double").alias("n"))
    domain, suffix = _levels(F.col("host"), suffixes)
    hosts = hosts.select("host", "bad", "n", domain.alias("domain"), suffix.alias("suffix"), F.lit(0).alias("all"))
    sums = lambda rows, *by: rows.groupBy(*by).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    domains = sums(hosts, "domain", "suffix", "all")
    suffixes = sums(domains, "suffix", "all")
    top = _weight(suffixes, "all", "p")
    mean = lambda prior: (F.col("bad") + F.col("p_weight") * prior) / (F.col("n") + F.col("p_weight"))
    parts = []

    def posterior(rows: DataFrame, name: str, parents: DataFrame, key: str, prior: Column) -> DataFrame:
        p = rows.join(parents, key)
        mu, size = mean(prior), F.col("n") + F.col("p_weight") + 1
        out = p.select(F.col(name).alias("name"), F.col("n"), mu.alias("mean"),
                       (mu - z * F.sqrt(mu * (1 - mu) / size)).alias("bound"))
        parts.append(out.withColumn("level", F.lit(name)))
        return p.select(F.col(name).alias("_" + name), mu.alias("prior"))

    overall = (F.col("p_bad") + 1) / (F.col("p_n") + 2)
    up = posterior(suffixes, "suffix", top, "all", overall)
    parents = _weight(domains, "suffix", "p").join(up, F.col("suffix") == F.col("_suffix")).drop("_suffix")
    up = posterior(domains, "domain", parents, "suffix", F.col("prior"))
    parents = _weight(hosts, "domain", "p").join(up, F.col("domain") == F.col("_domain")).drop("_domain")
    posterior(hosts, "host", parents, "domain", F.col("prior"))
    return cut_lineage(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("level", "name", "n", "mean", "bound"))


def judge_iris(iris: DataFrame, rules: list[Rule], reputation: DataFrame, limit: float = LIMIT, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``s``, ``host``, ``path``, ``rule``, ``verdict``, ``level``, ``mean`` and ``bound`` for every row of ``iris`` (``s``, ``o``).

    The longest fitting rule decides; else the reputation of the host, its registered domain or its suffix, the first that is known;
    ``suffixes`` must be those of the reputation; an IRI of which none is known is allowed, as is a NULL or one without a host when no such outcome was seen.
    """
    rows = iris.select(F.col("s"), F.col("o").cast("string").alias("o"))
    rows = rows.select("s", iri_host(F.col("o")).alias("host"), iri_path(F.col("o")).alias("path"))
    rule, says = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("s", "host", "path", rule.alias("rule"), says.alias("says"))
    # One row per host first, so that a host with a third of all IRIs is looked up once.
    hosts = rows.select("host").distinct()
    domain, suffix = _levels(F.col("host"), suffixes)
    known = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(i).alias("near"), F.lit(level).alias("level"), name.alias("name")) for i, (level, name) in
                                                     enumerate((("host", F.col("host")), ("domain", domain), ("suffix", suffix)))])).alias("k"))
    known = known.select("host", "k.*").join(reputation, ["level", "name"]).groupBy("host").agg(
        F.min(F.struct("near", "level", "mean", "bound")).alias("r"))
    known = cut_lineage(known.select(F.col("host").alias("_host"), "r.level", "r.mean", "r.bound"))
    out = rows.join(known, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce("says", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return out.select("s", "host", "path", "rule", verdict.alias("verdict"), "level", "mean", "bound")
