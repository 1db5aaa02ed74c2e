"""URL keys, tests and normalisation. Columns in, columns out."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlparse, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query keys that only track visitors.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format",
    "utm_marketing_tactic", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref",
    "msclkid", "mc_cid", "mc_eid", "yclid", "twclid", "_ga", "_gl", "_gid", "ref", "ref_src", "s_cid", "s_kwcid", "hsa_acc", "hsa_cam", "hsa_grp",
    "hsa_ad", "hsa_src", "hsa_tgt", "hsa_kw", "hsa_mt", "hsa_net", "hsa_ver", "hsa_la", "hsa_ol",
)
#: Extensions of files that aren't pages.
RESOURCE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "css", "js", "json", "xml", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip",
    "tar", "gz", "rar", "mp3", "mp4", "avi", "mov", "wmv", "flv", "webm", "woff", "woff2", "ttf", "eot", "otf",
)
#: Suffixes of two labels under which names are registered; others count as one label.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "com.au", "net.au", "org.au", "co.nz", "org.nz", "co.jp", "or.jp", "ne.jp", "ac.jp",
    "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "com.hk", "com.tw", "com.sg", "co.in", "co.kr", "co.za", "co.il",
)
#: Substrings of addresses of trackers, and of the safe characters of a path.
TRACKER_HOSTS = ["google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.net", "hotjar.com", "clarity.ms"]
_PATH_SAFE = "/:@!$&'()*+,;=-._~"


# keys of joins: each its own, never mixed


def strip_slashes(url: Column) -> Column:
    """All slashes at the end dropped."""
    return F.regexp_replace(url, "/+$", "")


def defragment(url: Column) -> Column:
    """Without fragment and slashes at the end."""
    return strip_slashes(F.regexp_replace(url, "(?s)#.*$", ""))


def graph_key(url: Column, normalized: Column) -> Column:
    """The normal form where there is one, else the url."""
    return F.coalesce(F.when(normalized != "", normalized), url)


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def base_path(url: Column) -> Column:
    """Scheme, host and path."""
    return F.regexp_extract(url, r"(?s)^([^?#]*)", 1)


def domain(url: Column) -> Column:
    """Host in lower case without one www."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def path_key(url: Column) -> Column:
    """The path without slashes at its end."""
    return strip_slashes(path(url))


# tests


def is_mixed_case(url: Column) -> Column:
    p = path(url)
    return (p != F.lower(p)) & (p != "/")


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def is_deep(url: Column, most: int = 5) -> Column:
    return path_depth(url) > most


def is_resource(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(RESOURCE_EXTENSIONS) + ")$")


def same_domain(url: Column, base: Column) -> Column:
    """Authorities equal, one www. of either left aside."""
    a, b = authority(url), authority(base)
    return (a == b) | (a == F.concat(F.lit("www."), b)) | (b == F.concat(F.lit("www."), a))


def is_blocked_tracker(url: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in TRACKER_HOSTS]), lambda x: F.contains(url, x))


def robots_blocks(url_path: Column, disallow: Column) -> Column:
    """Simplified robots test: a path that starts with one of the disallowed ones."""
    return F.exists(disallow, lambda d: (d != "") & F.startswith(url_path, d))


def priority(source: Column, depth: Column, lastmod: Column) -> Column:
    return (
        F.when((source == "sitemap") & lastmod.isNotNull(), 0)
        .when(source == "sitemap", 1)
        .when(source == "seed", 2)
        .when(depth == 0, 3)
        .when(depth == 1, 4)
        .when(depth == 2, 5)
        .when(depth <= 5, 6)
        .otherwise(7)
    )


# what Spark's own url functions can't say: percent-encoding as in urllib


def _host(parts) -> tuple[str, int | None] | None:
    try:
        return (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None


def normalize_one(url: str | None, deny: frozenset = frozenset(), allow: frozenset | None = None, drop_tracking: bool = True) -> str | None:
    """The normal form of one address; None where it is no page's."""
    try:
        parts = urlparse((url or "").strip())  # parameters of the last segment are split off, and dropped
    except ValueError:
        return None
    scheme, place = parts.scheme.lower(), _host(parts)
    if scheme not in ("http", "https") or not place or not place[0]:
        return None
    host, port = place
    usual = {"http": 80, "https": 443}[scheme]
    where = host if port in (None, usual) else f"{host}:{port}"
    p = quote(re.sub("/+", "/", unquote(parts.path)), safe=_PATH_SAFE) if parts.path else "/"
    by_key: dict[str, list[str]] = {}
    for k, v in parse_qsl(parts.query, keep_blank_values=True):
        low = k.lower()
        if (drop_tracking and low in _TRACKING) or low in deny or (allow is not None and low not in allow):
            continue
        by_key.setdefault(k, []).append(v)
    q = urlencode(sorted(by_key.items()), doseq=True)
    return f"{scheme}://{where}{p if p.startswith('/') else '/' + p}" + (f"?{q}" if q else "")


_TRACKING = frozenset(TRACKING_PARAMS)


def normalizer(deny=(), allow=None, drop_tracking: bool = True):
    """A function of columns: the normal form of urls under a parameter policy."""
    denied, allowed = frozenset(x.lower() for x in deny), None if allow is None else frozenset(x.lower() for x in allow)

    @F.pandas_udf(StringType())
    def normalize(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: normalize_one(u, denied, allowed, drop_tracking))

    return normalize


@F.pandas_udf(StringType())
def decoded_path(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else unquote(urlsplit(u).path))


def has_special_characters(url: Column) -> Column:
    """The decoded path holds something else than letters, digits and - _ / . %"""
    return decoded_path(url).rlike(r"[^a-zA-Z0-9\-_/.%]")


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href)], dtype=object)


def suffix_rules(text: str) -> frozenset[str]:
    """The rules of a public suffix list's text, without those that private parties have set for their own names."""
    official = text.split("===BEGIN PRIVATE DOMAINS===")[0]
    return frozenset(x.split()[0].lower() for x in official.splitlines() if x.strip() and not x.startswith("//"))


def split_host(host: str, rules: frozenset[str]) -> tuple[str, str]:
    """(subdomain, registrable name) of a host under suffix rules; no name where no rule fits, or nothing lies before the suffix."""
    labels = host.lower().rstrip(".").split(".")
    for i in range(len(labels)):
        rest = ".".join(labels[i + 1 :])
        if "!" + ".".join(labels[i:]) in rules:
            n = i + 1
        elif ".".join(labels[i:]) in rules or f"*.{rest}" in rules and rest:
            n = i
        else:
            continue
        return (".".join(labels[: n - 1]), ".".join(labels[n - 1 :])) if n else ("", "")
    return ".".join(labels[:-1]), ""


def is_internal_by(rules: frozenset[str], base_host: str, include_subdomains: bool = False, allowlist=()):
    """``is_internal`` under the rules of a public suffix list, which the caller reads from where it keeps it."""
    base, allowed = split_host(base_host, rules), frozenset(a.lower() for a in allowlist)

    def one(url: str | None) -> bool:
        try:
            host = urlsplit(url or "").hostname or ""
        except ValueError:
            return False
        sub, name = split_host(host, rules)
        return name == base[1] and (not sub or sub == base[0] or include_subdomains or sub in allowed)

    @F.pandas_udf("boolean")
    def internal(urls: pd.Series) -> pd.Series:
        return urls.map(one).astype("bool")

    return internal


def should_crawl(url: Column, base_host: str, **how) -> Column:
    """Has a normal form and is internal."""
    return normalizer()(url).isNotNull() & is_internal(url, base_host, **how)


def registrable(host: Column) -> Column:
    """The last two labels, three under a suffix of two."""
    labels = F.split(F.lower(host), r"\.")
    last2 = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    last3 = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    return F.when(last2.isin(*TWO_LABEL_SUFFIXES), last3).otherwise(last2)


def is_internal(url: Column, base_host: str, include_subdomains: bool = False, allowlist=()) -> Column:
    """Registered under the same name; a subdomain other than the base's must be allowed."""
    host = F.regexp_replace(F.lower(authority(url)), ":[0-9]+$", "")
    base = F.lit(base_host.lower())
    sub = lambda h: F.regexp_replace(h, F.concat(F.lit(r"\.?\Q"), registrable(h), F.lit(r"\E$")), F.lit(""))
    own = sub(host)
    fits = (own == "") | (own == sub(base)) | F.lit(include_subdomains) | own.isin(*[a.lower() for a in allowlist] or [""])
    return (registrable(host) == registrable(base)) & fits
