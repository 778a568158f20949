"""URL filter: longest-match rules first, a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict): fits the host and its subdomains where the path starts with "/" + path.
RULES = (
    ("com", "en/", "block"),
    ("example.com", "en/7", "allow"),
    ("net", "de/", "allow"),
    ("example.net", "de/8", "block"),
    ("org", "es/", "block"),
)

#: A small labelled URL table, 1 for unwanted: the default training set. Sites of both kinds get the same paths, so
#: that only the names tell them apart; a few paths are telling of themselves.
UNWANTED_SITES = """
casino-bonus best-casino online-poker-win jackpot-slots win-big-cash bets-live sports-betting free-bets-today cheap-meds
pills-online buy-viagra discount-pharmacy cheap-replica-watches replica-bags xxx-videos adult-dating adult-cams hot-sex-chat
porn-tube escort-girls payday-loans fast-cash-loan credit-repair-fast make-money-fast get-rich-quick click-track ads-server
track-clicks ad-network popup-ads affiliate-offers promo-deals free-gift-cards you-won-prize lottery-winner spam-links
link-farm seo-backlinks content-farm keyword-spam warez-crack torrent-free-movies serial-keygen free-download-crack
miracle-diet weight-loss-pills hair-loss-cure crypto-doubler
""".split()
WANTED_SITES = """
news library wiki docs.project gardening university museum journal.science cooking forum.linux cityhall weather newspaper
travel-notes school health history research.lab gov maps theatre books poetry astronomy music agriculture birds railway
help.software code archive blog teacher dictionary nature economics language painting hospital sewing chess engine river
opera thornton ostrander eastwood inlander
""".split()
PATHS = ("/", "/index.html", "/about", "/posts/2021/05", "/item/812", "/p/12.html", "/archive/977/", "/page/3")
HOSTS = ("www.{}.com", "{}.org", "{}.info", "shop.{}.co.uk", "{}-online.net", "the{}.io")
TELLING = (
    *((f"http://www.site.example/{p}", 1) for p in ("casino/spin", "free-slots", "buy-cheap-pills", "win-cash-now", "adult/xxx", "ad/banner/click", "loan/apply-now", "prize/claim")),
    *((f"http://www.site.example/{p}", 0) for p in ("courses/algebra", "recipes/bread", "articles/planets", "forecast/tomorrow", "catalogue/books", "guides/first-aid", "timetable", "papers/2019")),
)
LABELLED = (
    *((f"http://{HOSTS[(i + k) % len(HOSTS)].format(site)}{PATHS[(i + 3 * k) % len(PATHS)]}", label) for label, sites in ((1, UNWANTED_SITES), (0, WANTED_SITES)) for i, site in enumerate(sites) for k in (0, 1)),
    *TELLING,
    *(("", 0),) * 24,  # what has no host tells nothing: allowed
)


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or no "://"."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, F.struct(F.lit(f"{h}/{p}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _buckets(host: str, path: str, bits: int, sizes: Sequence[int]) -> np.ndarray:
    found = set()
    for kind, text in (("h", host), ("p", path)):
        digits = "".join("0" if c.isdigit() else c for c in text.lower())
        body = f"^{digits}$".encode("utf-8", "replace")
        found.update(zlib.crc32(kind.encode() + body[i : i + n]) & ((1 << bits) - 1) for n in sizes for i in range(len(body) - n + 1))
    return np.fromiter(found, dtype=np.int64)


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    return rest[:cut], rest[cut:].partition("?")[0].partition("#")[0]


def train_url_model(labelled: Sequence[tuple[str, int]] = LABELLED, bits: int = 14, sizes: Sequence[int] = (3, 4, 5), steps: int = 400, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression (the last is the bias) by gradient descent on the small labelled table."""
    x = np.zeros((len(labelled), (1 << bits) + 1))
    x[:, -1] = 1
    for row, (url, _) in zip(x, labelled):
        own = _buckets(*_split(url), bits, sizes)
        row[own] = 1 / np.sqrt(max(1, len(own)))
    used = np.flatnonzero(x.any(axis=0)) if len(x) else np.array([x.shape[1] - 1])
    x, size = x[:, used], x.shape[1]  # the other buckets keep weight 0
    y = np.array([label for _, label in labelled], dtype=float)
    w = np.zeros(len(used))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 20.0 * (x.T @ (p - y) / max(1, len(y)) + l2 * w)
    out = np.zeros(size)
    out[used] = w
    return out


def filter_urls(pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED, bits: int = 14, sizes: Sequence[int] = (3, 4, 5), threshold: float = 0.5) -> DataFrame:
    """All columns of the input (those named like a result give way) and host, path, rule, verdict, spam_score.

    verdict: the longest fitting rule's, else block if the model gives at least the threshold, else allow. Null and
    malformed urls have an empty host and path, fit no rule and are allowed, as the training table has such rows.
    Rows that repeat stay; an empty table gives an empty result.
    """
    w = train_url_model(labelled, bits, sizes)

    @F.pandas_udf("double")
    def unwanted(host: pd.Series, path: pd.Series) -> pd.Series:
        def one(h: str, p: str) -> float:
            own = _buckets(h, p, bits, sizes)
            return 1 / (1 + np.exp(-(w[own].sum() / np.sqrt(max(1, len(own))) + w[-1])))

        return pd.Series([one(h, p) for h, p in zip(host, path)], dtype=float)

    new = ("host", "path", "rule", "verdict", "spam_score")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    parts = pages.select(*kept, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = parts.withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("spam_score", unwanted("host", "path"))
    by_model = F.when(F.col("spam_score") >= threshold, "block").otherwise("allow")
    names = [f"`{c}`" for c in pages.columns if c.lower() not in new]
    return judged.select(*names, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"), "spam_score")
