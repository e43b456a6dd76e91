"""URL filters: ordered rules, and logistic regression on hashed character n-grams for the rest.

Method
------
The host and the path of a URL become hashed character n-grams (each with its own share of
the feature space for host and path). A logistic regression over them is trained in numpy
from a small labelled table of URLs; it judges the URLs that no rule fits. Rules are (host,
path) pairs that fit a host and its subdomains and the paths that start with theirs; the
longest rule that fits wins. Rules are Spark expressions; the regression runs on Arrow batches.

Edge cases
----------
A null URL or one without ``://`` has an empty host and path, and like every URL without a
rule gets the regression's verdict. Null ids and repeated rows are judged like any other. An
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, GRAMS = 1 << 15, (3, 4, 5)
#: A URL with at least this probability is blocked.
BLOCK_FROM = 0.5

# The labelled table, as host and path.
ALLOW = """
en.wikipedia.org/wiki/Astronomy de.wikipedia.org/wiki/Geschichte fr.wikipedia.org/wiki/Histoire
docs.python.org/3/library/re.html developer.mozilla.org/en-US/docs/Web/HTML www.gutenberg.org/ebooks/1342
arxiv.org/abs/1706.03762 news.example.org/2021/05/world/report.html blog.example.net/post/42
www.university.edu/research/papers/index.html library.university.edu/catalog/item/9913
www.nature.com/articles/s41586-020 www.bbc.co.uk/news/science-environment stackoverflow.com/questions/11227809
github.com/apache/spark/blob/master/README.md spark.apache.org/docs/latest/sql-programming-guide.html
www.gov.uk/guidance/travel-abroad www.europa.eu/law/documents/treaty.html weather.example.com/city/berlin
recipes.example.org/soup/tomato www.museum.org/exhibitions/archive forum.example.net/thread/7781
www.theatre.example.com/en/1021.html magazine.example.org/fr/culture/2019 www.school.edu/de/kurse/mathematik
shop.example.com/books/history/roman www.lawreview.org/volume/12/article/3 health.example.org/es/salud/guia
m.thenews.example.org/en/870 www.theherald.example.com/en/4410/ blog.thegarden.example.com/de/1373
thestory.example.net/fr/4163 www.thinking.example.org/en/1291/ tion.example.net/en/7817 m.station.example.com/fr/6094
blog.nation.example.com/es/8424 www.thereading.example.org/en/2246 hearing.example.org/de/590.html
thouse.example.net/en/7424.html www.theble.example.net/de/1170 blog.thour.example.net/en/365/ mountains.example.net/de/88
m.thable.example.net/en/2211 www.thorn.example.net/de/7442.html gardening.example.net/en/19 tigers.example.net/de/482/
www.shells.example.org/es/4270 blog.tables.example.org/fr/99 m.there.example.org/de/3782 weather.example.net/en/6248
www.cooking.example.net/en/77 history.example.net/de/2286.html physics.example.org/en/1570 m.athens.example.net/en/20
www.handbook.example.net/de/9662.html rivers.example.net/en/8835 m.theother.example.net/de/6137 letters.example.org/en/3
""".split()
BLOCK = """
www.casino-royal.example.com/win/big casino-win.example.net/en/4033 m.casino-win.example.org/bonus
online-casino.example.com/slots/free best-casino.bet/jackpot/now poker-stars-bonus.example.net/play
free-bets.example.org/en/5462 www.free-bets.example.net/football/odds betting-tips.example.com/today
sports-bet.example.com/live/odds cheap-pills.example.net/de/6652 www.cheap-pills.example.org/viagra
buy-viagra-online.example.com/order pharmacy-discount.example.net/pills/cheap no-prescription.example.com/meds
ads-track.example.org/en/9823 m.ads-track.example.net/click?id=1 track.adserver.example.com/pixel.gif
doubleclick-ads.example.com/banner popunder-ads.example.net/serve click-tracker.example.org/redirect
xxx-videos.example.com/watch hot-singles.example.net/chat adult-cams.example.org/live porn-tube.example.com/video
free-money.example.com/claim win-iphone.example.net/prize lottery-winner.example.org/claim-now
payday-loans.example.com/apply quick-cash.example.net/loan crypto-doubler.example.org/invest
replica-watches.example.com/rolex fake-bags.example.net/gucci torrent-crack.example.org/download/keygen
warez-serial.example.com/keygen login-verify-account.example.net/secure paypa1-security.example.com/update
malware-download.example.org/setup.exe spam-offers.example.com/win casino-slots.example.org/free-bets
www.adult-x.example.org/en/1209 adult-content.example.net/de/33 spam-links.example.net/de/71 link-farm.example.org/en/8
www.spam-farm.example.com/en/5150 seo-farm.example.net/de/912 m.ads-track.example.net/de/402 pills-shop.example.org/en/61
""".split()
_NUMBER = re.compile("[0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Rules: (verdict, rule)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of "host/path"."""
    host, slash, path = text.partition("/")
    path = _NUMBER.sub("0", path)  # which number a page has says nothing
    found = []
    for salt, part in ((17, f"^{host}$"), (29, f"^{slash}{path.lower()}$")):
        codes = np.frombuffer(part.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        for n in GRAMS:
            if len(codes) >= n:
                value = np.full(len(codes) - n + 1, salt * 100 + n, np.uint64)
                for j in range(n):
                    value = value * np.uint64(1099511628211) + codes[j:len(codes) - n + 1 + j]
                value ^= value >> np.uint64(29)
                found.append((value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(FEATURES))
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def train(allow: Sequence[str] = ALLOW, block: Sequence[str] = BLOCK, rounds: int = 400, rate: float = 0.5,
          decay: float = 1e-4) -> np.ndarray:
    """Weights of all features, and a bias at the end: gradient descent on the whole table."""
    rows = [features(u) for u in [*allow, *block]]
    labels = np.array([0.0] * len(allow) + [1.0] * len(block))
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows)
    value = 1 / np.sqrt(np.array([len(r) for r in rows], float))[at]
    weights = np.zeros(FEATURES + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(at, weights[column] * value, len(rows)) - weights[-1]))
        error = (p - labels) / len(rows)
        gradient = np.bincount(column, error[at] * value, FEATURES)
        weights[:-1] -= rate * 20 * (gradient + decay * weights[:-1])
        weights[-1] -= rate * error.sum()
    return weights


def block_probability(urls: Sequence[str], weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(urls))
    for i, url in enumerate(urls):
        at = features(url)
        out[i] = weights[at].sum() / max(1.0, len(at)) ** 0.5 + weights[-1]
    return 1 / (1 + np.exp(-out))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_score): one row per page."""
    weights = train()

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(block_probability(part.tolist(), weights))

    host, path = host_and_path(F.col(url_col).cast("string"))
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns(
        {"rule": rule, "decision": decision, "block_score": probability(F.concat("host", "path"))})
    method = F.when(F.col("block_score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce("decision", method).alias("verdict"), "block_score")
