"""URL filter: explicit rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table (`LABELLED`, or any of at most `MOST_LABELS` rows) and its
weights, 2^BITS numbers whatever the input, go to the executors with the function.

Edge cases: a null url or one without `://` has an empty host and path and gets the model's verdict for them; equal urls get
equal verdicts; rows are judged alone, other columns are untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import mix64, read_table, schema

BITS, GRAMS, STEPS, PENALTY, RATE = 14, (3, 4, 5), 400, 1e-3, 2.0
#: The labelled table may have so many rows; a larger one is an error.
MOST_LABELS = 100_000
#: (host and path prefix, allow?)
RULES = (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False))
#: Labelled urls of our own making, 1 to block.
LABELLED = (
    ("https://news.example.org/en/2021/world/article-one.html", 0), ("https://www.university.edu/research/papers/language.html", 0),
    ("https://blog.writer.example.net/en/essays/on-reading", 0), ("https://en.encyclopedia.org/wiki/Astronomy", 0),
    ("https://docs.library.example.org/guide/getting-started", 0), ("https://www.museum.example.fr/fr/collections/peinture", 0),
    ("https://journal.science.org/articles/12345", 0), ("https://www.gazette.example.de/de/politik/bericht", 0),
    ("https://forum.gardening.example.org/en/threads/roses", 0), ("https://archive.books.org/details/history-of-rome", 0),
    ("https://www.school.example.es/es/lecciones/historia", 0), ("https://recipes.kitchen.example.org/en/soup.html", 0),
    ("https://m.daily.example.net/en/43790", 0), ("https://blog.travel.example.com/de/15001/", 0), ("http://www.weather.example.org/en/report", 0),
    ("https://stories.example.org/fr/7857?page=2", 0), ("https://health.example.org/en/advice/sleep", 0), ("https://poetry.example.net/es/21678.html", 0),
    ("http://ads.tracker.example.com/click?id=1", 1), ("https://m.ads-track.example.com/en/40021", 1), ("http://banner.adserver.example.net/serve/img", 1),
    ("https://casino-bonus.example.org/en/win-big", 1), ("http://free-pills.example.net/buy/cheap", 1), ("https://track.click.example.org/redirect/4411", 1),
    ("http://xxx-cams.example.com/live/girls", 1), ("https://poker.slots.example.net/en/jackpot", 1), ("http://cheap-loans.example.org/apply/now", 1),
    ("https://promo.spam.example.com/offer/free-gift", 1), ("https://adult.videos.example.net/xxx/1", 1), ("https://popunder.adnet.example.org/track", 1),
    ("http://warez.download.example.com/crack/keygen", 1), ("https://login.phish.example.net/account/verify", 1), ("http://pixel.metrics.example.com/collect", 1),
    ("https://betting.odds.example.org/en/bet", 1), ("https://ad.doubleserve.example.net/adview", 1), ("http://viagra.shop.example.com/order", 1),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host = rest[:end].translate(_LOWER)
    if rest[end : end + 1] != "/":
        return host, ""
    path = rest[end:]
    return host, path[: min((k for k in (path.find(c) for c in "?#") if k >= 0), default=len(path))]


_LOWER = {c: c + 32 for c in range(65, 91)}


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of both parts; a part's name is part of the hash."""
    out = []
    for salt, part in ((1, host), (2, path)):
        codes = np.frombuffer(f"^{part}$".encode(), dtype=np.uint8).astype(np.uint64)
        for n in GRAMS:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, 131 * salt + n, dtype=np.uint64)
                for k in range(n):
                    h = h * np.uint64(1_000_003) + codes[k : len(codes) - n + 1 + k]
                out.append(mix64(h) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def train(labelled=LABELLED) -> tuple[np.ndarray, float]:
    """Weights and intercept, by gradient descent over the whole table; the same table gives the same model."""
    rows = list(labelled)
    if len(rows) > MOST_LABELS:
        raise ValueError(f"the labelled table has {len(rows)} rows; at most {MOST_LABELS} are allowed")
    weights, bias = np.zeros(2**BITS), 0.0
    if not rows:
        return weights, bias
    found = [features(*split_url(url)) for url, _ in rows]
    at = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    index = np.concatenate(found)
    value = 1 / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(rows))))
    y = np.array([label for _, label in rows], dtype=float)
    for _ in range(STEPS):
        z = np.bincount(at, weights[index], minlength=len(rows)) * value + bias
        error = 1 / (1 + np.exp(-z)) - y
        weights -= RATE * (np.bincount(index, (error * value)[at], minlength=2**BITS) / len(rows) + PENALTY * weights)
        bias -= RATE * error.mean()
    return weights, bias


def score(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    """The probability that the url should be blocked."""
    f = features(host, path)
    z = model[0][f].sum() / np.sqrt(max(1, len(f))) + model[1]
    return float(1 / (1 + np.exp(-z)))


def compile_rules(rules=RULES) -> dict[str, list[tuple[str, str, bool]]]:
    """By host: (path, rule, allow?), the longest first."""
    by_host: dict[str, list] = {}
    for rule, allow in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host, []).append(("/" + path, rule, allow))
    return {h: sorted(found, key=lambda x: -len(x[0])) for h, found in by_host.items()}


def match_rule(by_host: dict, host: str, path: str) -> tuple[str, bool] | None:
    """The longest rule whose host is the url's or above it and whose path the url's starts with. Tails of the host that are longer
    than every rule's host are not looked at, so a long host costs no more than its end."""
    longest = max(map(len, by_host), default=0)
    cut = len(host) > longest
    best, labels = None, host[-longest - 1 :].split(".") if cut else host.split(".")
    for k in range(int(cut), len(labels)):
        for prefix, rule, allow in by_host.get(".".join(labels[k:]), ()):
            if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                best = (rule, allow)
                break
    return best


VERDICT = "host string, path string, rule string, verdict string, score double"


def judge_urls(url: str | Column = "url", rules=RULES, labelled=LABELLED) -> Column:
    """A struct (host, path, rule, verdict, score) for a url column."""
    model, by_host = train(labelled), compile_rules(rules)

    @F.pandas_udf(schema(VERDICT))
    def judged(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            host, path = split_url(u)
            rule, p = match_rule(by_host, host, path), score(model, host, path)
            rows.append((host, path, rule and rule[0], "allow" if (rule[1] if rule else p < 0.5) else "block", p))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in VERDICT.split(", ")])

    return judged(F.col(url) if isinstance(url, str) else url)


def op10_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", judge_urls().alias("u")).select("page_id", "u.*")
