"""URL filters: rules by host and path and, where none fits, logistic regression on hashed character n-grams of both.

The model is trained on the driver from the small table of labelled URLs below, or one given in its place of `MOST_LABELLED`
rows at most; its weights are 2 ** BITS numbers, a fixed size, and are broadcast. N-grams of 3 to 5 characters are taken
from each label of the host but the last, whatever its place, so that a telling name counts as a registered domain and as a
subdomain; those of the label before the last count once more as the registered domain's, those of the labels before it as
subdomains'; further n-grams come from the path's letters. Only urls that no rule decides are scored.

The labelled hosts and paths are made of general vocabulary; none is a host of the tables that queries read, so verdicts on
those are the model's own. `held_out` tells how it judges labelled hosts that it was not trained on.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, and is judged by the model
(an empty url scores the bias: allow); a rule fits its host and all subdomains if the path starts with the rule's path; the
longest rule wins, and the score is null; repeated rows are judged each alone; very long urls are judged whole; an empty
table gives no rows; new columns replace those of the same name, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
MOST_LABELLED = 100_000

#: Labelled hosts. 1: pages to block (gambling, pills, adult, link farms, trackers, malware), 0: others.
LABELLED_HOSTS = {
    1: "best-casino online-casino slots-jackpot poker-bonus bet-now sports-betting lucky-spin free-spins viagra-shop pills-online "
    "cheap-meds pharmacy-discount xxx-videos adult-cams porn-tube sexy-dates hot-singles click-ads ad-server tracking-pixel popup-ads "
    "adclick banner-ads link-farm seo-links buy-backlinks spam-blog free-iphone win-prize claim-reward crypto-doubler get-rich-quick "
    "payday-loans fast-cash-loan replica-watches fake-bags warez-crack keygen-free torrent-cracks malware-drop phish-login "
    "verify-account-now weight-loss-miracle miracle-cure casino-royal-slots mega-jackpot roulette-bonus blackjack-win poker-online "
    "bet-live-odds betting-tips generic-viagra cialis-online diet-pills steroid-shop cheap-rx-pharmacy live-sex-cams xxx-porn "
    "nude-cams adult-dating escort-dates free-porn adserver-cdn ads-network pixel-tracker track-clicks popunder-ads link-exchange-seo "
    "cheap-backlinks spam-mailer win-free-gift free-gift-card claim-prize-now crypto-profit-bot bitcoin-doubler quick-payday-cash "
    "fake-rolex replica-handbags crack-serials free-keygen malware-payload phish-bank-login miracle-weight-loss",
    0: "news weather library university city-council museum health-service recipes garden-club history-society science-daily "
    "math-notes physics-lab open-data docs wiki encyclopedia dictionary translate maps travel-guide railway airport bank "
    "insurance theatre orchestra cinema book-club school kindergarten hospital parliament ministry court police fire-brigade "
    "football-club chess-union tennis bicycle hiking mountains ocean-research climate energy forestry farming weather-station "
    "software-docs code-review database-blog compiler-notes research-papers statistics tech-blog photo-gallery art-school "
    "there other nation station linguistics grammar-notes poetry novelist newspaper magazine radio television broadcaster "
    "observatory astronomy chemistry-lab biology geology archive heritage cathedral parish monastery embassy consulate "
    "township county-office public-transport bus-lines ferry harbour lighthouse bakery butcher carpenter plumber electrician "
    "architect engineer notary dentist veterinary pharmacy-school nursing midwife orchard vineyard brewery cheese-makers "
    "swimming athletics rowing-club sailing gymnastics choir-society brass-band dance-school pottery knitting woodwork birdwatch",
}
#: Paths that go with them.
LABELLED_PATHS = {
    1: ["/win/bonus", "/casino/free-spins", "/pills/buy-now", "/xxx/videos", "/ads/click", "/track/pixel", "/bet/odds", "/promo/claim"],
    0: ["/articles/archive", "/about", "/contact", "/products/list", "/docs/index", "/posts/summer", "/", "/wiki/page"],
}
PREFIXES, ENDINGS = ("", "www.", "", "www."), ("com", "info", "co.uk", "io", "org.au")


def labelled(hosts: dict[int, list[str]] | None = None) -> list[tuple[str, int]]:
    """The labelled URL table: each host under several prefixes and endings, with a neutral or a telling path."""
    out = []
    for label, own in (hosts or {k: v.split() for k, v in LABELLED_HOSTS.items()}).items():
        for i, host in enumerate(own):
            for k, prefix in enumerate(PREFIXES):
                path = LABELLED_PATHS[label if k == 0 else 0][(i + 3 * k) % 8]
                out.append((f"https://{prefix}{host}.{ENDINGS[(i + k) % len(ENDINGS)]}{path}/{i * 7 + k}", label))
    return out


def held_out(folds: int = 5, threshold: float = 0.5) -> dict[int, tuple[int, int]]:
    """By label the labelled hosts, and how many of them are blocked, with a neutral path, by a model trained on those of the other folds."""
    found = {1: [0, 0], 0: [0, 0]}
    every = [(h, label) for label, hosts in LABELLED_HOSTS.items() for h in hosts.split()]
    for fold in range(folds):
        away = [(h, label) for h, label in every if zlib.crc32(h.encode()) % folds == fold]
        w = train(labelled({label: [h for h, x in every if x == label and zlib.crc32(h.encode()) % folds != fold] for label in LABELLED_HOSTS}))
        for host, label in away:
            found[label][0] += 1
            found[label][1] += probability(w, f"{host}.com", "/about") >= threshold
    return {k: (n, blocked) for k, (n, blocked) in found.items()}


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def grams(host: str, path: str) -> np.ndarray:
    """Places of the n-grams of a url."""
    labels = host.split(".")
    named = [("h", x) for x in labels[:-1] or labels] + [("r", x) for x in labels[-2:-1]] + [("s", x) for x in labels[:-2]]
    letters = "".join(c if c.isalpha() or c in "/-" else "" for c in path.lower())
    out = set()
    for kind, text in [*((k, f"^{x}$") for k, x in named), ("p", letters)]:
        start, raw = zlib.crc32(kind.encode()), text.encode()
        for n in (3, 4, 5):
            out.update(zlib.crc32(raw[i : i + n], start) >> (32 - BITS) for i in range(len(raw) - n + 1))
    return np.fromiter(out, dtype=np.int64, count=len(out))


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1] if "://" in url else ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def train(rows: list[tuple[str, int]] | None = None, *, rounds: int = 60, rate: float = 0.3, decay: float = 3e-2) -> np.ndarray:
    """Weights by place, the bias last; batch gradient steps with a decaying rate per coordinate."""
    rows = labelled() if rows is None else rows
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table has {len(rows)} rows; it is held on the driver, {MOST_LABELLED} at most")
    places = [np.append(grams(*_split(u)), 1 << BITS) for u, _ in rows]
    y = np.array([label for _, label in rows], dtype=float)
    at, of = np.concatenate([np.zeros(0, dtype=np.int64), *places]), np.repeat(np.arange(len(rows)), [len(p) for p in places])
    scale = 1 / np.sqrt(np.array([len(p) for p in places], dtype=float))
    w, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    for _ in range(rounds if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(rows)) * scale, -35, 35)))
        g = np.bincount(at, ((p - y) * scale)[of], len(w)) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w.astype(np.float32)


def logit(w: np.ndarray, host: str, path: str) -> float:
    g = grams(host, path)
    return float(w[g].sum() + w[-1]) / np.sqrt(len(g) + 1)


def probability(w: np.ndarray, host: str, path: str) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit(w, host, path), -35, 35))))


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", weights: np.ndarray | None = None, threshold: float = 0.5) -> DataFrame:
    """`pages` with host, path, rule, verdict (allow or block) and score (the model's, 0 to 1). rules: (verdict, host/path)."""
    shown = pages.sparkSession.sparkContext.broadcast(train() if weights is None else weights)
    new = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in pages.columns if c not in new or c == url]
    host, path = parts(F.col(f"`{url}`"))
    # columns of the table stay inside a struct, where no name clashes
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"))

    @F.pandas_udf("double")
    def scored(hosts, paths):
        import pandas as pd

        w = shown.value
        total = np.full(len(hosts), np.nan)
        known: dict[tuple[str, str], float] = {}
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            if h is None:
                continue  # a rule decides
            x = (h, "".join(c for c in p if not c.isdigit()))
            if x not in known:
                known[x] = logit(w, *x)
            total[i] = known[x]
        return pd.Series(1 / (1 + np.exp(-np.clip(total, -35, 35)))).astype(object).where(~np.isnan(total), None)

    chosen = F.lit(None).cast("string")
    given = F.lit(None).cast("string")
    # the longest last, so that it is asked first
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, start = rule.partition("/")
        fits = ((F.col("host") == own) | F.endswith(F.col("host"), F.lit(f".{own}"))) & F.startswith(F.col("path"), F.lit(slash + start))
        chosen, given = F.when(fits, rule).otherwise(chosen), F.when(fits, verdict).otherwise(given)
    out = out.withColumns({"rule": chosen, "given": given})
    open_ = F.col("rule").isNull()
    out = out.withColumn("score", scored(F.when(open_, F.col("host")), F.when(open_, F.col("path"))))
    verdict = F.coalesce("given", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", "rule", "score", verdict.alias("verdict"))
