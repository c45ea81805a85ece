"""URL filters: allow and block rules, and logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled table of URLs (below,
or the caller's own); what it learns is a vector of 2**BITS weights.  A rule
fits its host and all subdomains if the URL's path starts with the rule's; the
longest rule that fits decides, else the model does.

Null URLs and those without "://": host and path are empty, no rule fits, and
the model judges the empty URL, which it allows.  Repeated rows are judged
each.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import own_columns

BITS, ORDERS, THRESHOLD = 16, (3, 4, 5), 0.5
#: The rules as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Generic words of the labelled URL table, chosen by hand without a look at any crawl; no whole host name is in it.
BAD = (
    "casino bet bets betting poker jackpot roulette slots bingo lottery gamble wager pills viagra cialis pharma steroids diet replica "
    "spam adult adults xxx porn sex sexy cams nude escort hentai ads adserver banner popup tracker tracking clickbait malware virus "
    "warez crack keygen torrent phishing payday loans lender winner prize bonus giveaway cheap hack exploit"
).split()
GOOD = (
    "news garden school library museum city travel recipes weather science history music docs forum sports health river house market "
    "radio university college church theatre orchestra bakery bicycle mountain forest harbour island village castle bridge railway "
    "airport hospital clinic dentist lawyer court council parliament ministry army police fire engineer software hardware network data "
    "cloud server code python kernel compiler maths physics chemistry biology geology astronomy climate energy solar water paper book "
    "reader writer poetry novel film photo painting gallery design fashion coffee tea kitchen cooking wine farm horse dog cat bird "
    "fish insect flower tree stone metal glass wood steel cotton shop store bank insurance tax career jobs family children parents "
    "teacher student exam language dictionary translate map atlas hotel hostel camping hiking sailing football tennis chess swimming "
    "archive blog magazine journal press report review opinion podcast video channel studio agency office support help contact"
).split()
#: Ordinary names and words that hold the letters of a bad one.
LOOKALIKES = (
    "sussex essex middlesex wessex sextant sextet alphabet alphabets betty better between tibet diabetes bethany roadside broads heads "
    "leads threads beads loads reloads downloads uploads salads nomads spamalot dieter dietrich hackney hackathon cheapside winners "
    "dinners pillsbury pillars caterpillar scampi camshaft camera campus cameron analysis nudges escorted bonuses prizes replicas "
    "betacarotene slotted exploits crackers banners trackers sluggish adserve adultery spamming hackers steroidal popups landlords"
).split()
SITES, TOPS = ["", "www.", "blog.", "shop."], ["com", "org", "net", "info", "co.uk", "de", "fr", "es", "eu", "io"]
PATHS = ["/", "/index.html", "/about", "/article/2041", "/page/2", "/category/all/", "/en/start", "/item.php", ""]
LEADS, ENDS = ["/", "/en/", "/p/", "/2019/04/", "/c/", "/tag/"], ["", "/", ".html", "/1", "-online", "/index.php"]


def training_table(bad: list[str] | None = None, good: list[str] | None = None) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): each word as a host, alone and joined to another of its kind, and each as the path of an ordinary host.

    Hosts and paths are dealt in turn over sites, tops, neutral paths and the leads and ends of paths, the same for both kinds, so that only words tell them apart.
    """
    bad, good = bad or BAD, good or [*GOOD, *LOOKALIKES]
    host = lambda name, i: f"{SITES[i % len(SITES)]}{name}.{TOPS[(i * 3 + i // 4) % len(TOPS)]}"
    out = []
    for label, words in ((1, bad), (0, good)):
        for i, w in enumerate(words):
            for j, name in enumerate((w, f"{w}-{words[(i + 3) % len(words)]}", f"{w}{words[(i + 5) % len(words)]}")):
                out.append((host(name, i + j), PATHS[(i + 4 * j) % len(PATHS)], label))
            for j, name in enumerate((w, f"{w}/{words[(i + 7) % len(words)]}", f"{w}-{words[(i + 2) % len(words)]}")):
                out.append((host(good[(5 * i + j) % len(good)], i + j), f"{LEADS[(i + j) % len(LEADS)]}{name}{ENDS[(i + 2 * j) % len(ENDS)]}", label))
    return [*out, ("", "", 0)]


def features(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams that the URL has; host and path have n-grams of their own."""
    grams = set()
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode()
        grams.update(part.encode() + raw[i : i + n] for n in ORDERS for i in range(len(raw) - n + 1))
    return np.array(sorted({zlib.crc32(g) & ((1 << bits) - 1) for g in grams}), np.int64)


def fit(table: list[tuple[str, str, int]], bits: int = BITS, rounds: int = 60, l2: float = 1e-4) -> np.ndarray:
    """Weights, and the bias at the end, of logistic regression by AdaGrad over the table in a fixed order."""
    weights, seen = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-8)
    rows = [(np.append(features(h, p, bits), 1 << bits), y) for h, p, y in table]
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x, y = rows[i]
            scale = 1 / np.sqrt(len(x))
            gradient = (1 / (1 + np.exp(-weights[x].sum() * scale)) - y) * scale + l2 * weights[x]
            seen[x] += gradient**2
            weights[x] -= 0.5 * gradient / np.sqrt(seen[x])
    return weights


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null: none), as host and path in one, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, table: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's score (1: block; null where a rule decides)."""
    weights = pages.sparkSession.sparkContext.broadcast(fit(table or training_table()))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = weights.value
        for hosts, paths in parts:
            out = np.full(len(hosts), np.nan)
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                if h is not None:
                    x = np.append(features(h, p), len(w) - 1)
                    out[i] = 1 / (1 + np.exp(-w[x].sum() / np.sqrt(len(x))))
            yield pd.Series(out)

    urls = own_columns(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(rules)
    judged = urls.withColumn("rule", rule).withColumn("by_rule", verdict)
    undecided = F.col("rule").isNull()
    judged = judged.withColumn("score", score(F.when(undecided, F.col("host")), F.when(undecided, F.col("path"))))
    by_model = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), F.nanvl("score", F.lit(None).cast("double")).alias("score"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
