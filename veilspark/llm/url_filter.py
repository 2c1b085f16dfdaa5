"""URL filter: host names cut into words, words judged by naive Bayes, rules above both.

Names in a host are concatenations; the cut with the most probable words under a unigram model (Viterbi) is taken, where
an unknown run of letters costs more the longer it is. The unigram model counts in how many texts of a corpus a word
occurs (corpus_words) and mixes in the words of the names below. A multinomial naive Bayes over the words of host and path
gives the odds of an unwanted page; words it doesn't know say nothing. It starts from the names below and adds
what a table of judged urls teaches, where there is one (learn).

The names are bounded training rows like any other: general words of the kinds of sites that filters are made for, and of
ordinary ones, among them ordinary uses of the ambiguous words. The tests hold the model against names in neither list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm._spark import ship, written

#: Names of unwanted sites, as words.
UNWANTED = (
    "ad server", "ad network", "ads click", "popup ads", "banner ads", "click tracker", "tracking pixel", "pixel track", "click bait", "affiliate clicks", "traffic exchange", "link spam", "spam links", "spam mail", "comment spam", "link farm", "content farm", "click farm", "seo links", "buy backlinks", "bulk mail", "adware download",
    "adult video", "adult chat", "adult dating", "adult toys", "xxx video", "xxx movies", "xxx tube", "porn tube", "porn videos", "free porn", "sex chat", "sex tube", "sex cams", "live sex", "cam girls", "nude cams", "nude girls", "hot girls", "escort girls", "escort service", "erotic stories", "milf porn", "strip poker",
    "online casino", "casino bonus", "casino games", "casino slots", "royal casino", "slots jackpot", "mega jackpot", "slot machines", "jackpot win", "win money", "win cash", "win prizes", "lottery win", "lotto jackpot", "sports bets", "live bets", "bet online", "betting odds", "best betting", "bet bonus", "poker bonus", "poker bets", "roulette win", "gamble online", "free spins",
    "buy viagra", "viagra pills", "cialis pills", "cheap viagra", "cheap meds", "diet pills", "pills online", "pills shop", "buy pills", "buy steroids", "buy xanax", "no prescription meds", "weight loss pills", "miracle diet", "cheap replica", "replica watches", "replica bags", "fake watches", "fake passports", "fake id",
    "payday loans", "payday cash", "quick loans", "instant loan", "cash advance", "fast cash", "easy money", "money fast", "get rich quick", "make money online", "crypto doubler", "bitcoin doubler", "forex signals", "free bitcoin", "cheap followers", "free robux", "free gift cards", "prize winner",
    "warez download", "crack keygen", "cracked software", "serial crack", "keygen serial", "torrent crack", "torrent movies", "pirate movies", "free movies stream", "malware download", "virus download", "trojan loader", "phishing login", "password stealer", "hack account", "game hacks", "cheat hacks", "essay writing cheap",
)
#: Names of ordinary sites.
ORDINARY = (
    "city news", "daily news", "local weather", "weather report", "evening post", "morning herald", "open library", "public library", "science journal", "health journal", "medical school", "history museum", "art museum", "school district", "state university", "online university", "online courses", "video lessons", "travel guide", "city guide", "food blog", "garden blog", "photo blog", "blog post", "music review", "book review", "film review", "movie times",
    "book shop", "coffee shop", "bike shop", "toy shop", "pet shop", "wine shop", "flower shop", "sports news", "football club", "tennis club", "golf club", "chess club", "track and field", "race track", "horse farm", "farm market", "farm house", "dairy farm", "wind farm", "fish market", "stock market", "world bank", "savings bank", "student loans", "home loans", "credit union", "tax office", "post office", "town hall", "law firm", "fire department", "police department",
    "cheap flights", "cheap hotels", "hotel booking", "car rental", "train times", "flight status", "free software", "free encyclopedia", "free press", "free fonts", "open source", "code review", "data science", "web developer", "software tracker", "bug tracker", "package tracking", "fitness tracker", "mail server", "game server", "web server", "ad council", "live radio", "live music", "live science", "public radio", "video games", "kids games", "board games", "olympic games",
    "cooking recipes", "easy recipes", "diet advice", "healthy diet", "family doctor", "health clinic", "cancer research", "research lab", "sex education", "adult education", "adult learning", "essex county", "sussex news", "green energy", "solar power", "home garden", "house design", "job search", "money advice", "gift shop", "watch repair", "camera store", "online store", "online maps", "world map", "animal rescue", "bird watch", "mountain hiking", "river fishing", "poetry magazine", "math tutor", "language school", "email login", "forum help", "support center", "about contact", "article archive", "wiki page", "hotel search", "winter sports", "winner school", "card games", "best practices", "hot springs", "fast trains", "quick start", "download center", "download page", "girls school", "girl scouts",
)
#: Labels that say nothing of a site.
NEUTRAL = frozenset(("www", "m", "mobile", "blog", "com", "net", "org", "info", "biz", "io", "co", "uk", "de", "fr", "es", "en", "us", "html", "htm", "php", "index", "example", "the"))
#: Cost of an unknown run: a start and a price for each letter, in natural logarithms.
UNKNOWN_START, UNKNOWN_LETTER = 9.0, 2.5
LONGEST_LABEL = 63
#: Added to a word's count in both classes.
SMOOTHING = 0.3
_RUN = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Rule:
    """allow or block a host with its subdomains, where the path begins with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


#: A word of the corpus is kept if it makes up this share of all that were counted, so at most 200,000 are.
LEAST_SHARE = 5e-6


class Model:
    """corpus: words and in how many texts each occurs; bad, good: words and how often judged urls hold them."""

    def __init__(self, unwanted: tuple[str, ...] = UNWANTED, ordinary: tuple[str, ...] = ORDINARY, prior: float = 0.2, corpus: dict[str, int] | None = None, bad: dict[str, int] | None = None, good: dict[str, int] | None = None) -> None:
        self.names, self.prior_share, self.corpus = (unwanted, ordinary), prior, corpus or {}
        named = [Counter(w for name in names for w in name.split()) for names in (unwanted, ordinary)]
        counts = [n + Counter(more or {}) for n, more in zip(named, (bad, good), strict=True)]
        words = counts[0] + counts[1] + Counter({w: 1 for w in NEUTRAL})
        parts = [(c, sum(c.values())) for c in (words, self.corpus) if c]
        share = lambda w: sum(c.get(w, 0) / total for c, total in parts) / len(parts)
        self.cost = {w: -log(share(w)) for c, _ in parts for w in c}
        self.longest = max(map(len, self.cost), default=1)
        kinds = len(set(counts[0]) | set(counts[1]))
        n_bad, n_good = (sum(c.values()) for c in counts)
        self.odds = {w: log((counts[0][w] + SMOOTHING) / (n_bad + SMOOTHING * kinds)) - log((counts[1][w] + SMOOTHING) / (n_good + SMOOTHING * kinds)) for w in counts[0] + counts[1] if w not in NEUTRAL}
        self.prior = log(prior / (1 - prior))

    def segment(self, name: str) -> list[str]:
        """The cheapest cut of a run of letters; neighbouring unknown letters stay together."""
        n = len(name)
        best = [(0.0, 0)] + [(float("inf"), 0)] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(name[start:end])
                if cost is not None and best[start][0] + cost < best[end][0]:
                    best[end] = (best[start][0] + cost, start)
            for start in range(max(0, end - LONGEST_LABEL), end):
                cost = best[start][0] + UNKNOWN_START + UNKNOWN_LETTER * (end - start)
                if cost < best[end][0]:
                    best[end] = (cost, start)
        out = []
        while n:
            out.append(name[best[n][1] : n])
            n = best[n][1]
        return out[::-1]

    def runs(self, host: str, path: str) -> list[list[str]]:
        """Words of each run of letters in host and path; runs longer than a label may be are cut at that length first."""
        runs = _RUN.findall(host) + _RUN.findall(path.lower())
        return [self.segment(r[i : i + LONGEST_LABEL]) for r in runs for i in range(0, len(r), LONGEST_LABEL)]

    def words(self, host: str, path: str) -> list[str]:
        return [w for run in self.runs(host, path) for w in run]

    def score(self, host: str, path: str) -> float:
        """Log odds that the page is unwanted; below 0 for a url without known words.

        A word next to letters that no word explains may be no word at all (camberwell), so a run's words count by the share
        of its letters that known words cover.
        """
        out = self.prior
        for run in self.runs(host, path):
            known = sum(len(w) for w in run if w in self.cost)
            out += sum(self.odds.get(w, 0.0) for w in run) * known / sum(map(len, run))
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The text of the longest rule that fits, of equal ones the first; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.text).otherwise(out)
    return out


def corpus_words(texts: DataFrame, text_col: str, *, markup: bool = False, least_share: float = LEAST_SHARE) -> dict[str, int]:
    """Words of two to 24 letters a to z, lower-cased, and in how many of all texts each occurs, for the commoner ones.

    With markup, tags are cut out first. Null texts hold no words; one that is repeated counts each time. A kept word makes
    up least_share of all that was counted (and two texts hold it), so the number collected is bounded by 1 / least_share.
    """
    text = F.lower(F.col(text_col).cast("string"))
    text = F.regexp_replace(text, r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ") if markup else text
    found = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\p{L})([a-z]{2,24})(?!\p{L})"), 1))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = written(found, "words")
    total = found.agg(F.sum("n")).first()[0] or 0
    return dict(found.filter(F.col("n") >= max(2, total * least_share)).collect())


def learn(urls: DataFrame, model: Model, url_col: str = "url", label_col: str = "unwanted", *, least_share: float = 1e-5) -> Model:
    """The model with the words of judged urls (label 1 for unwanted) added; null urls and labels teach nothing.

    Each distinct host counts once a label, so a host of many pages weighs as much as any. Words rarer than least_share of a
    label's words are left out, which bounds what is collected.
    """
    ship(urls.sparkSession)
    host, path = split_url(F.col(url_col).cast("string"))
    pages = urls.select(host.alias("host"), path.alias("path"), F.col(label_col).cast("int").alias("y")).filter("y is not null and host <> ''")
    once = pages.groupBy("host", "y").agg(F.min("path").alias("path"))

    @F.pandas_udf("array<string>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            yield pd.Series([model.words(h, p) for h, p in zip(host, path, strict=True)], dtype=object)

    words = written(once.select("y", F.explode(cut("host", "path")).alias("word")).groupBy("y", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = dict(words.groupBy("y").agg(F.sum("n")).collect())
    both = [dict(words.filter((F.col("y") == y) & (F.col("n") >= totals.get(y, 0) * least_share)).select("word", "n").collect()) for y in (1, 0)]
    return Model(*model.names, model.prior_share, model.corpus, *both)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: tuple[Rule, ...] = RULES, model: Model | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, unwanted (log odds by the model), verdict (allow or block).

    Null and malformed urls have an empty host and path, no rule, and are allowed. Repeated rows give repeated rows, other
    columns are ignored, an empty table gives an empty table. Nothing is shuffled.
    """
    ship(pages.sparkSession)
    model = model or Model()

    @F.pandas_udf("double")
    def unwanted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(100_000)(model.score)
        for host, path in parts:
            yield pd.Series([known(h, p) for h, p in zip(host, path, strict=True)], dtype="float64")

    host, path = split_url(F.col(url_col).cast("string"))
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    verdicts = {r.text: r.verdict for r in rules}
    out = out.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("unwanted", unwanted("host", "path"))
    ruled = F.lit(None).cast("string")
    for text, verdict in verdicts.items():
        ruled = F.when(F.col("rule") == text, verdict).otherwise(ruled)
    return out.withColumn("verdict", F.coalesce(ruled, F.when(F.col("unwanted") > 0, "block").otherwise("allow")))
