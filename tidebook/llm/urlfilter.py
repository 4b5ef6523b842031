"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 18
ORDERS = (2, 3, 4, 5)

# Words of the labelled URL table: fixed values. Roots of unwanted names: gambling, pills, adult content, quick money,
# counterfeits, pirated software, link spam, malware.
UNWANTED = (
    "casino poker slots jackpot roulette blackjack baccarat craps bingo keno lotto lottery bets betting bookie bookmaker sportsbook wager gambling punter toto slotmachine freespins highroller "
    "viagra cialis levitra pills meds tramadol xanax valium ambien steroids anabolics slimming dietpills weightloss testosterone enlargement botox hgh opioids oxycodone "
    "xxx porn sex adult escort escorts cams webcam hookup hookups singles milf hentai erotic nude nudes fetish hotgirls sexchat strip camgirls "
    "loan loans payday cash fastcash money earn doubler forex bitcoins hyip ponzi getrich cashback moneyback creditfix nocredit debtfix sweepstakes giveaway giftcards "
    "replica replicas rolex fake fakes counterfeit knockoff fakeid passports diplomas cloned skimmer "
    "warez crack cracked keygen torrent torrents serials nulled pirate pirated cheats modapk rapidleech megaupload "
    "spam spammer linkfarm backlinks seo followers likes traffic clicks clickbait ads adserver adclick tracker tracking popup popunder doorway "
    "malware phishing trojan ransomware spyware keylogger botnet exploitkit stealer hacktool carding cvv"
).split()
#: What stands around such roots in unwanted names.
AROUND = (
    "free cheap best buy online win winner bonus vip hot live top fast easy instant now deal deals discount discounts offer offers prize club 24 247 365 777 888 4u 123 x xx pro king royal lucky mega super real shop store direct secret sale"
).split()
#: What names of other sites are made of.
WANTED = (
    "library museum university school college research science history health hospital garden flowers recipe kitchen bread coffee travel hotel city council news "
    "daily weather sports club music radio theatre film photo gallery art book books novel poetry writer blog forum community open source code linux docs guide "
    "project data map maps road bridge river mountain lake forest bird animal farm farmers market village church house home family kids toys game chess puzzle math "
    "physics chemistry biology medicine law court bank insurance tax post railway airport bus bicycle car motor engine energy solar water climate earth ocean "
    "island north south green blue red white silver stone wood metal glass paper print design studio fashion shoe shirt tea wine cheese fish apple orange summer winter "
    "cooking hiking fishing wedding building training shipping knitting running cycling painting writing reading housing planning parking learning teaching shop store pharmacy"
).split()
#: Harmless words that hold a root, or what stands around it, as a part.
LOOKALIKES = (
    "better betterhomes between alphabet elizabeth sherbet tibet bethany abettor diabetes betwixt gobetween winter winnipeg window windows wind winery winston winchester winding twin darwin baldwin goodwin edwin "
    "cheapside freedom freelance freeman freeway freestyle carefree freezer freeport essex sussex middlesex wessex sextant sextet unisex sexton bisexuality cashmere cashew cashier moneypenny monet monetary harmony testimony ceremony "
    "poke pokemon spamhaus spamalot adsorption heads beads roads leads broads pads threads uploads loads nomads roadside shipload loaner salon loanhead lotion lotus lothian charlotte pilot pilots allotment shallots ballot "
    "pillsbury pillar pillow caterpillar spills medsci comedy comets nomeds likes likely likeness alike dislikes unlike seoul seorang museo videos clicks clicker cyclicks trackside trackers tracks tractor racetrack soundtrack backtrack "
    "buyer buyers buying topic topology stop laptop rooftop topaz hotel hotels shot photos hotchkiss hottinger livery oliver delivery olive alive deliverance best bestow bestseller everest kingston baking parking viking talking kingdom stockings "
    "royalty viceroy luckynow saleem salem jerusalem wholesale proper product professor protein prose proud reality realm realtor surreal cereal superior superb supervisor megabyte omega megan megaphone prized surprise enterprise comprise "
    "farmville fastener breakfast steadfast belfast fasten easygoing measures deaseasy crackers firecracker crackle nutcracker cracow torrential torrens serially cereals cereal serialist pirates torte tortoise trojanhorse troy trojans "
    "fakenham fakir forexample forest foreign adultery adulthood pornic porno strip stripes airstrip stripling erotica neurotic nudelman denude escorted camshaft camshafts camera cambridge camus dreamcams singleton singles milford milfoil "
    "slotted slots timeslot rouletteer jackdaw pokey bingen bingley lotteries wagering wagner craps scraps keynote kenosha ambience valiant botanic botany exploit exploits stealers steel steals"
).split()
SYLLABLES = "an ba che cor da der el et fi fo gan her ho in ist jo ka ker lu mel men no or ot pa pen qui ra ret ry sol sta ten ter tra ur va wen whe yo zan".split()
ENDINGS = ("com", "com", "net", "org", "info", "io", "co.uk", "de", "fr", "es", "shop", "site", "online", "biz", "eu", "us")
#: Ends that only the names of other sites have, and that mostly unwanted ones have.
SOBER, CHEAP = ("edu", "gov", "ac.uk", "ca", "gov.uk"), ("xyz", "top", "win", "club", "loan", "bid")
PAGES = ("", "/", "/{n}", "/{l}/{n}", "/{l}/{n}.html", "/{l}/{w}", "/{w}/{n}", "/{w}.html", "/page/{n}", "/20{y}/{n}/{w}", "/index.html", "/{w}/{w2}/", "/{l}/{w}-{n}")
LANGUAGES = ("en", "de", "fr", "es", "it", "nl")


def kept_back(word: str) -> bool:
    """The fifth of the words of either kind that are left out when a model is to be tried on words it has not seen."""
    return zlib.crc32(word.encode()) % 5 == 0


def labelled_urls(rows: int = 12_000, seed: int = 5, words: Callable[[str], bool] = lambda w: True) -> list[tuple[str, int]]:
    """The small labelled table: (host + path, 1 for unwanted), a third of them unwanted, of the roots and lookalikes for which
    `words` is true. Unwanted names are one or two roots, mostly with something around them; others are words, lookalikes
    and invented ones, as brands are, some with what stands around roots too. Prefixes and pages are alike for both."""
    r = random.Random(seed)
    roots, alike = [w for w in UNWANTED if words(w)], [w for w in LOOKALIKES if words(w)]
    out = []
    for i in range(rows):
        unwanted = i % 3 == 0
        if unwanted:
            name = r.sample(roots, 1 if r.random() < 0.8 else 2) + r.sample(AROUND, r.choice((0, 1, 1, 1, 2)))
            r.shuffle(name)
            end = r.choice(CHEAP) if r.random() < 0.2 else r.choice(ENDINGS)
        else:
            kind = r.random()
            brand = lambda: "".join(r.choices(SYLLABLES, k=r.randint(2, 4)))
            if kind < 0.4:
                name = [r.choice(alike)] + ([r.choice(WANTED)] if r.random() < 0.4 else [])
            elif kind < 0.7:
                name = r.sample(WANTED, r.choice((1, 2, 2)))
            else:
                name = [brand() for _ in range(r.choice((1, 1, 2)))]
            if r.random() < 0.06:
                name.insert(r.choice((0, len(name))), r.choice(AROUND))
            end = r.choice(SOBER) if r.random() < 0.15 else r.choice(ENDINGS)
        host = r.choice(("", "", "www.", "m.", "blog.", "shop.")) + r.choice(("-", "-", "")).join(name) + "." + r.choice(("", "", "", "example.")) + end
        page = r.choice(PAGES).format(n=r.randint(1, 9999), l=r.choice(LANGUAGES), y=r.randint(10, 29), w=r.choice(WANTED), w2=r.choice(WANTED))
        out.append((host + page, int(unwanted)))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    pattern, url = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def ngrams(address: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the address's character n-grams, and what each counts: those of the host, with its ends and
    hyphens marked, and apart from them those of the path count the root of their number less, so that neither a long path
    nor a long host outweighs the other."""
    host, slash, path = address.partition("/")
    buckets, scales = [], []
    for part, marked in (("h", f"^{host}$" if host else ""), ("p", f"/{path}$" if slash else "")):
        found = {zlib.crc32((part + marked[i : i + n]).encode("utf-8", "surrogatepass")) % BUCKETS for n in ORDERS for i in range(len(marked) - n + 1)}
        buckets += sorted(found)
        scales += [len(found) ** -0.5 for _ in found]
    return np.array(buckets, np.int64), np.array(scales, np.float64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def probability(self, address: str) -> float:
        """That the page is unwanted."""
        at, scale = ngrams(address)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at] @ scale, -30, 30))))


def train(table: Sequence[tuple[str, int]], steps: int = 500, rate: float = 0.05, decay: float = 3e-6) -> UrlModel:
    """Weights and bias of least logistic loss with a ridge, by Adam, of a small table of (host + path, 1 for unwanted). It
    is held whole: a list that people label, of at most some ten thousand rows. An empty table allows everything."""
    if not table:
        return UrlModel(np.zeros(BUCKETS), -1.0)
    rows = [ngrams(a) for a, _ in table]
    y = np.array([label for _, label in table], np.float64)
    n = np.array([len(x) for x, _ in rows])
    used, at = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
    owner, scale = np.repeat(np.arange(len(rows)), n), np.concatenate([x for _, x in rows])
    w, first, second = (np.zeros(len(used) + 1) for _ in range(3))  # the bias comes last
    for step in range(1, steps + 1):
        margin = w[-1] + np.bincount(owner, w[at] * scale, len(rows))
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(rows)
        slope = np.append(np.bincount(at, err[owner] * scale, len(used)) + decay * w[:-1], err.sum())
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1]
    return UrlModel(weights, float(w[-1]))


@cache
def built_in() -> UrlModel:
    """The model of the built-in table, trained once per process."""
    return train(labelled_urls())


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, `host/path`) that fits, as a struct(rule, verdict), else null. Rules are
    configuration, a short list in the plan; of equally long ones the first by text wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], table: Sequence[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict, probability).

    Host: after the first `://` up to `/`, `?`, `#` or the end; path: from there up to `?`, `#` or the
    end. Null urls and urls without `://` have both empty: no rule fits, and the model, which then has
    only its bias, judges them; with the built-in table they are allowed. A rule fits its host and all subdomains if the path starts with the
    rule's. Repeated rows are judged alike; no rows give no rows; other columns are not read.
    """
    model = built_in() if table is None else train(table)
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # plain data: executors need not have this class

    @F.pandas_udf(T.DoubleType())
    def probability(address: pd.Series) -> pd.Series:
        known, own = {}, UrlModel(*shared.value)
        return address.map(lambda a: known[a] if a in known else known.setdefault(a, own.probability(a)))

    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fits", rule_for(F.col("host"), F.col("path"), rules)).withColumn("probability", probability(F.concat("host", "path")))
    judged = F.when(F.col("probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", judged).alias("verdict"), "probability")
