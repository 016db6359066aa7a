"""URL filter: host and path rules, and boosted trees on lexical features for the rest. DataFrame functions only."""

from __future__ import annotations

import math
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Rules are compiled into one expression; a driver-side list, so bounded.
MOST_RULES = 2000
TREES, DEPTH, RATE, BINS, RIDGE = 24, 3, 0.3, 32, 1.0
#: Labelled URLs that fitting may use, the first by hash; they reach the driver as whole-number bins, equal ones once.
FIT_ROWS = 20_000
#: Labelled URLs of the same kind that a suffix's rate is drawn towards the mean by.
SUFFIX_PRIOR = 8

_BAD = ("casino", "royal", "bets", "meds", "win", "hot", "adult", "cams", "spam", "ads", "click", "pills", "bonus", "loan", "lotto", "sex", "replica", "seo", "crypto", "warez")
_GOOD = ("library", "weather", "garden", "history", "recipes", "museum", "science", "news", "maps", "poetry", "city", "star", "chess", "theatre", "rail", "botany", "school", "archive", "maths", "music")
#: Invented URLs of each label in the seed list.
SEEDS = 1500


def _seed_url(rng: Random, words: tuple[str, ...], bad: bool) -> str:
    """One invented URL: each trait is drawn by itself, and is only likelier in one label than in the other."""
    often = lambda p, q: rng.random() < (p if bad else q)
    name = ("-" if often(0.5, 0.2) else "").join(rng.choice(words) for _ in range(1 + often(0.8, 0.5) + often(0.3, 0.1)))
    if often(0.4, 0.1):
        name += str(rng.randrange(10 ** rng.randrange(1, 5)))
    if often(0.3, 0.05):
        name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(8, 20))) + "." + name
    elif often(0.4, 0.6):
        name = rng.choice(("www", "blog", "m")) + "." + name
    if often(0.4, 0.6):
        name += ".example"
    name += "." + rng.choice(("com", "net", "org", *(("top", "xyz", "biz") if often(0.5, 0.05) else ("edu", "com", "org"))))
    steps = ["".join(rng.choice(("en", "de", "a", "page", "item", "view", "read")) for _ in range(1 + often(0.3, 0.3))) for _ in range(rng.randrange(1, 3) + 2 * often(0.4, 0.15))]
    if often(0.7, 0.6):
        steps.append(str(rng.randrange(10 ** (rng.randrange(3, 10) if often(0.4, 0.15) else rng.randrange(1, 5)))) + rng.choice(("", "/", ".html")))
    params = [f"{k}={rng.randrange(99)}" for k in ("page", "ref", "aff", "cid", "utm_source") if often(0.3, 0.15)]
    return rng.choice(("http://", "https://")) + name + "/" + "/".join(steps) + ("?" + "&".join(params) if params else "")


def seed_urls() -> list[tuple[str, int]]:
    """Labelled URLs (1: block) to start from: invented, the same at every call, and told apart by no single feature."""
    rng = Random(7)
    return [(_seed_url(rng, words, y == 1), y) for _ in range(SEEDS) for y, words in ((1, _BAD), (0, _GOOD))]


def seeds(spark: SparkSession) -> DataFrame:
    rows = ",".join(f"('{u}',{y})" for u, y in seed_urls())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def host(url: Column) -> Column:
    """From after the first :// to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end to ?, # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.char_length(u))).otherwise("")


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null without one; of equal ones the first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = verdict = None
    for v, r in sorted(rules, key=lambda x: -len(x[1])):
        rh, _, rp = r.partition("/")
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith("/" + rp)
        name = F.when(fits, r) if name is None else name.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def suffix_bins(labelled: DataFrame) -> tuple[list[list[str]], int]:
    """Last host labels by bin of their smoothed share of blocked URLs, and the bin of all others; from one small aggregate."""
    s = labelled.select(_suffix(host(F.col("url"))).alias("s"), "label").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).collect()
    total, bad = sum(r["n"] for r in s), sum(r["k"] for r in s)
    base = (bad + 1) / (total + 2)
    bin_ = lambda rate: min(BINS - 1, int(rate * (BINS - 1)))
    out: list[list[str]] = [[] for _ in range(BINS)]
    for r in sorted(s, key=lambda r: r["s"]):
        out[bin_((r["k"] + SUFFIX_PRIOR * base) / (r["n"] + SUFFIX_PRIOR))].append(r["s"])
    other = bin_(base)
    out[other] = []
    return out, other


def _suffix_bin(h: Column, bins: list[list[str]], other: int) -> Column:
    """Every suffix of the fitted rows has its bin; they are at most FIT_ROWS and looked up as sets."""
    out, s = F.lit(other), _suffix(h)
    for i, names in enumerate(bins):
        if names:
            out = F.when(s.isin(names), i).otherwise(out)
    return out


def _suffix(h: Column) -> Column:
    return F.regexp_extract(h, r"[^.]*$", 0)


def _share(s: Column, cls: str) -> Column:
    n = F.char_length(s)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(s, cls, ""))) / n).otherwise(0.0)


def _entropy(s: Column) -> Column:
    """Bits a character."""
    chars = F.split(s, "")
    n = F.char_length(s)
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - part(c) * F.log2(part(c)))).otherwise(0.0)


def features(url: Column, suffixes: tuple[list[list[str]], int]) -> dict[str, Column]:
    """Lexical features, each as a whole-number bin from 0 to BINS - 1."""
    u, h, p = F.coalesce(url, F.lit("")), host(url), path(url)
    count = lambda s, ch: F.char_length(s) - F.char_length(F.replace(s, F.lit(ch), F.lit("")))
    raw = {
        "length": F.char_length(u) / 8,
        "depth": count(p, "/") * 2,
        "digits": _share(u, "[0-9]+") * 64,
        "entropy": _entropy(h) * 6,
        "params": count(u, "&") + F.when(F.contains(u, F.lit("?")), 1).otherwise(0),
        "hyphens": count(h, "-"),
        "labels": count(h, "."),
        "host": F.char_length(h) / 3,
        "host_digits": _share(h, "[0-9]+") * 64,
        "suffix": _suffix_bin(h, *suffixes),
    }
    return {k: F.least(F.lit(BINS - 1), F.floor(v)).cast("int") for k, v in raw.items()}


def boost(rows: list[tuple[tuple[int, ...], int, int]], trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[tuple[list[tuple[int, int]], list[float]]]]:
    """Gradient boosting with logistic loss on (bins, label, weight) rows: a base margin and symmetric trees.

    A tree asks at each level whether one feature is at or over one cut, the same for all its
    leaves; the split with the greatest gain g^2 / (h + RIDGE), summed over leaves, is taken, of
    equal ones the first by feature and cut. Leaves are RATE * g / (h + RIDGE)."""
    n, bad = sum(w for *_, w in rows), sum(w for _, y, w in rows if y)
    base = math.log((bad + 1) / (n - bad + 1))
    if not rows:
        return base, []
    margin, out, names = [base] * len(rows), [], len(rows[0][0])
    gain = lambda g, h: g * g / (h + RIDGE)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [w * (y - q) for (_, y, w), q in zip(rows, p, strict=True)]
        hess = [w * q * (1 - q) for (*_, w), q in zip(rows, p, strict=True)]
        leaf, splits, leaves = [0] * len(rows), [], []
        for level in range(depth):
            hist = [[[0.0, 0.0] for _ in range(names * BINS)] for _ in range(1 << level)]
            for (x, *_), at, g, h in zip(rows, leaf, grad, hess, strict=True):
                mine = hist[at]
                for f, b in enumerate(x):
                    cell = mine[f * BINS + b]
                    cell[0] += g
                    cell[1] += h
            best = None
            for f in range(names):
                sums = [cells[f * BINS : (f + 1) * BINS] for cells in hist]
                whole = [(sum(c[0] for c in s), sum(c[1] for c in s)) for s in sums]
                left = [(0.0, 0.0)] * len(sums)
                for cut in range(1, BINS):
                    left = [(g + s[cut - 1][0], h + s[cut - 1][1]) for (g, h), s in zip(left, sums, strict=True)]
                    right = [(a - g, b - h) for (a, b), (g, h) in zip(whole, left, strict=True)]
                    value = round(sum(gain(*x) for x in left + right) - sum(gain(*x) for x in whole), 9)
                    if value > 1e-6 and (best is None or value > best[0]):
                        best = (value, (f, cut), [RATE * g / (h + RIDGE) for pair in zip(left, right, strict=True) for g, h in pair])
            if best is None:
                break
            splits.append(best[1])
            leaves = best[2]
            f, cut = best[1]
            leaf = [at * 2 + (x[f] >= cut) for at, (x, *_) in zip(leaf, rows, strict=True)]
        if not splits:
            break
        out.append((splits, leaves))
        margin = [m + leaves[at] for m, at in zip(margin, leaf, strict=True)]
    return base, out


class Boosted:
    """Boosted trees fitted on at most limit labelled URLs, and applied as one expression.

    Two small jobs bring what fitting needs to the driver: URL counts by suffix, and the distinct
    bin vectors with their weights."""

    def __init__(self, labelled: DataFrame, trees: int = TREES, limit: int = FIT_ROWS):
        known = labelled.where(F.col("label").isNotNull()).select("url", F.col("label").cast("int").alias("label"))
        part = min(1.0, 0.9 * limit / max(1, known.count()))
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(part * (1 << 20)))
        self.suffixes = suffix_bins(known)
        bins = features(F.col("url"), self.suffixes)
        self.names = list(bins)
        rows = known.select(F.col("label").alias("y"), *[c.alias(k) for k, c in bins.items()]).groupBy("y", *self.names).agg(F.count(F.lit(1)).alias("w"))
        self.base, self.trees = boost(sorted((tuple(r[k] for k in self.names), r["y"], r["w"]) for r in rows.collect()), trees)

    @staticmethod
    def _leaf(splits, col) -> Column:
        at = F.lit(0)
        for f, cut in splits:
            at = at * 2 + F.when(col(f) >= cut, 1).otherwise(0)
        return at

    def margin(self, col) -> Column:
        total = F.lit(self.base)
        for splits, leaves in self.trees:
            total = total + F.get(F.array(*map(F.lit, leaves)), self._leaf(splits, col))
        return total

    def judge(self, df: DataFrame, url: str = "url", out: str = "block_score") -> DataFrame:
        """df with the probability of a block in out, which replaces a column of that name; bins are computed once a row."""
        names = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
        (held,) = fresh(df, "bins")
        bins = df.select(*names, F.array(*features(F.col(f"`{url}`"), self.suffixes).values()).alias(held))
        return bins.select(*names, (1 / (1 + F.exp(-self.margin(lambda f: F.get(held, F.lit(f)))))).alias(out))


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and block_score; columns of those names are replaced.

    A rule's verdict stands where one fits, the longest winning; else the trees block from 0.5 on.
    labelled has url and label (1: block) and defaults to the seed list; of a large one FIT_ROWS rows
    are used. Rules of equal length that fit the same url are tried in the order given. Null urls have empty host and path, no rule, and the score of an
    empty url. Long urls count whole, repeated rows are judged alike, an empty table stays empty."""
    base = pages.drop("host", "path", "rule", "verdict", "block_score")
    trees = Boosted(seeds(pages.sparkSession) if labelled is None else labelled)
    d = trees.judge(base, url).withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))
    return d


def op2(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page."""
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


def query(spark, sf_dir: str) -> DataFrame:
    return op2(table(spark, sf_dir, "pages"))
