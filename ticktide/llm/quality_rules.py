"""Quality rules: fixed base rules, and thresholds adapted to each language and source by mergeable quantile sketches.

DataFrame functions only. The sketch of a metric is a histogram over log-linear buckets of its
integer values (relative width at most 1/32): sums of counts merge it in any order with one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, stage, table

WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: A threshold is the group's median plus SPREADS times its mean distance above the median.
SPREADS = 8
#: Documents that a group's language counts for in its threshold, and the corpus in the language's.
SHRINK = 100
#: Units over the threshold that mean nothing in any document (characters, lines or words; one pair of equal windows).
SLACK = {"symbols": 2, "upper": 2, "dup_lines": 2, "repeats": 16, "echoes": 2}
METRICS = tuple(SLACK)


def _per(part: Column, whole: Column, scale: int = 1000) -> Column:
    """Whole thousandths of part in whole, 0 where there is nothing."""
    return F.when(whole > 0, F.floor(part * scale / whole)).otherwise(0).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct q of counts and metrics of text; a column already named q is replaced, others may have any name.

    Null and empty texts count 0 everywhere. Windows are compared by 64-bit hashes, within one text."""
    kept = [f"`{c}`" for c in docs.columns if c.lower() != "q"]
    names = ["doc"]
    d = docs.select(F.struct(*kept).alias("doc") if kept else F.struct(F.lit(None).alias("q")).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("q_t"))
    d = d.withColumn("q_w", F.filter(F.split("q_t", SPACE_CLASS, -1), lambda w: w != ""))
    d = d.withColumn("q_l", F.filter(F.split("q_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    length = lambda c: F.char_length(c).cast("long")
    without = lambda cls: length(F.col("q_t")) - length(F.regexp_replace("q_t", cls, ""))
    d = d.select(
        *names,
        F.size("q_w").cast("long").alias("q_n"),
        F.aggregate("q_w", F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)).alias("q_chars"),
        without("[#*$%&|<>]+").alias("q_symbols"),
        without("[A-Z]+").alias("q_upper"),
        F.size("q_l").cast("long").alias("q_lines"),
        (F.size("q_l") - F.size(F.array_distinct("q_l"))).cast("long").alias("q_dup"),
        F.transform("q_w", lambda w: F.xxhash64(w)).alias("q_h"),
    )
    windows = F.when(F.col("q_n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("q_n").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get("q_h", i + k) for k in range(WINDOW)])))
    echoes = F.size(F.filter("q_h", lambda h, i: F.get("q_h", i - 1) == h)).cast("long")
    d = d.withColumn("q_g", windows).withColumn("q_e", echoes).drop("q_h")
    d = d.withColumn("q_s", F.when(F.size("q_g") > F.size(F.array_distinct("q_g")), F.array_sort(F.transform("q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("q_g")
    d = d.withColumn("q_p", _covered(F.col("q_s"))).drop("q_s")
    return d.select(
        *([F.col("doc.*")] if kept else []),
        F.struct(
            F.col("q_n").alias("n_words"),
            F.col("q_chars").alias("word_chars"),
            F.col("q_symbols").alias("n_symbols"),
            F.col("q_dup").alias("n_dup_lines"),
            F.col("q_p").alias("n_repeat_words"),
            F.col("q_upper").alias("n_upper"),
            F.col("q_lines").alias("n_lines"),
            F.col("q_e").alias("n_echoes"),
            _per(F.col("q_symbols"), F.col("q_chars")).alias("symbols"),
            _per(F.col("q_upper"), F.col("q_chars")).alias("upper"),
            _per(F.col("q_dup"), F.col("q_lines")).alias("dup_lines"),
            _per(F.col("q_p"), F.col("q_n")).alias("repeats"),
            _per(F.col("q_e"), F.col("q_n")).alias("echoes"),
        ).alias("q"),
    )


def _covered(s: Column) -> Column:
    """Words in the windows of the sorted (hash, position) array that have an equal neighbour."""
    twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    return F.coalesce(F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start, step, lambda a: a["n"]), F.lit(0).cast("long"))


def bucket(v: Column) -> Column:
    """Lower edge of the log-linear bucket of a whole number of 0 or more."""
    drop = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop))


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """groups, metric, value (bucket edge), n: mergeable by summing n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"q.{m}")).alias("value")) for m in METRICS]))
    return measured.select(*groups, pairs.alias("x")).groupBy(*groups, "x.metric", "x.value").agg(F.count(F.lit(1)).alias("n"))


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source with a threshold per metric, in millionths.

    From a group's sketch come its median and its spread, the mean over its documents of how far
    they lie above the median; the threshold is median + SPREADS * spread. It is shrunk towards the
    language's mean threshold as if that were SHRINK documents more, and the language's likewise
    towards the corpus's, so that a small group's threshold moves smoothly as the group grows."""
    fine = sketch(measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), "q").where(base_ok()), ["lang", "source"])
    w = Window.partitionBy("lang", "source", "metric")
    at = fine.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("value")))
    at = at.withColumn("mid", F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("value"))).over(w))
    # allowed is the threshold times the documents, a whole number, so that sums over groups are exact.
    allowed = F.first("total") * F.first("mid") + SPREADS * F.sum(F.col("n") * F.greatest(F.col("value") - F.col("mid"), F.lit(0)))
    group = at.groupBy("lang", "source", "metric").agg(F.first("total").alias("total"), (1000 * allowed).alias("allowed"))
    language = group.groupBy("lang", "metric").agg(F.sum("total").alias("t1"), F.sum("allowed").alias("a1"))
    corpus = language.groupBy("metric").agg(F.sum("t1").alias("t2"), F.sum("a1").alias("a2"))
    language = language.join(corpus, "metric").select(F.col("lang").alias("lang1"), F.col("metric").alias("metric1"), F.expr(f"(a1 + {SHRINK} * (a2 div t2)) div (t1 + {SHRINK})").alias("near"))
    rows = group.join(language, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("metric") == F.col("metric1"))).withColumn("cut", F.expr(f"(allowed + {SHRINK} * near) div (total + {SHRINK})"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("cut"))).alias(f"max_{m}") for m in METRICS])


def base_ok() -> Column:
    q = F.col("q")
    return ~((q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"]))


def judge(measured: DataFrame, cuts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured with base_failed and kept (columns of these names are replaced); no metric of a kept document is over its group's threshold by more than SLACK units."""
    cuts = cuts.select(F.col("lang").alias("cut_lang"), F.col("source").alias("cut_source"), F.struct(*[f"max_{m}" for m in METRICS]).alias("cut"))
    j = measured.drop("base_failed", "kept").join(cuts, measured[lang].eqNullSafe(cuts["cut_lang"]) & measured[source].eqNullSafe(cuts["cut_source"]), "left").drop("cut_lang", "cut_source")
    within, counts = F.lit(True), {"symbols": ("n_symbols", "word_chars"), "upper": ("n_upper", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "echoes": ("n_echoes", "n_words")}
    for m, (part, whole) in counts.items():
        within = within & F.coalesce(1_000_000 * (F.col(f"q.{part}") - SLACK[m]) <= F.col(f"cut.max_{m}") * F.col(f"q.{whole}"), F.lit(True))
    return j.withColumn("base_failed", ~base_ok()).withColumn("kept", base_ok() & within).drop("cut")


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    m = stage(measure(docs.select("doc_id", "lang", "source", "text")).drop("text"), "measured")
    return judge(m, thresholds(m)).select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the rows that the rules reject, all columns as they were.

    Null languages and sources are groups like others; repeated rows are judged alike; a value
    equal to its threshold passes; an empty table stays empty; texts count whole."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    m = stage(measure(whole).drop("text"), "measured")
    return judge(m, thresholds(m)).where("kept").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return op7(table(spark, sf_dir, "documents"))
