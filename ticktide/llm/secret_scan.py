"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Parts that mean nothing alone.
WEAK_ID = r"""(?i:client_?id|access_?key(?:_?id)?|key_?id|user_?name|user|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}|(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}"""
WEAK_SECRET = r"""(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32,}+|(?i:pwd|pass|auth|bearer|private_?key|credentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
ENDPOINT = r"""(?i:https?|ftps?|ssh|jdbc:[a-z0-9]{1,20}|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._~:@/?&=%+-]{4,}|(?i:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
#: Parts whose spans are at most so many characters apart share a scope.
SCOPE = 256
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
SPAN = "array<struct<kind:string,a:int,b:int>>"


def _let(x: Column, f) -> Column:
    """f of x, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(a: Column, zero: Column, op) -> Column:
    """op over the items up to each one, in blocks of about the root of the array's size, so its cost grows with size ** 1.5."""

    def scan(v: Column, n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / n).cast("int") - 1), lambda k: F.slice(v, k * n + 1, n))
        inside = lambda block, before: F.transform(block, lambda _, i: F.aggregate(F.slice(block, 1, i + 1), before, op))
        each = lambda b, sums: F.transform(b, lambda block, k: _let(F.aggregate(F.slice(sums, 1, k), zero, op), lambda before: inside(block, before)))
        return F.flatten(_let(blocks, lambda b: _let(F.transform(b, lambda block: F.aggregate(block, zero, op)), lambda sums: each(b, sums))))

    return _let(a, lambda v: F.when(F.size(v) > 0, _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda n: scan(v, n))).otherwise(v))


def spans(t: Column, kind: str, pattern: str, keep=None) -> Column:
    """Code point spans of the leftmost non-overlapping matches, of those that keep accepts: starts are running sums of the lengths between and of the matches."""

    def place(found: Column) -> Column:
        steps = lambda between: F.transform(found, lambda _, i: F.char_length(F.get(between, i)) + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0))
        starts = running(_let(F.split(t, pattern, -1), steps), F.lit(0), lambda s, x: s + x)
        span = lambda at, m, i: F.struct(F.lit(kind).alias("kind"), F.get(at, i).alias("a"), (F.get(at, i) + F.char_length(m)).alias("b"))
        all_ = lambda at: F.transform(found, lambda m, i: F.when(keep(m), span(at, m, i)) if keep else span(at, m, i))
        return F.filter(_let(starts, all_), lambda x: x.isNotNull())

    none = F.array().cast(SPAN)
    return _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none)).cast(SPAN)


def near(xs: Column, ys: Column, scope: int, wanted: bool = True) -> Column:
    """The spans of xs with one of ys at most scope characters apart (-1: overlapping), or those without.

    An interval join by one sweep: both lists in order of their starts, for each x the furthest end
    of the ys before it and the start of the next one."""
    none, far = F.array().cast(SPAN), F.lit(1 << 30)
    side = lambda s, k: F.transform(s, lambda x: F.struct(x["a"].alias("a"), F.lit(k).alias("side"), x["b"].alias("b"), x["kind"].alias("kind")))

    def sweep(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["side"] == 0, x["b"]).otherwise(-far)), -far, lambda s, x: F.greatest(s, x))
        starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["side"] == 0, x["a"]).otherwise(far))), far, lambda s, x: F.least(s, x)))

        def pick(before: Column, after: Column) -> Column:
            close = lambda x, i: (F.get(before, i) >= x["a"] - scope) | (F.get(after, i) <= x["b"] + scope)
            mine = lambda x, i: (x["side"] == 1) & (close(x, i) if wanted else ~close(x, i))
            return F.transform(both, lambda x, i: F.when(mine(x, i), F.struct(x["kind"].alias("kind"), x["a"].alias("a"), x["b"].alias("b"))))

        return F.filter(_let(ends, lambda before: _let(starts, lambda after: pick(before, after))), lambda x: x.isNotNull())

    joined_ = _let(F.array_sort(F.concat(side(ys, 0), side(xs, 1))), sweep).cast(SPAN)
    return F.when(F.size(xs) == 0, none).when(F.size(ys) == 0, none if wanted else xs).otherwise(joined_)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secret_base and secret_linked, arrays of (kind, a, b) in code points, b exclusive, and n_assign, n_access and n_hex.

    Base kinds stand alone: assign, access and hex. Weak identifiers, secrets and endpoints are
    reported only within SCOPE characters of a complement: a weak secret near an identifier or
    endpoint, a weak identifier near a secret, an endpoint near both; a base access key is an
    identifier and the other base kinds are secrets. The interval joins run inside each text by
    sweeps, so nothing is shuffled. Nulls and empty texts have no spans, equal rows are scanned each
    for itself, texts are scanned whole, and columns of those five names are replaced, in any case;
    others may have any name."""
    made = ("secret_base", "secret_linked", "n_assign", "n_access", "n_hex")
    names = [c for c in docs.columns if c.lower() not in made]
    held = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("int"))
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    mixed = lambda m: m.rlike("[:=]") | (m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))
    none, t = F.array().cast(SPAN), F.col("t")
    sign = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    d = docs.select(held.alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = d.select(
        "doc",
        "t",
        F.when(sign, spans(t, "assign", ASSIGN, value)).otherwise(none).alias("assign"),
        F.when(F.contains(t, F.lit("AKIA")), spans(t, "access", ACCESS)).otherwise(none).alias("access"),
        spans(t, "hex", HEX).alias("hex"),
        spans(t, "secret", WEAK_SECRET, mixed).alias("secret"),
    )
    d = d.withColumn("base", F.concat("assign", "access", "hex"))
    # Ids and endpoints are looked for only where some secret or access key is about.
    some = (F.size("base") + F.size("secret")) > 0
    d = d.withColumn("id", F.when(some, spans(t, "id", WEAK_ID)).otherwise(none)).withColumn("end", F.when(some, spans(t, "endpoint", ENDPOINT)).otherwise(none)).drop("t")
    for c in ("secret", "id", "end"):
        d = d.withColumn(c, near(F.col(c), F.col("base"), -1, wanted=False))
    d = d.withColumn("ids", F.concat("access", "id")).withColumn("secrets", F.concat("assign", "hex", "secret"))
    linked = F.concat(near(F.col("id"), F.col("secrets"), SCOPE), near(F.col("secret"), F.concat("ids", "end"), SCOPE), near(near(F.col("end"), F.col("ids"), SCOPE), F.col("secrets"), SCOPE))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return d.select(*([F.col("doc.*")] if names else []), F.col("base").alias("secret_base"), linked.alias("secret_linked"), *counts)


def joined(s: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    rows = F.array_sort(F.transform(s, lambda x: F.struct(x["a"].alias("a"), rank(x["kind"]).alias("r"), x["b"].alias("b"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"])), ",")


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    f = find(docs.select("doc_id", "text"))
    f = f.select("doc_id", "n_assign", "n_access", "n_hex", "secret_base", F.concat("secret_base", "secret_linked").alias("every"))
    return f.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("secret_base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of text, base or linked, replaced by mask; overlapping spans become one mask.

    Null texts stay null; texts without spans stay as they are, and so do all other columns."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(text).alias("text"))
    f = find(whole).withColumn("every", F.array_sort(F.transform(F.concat("secret_base", "secret_linked"), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))))
    # What stands before a span and after all others' ends: its own pieces are joined once.
    ends = running(F.transform("every", lambda x: x["b"]), F.lit(0), lambda s, x: F.greatest(s, x))
    last = lambda e, i: F.when(i > 0, F.get(e, i - 1)).otherwise(0)
    cut = lambda e: F.transform("every", lambda x, i: F.when((i == 0) | (x["a"] >= last(e, i)), F.concat(F.substring(F.col("text"), last(e, i) + 1, x["a"] - last(e, i)), F.lit(mask))).otherwise(""))
    rest = lambda e: F.substring(F.col("text"), F.element_at(e, -1) + 1, F.char_length(F.col("text")))
    clean = F.when(F.size("every") > 0, _let(ends, lambda e: F.concat(F.array_join(cut(e), ""), rest(e)))).otherwise(F.col("text"))
    return f.select(*[clean.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    return op6(table(spark, sf_dir, "documents"))
