"""The methods themselves against brute force, and edges: clashing names, repeats, ties, long texts, empty tables."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from ticktide.llm import common, decontaminate, html_text, packing, pii, quality_rank, quality_rules, secret_scan, token_count, url_filter

from .test_operators import DOCS, prose


def slow_boost(rows, trees, depth):
    """Symmetric trees straight from the definition: every split is tried on all rows."""
    n, bad = sum(w for *_, w in rows), sum(w for _, y, w in rows if y)
    base = math.log((bad + 1) / (n - bad + 1))
    margin, out = [base] * len(rows), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        leaf, splits, leaves = [()] * len(rows), [], {}
        for _ in range(depth):
            best = None
            for f in range(len(rows[0][0])):
                for cut in range(1, url_filter.BINS):
                    sums, before = {}, {}
                    for (x, y, w), at, q in zip(rows, leaf, p, strict=True):
                        for where, key in ((sums, (*at, x[f] >= cut)), (before, at)):
                            g, h = where.get(key, (0.0, 0.0))
                            where[key] = (g + w * (y - q), h + w * q * (1 - q))
                    gain = round(sum(g * g / (h + url_filter.RIDGE) for g, h in sums.values()) - sum(g * g / (h + url_filter.RIDGE) for g, h in before.values()), 9)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, (f, cut), sums)
            if best is None:
                break
            splits.append(best[1])
            leaves = best[2]
            leaf = [(*at, x[best[1][0]] >= best[1][1]) for (x, *_), at in zip(rows, leaf, strict=True)]
        if not splits:
            break
        out.append(splits)
        margin = [m + url_filter.RATE * leaves[at][0] / (leaves[at][1] + url_filter.RIDGE) for m, at in zip(margin, leaf, strict=True)]
    return out, margin


def test_boosting_equals_its_definition():
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        x = tuple(rng.randrange(url_filter.BINS) for _ in range(3))
        rows.append((x, int(x[0] + x[1] + rng.randrange(20) > 38), rng.randrange(1, 3)))
    base, trees = url_filter.boost(rows, 3, 2)
    want, margin = slow_boost(rows, 3, 2)
    assert [s for s, _ in trees] == want
    for (x, *_), m in zip(rows, margin, strict=True):
        got = base
        for splits, leaves in trees:
            at = 0
            for f, cut in splits:
                at = at * 2 + (x[f] >= cut)
            got += leaves[at]
        assert got == pytest.approx(m)


def test_url_edges(spark):
    """Repeated rows are judged alike, a clashing score is replaced, and of rules of one length that both fit the first counts."""
    pages = spark.createDataFrame([(1, "http://a.com/x/", 5.0), (1, "http://a.com/x/", 6.0)], "page_id long, url string, Block_Score double")
    got = url_filter.filter_urls(pages, rules=(("allow", "com/x"), ("block", "com/x"))).collect()
    assert [r["verdict"] for r in got] == ["allow", "allow"] and len(set(r["block_score"] for r in got)) == 1
    assert len([c for c in got[0].asDict() if c.lower() == "block_score"]) == 1
    assert url_filter.Boosted(pages.limit(0).selectExpr("url", "1 AS label")).trees == []


def slow_links(t):
    """Weak spans by plain expressions and a loop over all pairs."""
    find = lambda kind, p, ok=lambda m: True: [(m.start(), m.end(), kind) for m in re.finditer(p, t) if ok(m)]
    mixed = lambda m: re.search("[:=]", m[0]) or all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))
    s = secret_scan
    assign = find("assign", s.ASSIGN, lambda m: len(m[1]) >= 6)
    access, hexes, secret = find("access", s.ACCESS), find("hex", s.HEX), find("secret", s.WEAK_SECRET, mixed)
    base = assign + access + hexes
    ids, ends = (find("id", s.WEAK_ID), find("endpoint", s.ENDPOINT)) if base or secret else ([], [])
    apart = lambda xs: [x for x in xs if not any(y[0] < x[1] and y[1] > x[0] for y in base)]
    secret, ids, ends = apart(secret), apart(ids), apart(ends)
    near = lambda x, ys: any(y[0] <= x[1] + s.SCOPE and y[1] >= x[0] - s.SCOPE for y in ys)
    linked = [x for x in ids if near(x, assign + hexes + secret)] + [x for x in secret if near(x, access + ids + ends)] + [x for x in ends if near(x, access + ids) and near(x, assign + hexes + secret)]
    return {(k, a, b) for a, b, k in base + linked}


def test_linked_secrets_equal_a_loop_over_pairs(spark):
    rng = random.Random(17)
    parts = ["login=bobby9", "user: anna_b", "pwd=hunter2x", "password=abcdef1", "AKIA" + "Q7" * 9, "0f" * 13, "https://db.example.com/x", "host=a.b.c", "far " * 90, "é", " ", "bearer: abcDEF123456", "x" * 40, "Ab1" * 12, "\n", "token = ab"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.find(d).collect():
        got = {(x["kind"], x["a"], x["b"]) for x in r["secret_base"] + r["secret_linked"]}
        assert got == slow_links(r["text"] or ""), r["text"]


def test_secret_edges(spark):
    """Input columns of the operator's own names, many spans in one text, and what redaction leaves."""
    many = " ".join(f"token=abcdef{i}" for i in range(3000))
    d = spark.createDataFrame([(1, many, 7, "x"), (1, many, 7, "x")], "doc_id long, text string, n_hex int, S_ASSIGN string")
    got = secret_scan.find(d).collect()
    assert [len(r["secret_base"]) for r in got] == [3000, 3000] and got[0]["S_ASSIGN"] == "x" and got[0]["n_hex"] == 0
    clean = secret_scan.redact(d).first()
    assert clean["text"] == " ".join(["[SECRET]"] * 3000) and clean["n_hex"] == 7


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 5, 99, 100):
        xs = [(7 * i) % 11 for i in range(n)]
        d = spark.createDataFrame([(xs,)], "x array<int>").select(secret_scan.running(F.col("x"), F.lit(0), lambda s, v: s + v).alias("y"))
        assert d.first()["y"] == np.cumsum(xs).tolist()


def test_thresholds_follow_each_group(spark):
    """A source of other habits has another threshold, and equal documents other verdicts; a small group's moves smoothly."""
    rng = random.Random(4)
    text = lambda marks: " ".join(rng.choice(("river", "stone", "cloud", "of", "the", "m%d" % rng.randrange(300))) + ("#" if rng.random() < marks else "") for _ in range(120))
    rows = [(i, text(0.2), "en", "codes", 0) for i in range(150)] + [(i, text(0.002), "en", "plain", 0) for i in range(150, 300)]
    odd = text(0.15)
    rows += [(1000, odd, "en", "codes", 0), (1001, odd, "en", "plain", 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.op7(d).collect()}
    assert got[1000] and not got[1001]
    cuts = {r["source"]: r["max_symbols"] for r in quality_rules.thresholds(quality_rules.measure(d)).collect()}
    assert cuts["codes"] > 2 * cuts["plain"]


def test_rule_edges(spark):
    """Columns q, q_n, kept and base_failed in the input; ties stand; repeated rows alike; an empty table."""
    rng = random.Random(1)
    t = prose(rng, 60)
    d = spark.createDataFrame([(1, t, None, None, 3, "k", True), (1, t, None, None, 3, "k", True)], "doc_id long, text string, lang string, source string, q_n int, Q string, kept boolean")
    assert [r["q_n"] for r in quality_rules.keep_good(d).collect()] == [3, 3]
    m = quality_rules.measure(d)
    j = quality_rules.judge(m, quality_rules.thresholds(m)).collect()
    assert [r["kept"] for r in j] == [True, True] and j[0]["q"]["n_words"] == 60
    assert quality_rules.keep_good(d.limit(0)).count() == 0


def slow_fit(x, y, pairs, ridge, seed):
    """Bradley-Terry by plain gradient steps on the same pairs."""
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(y == 1), pairs)] - z[rng.choice(np.flatnonzero(y == 0), pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(20000):
        p = 1 / (1 + np.exp(-d @ w))
        w += (d.T @ (1 - p) - ridge * w) / (len(d) * 3)
    return w


def test_ranking_is_the_maximum_of_the_pairwise_likelihood():
    rng = np.random.default_rng(5)
    n = len(quality_rank.FEATURES)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, n)) + y[:, None] * np.linspace(0, 0.6, n)
    model = quality_rank.BradleyTerry(x, y, pairs=500, ridge=5.0, seed=7)
    assert np.allclose(model.w, slow_fit(x, y, 500, 5.0, 7), atol=1e-3)
    share = (model.score(x) >= 0.5).mean()
    assert abs(share - y.mean()) <= 0.01


def test_ranking_edges(spark):
    """Repeated rows score alike, labels that contradict each other are taken once, long texts and other columns do no harm."""
    rng = random.Random(6)
    t, long = prose(rng, 50), prose(rng, 40000)
    d = spark.createDataFrame([(1, t, 1.0), (1, t, 2.0), (2, long, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = sorted(quality_rank.rank(d, labels).collect(), key=lambda r: r["doc_id"])
    assert got[0]["score"] == got[1]["score"] and len(got) == 3


def test_body_classes_and_quotes_lose_no_article():
    x = html_text.extract
    for marks in ("right-sidebar", "has-sidebar home", "no-header", "single-post comments-closed"):
        assert x(f'<body class="{marks}"><div><p>Plain article.</p></div></body>') == "Plain article."
    assert x('<div id="share-price-news"><p>Prices rose.</p></div>') == "Prices rose."
    assert x('<article><h1>T</h1><section class="related-work"><p>w</p></section></article>') == "T\nw"
    assert x('<p>x <img alt="a > b" src=x> y</p><p title=it\'s>z</p>') == "x y\nz"
    assert x('<div class="comment-list"><p>first!</p></div><article><p>body</p></article><div class="cookie-notice">ok?</div>') == "body"


def test_closing_paragraph_of_all_pages_is_template():
    pages = [f"<html><body><article><h1>Title {i}</h1><p>own text {i} and more words {i * 7}</p><p>Thanks for reading us.</p></article></body></html>" for i in range(5)]
    found = html_text.infer([html_text.compact(p) for p in pages])
    wrapper = html_text.Wrapper(found)
    assert found["expression"].count("text") == 1
    assert [html_text.extract(p, wrapper) for p in pages] == [f"Title {i}\nown text {i} and more words {i * 7}" for i in range(5)]
    # The same words elsewhere in an article match no template leaf at their place and stay.
    assert "Thanks for reading us." in html_text.extract("<html><body><article><h1>A</h1><section><p>Thanks for reading us.</p></section><p>b</p></article></body></html>", wrapper)


def test_copies_of_one_article_are_no_template():
    pages = [f"<article><p>{'The whole article. ' * 20}</p><p>Views: {i}</p></article>" for i in range(9)]
    wrapper = html_text.Wrapper(html_text.infer([html_text.compact(p) for p in pages]))
    assert all("The whole article." in html_text.extract(p, wrapper) for p in pages)


def slow_fold(keys):
    """Whether two adjacent units of any size are equal."""
    return any(keys[i : i + n] == keys[i + n : i + 2 * n] and (n > 1 or keys[i] == "#") for n in range(1, len(keys) // 2 + 1) for i in range(len(keys) - 2 * n + 1))


def test_fold_leaves_no_adjacent_equal_units():
    rng = random.Random(8)
    for _ in range(300):
        seq = [["t", rng.choice("ab")] if rng.random() < 0.7 else ["c", "h", [], 1, 0] for _ in range(rng.randrange(20))]
        assert not slow_fold([html_text._key(n) for n in html_text.fold(seq)])
    unit = [["t", f"x{i}"] for i in range(60)]
    assert html_text.fold(unit * 3) == [["+", unit]]


def test_place_statistics_merge_in_any_order():
    pages = [html_text.compact(f"<div><p>menu</p><p>own {i % 4}</p></div><p>{i}</p>") for i in range(12)]
    whole = html_text.Places()
    for p in pages:
        whole.add(p)
    parts = []
    for k in (2, 0, 1):
        part = html_text.Places()
        for p in pages[k::3]:
            part.add(p)
        parts.append(part)
    merged = html_text.Places()
    for p in parts:
        merged.merge(p.dump())
    assert merged.at == whole.at


def test_html_merges_in_rounds_and_odd_columns(spark, monkeypatch):
    """More partitions than one merge takes, columns named like the operator's own, repeated and long pages."""
    monkeypatch.setattr(html_text, "FAN_IN", 2)
    long = "<article>" + "".join(f"<p>paragraph {i}</p>" for i in range(3000)) + "</article>"
    rows = [(i, f"http://h.com/{i}", f"<article><h1>T{i}</h1><p>text of page {i}</p></article><div>ad</div>", "a", "b", 1) for i in range(12)]
    rows += [rows[0], (99, "http://h.com/l", long, "a", "b", 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string, salt int").repartition(7)
    got = html_text.extract_text(d).collect()
    assert sorted(r["text"] for r in got if r["page_id"] == 0) == ["T0\ntext of page 0"] * 2
    assert next(r["text"] for r in got if r["page_id"] == 99).count("\n") == 2999 and {r["salt"] for r in got} == {1}


def test_added_spans_equal_a_run_over_the_table(spark):
    rng = random.Random(2)
    parts = ["john at example dot com", "a@b.co", "plus 49 30 1234567", "1.2.3.4", "4111 1111 1111 1111", "word", "ｊｏｅ@x.org", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(60)] + ["", None, "x " * 60000 + "a@b.co"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, PII_BASE int")
    for r in pii.op5(d).collect():
        t = texts[r["doc_id"]] or ""
        base = pii.detect(t)
        assert r["spans"] == pii.joined(base + pii.added(t, base)) and r["n_email"] == sum(k == "email" for *_, k in base)
    assert "pii_base" in pii.find(d).columns or "PII_BASE" in pii.find(d).columns


def test_batches_are_balanced_by_bytes():
    texts = ["é" * 400, "", "a" * 100, "word " * 1000, "b" * 300]
    batches = list(token_count.by_bytes(texts, 1000))
    assert "".join(p for b in batches for i, p in b if i == 3) == texts[3]
    assert all(len(b) == 1 or sum(len(p.encode()) for _, p in b) <= 1000 for b in batches)
    assert {i for b in batches for i, _ in b} == set(range(5))


def test_token_edges(spark):
    d = spark.createDataFrame([(1, "two words", 5), (1, "two words", 5), (2, "w " * 200000, 5), (3, None, 5)], "doc_id long, text string, N_Tokens int")
    got = [tuple(r) for r in token_count.count_tokens(d).orderBy("doc_id").collect()]
    assert got[0] == got[1] == (1, "two words", 2) and got[2][2] == 200001 - 0 or got[2][2] > 199999
    assert got[3][2] == 0


def whole_best_fit(parts, most):
    """Sequences left when each round hands on at most so many of a group (None: all)."""
    now = [sorted(packing.best_fit(p, 1024)[2]) for p in parts]
    done = 0
    while len(now) > 1:
        after = []
        groups = -(-len(now) // 4)
        for i in range(0, len(now), 4):
            used = np.array(packing.best_fit([x for g in now[i : i + 4] for x in g], 1024)[2])
            go = packing.carried(used, 1024, groups) if most else used < 1024
            done += int((~go).sum())
            after.append(sorted(used[go].tolist()))
        now = after
    return done + len(now[0])


def test_handing_on_no_more_than_joins_can_follow_costs_no_sequence():
    rng = random.Random(13)
    for _ in range(200):
        low, high = sorted((rng.randrange(1, 1024), rng.randrange(1, 1024)))
        parts = [[rng.randint(low, high) for _ in range(rng.randrange(1, 40))] for _ in range(rng.randrange(1, 30))]
        assert whole_best_fit(parts, True) == whole_best_fit(parts, False)


def test_packing_edges(spark, monkeypatch):
    """Columns of the operator's own names, ties, repeated rows, and many rounds give whole gapless sequences."""
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(3)
    rows = [(i % 50, prose(rng, 90), 1, "x") for i in range(100)] + [(None, None, 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, part int, sequence_id string").repartition(9)
    got = packing.pack(d).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 101
    for pieces in seqs.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at <= 1024


def test_decontamination_edges(spark):
    """Null and repeated item ids, one window in two items, repeated and empty documents."""
    b = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x a b c"), (1, "x a b c"), (2, None), (3, "")], "doc_id long, text string")
    got = decontaminate.op9(d, b).collect()
    hit = [r for r in got if r["doc_id"] == 1]
    assert [r["n_hit"] for r in hit] == [3, 3] and hit[0]["items_sha256"] == hit[1]["items_sha256"]
    import hashlib

    assert hit[0]["items_sha256"] == hashlib.sha256(b",7").hexdigest() and hit[0]["n_items"] == 2
    assert decontaminate.op9(d.limit(0), b).count() == 0


def test_windows_equal_a_plain_search():
    rng = random.Random(19)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))) for i in range(12)]
    known = decontaminate.Windows(items, 4)
    for _ in range(400):
        words = [rng.choice("abcd").encode() for _ in range(rng.randrange(0, 14))]
        hit, found = set(), set()
        for i, t in items:
            ws = decontaminate.words_of(t)
            n = min(4, len(ws))
            for k in range(len(ws) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == ws[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(i)
        spans, names = known.scan(words)
        assert {p for a, b in spans for p in range(a, b)} == hit and set(names) == found


def test_stages_need_a_shared_folder_off_local_masters():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_held_out_is_a_third():
    assert 0.3 < sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(3000)) / 3000 < 0.37
