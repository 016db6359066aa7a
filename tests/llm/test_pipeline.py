"""The pipeline on small corpora: what each stage keeps, and all stages against a brute-force version."""

import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from ticktide.llm import bpe, decontaminate, near_dedup, packing, quality_rules, secret_scan
from ticktide.llm.common import stage

from .test_methods import slow_links
from .test_operators import groups, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    good = [prose(rng, 150) for _ in range(30)]
    item = "what is the capital of the country that lies north of here"
    texts = [*good, good[0], good[1] + " tail", "too short", "spam " * 100, good[2] + " " + item, prose(rng, 60) + " password=abc123def " + prose(rng, 30), None]
    d = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == d.columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[0]) == set(range(len(texts))) - {32, 33, 36}
    assert set(seen[1]) == set(seen[0]) - {30, 31, 34} or set(seen[1]) == set(seen[0]) - {30, 31}
    assert set(seen[2]) == set(seen[1]) - {34}
    assert "[SECRET]" in seen[3][35] and seen[3][3] == good[3]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(seen[3])
    assert [n for n, _ in corpus_pipeline.STAGES] and all((near_dedup, decontaminate, packing, quality_rules, secret_scan))


def bucket(v):
    drop = max(0, v.bit_length() - 6)
    return v if v < 64 else v >> drop << drop


def slow_rules(rows):
    """The rules from their definition: counts of one text at a time, thresholds of one group at a time."""
    per = []
    for d, t, lang, source in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows, covered = {}, set()
        for i in range(len(w) - 7):
            windows.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in windows.values():
            if len(at) > 1:
                covered.update(p for i in at for p in range(i, i + 8))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars = sum(map(len, w))
        parts = {"symbols": (sum(c in "#*$%&|<>" for c in t or ""), chars), "upper": (sum("A" <= c <= "Z" for c in t or ""), chars), "dup_lines": (len(lines) - len(set(lines)), len(lines)), "repeats": (len(covered), len(w)), "echoes": (sum(a == b for a, b in zip(w, w[1:])), len(w))}
        per.append((d, lang, source, len(w) < 20 or 100 * len(covered) > 30 * len(w), parts))
    cuts = {}
    for m in quality_rules.METRICS:
        groups = {}
        for _, lang, source, bad, parts in per:
            if not bad:
                a, b = parts[m]
                groups.setdefault((lang, source), []).append(bucket(a * 1000 // b if b else 0))
        allowed = {}
        for g, vs in groups.items():
            mid = sorted(vs)[(len(vs) + 1) // 2 - 1]
            allowed[g] = 1000 * (len(vs) * mid + 8 * sum(max(v - mid, 0) for v in vs))
        whole, count = sum(allowed.values()), sum(map(len, groups.values()))
        for g, vs in groups.items():
            mine = [k for k in groups if k[0] == g[0]]
            near = (sum(allowed[k] for k in mine) + 100 * (whole // count)) // (sum(len(groups[k]) for k in mine) + 100)
            cuts[m, g] = (allowed[g] + 100 * near) // (len(vs) + 100)
    return {d for d, lang, source, bad, parts in per if not bad and all(1_000_000 * (a - quality_rules.SLACK[m]) <= cuts[m, (lang, source)] * b for m, (a, b) in parts.items())}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage against plain Python on 160 documents of several sources, nulls and repeats among them."""
    rng = random.Random(31)
    item = "name the river that runs through the old town near the sea"
    texts = [prose(rng, rng.randrange(15, 160)) for _ in range(120)]
    texts += [texts[k] + " more words here" for k in range(0, 30, 3)] + [texts[1], texts[2].upper(), None, "", "short"]
    texts += [texts[40] + " " + item + " " + prose(rng, 20), prose(rng, 60) + " " + item]
    texts += [prose(rng, 40) + f" login=bobby{k} pwd=hunter{k}xx token=abcdef{k} " + prose(rng, 40) for k in range(5)]
    texts += [" ".join(w + "#" * rng.randrange(3) for w in prose(rng, 80).split()) for _ in range(6)] + ["same line of words here\n" * 9 + prose(rng, 40)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b")[i % 2]) for i, t in enumerate(texts)]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, str(tmp_path)), "test")
        steps.append({r["doc_id"]: r["text"] for r in docs.collect()})

    kept = slow_rules(rows)
    assert set(steps[0]) == kept and 0 < len(kept) < len(rows)
    left = [(i, t, *x) for i, t, *x in rows if i in kept]
    first = {doc for doc, _, least in groups(left, 5) if doc == least}
    assert {str(i) for i in steps[1]} == first
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    ws = words(item)
    windows = [ws[k : k + 10] for k in range(len(ws) - 9)]
    hit = {i for i, t in steps[1].items() if any(words(t)[k : k + 10] in windows for k in range(len(words(t))))}
    assert set(steps[2]) == set(steps[1]) - hit and hit
    for i, t in steps[2].items():
        out, end = [], 0
        for a, b in sorted((a, b) for _, a, b in slow_links(t)):
            if a >= end:
                out += [t[end:a], "[SECRET]"]
            end = max(end, b)
        assert steps[3][i] == "".join([*out, t[end:]])
    assert any("[SECRET]" in t for t in steps[3].values())
    library = Tokenizer.from_file(bpe.default_path())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {(i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in steps[3].items()}
    assert {(r["doc_id"], r["length"]) for r in got} == want
    for s in {r["sequence_id"] for r in got}:
        mine = sorted((r["offset"], r["length"]) for r in got if r["sequence_id"] == s)
        assert [a for a, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))] and sum(n for _, n in mine) <= 1024


def test_empty_pipeline(spark, tmp_path):
    """No documents give no pieces, and columns named like the stages' own pass through."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, hits string, q int, secret_base string"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
    assert "hits" in docs.columns and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
