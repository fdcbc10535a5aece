"""Quality rules and url verdicts beside brute force; fits of the classifiers on made-up labels, held out."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from resona.llm import ordinal_quality, quality_rules, toxicity, url_filter

DOCS = "doc_id long, text string, label string, score double"


def prose(rnd, n, vocabulary=300):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(2 + rnd.randrange(7))) for _ in range(n))


def rule_texts():
    rnd = random.Random(4)
    texts = [None, "", prose(rnd, 49), prose(rnd, 50), prose(rnd, 400), prose(rnd, 80).upper(), "é à ü " * 30 + prose(rnd, 60)]
    texts += [prose(rnd, 60) + " !?" * 20, prose(rnd, 60) + " #*" * 20, "12 34 " * 5 + prose(rnd, 20) + "".join(f" {7919 * i + 10**9}" for i in range(60))]
    texts += [prose(rnd, 80) + " no" * 30, "x" * 20 + " " + " ".join("y" * 17 + str(i) for i in range(70)), " ".join("abcdefghij"[i % 10] for i in range(70))]
    texts += [(prose(rnd, 9) + "\n") * 7, prose(rnd, 60) + "\n\n \n" + "a b\na b\n a b\na b", prose(rnd, 30) * 3, prose(rnd, 6000)]
    return texts


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    twice = {k for k, c in Counter(windows).items() if c > 1}
    repeated = len({i + j for i, x in enumerate(windows) if x in twice for j in range(3)})
    raw = t.encode()
    chars, signs = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)
    capitals, small = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    share = lambda a, b: a / max(b, 1)
    rejected = {
        "symbols": share(signs, n) > 0.2,
        "capitals": share(capitals, capitals + small) > 0.5,
        "marks": share(sum(c in "!?" for c in t), n) > 0.2,
        "letters": share(sum(chr(b).isalpha() if b < 128 else True for b in raw), len(raw)) < 0.5,
        "word_length": share(chars, n) > 15 or share(chars, n) < 2,
        "adjacent": share(sum(a == b for a, b in zip(w, w[1:])), n) > 0.2,
    }
    failed = n < 50 or 100 * repeated > 50 * n
    return (n, chars, signs, len(lines) - len(set(lines)), repeated, failed), rejected


def test_quality_rules_equal_brute_force(spark):
    texts = rule_texts()
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    seen = set()
    for i, text in enumerate(texts):
        r = got[i]
        measures, rejected = brute_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures
        assert r.kept == (not measures[-1] and not any(rejected.values()))
        by = {name for name, yes in rejected.items() if yes}
        assert r.rejected_by is None if measures[-1] or not by else r.rejected_by in by
        seen |= by if not measures[-1] else set()
    assert seen == set(quality_rules.RULES) and any(r.kept for r in got.values())


def test_rules_are_ordered_by_what_the_earlier_ones_leave():
    names = ["a", "b", "c"]
    # a alone rejects 10, a and b together 30, b alone 5, c alone 4; none 50
    patterns = {1: 10, 3: 30, 2: 5, 4: 4, 0: 50}
    assert quality_rules.by_worth(names, patterns, {"a": 1.0, "b": 1.0, "c": 1.0}) == ["a", "b", "c"]
    assert quality_rules.by_worth(names, patterns, {"a": 1.0, "b": 2.0, "c": 1.0}) == ["a", "c", "b"]
    assert quality_rules.by_worth(names, patterns, {"a": 9.0, "b": 1.0, "c": 0.1}) == ["c", "b", "a"]
    assert quality_rules.by_worth(names, {0: 7}, {"a": 3.0, "b": 1.0, "c": 2.0}) == ["b", "c", "a"]


def test_order_comes_from_documents_that_pass_the_base_test(spark):
    rnd = random.Random(8)
    # short documents would make `marks` the best rule, but the cascade never sees them
    rows = [(i, "!? " * 20, "x", 0.5) for i in range(300)]
    rows += [(1000 + i, prose(rnd, 80).upper() if i % 2 else prose(rnd, 80), "x", 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    assert quality_rules.rule_order(df, ["marks", "capitals"])[0] == "capitals"


def brute_urls(pages, rules=url_filter.RULES):
    counts = Counter(x for _, _, html in pages for x in re.findall(r"[^\W\d_]+", (html or "").lower()))
    total = sum(counts.values()) or 1

    def cut(part):
        @lru_cache(None)
        def best(end):
            if not end:
                return 0.0, 0, 0, ()
            found = []
            for start in range(end):
                word = part[start:end]
                if word in counts:
                    cost, n, _, words = best(start)
                    found.append((cost - math.log(counts[word] / total), n + 1, end - start, (*words, word)))
            cost, n, _, words = best(end - 1)
            found.append((cost - math.log(0.5 / total) + 3, n + 1, 1, (*words, part[end - 1 : end])))
            return min(found)

        return best(len(part))[3]

    rows = []
    for page, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = []
        for rule, decision in rules:
            name, _, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append((-len(rule), decision != "block", rule, decision))
        rule, decision = min(fits)[2:] if fits else (None, None)
        words = [w for run in re.findall(r"0|[^\W\d_]+", re.sub("[0-9]+", "0", host)) for w in cut(run)]
        tokens = words + ["/" + w for w in re.findall(r"(?:[^\W\d_]|0)+", re.sub("[0-9]+", "0", path.lower()))]
        rows.append((page, host, path, rule, decision, words, tokens))
    taught = Counter(r[4] for r in rows if r[4])
    seen = {d: Counter(t for r in rows if r[4] == d for t in r[6]) for d in ("block", "allow")}
    kinds = len(set(seen["block"]) | set(seen["allow"]))
    size = {d: sum(seen[d].values()) + kinds + 1 for d in seen}
    out = {}
    for page, host, path, rule, decision, words, tokens in rows:
        known = [t for t in tokens if t in seen["block"] or t in seen["allow"]]
        score = math.log((taught["block"] + 1) / (taught["allow"] + 1)) + sum(
            math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"]) for t in known
        )
        score = round(score, 6)
        out[page] = (host, path, rule, decision or ("block" if score > 0 else "allow"), " ".join(words), score)
    return out


def test_url_verdicts_equal_brute_force(spark):
    rnd = random.Random(6)
    stock = ["news", "sport", "best", "shop", "free", "casino", "new", "s", "spor", "t", "straße"]
    pages = []
    for i in range(80):
        host = "".join(rnd.choice(stock) for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", "7", "-x"])
        tail = rnd.choice([".net", ".org", ".com", ".example.net", ".example.com"])
        path = rnd.choice(["", "/", "/fr/", "/en/a1", "/de/", "/Page-12/shop", "/casino/free?x=1", "#top"])
        html = " ".join(rnd.choice(stock) for _ in range(rnd.randrange(12)))
        pages.append((i, f"http://{host}{tail}{path}", html))
    pages += [(100, None, None), (101, "no scheme", ""), (102, "HTTP://NewsSport.ORG/fr/x", "news"), (103, pages[0][1], None)]
    rows = [(p, u, h, "x", "y") for p, u, h in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, word string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.host_words, r.score) for r in url_filter.judged(df).collect()}
    want = brute_urls(pages)
    assert got.keys() == want.keys()
    for page, row in want.items():
        assert got[page][:5] == row[:5]
        assert got[page][5] == pytest.approx(row[5], abs=2e-6)


def labelled(n, seed):
    """Prose, prose with insults, junk: (doc_id, text), (doc_id, quality, toxic) for all of them."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, kind = prose(rnd, 70), i % 3
        if kind == 1:
            words = text.split()
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["you stupid", "idiot", "you moron", "vile scum"]))
            text = " ".join(words)
        elif kind == 2:
            text = " ".join(rnd.choice(["BUY NOW!!!", "$$$", "###", "CLICK >>>", w.upper()]) for w in text.split())
        docs.append((i, text, "x", 0.5))
        labels.append((i, int(kind != 2), int(kind == 1)))
    return docs, labels


def test_ordinal_regression_grades_held_out_documents(spark):
    docs, labels = labelled(360, 1)
    known = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, quality int, toxic int")
    rows = ordinal_quality.graded(spark.createDataFrame(docs, DOCS), known).collect()
    held = [r for r in rows if r.doc_id % 4 == 0]
    right = sum(r.accepted == bool(labels[r.doc_id][1]) for r in held)
    assert right >= 0.95 * len(held) and len(held) == 90
    assert all(1 >= r.tail_1 >= r.tail_2 >= 0 and math.isclose(r.expected_grade, r.tail_1 + r.tail_2) for r in rows)
    mean = lambda kind: sum(r.expected_grade for r in held if r.doc_id % 3 == kind) / 30
    assert mean(2) < mean(1) < mean(0)  # rejected, toxic, good


def test_toxicity_trees_find_held_out_insults(spark):
    docs, labels = labelled(900, 2)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = toxicity.scored(spark.createDataFrame(docs, DOCS), known, F.col("doc_id") % 4 != 2)
    held = [r for r in scored.collect() if r.doc_id % 4 == 2]
    caught = [r.predicted for r in held if labels[r.doc_id][2]]
    clean = [r.predicted for r in held if not labels[r.doc_id][2]]
    assert sum(caught) >= 0.95 * len(caught) and sum(clean) <= 0.05 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)
