"""Operators of resona.llm on small awkward tables, beside brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.llm import (
    decontamination, line_dedup, mixing, ngram_join, ordinal_quality, quality_rules, queries, suffix_tree, token_counts,
    toxicity, url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, n long, label int"
LABELS = "doc_id long, quality int, toxic int"


def words(n: int, seed: int, size: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


BASE = words(120, 1)
TEXTS = [
    (1, BASE), (2, BASE.upper()), (3, BASE.replace("w7", "other", 1)), (4, None), (5, ""), (6, " \t\n"),
    (7, "one two"), (8, "ONE  two"), (9, words(60, 2)), (9, words(60, 3)), (None, words(55, 4)), (10, "é" * 9),
    (11, words(60, 2) + "\n" + words(60, 5)), (12, words(60, 6) + "\nshort\n" + words(60, 5)), (13, "a b\n" * 30),
    (14, words(4000, 7, 9000)), (14, words(4000, 7, 9000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][k % 3], None, "x", 1, 2) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts():
    return [(i, t or "") for i, t in TEXTS]


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_ngram_join_equals_brute_force(docs):
    def shingles(text):
        w = lower(text).encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for _, t in texts()]
    group = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (i, _), g in zip(texts(), group, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    want = Counter((i, len(s), least[g]) for (i, _), s, g in zip(texts(), sets, group, strict=True))
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = [r.doc_id for r in ngram_join.one_of_each(docs).select("doc_id").collect()]
    assert kept.count(14) == 1 and 2 not in kept and {1, 4, 5, 6, 7, None} <= set(kept)


def test_line_dedup_deletes_later_passages_only(docs):
    rows = {(r.doc_id, r.n_lines): r for r in line_dedup.deduplicated(docs).collect()}
    assert rows[(12, 3)].text == words(60, 6) + "\nshort" and rows[(12, 3)].n_deleted == 1
    assert rows[(11, 2)].text == words(60, 5)  # its first line stands in document 9
    assert rows[(4, 0)].text is None and rows[(1, 1)].text == BASE
    assert rows[(13, 31)].n_deleted > 0  # 60 words of one line over and over
    assert sum(r.doc_id == 14 and r.n_deleted == 0 for r in line_dedup.deduplicated(docs).collect()) == 2


def test_decontamination_is_the_same_broadcast_or_joined(spark, docs):
    item = " ".join(BASE.split()[20:45])
    bench = spark.createDataFrame([(1, item), (1, item), (2, "One, two!"), (3, None), (4, "")], "item_id long, text string")
    results = [
        sorted(map(str, decontamination.contamination(docs, bench, limit=limit).collect())) for limit in (0, 10_000)
    ]
    assert results[0] == results[1]
    by = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert by[1].n_hit == 25 and by[2].n_hit == 25 and by[1].n_items == 1
    assert by[7].n_hit == by[8].n_hit == 2 and by[4].n_hit == 0 and not by[9].contaminated
    clean = {r.doc_id for r in decontamination.clean(docs, bench).collect()}
    assert {4, 5, 9, None} <= clean and not {1, 2, 7, 8} & clean


def test_mixture_reaches_its_targets(docs):
    rows = mixing.mixture(docs).collect()
    assert all(r.taken <= 3 * r["size"] and len(r.positions) == r.epochs for r in rows)
    largest = max(r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest / 2 + 1
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    order = [r.position for r in mixing.curriculum(mixing.mixture(docs)).collect()]
    assert order == sorted(order)


def _library():
    model = str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    return model, pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


def test_token_counts_equal_the_library(spark, docs):
    model, library = _library()
    rows = [*texts(), (5, "twice " * 400), (5, "twice " * 400), (None, "é▁▁" * 300), (6, "abcdefgh" * 200)]
    docs = docs.unionByName(spark.createDataFrame(rows[-4:], "doc_id long, text string"), allowMissingColumns=True)
    want = Counter((i, len(t.encode()), len(library.encode(t))) for i, t in rows)
    for chunk in (7, 1 << 20):
        got = token_counts.token_counts(docs, model, chunk=chunk).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_transducer_equals_the_library_on_any_text_and_cuts(monkeypatch):
    model, library = _library()
    rng, machine = random.Random(3), token_counts.Transducer.of_model(model)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    letters = "aabcdeeeiilnorssttt   ▁\n\t\0.,'\"-_/01<>　ﬁé\u0301ßзж中文日本🙂\u200d\ufffd"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))).replace("▁", rng.choice(["", " "])) for _ in range(1500)]
    made += ["<s>", "</s><unk>", "<0x0A>", " ", "▁", "   ", "a" * 500, "\n" * 50]
    want = [len(ids) for ids in library.encode(made)]
    assert [machine.count(t) for t in made] == want
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)  # the memory starts anew in the middle of texts
    for text, n in zip(made[::7], want[::7], strict=True):
        size = rng.choice([1, 2, 5, 17])
        maps = [machine.chunk(text[i : i + size], i == 0) for i in range(0, len(text), size)]
        while len(maps) > 1:  # any order of compositions
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [machine.then(maps[i], maps[i + 1])]
        assert not maps or (maps[0].head, maps[0].emitted) == ("", n)


def test_suffix_tree_base_is_exact_and_scores_repeat(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = suffix_tree.scores(docs, held).collect()
    tokens = [(i, [*lower(t).encode().split(), None]) for i, t in texts()]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens]
    c = Counter(w for (_, ws), o in zip(tokens, out, strict=True) if not o for w in ws)
    n = sum(c.values())
    norm = math.log10(n + 0.5 * (len(c) + 1))
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10(c[w] + 0.5) - norm for w in ws), 4)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    again = suffix_tree.scores(docs.repartition(2), held).collect()
    assert sorted(round(r.score, 3) for r in got) == sorted(round(r.score, 3) for r in again)


def test_suffix_tree_scores_equal_brute_force(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in suffix_tree.scores(docs, held).collect())
    depth, after = suffix_tree.DEPTH, {}
    symbols = [(i, b"\n" * depth + b"".join(w + b" " for w in lower(t).encode().split()) + b"\n") for i, t in texts()]
    for i, s in symbols:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            for at in range(depth, len(s)):
                for size in range(depth + 1):
                    after.setdefault(s[at - size : at], Counter())[s[at]] += 1

    def p(context, symbol):
        n = after.get(context, Counter())
        if not context:
            return (n[symbol] + 0.5) / (n.total() + 128)
        return (n[symbol] + suffix_tree.SMOOTHING * p(context[1:], symbol)) / (n.total() + suffix_tree.SMOOTHING)

    states = {b""}
    for context, n in after.items():
        if context and sum(k * math.log(k / n.total() / p(context[1:], x)) for x, k in n.items()) >= suffix_tree.DIVERGENCE:
            states |= {context[at:] for at in range(len(context))}

    def predicted(s, at):
        return math.log10(p(next(s[k:at] for k in range(at - depth, at + 1) if s[k:at] in states), s[at]))

    assert len(states) > 100
    assert got == sorted((str(i), round(sum(predicted(s, at) for at in range(depth, len(s))), 4)) for i, s in symbols)


def test_suffix_tree_grows_with_the_corpus(spark):
    # 15 places of 4 million: seen often enough for the divergence test, but a tiny share
    rows = [(k, "x" * 400_000) for k in range(10)] + [(k, "qzjk vw") for k in range(10, 25)] + [(99, "qzjk vw")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = {r.doc_id: r.score for r in suffix_tree.scores(table, F.col("doc_id") == 99).collect()}
    assert by[99] > -5


def test_suffix_tree_keeps_its_states_at_any_size(spark):
    # 120,000 contexts over all bytes: a dense table of their children would have some 100 MiB or more
    context = F.xxhash64("id").bitwiseAND(F.lit((1 << 40) - 1))
    gram = F.shiftleft(context, 8).bitwiseOR(F.pmod(F.hash("id"), F.lit(256)).cast("long"))
    counts = spark.range(120_000).select(gram.alias("gram"), F.lit(40).cast("long").alias("n")).cache()
    states = suffix_tree.grow(counts)[1]
    assert states.count() > 87_000
    longest = states.where("size = 3").select(F.col("context").bitwiseAND(F.lit(0xFFFF)).alias("context")).distinct()
    assert longest.join(states.where("size = 2"), "context", "left_anti").count() == 0


def test_suffix_tree_keys_survive_packing_and_lookup():
    rng = np.random.default_rng(3)
    every = rng.integers(0, 1 << 48, 100_000)
    known = suffix_tree._distinct(np.concatenate([every, every[:500]]))
    assert known.tolist() == sorted(set(every.tolist()))
    wanted = rng.choice(every, 90_000)
    assert (known[suffix_tree._places(known, wanted)] == wanted).all()
    signed = np.sort(rng.integers(-(2**63), 2**63 - 1, 1000))
    for keys in (known, signed, signed[:1], signed[:0]):
        assert (suffix_tree.unpacked(suffix_tree.packed(keys)) == keys).all()


def test_suffix_tree_words_with_few_keys_a_part_and_wide_top(docs, monkeypatch):
    held = F.col("doc_id") % 3 == 1
    whole = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.scores(docs, held).collect())
    monkeypatch.setattr(suffix_tree, "PART", 40)  # many parts
    monkeypatch.setattr(suffix_tree, "SENT_ROWS", 0)  # the top is joined by a shuffle
    parts = suffix_tree.scores(docs, held).collect()
    assert whole == sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in parts)


def test_suffix_tree_reads_pieces_shorter_than_a_context():
    assert suffix_tree.preceding(np.array([120, 32, 10], np.uint8), np.arange(3), 5).tolist() == [10, 10, 10]


def test_quality_rules(docs):
    by = {(r.doc_id, r.n_words): r for r in quality_rules.judged(docs).collect()}
    assert by[(4, 0)].base_failed and by[(13, 60)].n_dup_lines == 29 and by[(13, 60)].n_repeat_words == 60
    assert not by[(1, 120)].base_failed and by[(1, 120)].rejected_by == "letters" and not by[(7, 2)].kept


def test_urls(spark):
    rows = [(1, "http://www.example.net/en/x?y"), (2, "https://A.Example.COM/de/1#z"), (3, "http://s.org/fr/"), (4, None),
            (5, "nothing"), (6, "http://x.net"), (1, "http://www.example.net/en/x?y"), (7, "http://x.net/a")]
    pages = spark.createDataFrame([(*r, "<p>example words</p>") for r in rows], "page_id long, url string, html string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()]
    assert got.count((1, "www.example.net", "/en/x", "example.net/en/", "allow")) == 2
    assert (2, "a.example.com", "/de/1", "example.com/de/", "block") in got
    assert (3, "s.org", "/fr/", "org/fr/", "allow") in got and (7, "x.net", "/a", "net/", "block") in got
    assert {(r[1], r[2], r[3]) for r in got if r[0] in (4, 5)} == {("", "", None)}
    assert [r[1:4] for r in got if r[0] == 6] == [("x.net", "", None)]


def test_host_words_of_any_length_digits_and_letters(spark):
    text = "<p>donaudampfschifffahrtsgesellschaft grünwald shop i phone i phone</p>"
    hosts = ["donaudampfschifffahrtsgesellschaftshop.net", "grünwaldshop24.net", "iphone.net"]
    rows = [(k, f"http://{host}/straße/7", text) for k, host in enumerate(hosts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.host_words.split(" ")[:-1] for r in url_filter.judged(pages).collect()}
    # "net" is no word of the text, so it falls into letters
    assert got[0][:2] == ["donaudampfschifffahrtsgesellschaft", "shop"] and got[1][:3] == ["grünwald", "shop", "0"]
    assert got[2][:2] == ["i", "phone"]
    listed = url_filter._path_words(F.lit("/straße/7"))
    assert spark.range(1).select(listed.alias("w")).first().w == ["/straße", "/0"]


def test_classifiers_without_labels_have_a_defined_result(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert all(r.accepted for r in ordinal_quality.graded(docs, none).collect())
    assert {r.score for r in toxicity.scored(docs, none, F.lit(True)).collect()} == {0.0}


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for result in (
        ngram_join.near_duplicates(empty), line_dedup.deduplicated(empty), decontamination.contamination(empty, bench),
        token_counts.token_counts(empty, queries._model("piece_bpe_32k.model")), mixing.mixture(empty), quality_rules.judged(empty), suffix_tree.scores(empty, F.lit(False)), url_filter.judged(pages),
        ordinal_quality.graded(empty, labels), toxicity.scored(empty, labels, F.lit(True)),
    ):
        assert result.count() == 0
