"""URL filter: explicit rules first, then naive Bayes over words of host and path.

Hosts are often words run together. The parts of a distinct host (runs of letters of any script) are cut into words
by the unigram Viterbi path: every substring up to the length of the corpus's longest word meets the word counts of
the corpus in a join, and the cheapest cover of the part is taken (cost of a word: minus log of its
share; of a character that no word covers: that of a word seen half a time, and 3 more). Word
counts come from the visible text of all pages.

Naive Bayes is multinomial with add-one smoothing over host words and path words; it learns from
the pages that a rule decides and judges the others; digits count as one word `0`.

A rule `host/path` fits its host and all subdomains when the path starts with the rule's; the
longest rule wins, of equal ones the one that blocks, then the smaller text.

Defined cases: null urls and urls without `://` have empty host and path, fit no rule and are judged
by the class sizes alone; equal urls get equal verdicts (ties: allow); an empty table gives an empty
result; other columns are ignored. Hot hosts, urls and words are joined as distinct values to small
rows; what is left uneven is split by adaptive execution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm.text import UPPER
from resona.session import cut_lineage

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LETTERS = r"\p{L}\p{M}"


def _small(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _small(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def word_counts(pages: DataFrame) -> DataFrame:
    """How often the visible text of all pages uses each word, a run of letters."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(bare), f"[^{LETTERS}]+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, words) for distinct parts, by the unigram Viterbi path."""
    # two numbers
    sums = counts.agg(F.sum("n").alias("total"), F.max(F.length("word")).alias("longest")).collect()[0]
    all_words, longest = sums.total or 1, sums.longest or 1
    from_to = F.posexplode(F.sequence(F.lit(1), F.length("part"))).alias("skip", "start")
    rest = F.least(F.lit(longest), F.length("part") - F.col("start") + 1)
    places = labels.select("part", from_to).select("part", "start", F.explode(F.sequence(F.lit(1), rest)).alias("length"))
    pieces = places.select("part", "start", "length", F.substr("part", F.col("start"), F.col("length")).alias("word"))
    known = pieces.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))
    known = labels.join(known, "part", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = -math.log(0.5 / all_words) + 3
        for batch in batches:
            cuts = []
            for part, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends: dict[int, list] = {}
                for span in spans or []:
                    ends.setdefault(span["start"] - 1 + span["length"], []).append((span["length"], span["n"]))
                best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # cost, words, length of the last
                for end in range(1, len(part) + 1):
                    choices = [(best[end - 1][0] + unseen, best[end - 1][1] + 1, 1)]
                    for length, n in ends.get(end, ()):
                        cost, words, _ = best[end - length]
                        choices.append((cost - math.log(n / all_words), words + 1, length))
                    best.append(min(choices))
                words, end = [], len(part)
                while end:
                    words.append(part[end - best[end][2] : end])
                    end -= best[end][2]
                cuts.append(words[::-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.list_(pa.string()))], ["part", "words"])

    return known.select("part", "known").mapInArrow(cut, "part string, words array<string>")


def _path_words(path: Column) -> Column:
    numbered = F.regexp_replace(F.lower(path), "[0-9]+", "0")
    return F.transform(F.array_remove(F.split(numbered, f"[^{LETTERS}0-9]+"), ""), lambda w: F.concat(F.lit("/"), w))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, words (the host's), score (log odds of block)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    split = [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in rules]
    book = spark.createDataFrame(split, "rule string, rule_host string, rule_path string, decision string")

    # by distinct host: the rules that may fit, and its words
    hosts = cut_lineage(rows.select("host").distinct())
    labels = F.split("host", r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fits = hosts.select("host", F.explode(ends).alias("rule_host")).join(book, "rule_host")
    fits = fits.groupBy("host").agg(F.collect_list(F.struct("rule_path", "rule", "decision")).alias("rules"))
    runs = F.regexp_extract_all(F.regexp_replace(F.lower("host"), "[0-9]+", "0"), F.lit(f"0|[{LETTERS}]+"), F.lit(0))
    named = hosts.select("host", F.posexplode(runs).alias("at", "part"))
    words = segmented(named.select("part").distinct(), cut_lineage(word_counts(pages)))
    words = named.join(words, "part").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words")
    )
    hosts = hosts.join(fits, "host", "left").join(words, "host", "left")
    hosts = cut_lineage(hosts.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))

    rows = rows.join(hosts, "host", "left")
    fitting = F.filter(F.coalesce("rules", F.array()), lambda r: F.startswith(F.col("path"), r["rule_path"]))
    longest = F.array_sort(
        F.transform(
            fitting,
            lambda r: F.struct(
                (-F.length(r["rule"])).alias("size"),
                F.when(r["decision"] == "block", 0).otherwise(1).alias("rank"),
                r["rule"].alias("rule"),
                r["decision"].alias("decision"),
            ),
        )
    )
    rows = rows.withColumn("best", F.get(longest, F.lit(0))).drop("rules")
    rows = cut_lineage(rows.withColumn("rule", F.col("best.rule")).withColumn("decision", F.col("best.decision")).drop("best"))

    tokens = F.concat("words", _path_words(F.col("path")))
    taught = rows.where("decision is not null").groupBy("host", "path", "words", "decision").count()
    block, allow = (F.sum(F.when(F.col("decision") == d, F.col("count")).otherwise(0)) for d in ("block", "allow"))
    weights = taught.select("decision", "count", F.explode(tokens).alias("token")).groupBy("token")
    weights = cut_lineage(weights.agg(block.alias("block"), allow.alias("allow")))
    # three bounded rows of totals
    priors = {r.decision: r.n for r in taught.groupBy("decision").agg(F.sum("count").alias("n")).collect()}
    sums = weights.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("kinds")).collect()[0]
    n_block, n_allow, kinds = sums.block or 0, sums.allow or 0, sums.kinds or 0
    odds = F.log((F.col("block") + 1.0) / (n_block + kinds + 1.0)) - F.log((F.col("allow") + 1.0) / (n_allow + kinds + 1.0))
    prior = math.log((priors.get("block", 0) + 1) / (priors.get("allow", 0) + 1))

    urls = rows.select("host", "path", "words").distinct()
    spread = urls.select("host", "path", F.explode(tokens).alias("token")).groupBy("host", "path", "token").count()
    scored = spread.join(weights.select("token", odds.alias("odds")), "token").groupBy("host", "path")
    scored = scored.agg(F.sum(F.col("odds") * F.col("count")).alias("sum"))
    rows = rows.join(scored, ["host", "path"], "left")
    score = F.round(prior + F.coalesce("sum", F.lit(0.0)), 6)
    verdict = F.coalesce("decision", F.when(score > 0, "block").otherwise("allow"))
    return rows.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"),
        F.array_join("words", " ").alias("host_words"), score.alias("score"),
    )
