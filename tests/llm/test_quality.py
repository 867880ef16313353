import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import quality

DOC = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def brute(rows, least=quality.LEAST, share=quality.SHARE):
    """[(doc_id, base counts, kept)] of (doc_id, text, source) rows."""
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    having, hosts = defaultdict(set), defaultdict(set)
    for i, text, source in rows:
        hosts[source].add((i, text))
        for line in (text or "").split("\n"):
            having[source, norm(line)].add((i, text))
    out = []
    for i, text, source in rows:
        counts = base(text)
        left = sum(
            len(WORD.findall(line))
            for line in (text or "").split("\n")
            if len(having[source, norm(line)]) <= max(least, share * len(hosts[source]))
        )
        out.append((i, *counts, not counts[-1] and left >= 20 and left >= 0.5 * counts[0]))
    return out


def same(got, want):
    names = ["doc_id", *quality._COUNTS, "base_failed", "kept"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)


def test_query_against_brute_force(spark, folder, given):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in given("documents")]
    same(quality.op5_quality(spark, folder).collect(), brute(rows))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tight = brute(rows, 1, 0.0)
    same(quality.judged(docs, 1, 0.0).collect(), tight)
    assert any(not r[-1] and not r[-2] for r in tight)


@pytest.mark.parametrize("seed", range(6))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.choice(["a", "b"]) for _ in range(rng.randint(0, 60))] + ["x"] * rng.randint(0, 12)
    assert quality.repeated_words([w.encode() for w in words]) == base(" ".join(words))[4]


LONG = " ".join(f"w{n}" for n in range(40))
MENU = "Home  About\tContact " + " ".join(f"m{n}" for n in range(30))
ROWS = (
    [(n, f"{MENU}\nown {n} line", "hot") for n in range(30)]
    + [(100 + n, f"{MENU.upper()}\n{LONG} {n} {LONG[::-1]}", "hot") for n in range(5)]
    + [(200, f"{MENU}\n{LONG}", None), (201, None, "hot"), (202, "", None), (None, LONG, ""), (None, LONG, "")]
    + [(203, "rep " * 50_000, "a"), (204, "\n\n é#* \n\n", "a"), (205, LONG + "\r\n" + LONG, "a")]
)


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, DOC).withColumns({c: F.lit("clash") for c in ("row", "doc", "lines", "kept", "host")})
    got = quality.judged(docs).collect()
    same(got, brute(ROWS))
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {100, 101, 102, 103, 104, 200, None}


def test_clean_texts(spark):
    docs = spark.createDataFrame(ROWS, DOC).withColumn("gone", F.lit("clash"))
    got = quality.clean(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[100] == f"{LONG} 0 {LONG[::-1]}"
    assert texts[200] == f"{MENU}\n{LONG}"
    assert got.filter("doc_id is null").count() == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert quality.judged(docs).collect() == [] and quality.clean(docs).collect() == []
