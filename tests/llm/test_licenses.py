import re
from collections import defaultdict

from pyspark.sql import functions as F

from tallyweave.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    """(n_words, places, labels) of the phrases."""
    words = split(text)
    places = [
        (at, label)
        for phrase, label in licenses.PHRASES
        for at in range(len(words))
        if words[at : at + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(places), sorted({label for _, label in places})


def method(text):
    """(labels, best share), by comparing every place of the text with every place of every notice."""
    words, labels, best = split(text), set(), 0.0
    places_of = defaultdict(list)
    for at in range(len(words) - 3):
        places_of[tuple(words[at : at + 4])].append(at)
    for label, notice in licenses.all_notices():
        own = split(notice)
        grams = len(own) - 3
        votes = {}
        for t in range(grams):
            for at in places_of.get(tuple(own[t : t + 4]), ()):
                votes.setdefault(at - t, []).append((at, t))
        groups = []
        for diagonal in sorted(votes):
            if groups and diagonal - groups[-1][0] <= licenses.NEAR:
                groups[-1] = (diagonal, groups[-1][1] + votes[diagonal])
            else:
                groups.append((diagonal, votes[diagonal]))
        for _, found in groups:
            places = len({t for _, t in found})
            length = max(at for at, _ in found) + 4 - min(at for at, _ in found)
            held, dense = places / grams, min(1.0, (places + 3) / length)
            if (held >= licenses.HELD or places + 3 >= licenses.LONG) and dense >= licenses.DENSE:
                labels.add(label)
                best = max(best, held, licenses.HELD)
            else:
                best = max(best, held / 2)
    return labels, best


def check(row, text):
    n_words, places, labels = base(text)
    more, best = method(text)
    assert (row.n_words, row.n_base) == (n_words, len(places))
    assert (row.first_word, row.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert row.base_labels == ",".join(labels)
    assert row.labels == ",".join(sorted({*labels, *more}))
    assert abs(row.score - (1.0 if places else best)) < 1e-12


def test_query_against_brute_force(spark, folder, given):
    texts = {r["doc_id"]: r["text"] for r in given("documents")}
    got = licenses.op7_licenses(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r, texts[r.doc_id])


TEXT = dict(licenses.SHORT_TEXTS)
APACHE = TEXT["apache"]
OPENING = "This is free and unencumbered software released into the public domain"
ROWS = [
    (1, "x " * 9 + TEXT["mit"].upper() + " y"),
    (2, APACHE.replace("you may not use", "you really may never use")),
    (3, "word " * 50_000 + "mit LICENSE. " + APACHE),
    (4, None),
    (5, ""),
    (6, "mit license mit license general public license"),
    (None, "Licensed under CC BY-NC 4.0."),
    (7, "Licensed under CC BY-NC 4.0."),
    (7, "Licensed under CC BY-NC 4.0."),
    (8, "Permission is hereby granted to nobody"),
    (9, "\n".join([OPENING] * 3)),
    (10, "lïcense MIT"),
]


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("words", "at", "label", "doc", "places")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = licenses.op7_licenses(spark, str(tmp_path)).collect()
    texts = dict(ROWS)
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i in texts)
    for r in got:
        check(r, texts[r.doc_id])
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].labels == "mit" and by_id[1].base_labels == ""
    assert by_id[2].labels == "apache"
    assert by_id[None].labels == "cc-by-nc"


def test_repeated_notices_are_spans_of_their_own(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").filter("doc_id = 9")
    found = licenses.spans(licenses.matches(docs, [("unlicense", OPENING)]).filter("places is not null")).collect()
    assert sorted((r.start, r.stop, r.held) for r in found) == [(0, 11, 1.0), (11, 22, 1.0), (22, 33, 1.0)]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_middle_of_every_license_is_enough(spark):
    """Between other words, with every twentieth word changed, and without the names that phrases look for."""
    docs, want = [], {}
    for n, (label, notice) in enumerate(licenses.all_notices()):
        words = notice.split()
        if len(words) < 150:
            continue
        for part in range(3):
            at = (len(words) - 100) * part // 2
            middle = ["changed" if i % 20 == 10 else w for i, w in enumerate(words[at : at + 100])]
            docs.append((10 * n + part, " ".join(["before"] * 30 + middle + ["behind"] * 30)))
            want[10 * n + part] = label
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {"mit", "bsd", "apache", "gpl", "lgpl", "mpl"} <= set(want.values())
    for doc, label in want.items():
        assert label in got[doc], (doc, label, got[doc])
    # Other licenses are named by shared passages only now and then.
    assert sum(len(set(got[d]) - {want[d]}) for d in want) <= len(want) // 4


def test_text_without_a_license_has_no_label(spark):
    prose = "The terms of this agreement are of no interest to the reader, who may use the software as they like. " * 20
    row = licenses.scan(spark.createDataFrame([(1, prose)], "doc_id long, text string")).first()
    assert row.labels == [] and row.score < 0.3
