import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tallyweave.llm import substrings

DOC = "doc_id long, text string"


def plain_chunks(text):
    """Cuts by a byte loop, chunks by walking on from each beginning."""
    gear, hash_, hashes, cuts, begins = substrings.gear().tolist(), 0, [], {0}, {0}
    for at, byte in enumerate(text):
        hash_ = ((hash_ << 1) + gear[byte]) % (1 << 32)
        hashes.append(hash_)
        if hash_ < (1 << 32) // substrings.CUT:
            cuts.add(at + 1)
        if hash_ < (1 << 32) // substrings.MEAN:
            begins.add(at + 1)
    cuts = sorted({*cuts, len(text)})
    edges = [*sorted(begins), len(text)]
    for a, b in zip(edges, edges[1:]):
        if b - a > substrings.GAP:
            for at in range(a, b - substrings.GAP + 1, substrings.GAP):
                own = hashes[at : at + substrings.GAP]
                begins.add(at + own.index(min(own)) + 1)
    starts = [i for i in range(len(text)) if text[i : i + 1].strip() and (i == 0 or not text[i - 1 : i].strip())]
    out = []
    for a in sorted(begins):
        own = [s for s in starts if s >= a]
        ends = [b for b in cuts if b >= a + substrings.LONG or sum(s < b for s in own) >= substrings.SPAN][:1]
        ends += own[substrings.SPAN + substrings.MORE - 1 :][:1]
        if a + substrings.LONG + substrings.LONGER <= len(text):
            ends.append(a + substrings.LONG + substrings.LONGER)
        if ends:
            out.append((a, min(ends)))
    return out


def test_chunks_against_a_byte_loop():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(n)).encode() for n in (0, 5, 60, 90)]
    texts += [b"x" * 700 + b" y", b"  lead and trail  ", bytes(rng.choices(range(256), k=900)), b"ab cd " * 100, b"x"]
    got = substrings.chunks(texts)
    for text, (starts, stops) in zip(texts, got, strict=True):
        assert list(zip(starts.tolist(), stops.tolist(), strict=True)) == plain_chunks(text)


def brute(rows):
    """{(id, text): repeated byte places} of rows that have any."""
    having = defaultdict(set)
    for i, text in rows:
        for a, b in plain_chunks((text or "").encode()):
            having[(text or "").encode()[a:b]].add(i)
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        hit, late = set(), set()
        for a, b in plain_chunks(data):
            ids = having[data[a:b]]
            if len(ids) > 1:
                hit.update(range(a, b))
                if min(ids) != i:
                    late.update(range(a, b))
        if hit:
            out[i, text] = (hit, late)
    return out


def places(spans):
    return {p for a, b in zip(spans["starts"], spans["stops"], strict=True) for p in range(a, b)}


def test_query_against_brute_force(spark, folder, given):
    rows = sorted((r["doc_id"], r["text"]) for r in given("documents") if len(r["text"]) < 1500)
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in substrings.repeats(docs).collect()}
    want = {k[0]: v for k, v in brute(rows).items()}
    assert got.keys() == want.keys() and len(got) > 3
    for i, (hit, late) in want.items():
        assert places(got[i].repeated) == hit and places(got[i].dropped) == late
    rows = substrings.op2_substrings(spark, folder).collect()
    assert {r.doc_id for r in rows} >= set(want)
    assert all(0 <= r.dropped_bytes <= r.repeated_bytes and r.n_spans == len(r.spans) > 0 for r in rows)


def passage(rng, n):
    return " ".join("".join(rng.choices("etaoinshrd", k=rng.randint(2, 10))) for _ in range(n))


def test_passages_of_corpus_words_are_found():
    """Passages of given words between others, of several seeds: how many have no whole chunk, and how much is covered."""
    rows = duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    words, missed, covered, total = [w for (text,) in rows for w in text.split()], 0, 0.0, 0
    for seed in (1, 2, 3):
        rng = random.Random(seed)

        def some(n, rng=rng):
            at = rng.randrange(len(words) - n)
            return " ".join(words[at : at + n]).encode()

        for _ in range(1500):
            planted, found = some(50), []
            for _ in range(2):
                before = some(20) + b" "
                text = before + planted + b" " + some(20)
                ((starts, stops),) = substrings.chunks([text])
                a, b = len(before), len(before) + len(planted)
                own = [(x, y) for x, y in zip(starts.tolist(), stops.tolist(), strict=True) if a <= x and y <= b]
                found.append({(x - a, y - a): text[x:y] for x, y in own})
            both = {k for k, t in found[0].items() if t in found[1].values()}
            missed += not both
            covered += len({p for x, y in both for p in range(x, y)}) / len(planted)
            total += 1
    assert missed <= 0.001 * total and covered > 0.7 * total


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(9)
    shared = [passage(rng, 55) for _ in range(40)]
    rows, planted = [], set()
    for i in range(300):
        text = passage(rng, rng.randint(30, 300))
        if i % 3 == 0:
            words, at = text.split(), rng.randint(0, 25)
            text = " ".join([*words[:at], shared[i // 3 % 40], *words[at:]])
            planted.add(i)
        rows.append((i, text))
    found = {r.doc_id for r in substrings.repeats(spark.createDataFrame(rows, DOC)).collect()}
    assert found <= planted and len(found) >= 0.999 * len(planted)


def test_clean_texts_and_odd_rows(spark):
    rng = random.Random(4)
    shared, own = passage(rng, 80), [passage(rng, 40) for _ in range(4)]
    rows = [(5, f"{own[0]} {shared}"), (2, f"{shared} {own[1]}"), (None, None), (7, ""), (None, f"é{shared}"), (8, own[2]), (8, own[2])]
    rows += [(9, "x" * 200_000), (10, "same " * 20_000), (None, f"{own[3]} {shared}")]
    docs = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("row", "doc", "digests", "key")})
    got = {r.doc_id: r for r in substrings.repeats(docs).collect()}
    assert set(got) == {5, 2, None}
    assert None in got[2].kept_by and None in got[5].kept_by
    # Rows without an id are documents of their own, one of which keeps the passage.
    none = [r for r in substrings.repeats(docs).collect() if r.doc_id is None]
    assert len(none) == 2 and sorted(len(r.dropped["starts"]) > 0 for r in none) == [False, True]
    cleaned = substrings.clean(docs)
    assert cleaned.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str)
    assert len(texts) == len(rows)
    left = dict(t for t in texts if t[0])
    assert own[0] in left[5] and len(left[5]) < len(own[0]) + 200
    assert own[1] in left[2] and (8, own[2]) in texts
    assert ((None, f"é{shared}") in texts) != ((None, f"{own[3]} {shared}") in texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert substrings.repeats(docs).collect() == [] and substrings.clean(docs).collect() == []
