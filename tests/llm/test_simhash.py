import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import graph, simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    """Smallest id reachable, by id, of {id: fingerprint}."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if label[a] != label[b] and (fps[a] ^ fps[b]).bit_count() <= 3:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_query_against_brute_force(spark, folder, given):
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in given("documents")}
    want = brute_classes(fps)
    got = simhash.op9_simhash(spark, folder).collect()
    assert len(got) == len(fps)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_some_mask_misses_any_three_positions():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 15
    for spots in itertools.combinations(range(64), 3):
        assert any(not sum(1 << s for s in spots) & m for m in masks)


def test_last_level_leaves_small_buckets():
    for _, _, mask in simhash._tables(3)[-1]:
        assert 1 << (64 - mask.bit_count()) <= simhash.CROWD


@pytest.mark.parametrize("crowd", [256, 4])
def test_links_span_all_components(spark, monkeypatch, crowd):
    """Clusters around centres, also with buckets that have to be split."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(30):
            fp = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                fp ^= 1 << bit
            fps.add(simhash._signed(fp))
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    mask = (1 << 64) - 1
    assert all(((e.a ^ e.b) & mask).bit_count() <= 3 for e in edges.collect())
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    want = brute_classes({f: f & mask for f in fps})
    assert {f: roots.get(f, f) for f in fps} == want


def test_components_of_a_path_a_star_and_odd_edges(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, i) for i in range(1001, 1200)]
    odd = [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = graph.components(spark.createDataFrame(path + star + odd, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(101)}, **{i: 1000 for i in range(1000, 1200)}}


def test_odd_rows(spark):
    rows = [(3, None), (2, ""), (9, " \n "), (None, "A b"), (7, "a B"), (7, "a B"), (8, "x " * 200_000), (6, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.classes(docs).collect()
    assert sorted((r.doc_id or -1, r.fp, r.component_id) for r in got) == sorted(
        (i or -1, simhash._signed(brute_fp(t)), 2 if not (t or "").strip() else 7 if t.lower() == "a b" else i)
        for i, t in rows
    )
    assert simhash.classes(docs.limit(0)).collect() == []
