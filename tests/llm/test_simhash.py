import random
import re

import numpy as np
import pytest
import xxhash

from reclutark.llm import simhash
from reclutark.llm.graph import connected_components


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def close(fps, bits=3):
    x = np.array(fps, dtype=np.uint64)
    return [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= bits) + i + 1]


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "One two", "A b C", "É à Î ô", "x y z w v", "a b c a b c a b c", "p q\x0br\x1cs t"])
def test_fingerprint_of_short_texts(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_long_texts_are_summed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(2000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_query_equals_brute_force(spark, table):
    import __spark_entry__ as entry

    rows = sorted(entry.queries()["op6_simhash"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) and len(r.fingerprint) == 16 for r in rows)
    ids = [r.doc_id for r in rows]
    want = components(ids, [(ids[i], ids[j]) for i, j in close([int(r.fingerprint, 16) for r in rows])])
    assert {r.doc_id: r.component_id for r in rows} == want


@pytest.mark.parametrize("bucket", [4096, 64])
def test_dense_groups_lose_no_link_when_buckets_are_divided(spark, bucket):
    rnd = random.Random(3)
    centres, fps = [rnd.getrandbits(64) for _ in range(8)], set()
    for k in range(900):
        x = centres[k % 8]
        for _ in range(rnd.randint(0, 6)):
            x ^= 1 << rnd.randint(0, 63)
        fps.add(x)
    fps = sorted(fps)
    classes = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "node long, fp long")
    links = simhash.near_links(classes, bucket=bucket)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = components(range(len(fps)), close(fps))
    assert {i: got.get(i, i) for i in want} == want


def test_pivots_discard_only_what_is_too_far():
    rnd = random.Random(4)
    fps = np.array([rnd.getrandbits(64) & 0xFFF for _ in range(300)], dtype=np.uint64)
    pivots = np.stack([np.bitwise_count(fps ^ np.uint64(p % 2**64)) for p in simhash.references()], axis=1).astype(np.int8)
    left, right = simhash._links(fps, pivots, 3)
    assert {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist())} == set(close(fps.tolist()))


def test_any_two_fingerprints_in_reach_share_a_bucket_at_every_level():
    rnd = random.Random(5)
    for _ in range(300):
        differ = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))
        masks = [m for m in simhash.first_masks() if differ & m % 2**64 == 0]
        assert masks
        for _ in range(4):
            finer = [f for f in simhash.finer_masks(masks[0]) if differ & f % 2**64 == 0]
            assert finer
            masks = finer


def test_one_document_of_each_group_stays(documents):
    copy = " ".join(f"copy{i}" for i in range(60))
    docs = documents((5, copy), (2, copy), (9, copy + " tail"), (2, copy), (1, "other words here and there"), (None, copy), (4, None), (3, ""))
    near = ((simhash.fingerprint(copy) ^ simhash.fingerprint(copy + " tail")) % 2**64).bit_count() <= simhash.MAX_BITS
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == ([1, 2, 3] if near else [1, 2, 3, 9])
    assert kept[0].asDict().keys() == docs.first().asDict().keys()
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_rows_of_one_id_are_copies_only_if_they_are_alike(documents):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two", "three", "four")]
    docs = documents((1, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[0]), (None, None), (7, None))
    for d in (docs, docs.repartition(3)):
        kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(d).collect()), key=str)
        assert kept == sorted([(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (7, None)], key=str)


@pytest.mark.parametrize("n", [0, 1, 300])
def test_components_of_random_links_chains_and_hubs(spark, n):
    rnd = random.Random(n)
    links = [(rnd.randint(0, n), rnd.randint(0, n)) for _ in range(n)] + [(i, i + 1) for i in range(1000, 1000 + n)] + [(5000, 5000 + i) for i in range(n)]
    rows = connected_components(spark.createDataFrame([*links, (None, 3), (7, None), (8, 8)], "a long, b long")).collect()
    nodes = {x for pair in links for x in pair if pair[0] != pair[1]}
    assert {r.node: r.component for r in rows} == components(sorted(nodes), [p for p in links if p[0] != p[1]])
