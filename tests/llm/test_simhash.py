import random

import xxhash

from tallyspark.llm.simhash import near_duplicates

SCHEMA = "doc_id long, text string, fp string, root long"


def brute(rows):
    prints = []
    for doc_id, text in rows:
        words = bytes(text or "", "utf-8").lower().split()
        parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        fp = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        prints.append((doc_id, fp))
    parent = {i: i for i in range(len(prints))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, f, least.get(root(i))) for i, (d, f) in enumerate(prints)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in near_duplicates(df).collect()), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(300)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(1, 300))
        rows.append((i * 10, " ".join(words)))
        for j in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i * 10 + j + 1, rng.choice([" ", "\n", "  "]).join(copy).title()))
    return rows


def test_matches_brute_force(spark):
    rows = corpus() + [(None, "a b c d"), (9001, ""), (9000, None), (9002, " \t\n"), (9003, "one"), (9003, "one"), (9004, "x " * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_long_texts_in_parts(spark, monkeypatch):
    """Texts of many parts, and parts with words that span them, have the fingerprints of whole texts."""
    import pyarrow as pa

    from tallyspark.llm import common, simhash

    rng = random.Random(11)
    long_ = lambda n: rng.choice([" ", "\n \t"]).join("".join(rng.choices("ABcdéf", k=rng.randint(1, 30))) for _ in range(n))
    texts = [long_(900), "", None, long_(2), "x" * 5000, "x" * 5000 + " y", "a b " + "x" * 5000 + " c", long_(300) + " " * 3000, " " * 4000 + long_(300), "one two", *(long_(n) for n in range(1, 40))]
    part = lambda batch, overlap: common.text_parts(batch, overlap, 200)
    monkeypatch.setattr(simhash, "text_parts", part)
    n = len(texts)
    batch = pa.record_batch({"doc_id": pa.array(range(n)), "text_hash": pa.array(range(n)), "text": pa.array(texts)})
    found = next(simhash._fingerprints([batch])).column("fp").to_numpy().view("uint64").tolist()
    assert found == [f for _, f, _ in sorted(brute(list(enumerate(texts))), key=lambda r: r[0])]


def peak_mb(code):
    """MB that a worker's function adds at its peak, on one text of 64 MB of random words."""
    import subprocess
    import sys

    made = """
import resource, sys
import numpy as np, pyarrow as pa
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
letters = np.random.default_rng(1).integers(97, 123, 64 << 20, np.uint8)
letters[np.random.default_rng(2).integers(0, letters.size, letters.size // 7)] = 32
text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, letters.size], np.int32)), pa.py_buffer(letters))
"""
    out = subprocess.run([sys.executable, "-c", made + code], capture_output=True, text=True, check=True, timeout=600)
    return float(out.stdout.strip().splitlines()[-1])


def test_memory_of_a_64_mb_text():
    code = """
from tallyspark.llm.simhash import _fingerprints
batch = pa.record_batch({"doc_id": pa.array([1]), "text_hash": pa.array([1]), "text": text})
before = peak()
list(_fingerprints([batch]))
print(peak() - before)
"""
    assert peak_mb(code) < 500


def test_close_fingerprints_link(spark):
    """Chains of fingerprints three bits apart, in every mix of set and cleared bits."""
    from tallyspark.llm.components import connected_components
    from tallyspark.llm.simhash import links

    rng = random.Random(5)
    fps = {0, 2**64 - 1, 1, 3, 7, 15}
    for _ in range(150):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    signed = lambda x: x - 2**64 if x >> 63 else x
    found = {r.node: r.root for r in connected_components(links(spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3))).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    groups = {}
    for x in fps:
        groups.setdefault(root(x), set()).add(signed(x))
    for group in groups.values():
        assert {found.get(x, x) for x in group} == {min(group)}


def test_empty_table(spark):
    assert run(spark, []) == []


def components(spark, fps, most):
    from tallyspark.llm.components import connected_components
    from tallyspark.llm.simhash import links

    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    return {r.node: r.root for r in connected_components(links(df, most)).collect()}


def test_crowded_keys_are_dealt_by_variant(spark):
    """A cluster that shares all its keys gives the same components with room for few variants as with room for all."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:
        x = centre
        for b in rng.sample(range(46), rng.randint(1, 9)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    every = components(spark, fps, 1 << 21)
    assert len(every) > 20
    for most in (1000, 20_000):
        assert components(spark, fps, most) == every


def test_rows_of_a_fingerprint_grow_slowly():
    """Rows a fingerprint at the keys of 200 thousand, 15 million, 150 million and 50 billion fingerprints."""
    import numpy as np

    from tallyspark.llm.simhash import _keys, _number_of_variants, _variants, key_bits

    fps = np.random.default_rng(1).integers(0, 2**64, 2000, np.uint64)
    rows = {}
    for n in (200_000, 15_000_000, 150_000_000, 5 * 10**10):
        row, key = _keys(fps, key_bits(n))
        rows[n] = row.size / fps.size
        assert np.unique(np.stack([row.astype(np.uint64), key]), axis=1).shape[1] == row.size
        got, variant, rim = _variants(fps[row], key, key_bits(n))
        assert (np.bincount(got, minlength=row.size) == _number_of_variants(fps[row], key, key_bits(n))).all()
        assert (variant >> np.uint64(64 - key_bits(n)) == key[got]).all()
        own = row[got] == 0
        x = int(fps[0])
        ones = [b for b in range(64) if x >> b & 1]
        core = {x} | {x ^ 1 << b for b in range(64)}
        assert set(variant[own & ~rim].tolist()) == core
        assert set(variant[own & rim].tolist()) == {x ^ 1 << a ^ 1 << b for a in ones for b in ones if a < b}
    assert rows[15_000_000] < 1.2 * rows[200_000] and rows[150_000_000] < 1.5 * rows[200_000] and rows[5 * 10**10] < 120
