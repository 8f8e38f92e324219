import hashlib
import random
import re

from tallyspark.llm.substring import remove_repeated


def brute(rows, window):
    first = {}
    docs = sorted(((d if d is not None else 2**63, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows), key=lambda x: x[0])
    for d, words in docs:
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (d, i))
    out = []
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (d if d is not None else 2**63, i):
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window, gram):
    df = spark.createDataFrame([(t, d, 1, "x") for d, t in rows], "text string, doc_id long, p int, firsts string").repartition(5)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(df, window, gram).collect()), key=str)


def corpus(seed, vocabulary=400, window=20):
    rng = random.Random(seed)
    names = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    passages = [rng.choices(names, k=rng.randint(window - 2, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(80):
        words = rng.choices(names, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            passage = rng.choice(passages)
            words[at:at] = passage[rng.randint(0, 3) :]
        if rows and rng.random() < 0.3:
            words = re.findall(r"\S+", rng.choice(rows)[1])
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(names)
        rows.append((1000 - i * 3, rng.choice([" ", "\n", "\t \r"]).join(words)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1) + [(None, "a b c " * 30), (2, None), (3, ""), (4, " \n"), (5, "x " * 5000), (6, "y z " * 40), (6, "y z " * 40)]
    assert run(spark, rows, 20, 6) == brute(rows, 20)


def test_many_branches(spark):
    """A tiny vocabulary and short windows make nearly every node branch."""
    rows = corpus(2, vocabulary=3, window=6)
    assert run(spark, rows, 6, 2) == brute(rows, 6)


def test_empty_table(spark):
    assert run(spark, [], 20, 6) == []


def test_different_texts_without_an_id_or_under_one_id(spark):
    """The texts get ids of their own in the order that the docstring gives, and nothing else changes."""
    from pyspark.sql import functions as F

    texts = [t for _, t in corpus(3)]
    rows = [(None if i % 3 else 7 if i % 2 else i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (7, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = df.select("*", F.xxhash64("text").alias("h")).distinct().collect()
    number = {(r.doc_id, r.text): n for n, r in enumerate(sorted(order, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h)))}
    assert len(number) > 60
    want = sorted(x[1:] for x in brute([(number[r], r[1]) for r in rows], 20))
    assert sum(x[1] for x in want) > 0
    for shared in (20_000, 0):
        import tallyspark.llm.substring as S

        was, S.SHARED_IDS = S.SHARED_IDS, shared
        try:
            assert sorted(x[1:] for x in run(spark, rows, 20, 6)) == want
        finally:
            S.SHARED_IDS = was


def test_kept_text(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    got = remove_repeated(df, 20, 6, with_text=True).collect()
    assert any(r.n_removed for r in got)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert "kept_text" not in remove_repeated(df, 20, 6).columns


def test_words_that_collide_under_polynomial_hashes(spark):
    """Words in the Thue-Morse order and its complement are different words."""
    order = [bin(i).count("1") & 1 for i in range(1024)]
    one, other = ("".join("ab"[x ^ flip] for x in order) for flip in (0, 1))
    tail = " ".join(["same"] * 19)
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}")]
    assert run(spark, rows, 20, 6) == brute(rows, 20)
    assert [x[2] for x in run(spark, rows, 20, 6)] == [0, 0]


def test_differing_spans_start_another_attempt(spark, monkeypatch):
    """Hashes of four bits collide all the time: no word goes on their word, and the next attempt is right."""
    import tallyspark.llm.substring as S

    tried = []
    attempt = S._attempt

    def watched(*args):
        out = attempt(*args)
        tried.append((args[-1], out.where("differing > 0").count()))
        return out

    monkeypatch.setattr(S, "_attempt", watched)
    rows = corpus(4)
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.remove_repeated(df, 20, 6, attempts=(4, 64)).collect()), key=str)
    assert got == brute(rows, 20)
    assert [bits for bits, _ in tried] == [4, 64] and tried[0][1] > 0 and tried[1][1] == 0


def test_row_order_does_not_matter(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words[:40]), " ".join(words[10:60])
    for id_ in (5, None, 2**63 - 1):
        found = []
        for rows in ([(id_, a), (id_, b)], [(id_, b), (id_, a)]):
            found.append(run(spark, rows, 20, 6))
        assert found[0] == found[1]
        assert [x[0] for x in found[0]] == [id_, id_]
        assert sum(x[2] for x in found[0]) == 30


def test_heavy_minimizers_count_as_branches(spark, monkeypatch):
    import tallyspark.llm.substring as S

    monkeypatch.setattr(S, "HEAVY_LEAST", 9)
    rows = corpus(5, vocabulary=30)
    assert run(spark, rows, 20, 6) == brute(rows, 20)


def test_text_parts_cover_every_window():
    import numpy as np
    import pyarrow as pa

    from tallyspark.llm.common import text_parts, words_of

    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "bb", "ccé", " ", "\n ", "x" * 90]) for _ in range(n)) for n in (3000, 0, 40, 5000)]
    batch = pa.record_batch({"text": pa.array(texts)})
    seen = [dict() for _ in texts]
    for rows, before, data, offsets in text_parts(batch, 4, limit=700):
        start, end, bounds = words_of(data, offsets)
        for i, row in enumerate(rows.tolist()):
            words = [data[a:b].tobytes().decode() for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])]
            for j in range(len(words) - 4):
                assert int(before[i]) + j not in seen[row]
                seen[row][int(before[i]) + j] = words[j : j + 5]
    for text, found in zip(texts, seen):
        words = text.split()
        assert found == {j: words[j : j + 5] for j in range(len(words) - 4)}
    assert np.all([len(s) for s in (seen[0], seen[3])])


def test_long_text(spark):
    rng = random.Random(7)
    text = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=1_200_000))
    cut = text[3_000_000:3_100_000]
    rows = [(1, text), (2, cut), (3, cut[50_000:] + " new " + text[:5_000_000])]
    assert run(spark, rows, 20, 6) == brute(rows, 20)


def test_clashing_columns(spark):
    rows = corpus(8)[:30]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("d", "v", "p", "k", "t", "n", "sd", "first", "salt", "heavy", "opened", "asked", "spans", "copies", "shared_id", "several", "differing", "copy"):
        df = df.withColumn(name, df["doc_id"] * 0)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated(df).collect()), key=str) == brute(rows, 20)
