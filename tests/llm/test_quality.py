import random
import zlib

import numpy as np
import pytest

from tallyspark.llm.quality import STATISTICS, pool, score_quality, statistics

DOCS, LABELS = "doc_id long, text string, score double, x string", "doc_id long, quality int, y double"


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 8))) for _ in range(rng.randint(15, 80))]
        text = (" ".join(words) + ".").capitalize() if good else rng.choice([lambda w: " | ".join(w), lambda w: "!! ".join(w).upper(), lambda w: " ".join([w[0]] * 60)])(words)
        docs.append((i, text, 0.0, "x"))
        labels.append((i, int(good), 0.0))
    return docs, labels


EDGE = [(9001, None, 0.0, "x"), (9002, "", 0.0, "x"), (None, "abc def", 0.0, "x"), (9003, "w " * 60_000, 0.0, "x"), (9004, "same", 0.0, "x"), (9004, "same", 0.0, "x")]


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    got = score_quality(spark.createDataFrame(docs + EDGE, DOCS), spark.createDataFrame(labels + [(None, 1, 0.0), (3, None, 0.0), (77_777, 1, 0.0)], LABELS)).collect()
    assert len(got) == len(docs) + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {d: q for d, q, _ in labels}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and auc(held) > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(200)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, y) for d, q, y in labels]
    run = lambda rows: sorted((r.doc_id, r.score) for r in score_quality(spark.createDataFrame(docs, DOCS).repartition(1), spark.createDataFrame(rows, LABELS).repartition(1)).collect())
    for a, b in zip(run(labels), run(flipped), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6)


def test_no_labels_and_no_rows(spark):
    docs, _ = corpus(5)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in score_quality(spark.createDataFrame(docs, DOCS), none).collect()} == {0.5}
    assert score_quality(spark.createDataFrame([], DOCS), none).count() == 0


def test_statistics_by_hand():
    texts = [b"", b"Aa aa aa!\nAa aa aa!\nx,", "é é".encode()]
    x = statistics(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    s = [dict(zip(STATISTICS, row, strict=True)) for row in x]
    assert s[0]["log_bytes"] == s[0]["entropy"] == s[0]["distinct_words"] == 0
    assert s[1]["distinct_words"] == pytest.approx(4 / 7) and s[1]["top_word"] == pytest.approx(2 / 7)
    assert s[1]["distinct_lines"] == pytest.approx(2 / 3) and s[1]["exclamation"] == pytest.approx(2 / 22) and s[1]["marked_words"] == pytest.approx(2 / 7)
    assert s[2]["non_ascii"] == pytest.approx(4 / 5) and s[2]["repeated_next"] == pytest.approx(1 / 2)


def test_pooling_is_isotonic():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 50, 60).astype(float)
    r = np.arange(60.0)
    y = n * np.clip(r / 60 + rng.normal(0, 0.2, 60), 0, 1)
    knots, values = pool(n, y, r * n)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    # Least squares by brute force: max over starts of the min over ends of the mean.
    want = [max(min(y[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(values, 9)))


def test_long_texts_have_the_same_statistics_in_parts(monkeypatch):
    rng = random.Random(2)
    for tail in (b"", b"\n", b" end", b"\n\n"):
        text = "".join(rng.choice(["word ", "Über ", "a a ", "x!\n", "same line\n", "y" * 300 + " ", "1,2|"]) for _ in range(400)).encode() + tail
        data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        whole = statistics(data, offsets)
        monkeypatch.setattr("tallyspark.llm.quality.LONG_TEXT", 10)
        for size in (5, 64, 1000):
            monkeypatch.setattr("tallyspark.llm.quality.PART_BYTES", size)
            assert statistics(data, offsets) == pytest.approx(whole, rel=1e-12)
        monkeypatch.undo()


def plain_statistics(text):
    """The 23 statistics of one text, one after the other."""
    from collections import Counter
    from math import log, log1p

    raw = text.encode()
    n, words = max(len(raw), 1), [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", raw) if w]
    w = max(len(words), 1)
    count = lambda of: sum(b in of for b in raw) / n
    upper, lower, digit = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
    shares = [count(upper), count(lower), count(digit), count(b"\t\v\f\r "), count(b"\n"), sum(b > 127 for b in raw) / n, count(b","), count(b".?"), count(b"!"), count(b"|")]
    entropy = -sum(c / n * log(c / n) for c in Counter(raw).values())
    lines = raw.split(b"\n")
    ended = lines[:-1] if not lines[-1] else lines
    return [
        log1p(len(raw)), log1p(len(words)), sum(map(len, words)) / w, *shares, (1 - sum(shares)) if raw else 0.0, entropy, len(set(words)) / w,
        max(Counter(words).values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w, sum(len(x) <= 3 for x in words) / w,
        sum(len(x) >= 12 for x in words) / w, sum(x[-1] < 128 and not x[-1:].isalnum() and x[-1:] not in (b",", b".", b"?") for x in words) / w,
        min(len(words) / len(lines), 200), len(set(ended)) / len(lines),
    ]


def test_scores_match_a_dense_solve(spark):
    docs, labels = corpus(300, seed=4)
    docs = docs + EDGE[:2]
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 4
    x = {d: np.array(plain_statistics(t or "")) for d, t, _, _ in docs}
    truth = {d: q for d, q, _ in labels if fold(d) != 2}
    seen = np.array([x[d] for d in truth])
    mean, scale = seen.mean(axis=0), np.maximum(seen.std(axis=0), 1e-3)
    rng = np.random.default_rng(11)
    directions, phase = rng.normal(0, 1 / 3.0, (23, 192)), rng.uniform(0, 2 * np.pi, 192)
    wave = lambda v: np.sqrt(2 / 192) * np.cos(np.clip((v - mean) / scale, -8, 8) @ directions + phase)
    fitted = [d for d in truth if fold(d) != 3]
    a, y = np.array([wave(x[d]) for d in fitted]), np.array([truth[d] for d in fitted], float)
    # Ridge with a free constant: centre both sides, then least squares on rows extended by the penalty.
    root = np.sqrt(1e-3 * len(fitted)) * np.eye(192)
    weights = np.linalg.lstsq(np.r_[a - a.mean(axis=0), root], np.r_[y - y.mean(), np.zeros(192)], rcond=None)[0]
    ridge = lambda d: (wave(x[d]) - a.mean(axis=0)) @ weights + y.mean()
    bins = {}
    for d in truth:
        if fold(d) == 3:
            bins.setdefault(min(max(int((ridge(d) + 0.5) / 2 * 256), 0), 255), []).append((truth[d], ridge(d)))
    table = np.array([[len(v), sum(q for q, _ in v), sum(r for _, r in v)] for _, v in sorted(bins.items())])
    k = len(table)
    fit = [max(min(table[s : e + 1, 1].sum() / table[s : e + 1, 0].sum() for e in range(i, k)) for s in range(i + 1)) for i in range(k)]
    blocks = {}
    for value, row in zip(np.round(fit, 12), table):
        blocks[value] = blocks.get(value, 0) + row
    knots, values = zip(*((b[2] / b[0], v) for v, b in sorted(blocks.items())))
    assert set(got) == set(x)
    for d in x:
        assert got[d] == pytest.approx(np.interp(ridge(d), knots, values), abs=1e-3)
