import random
import re
import zlib
from collections import Counter

from tallyspark.llm import spelling
from tallyspark.llm.spelling import grouped_variants, near_words, word_counts

SCHEMA = "doc_id long, text string, word string, n string"


def edits(word, letters):
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    changed = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (cut | put | changed) - {word}


def brute(rows, damage=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    letters = {c for w in words for c in w}
    out, forms = {}, {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in edits(w, letters) if x in words)
        if near and -near[0][0] >= 10 * n:
            forms[w] = near[0][1]
        out[w] = (len(near), n)
    found = set()
    for w, (n_near, n) in out.items():
        root = w
        while root in forms:
            root = forms[root]
        found.add((w, forms.get(w), root, n, n_near, words[forms[w]] if w in forms else None))
    return found


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)


def run(spark, rows):
    return [tuple(r) for r in grouped_variants(frame(spark, rows), damage=31).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé×ÿ", k=rng.randint(6, 10))) for _ in range(40)]
    words = list(base)
    for w in base:
        for _ in range(6):
            x = rng.choice(words[-8:] + [w])
            k = rng.randrange(len(x))
            words.append(rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("abcé") + x[k:], x[:k] + rng.choice("abcé") + x[k + 1 :], x[:k] + x[k : k + 2][::-1] + x[k + 2 :]]))
    weights = [rng.choice([1, 3, 40, 500]) for _ in words]
    return [(i if i % 9 else None, rng.choice([" ", ", ", "1", "\n"]).join(w.title() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=200))) for i in range(150)]


def test_matches_brute_force(spark):
    rows = [*corpus(2), (1, None), (2, ""), (3, "short 12 --"), (4, "Repeated repeated REPEATED repeated"), (4, "Repeated repeated REPEATED repeated")]
    found = run(spark, rows)
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert sum(f[1] is not None for f in found) > 20


def test_portions_do_not_split_words(spark, monkeypatch):
    rows = [(7, "anything everything étéétéété " * 3000 + "é" * 70), (8, "z" * 100)]
    whole = sorted(tuple(r) for r in word_counts(frame(spark, rows)).collect())
    parts = Counter()
    monkeypatch.setattr(spelling, "_PORTION", 11)
    for _, text in rows:
        for portion in spelling._portions(memoryview(text.encode())):
            parts.update(re.findall("[A-Za-zÀ-ÿ]{7,}", portion))
    assert sorted(parts.items()) == whole


def test_very_long_words(spark):
    """Words over the length that travels whole: one letter inserted, replaced, moved, and at the limit itself."""
    rng = random.Random(3)
    long_ = "".join(rng.choices("abcdefgh", k=5000))
    limit = "".join(rng.choices("abcdefgh", k=64))
    words = [long_, long_[:77] + "z" + long_[77:], long_[:9] + "z" + long_[10:], long_[1:] + long_[0], limit, limit + "q", limit[:-1] + "q", "a" * 9000]
    rows = [(i, " ".join([w, w])) for i, w in enumerate(words)] + [(99, " ".join([long_] * 40))]
    found = run(spark, rows)
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_chain_of_forms_leads_to_its_end(spark):
    words = ["chaining" + "x" * k for k in range(4)]
    rows = [(k, " ".join([w] * 2 * 11 ** (3 - k))) for k, w in enumerate(words)]
    roots = {r.word: r.root for r in grouped_variants(frame(spark, rows)).collect()}
    assert roots == dict.fromkeys(words, "chaining")


def test_pairs_are_listed_once(spark):
    words = ["aabbcc", "aabcc", "abbcc", "aabbc", "ababcc", "aabbccc", "aabbcd", "abbcca", "bbbbbb", "bbbbb", "bbbbbbb"]
    pairs = [tuple(r)[:2] for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if b in edits(a, "abcd"))


def test_empty_table(spark):
    assert run(spark, []) == []
