import random
import zlib

import numpy as np

from tallyspark.llm.langid import BUCKETS, UNDETERMINED, _mix, identify, infer, known_languages, trigram_counts

WORDS = {"en": "the and of to that with ing tion er was", "fr": "le la des que est eau oux ment é è", "de": "der die und sch ung keit ein ich ü ß"}


def documents(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(12, 80))), lang))
    return rows


EDGE = [(9001, None, "en"), (9002, "", "en"), (9003, " 123 !?", "fr"), (None, "the and of that the and", "en"), (9005, "x", None), (9006, "the " * 40_000, None), (9006, "the " * 40_000, None)]
SCHEMA = "doc_id long, text string, lang string, score double, mixture string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, 0.5, "m") for d, t, g in rows], SCHEMA)


def test_held_out_accuracy_and_edges(spark):
    rows = documents()
    got = identify(frame(spark, rows + EDGE)).collect()
    assert len(got) == len(rows) + len(EDGE)
    by_id = {r.doc_id: r for r in got}
    for d, t, g in rows:
        assert by_id[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert by_id[d].lang_pred == g and 0 <= by_id[d].score <= 1
    assert [by_id[i].lang_pred for i in (9001, 9002, 9003)] == [UNDETERMINED] * 3
    assert by_id[None].lang_pred == "en" and not by_id[None].held_out and by_id[9006].lang_pred == "en" and by_id[9005].lang_pred in WORDS


def test_held_out_labels_are_not_used(spark):
    rows = documents()
    flipped = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else g) for d, t, g in rows]
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    assert sorted(map(key, identify(frame(spark, rows)).collect())) == sorted(map(key, identify(frame(spark, flipped)).collect()))


def test_em_finds_the_proportions_of_a_mixture():
    rng = np.random.default_rng(2)
    model = rng.dirichlet(np.full(BUCKETS, 0.02), 3) * 0.98 + 0.02 / BUCKETS
    model = np.concatenate([model, np.full((1, BUCKETS), 1 / BUCKETS)]).astype(np.float32)
    want = np.array([0.7, 0.3, 0.0, 0.0])
    counts = rng.multinomial(4000, (want @ model) / (want @ model).sum())[None].astype(np.float32)
    share, evidence = infer(counts, model)
    assert np.abs(share[0] - want[:3]).max() < 0.04 and share[0, 2] == 0 and evidence[0] > 0
    weights, likelihood = _mix(counts, model, np.full((1, 4), 0.25))
    assert likelihood[0] >= (counts[0] * np.log(want @ model)).sum() - 2


def test_a_single_language_is_kept_alone():
    rng = np.random.default_rng(3)
    model = np.concatenate([rng.dirichlet(np.full(BUCKETS, 0.02), 3) * 0.98 + 0.02 / BUCKETS, np.full((1, BUCKETS), 1 / BUCKETS)]).astype(np.float32)
    counts = rng.multinomial(500, model[1].astype(float) / model[1].sum(dtype=float))[None].astype(np.float32)
    assert infer(counts, model)[0][0].tolist() == [0.0, 1.0, 0.0]


def test_trigrams_stay_inside_a_text():
    a, b = b"the cat", b"und so"
    both = trigram_counts(np.frombuffer(a + b, np.uint8), np.array([0, 7, 13]))
    alone = [trigram_counts(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in (a, b)]
    assert (both[0] == alone[0]).all() and (both[1] == alone[1]).all()


def test_stage_keeps_clean_rows_and_all_columns(spark):
    rows = documents()
    kept = known_languages(frame(spark, rows + EDGE))
    assert kept.columns == ["doc_id", "text", "lang", "score", "mixture"]
    got = kept.collect()
    assert {r.doc_id for r in got} >= {d for d, _, _ in rows} and not {9001, 9002, 9003} & {r.doc_id for r in got}
    assert all(r.lang for r in got)


def test_no_labels_and_no_rows(spark):
    assert {r.lang_pred for r in identify(frame(spark, [(1, "abc", None)])).collect()} == {UNDETERMINED}
    assert identify(frame(spark, [])).count() == 0


def spoken():
    """Documents of four languages, each with 120 words of its own letters."""
    rng = random.Random(4)
    names = {g: ["".join(rng.choices(a, k=rng.randint(3, 8))) for _ in range(120)] for g, a in (("de", "abcdefg"), ("en", "hijklmn"), ("es", "opqrstu"), ("fr", "vwxyzaeo"))}
    say = lambda g: " ".join(rng.choices(names[g], k=150))
    return say, [(i, say(g), g) for i, g in enumerate(list(names) * 15)], list(names)


def test_stage_keeps_mixed_and_tiny_texts_and_drops_noise(spark):
    say, rows, names = spoken()
    rng = random.Random(5)
    mixed = [(7000 + k, " ".join(say(g) for g in rng.sample(names, k)), None) for k in (2, 3, 4)] + [(7009, say("de") + " " + "".join(map(chr, rng.choices(range(0x4E00, 0x9FFF), k=400))), None)]
    tiny = [(8001, "ok", None), (8002, "a", None), (8003, "é", None)]
    noise = [(8100 + i, "".join(map(chr, rng.choices(range(0x4E00, 0x9FFF), k=n))), None) for i, n in enumerate((3, 50, 400))] + [(8110, "12 !", None)]
    got = {r.doc_id: r for r in known_languages(frame(spark, rows + mixed + tiny + noise)).collect()}
    assert set(got) == {r[0] for r in rows + mixed + tiny}
    assert all(got[d].lang in names for d, _, _ in mixed + tiny)
    whole = {r.doc_id: r for r in identify(frame(spark, rows + mixed)).collect()}
    assert len(whole[7004].mixture.split()) == 4 and whole[7004].evidence > 0


def test_long_texts_count_the_same_in_parts(monkeypatch):
    texts = [("École É " * 90 + "the cat Ü").encode(), b"", "ab é".encode() * 50]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = trigram_counts(data, offsets)
    for size in (1, 7, 64):
        monkeypatch.setattr("tallyspark.llm.langid.PART_BYTES", size)
        assert (trigram_counts(data, offsets) == whole).all()


def plain_counts(raw):
    """Trigram classes of one text, written byte by byte."""
    kinds = []
    for i, b in enumerate(raw):
        if 65 <= b <= 90:
            kind = b + 32
        elif 97 <= b <= 122 or b >= 128:
            kind = b + 32 if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E else b
        else:
            kind = 1 if b in b"\t\n\v\f\r " else 2 if 48 <= b <= 57 else 3
        kinds.append(kind)
    counts = {}
    for x, y, z in zip(kinds, kinds[1:], kinds[2:]):
        if max(x, y, z) > 3:
            h = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) % 2**32
            h = ((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 20
            counts[h] = counts.get(h, 0) + 1
    return counts


def plain_em(counts, models, members):
    """Log-likelihood and weights after many rounds of EM over `members` and the background, in plain arithmetic."""
    weights = {m: 1 / (len(members) + 1) for m in [*members, None]}
    p = lambda m, g: models[m].get(g, 0.02 / 4096) if m else 1 / 4096
    total = sum(counts.values())
    for _ in range(150):
        new = dict.fromkeys(weights, 0.0)
        for g, c in counts.items():
            mix = sum(w * p(m, g) for m, w in weights.items())
            for m, w in weights.items():
                new[m] += c * w * p(m, g) / mix / total
        weights = new
    return sum(c * np.log(sum(w * p(m, g) for m, w in weights.items())) for g, c in counts.items()), weights


def test_matches_em_over_all_sets_by_brute_force(spark):
    from itertools import combinations

    say, rows, names = spoken()
    rng = random.Random(6)
    mixed = [(7000 + i, " ".join(say(g) for g in rng.sample(names, 1 + i % 3)), None) for i in range(9)]
    totals = {g: {} for g in names}
    for d, t, g in rows:
        if zlib.crc32(str(d).encode()) % 4 != 2:
            for k, c in plain_counts(t.encode()).items():
                totals[g][k] = totals[g].get(k, 0) + c
    models = {g: {k: 0.98 * c / sum(of.values()) + 0.02 / 4096 for k, c in of.items()} for g, of in totals.items()}
    got = {r.doc_id: r for r in identify(frame(spark, rows + mixed)).collect()}
    for d, t, _ in mixed + rows[:4]:
        counts = plain_counts(t.encode())
        penalty = 0.5 * np.log(sum(counts.values()))
        value, weights = max(((lambda f: (f[0] - penalty * n, f[1]))(plain_em(counts, models, s)) for n in range(1, 5) for s in combinations(names, n)), key=lambda x: x[0])
        share = {m: w / (1 - weights[None]) for m, w in weights.items() if m}
        mixture = dict(x.split(":") for x in got[d].mixture.split())
        assert set(mixture) == set(share)
        assert all(abs(float(mixture[m]) - share[m]) < 0.02 for m in share)
        assert share[got[d].lang_pred] >= max(share.values()) - 0.01 and abs(got[d].score - share[got[d].lang_pred]) < 0.02
