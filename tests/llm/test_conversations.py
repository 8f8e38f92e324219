import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tallyspark.llm.conversations import conversation_reports, damaged, repaired

SCHEMA = "conv_id long, turn long, role string, text string, gone string, audit string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def key(turn):
    return (turn is not None, turn or 0)


def brute(rows):
    """Every edit sequence of the rows (turn, role, text) of one conversation, with up to two insertions at a place."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (key(r[0]), r[1], r[2]))
    said, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0d]", text)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in said else "" if end[0] in ".!?" else "truncated")
        said.add((role, text))
    put = [[(5 * n, "I" * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]]
    choices = list(put)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        own = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            own += [(more, "K", [(role, text)])] + [(more + 1, "R", [(r, text)]) for r in ("user", "assistant")]
        choices += [own, put[0]]
    best = (10**9, "", [])
    for picked in itertools.product(*choices):
        cost = sum(p[0] for p in picked)
        if cost <= best[0]:
            out = [x for p in picked for x in p[2]]
            found = (cost, "".join(p[1] for p in picked), out)
            if found[:2] < best[:2] and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = found
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256("\n".join(f"{r}:{x}" for r, x in best[2]).encode()).hexdigest(),
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "no", "x") for r in rows], SCHEMA)


def reports(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "é.", "Ends. \n", "a,"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "uninvited"]
    return {c: [(rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, most))] for c in [*range(n), None]}


def test_matches_every_edit_sequence(spark):
    given = conversations(4, 70, 2) | {1000 + c: rows for c, rows in conversations(5, 6, 3).items() if c is not None}
    rows = [(c, *r) for c, own in given.items() for r in own]
    random.Random(1).shuffle(rows)
    assert reports(conversation_reports(frame(spark, rows))) == {c: brute(own) for c, own in given.items()}


def test_ordinary_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "assistant", "Hello."), (2, 3, "user", "Hi!")]
    found = reports(conversation_reports(frame(spark, rows)))
    assert found[1][:7] == (0, 0, 0, 0, 0, 0, "KKK")
    assert found[2][:7] == (2, 0, 0, 0, 0, 2, "RR")
    assert found[1][7] == hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Hello.").hexdigest()


def test_repaired_rows_have_the_digest(spark):
    rows = [(c, *r) for c, own in conversations(6, 150, 9).items() for r in own]
    df = frame(spark, rows)
    lines: dict = {}
    for r in sorted(repaired(df).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for conv_id, report in reports(conversation_reports(df)).items():
        own = lines.get(conv_id, [])
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == report[7]


def test_damage(spark):
    rows = [(c, t, "assistant", f"Text {c}. {t}!") for c in range(40) for t in [*range(6), None]] + [(None, None, None, None)]
    got = {}
    for r in damaged(frame(spark, rows)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        expected = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind == 0)
        assert got[c, t] == [expected] * (2 if kind == 3 else 1)


def test_rows_all_gone_leave_zeros(spark):
    df = frame(spark, [(5, 0, "user", "a"), (5, 1, "user", "a"), (6, 0, "user", "b.")]).withColumn("away", F.expr("conv_id = 5"))
    found = reports(conversation_reports(df, F.col("away")))
    assert found[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[6][5:7] == (2, "D")
    assert repaired(df, F.col("away")).where("conv_id = 5").count() == 0


def test_empty_table(spark):
    assert reports(conversation_reports(frame(spark, []))) == {} and repaired(frame(spark, [])).collect() == []


def test_long_conversation_and_text(spark):
    """20,000 turns of which every third is damaged, against a plain table of costs; and one text of 3 MB."""
    rng = random.Random(8)
    rows = [(t, rng.choice(["user", "assistant"]), f"{t}{rng.choice(['.', '.', ''])}") for t in range(20_000)]
    found = reports(conversation_reports(frame(spark, [(1, *r) for r in rows] + [(2, 0, "user", "w " * 1_500_000 + "."), (2, 1, "assistant", ".")])))
    cost = {0: 0}
    arcs = {(0, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    def spread(cost):
        for _ in range(2):
            for (s, _), to in arcs.items():
                if s in cost:
                    cost[to] = min(cost.get(to, 10**9), cost[s] + 5)
        return cost
    for _, role, text in rows:
        after = {}
        more = 0 if text[-1] == "." else 5
        for s, c in spread(cost).items():
            after[s] = min(after.get(s, 10**9), c + 2)
            for x in "ua":
                if (s, x) in arcs:
                    to = arcs[s, x]
                    after[to] = min(after.get(to, 10**9), c + more + (x != role[0]))
        cost = after
    cost = spread(cost)
    assert found[1][5] == min(cost[0], cost[3])
    assert sum(c in "KRD" for c in found[1][6]) == 20_000
    assert found[2][5:7] == (0, "KK")
