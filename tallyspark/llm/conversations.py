"""Conversation structure repair by weighted finite-state composition.

Three machines: an acceptor with a row of the conversation for each step, a transducer of edits, and an acceptor of the
role sequences that a conversation may have. They are composed lazily: what an edit of a row leads to from a state of
the role grammar is worked out when such a row first meets it, and kept. The shortest path goes through the rows in
order, which is a topological order of the composition, over weights (cost, edit labels) that compare by cost and then
by labels.

Two different paths that have used up the same rows have label strings neither of which begins the other, as each ends
with the edit of the last row. So comparing (cost, order of the earlier labels, own labels) compares the whole strings,
at most four paths stay alive after a row, and each carries the digest of its repaired rows along. A conversation of any
length streams through in order: besides the four paths only one label a row is kept, which is a part of the result.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The role grammar (s?(ua)+)?: arcs by state and role initial, and the states where a conversation may end.
ROLE_ARCS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE_ENDS = (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")
#: The edit transducer: costs of its labels, and the roles that it can write.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
WRITTEN = {"u": "user", "a": "assistant"}
#: More insertions in a row than this lead back to a role that fewer reach.
MOST_INSERTED = 2
_SPACES = " \t\n\v\f\r"
_LABELS_HELD = 4096

Step = tuple[int, int, int, str, tuple[str, ...], str]


def _inserted(state: int) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(state, roles) after each useful number of insertions."""
    reached = [(state, ())]
    for _ in range(MOST_INSERTED):
        reached += [(ROLE_ARCS[s, x], (*roles, role)) for s, roles in reached[-1:] for x, role in WRITTEN.items() if (s, x) in ROLE_ARCS]
    return iter(reached)


@functools.cache
def steps(state: int, initial: str, fault: str) -> tuple[Step, ...]:
    """Arcs of the composed machine from a state of the grammar over one row: (from, to, cost, labels, inserted roles,
    role written), for each state reached the one of least (cost, labels). An empty role written deletes the row, one of
    "=" keeps its own."""
    best: dict[int, Step] = {}
    for at, roles in _inserted(state):
        before = COSTS["I"] * len(roles)
        found = [(at, COSTS["D"], "D", "")]
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED_COST if fault == "truncated" else 0
            if (at, initial) in ROLE_ARCS:
                found.append((ROLE_ARCS[at, initial], COSTS["K"] + more, "K", "="))
            found += [(ROLE_ARCS[at, x], COSTS["R"] + more, "R", role) for x, role in WRITTEN.items() if (at, x) in ROLE_ARCS]
        for to, cost, label, role in found:
            step = (state, to, before + cost, "I" * len(roles) + label, roles, role)
            if to not in best or step[2:4] < best[to][2:4]:
                best[to] = step
    return tuple(best.values())


@functools.cache
def endings(state: int) -> tuple[int, str, tuple[str, ...]] | None:
    """(cost, labels, inserted roles) that end a conversation in this state."""
    return min(((COSTS["I"] * len(roles), "I" * len(roles), roles) for at, roles in _inserted(state) if at in ROLE_ENDS), default=None)


class _Repair:
    """The shortest path over the rows of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.before = None
        self.settled = bytearray()
        self.held = 0
        # By state of the grammar: cost, order of the labels, labels as a linked list, digest, whether nothing is written.
        self.alive = {0: (0, 0, None, hashlib.sha256(), True)}

    @staticmethod
    def _write(digest, empty: bool, roles: tuple[str, ...], role: str, own: bytes, text: bytes):
        if not roles and not role:
            return digest, empty
        digest = digest.copy()
        for line in [f"{r}:".encode() for r in roles] + ([own if role == "=" else role.encode()] if role else []):
            if not empty:
                digest.update(b"\n")
            digest.update(line)
            empty = False
        if role:
            digest.update(b":")
            digest.update(text)
        return digest, empty

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        initial = role[:1]
        if self.before is not None and self.before[1][:1] + initial not in LEGAL_PAIRS:
            self.illegal += 1
        repeated = repeated or self.before == (turn, role, text)
        self.before = (turn, role, text)
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        end = text.rstrip(_SPACES)[-1:]
        fault = "blank" if not end else "duplicate" if repeated else "" if end in ".!?" else "truncated"
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)

        best: dict[int, tuple] = {}
        for state, (cost, order, *_) in self.alive.items():
            for step in steps(state, initial if initial in ("s", "u", "a") else "", fault):
                found = (cost + step[2], order, step[3], step)
                if step[1] not in best or found[:3] < best[step[1]][:3]:
                    best[step[1]] = found
        ranked = sorted(best, key=lambda to: best[to][1:3])
        own, data = role.encode(), text.encode()
        alive = {}
        for rank, to in enumerate(ranked):
            cost, _, labels, step = best[to]
            _, _, path, digest, empty = self.alive[step[0]]
            alive[to] = (cost, rank, (path, labels), *self._write(digest, empty, step[4], step[5], own, data))
        self.alive = alive
        self.held += 1
        if self.held >= _LABELS_HELD:
            self._settle()

    @staticmethod
    def _labels(path) -> str:
        parts = []
        while path is not None:
            path, labels = path
            parts.append(labels)
        return "".join(reversed(parts))

    def _settle(self) -> None:
        """What all living paths share is settled; the rest stays as one label each."""
        texts = {state: self._labels(x[2]) for state, x in self.alive.items()}
        same = len(os.path.commonprefix(list(texts.values())))
        self.settled += next(iter(texts.values()))[:same].encode()
        self.alive = {state: (*x[:2], (None, texts[state][same:]), *x[3:]) for state, x in self.alive.items()}
        self.held = 0

    def report(self) -> tuple:
        ends = [(x[0] + end[0], x[1], end[1], state, end[2]) for state, x in self.alive.items() if (end := endings(state)) is not None]
        cost, _, labels, state, roles = min(ends)
        _, _, path, digest, empty = self.alive[state]
        digest, _ = self._write(digest, empty, roles, "", b"", b"")
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        audit = self.settled.decode() + self._labels(path) + labels
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT_TYPES = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in REPORT.split(", ")])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One report for each conversation of rows sorted by conversation and turn."""
    repair, done = None, []

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist([dict(zip(_REPORT_TYPES.names, r, strict=True)) for r in done], schema=_REPORT_TYPES)
        done.clear()
        return rows

    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "gone", "repeated")]
        for conv_id, turn, role, text, gone, repeated in zip(*columns, strict=True):
            conv_id = conv_id.as_py()
            if repair is None or repair.conv_id != conv_id:
                if repair is not None:
                    done.append(repair.report())
                repair = _Repair(conv_id)
            if not gone.as_py():
                repair.row(turn.as_py(), role.as_py(), text.as_py(), repeated.as_py())
        if done:
            yield flush()
    if repair is not None:
        done.append(repair.report())
        yield flush()


def _texts(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows as they are dealt, with nulls of role and text as one space.

    By crc32 of `conv_id:turn` (null: one space) modulo 20: 0 drops a row (it stays, marked as gone), 1 empties its text,
    2 takes the sentence ends out of it, 3 repeats it, 4 makes its role user.
    """
    kind = F.pmod(F.crc32(F.concat(_texts("conv_id"), F.lit(":"), _texts("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _texts("role").alias("role"), _texts("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with `repeated`: whether role and text come in an earlier turn too. Repeats within a turn are neighbours.

    Groups of equal rows are aggregated before they shuffle, and only those of several turns are joined back, on keys
    whose crowded partitions Spark can split.
    """
    placed = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), 256)).withColumn("place", placed)
    said = rows.where("NOT gone").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    joined = rows.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("conv_id", "turn", "role", "text", "gone", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("repeated"))


def _prepared(rows: DataFrame, gone: Column | None) -> DataFrame:
    gone = F.lit(False) if gone is None else gone
    return _marked(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _texts("role").alias("role"), _texts("text").alias("text"), gone.alias("gone")))


def conversation_reports(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """A row of faults, cheapest edits and digest for each conversation of `rows` (conv_id, turn, role, text; other
    columns are ignored). Rows for which `gone` holds are only there to name their conversation.

    Rows go by turn (null first), then role and text. A null role or text is one space, which is no legal role and a
    blank text; rows of a null conv_id are a conversation of their own. Texts and conversations may be of any length: a
    conversation streams through one task, as its digest is one hash over its rows in order, which no other way of
    dealing them out can shorten; nothing of it is held but the four living paths and its audit. An empty table gives an
    empty one.
    """
    return _ordered(_prepared(rows, gone)).mapInArrow(_reports, REPORT)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows, from sorted rows that have the audit of their conversation before them."""
    conv_id, audit, at, place, state = None, "", 0, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def write(role: str, text: str, edit: str, turn: int | None, out: list[tuple] = out) -> None:
            nonlocal place, state
            out.append((conv_id, place, turn, role, text, edit))
            place, state = place + 1, ROLE_ARCS[state, role[:1]]

        def insert() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                write(WRITTEN["a" if (state, "a") in ROLE_ARCS else "u"], "", "I", None)
                at += 1

        for row in batch.to_pylist():
            if row["audit"] is not None:
                conv_id, audit, at, place, state = row["conv_id"], row["audit"], 0, 0, 0
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit == "K":
                write(row["role"], row["text"], "K", row["turn"])
            elif edit == "R":
                write(WRITTEN["a" if (state, "a") in ROLE_ARCS else "u"], row["text"], "R", row["turn"])
            insert()
        names = ("conv_id", "place", "turn", "role", "text", "edit")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.record_batch({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})


def repaired(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the repaired conversations themselves, with the label of each row's edit.

    Inserted rows have a null turn and an empty text. Edge cases are those of conversation_reports; conversations of
    which nothing is left have no rows.
    """
    prepared = _prepared(rows, gone).where("NOT gone").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    audits = conversation_reports(rows, gone).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = prepared.unionByName(audits).withColumn("kind", F.col("audit").isNull())
    schema = "conv_id long, place long, turn long, role string, text string, edit string"
    return _ordered(both, "kind").select("conv_id", "turn", "role", "text", "audit").mapInArrow(_applied, schema)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """conversation_reports over all of `conversations`, damaged as dealt; its edge cases hold."""
    return conversation_reports(damaged(table(spark, sf_dir, "conversations")), F.col("gone"))


OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(range((length(h) / 2)::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                         lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind
  FROM (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations), crc_table),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS i,
         substr(role, 1, 1) AS initial, regexp_extract(text, '([^ \\t-\\r])[ \\t-\\r]*$', 1) AS final
  FROM rows_after),
faulty AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
grammar(g, x, g2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts AS (
  SELECT g, g AS g1, '' AS l, 0 AS c, '' AS r FROM range(4) s(g)
  UNION ALL SELECT g, g2, 'I', 5, CASE x WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || chr(10) FROM grammar WHERE x <> 's'
  UNION ALL SELECT a.g, b.g2, 'II', 10, CASE a.x WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || chr(10) || CASE b.x WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || chr(10)
  FROM grammar a JOIN grammar b ON b.g = a.g2 WHERE a.x <> 's' AND b.x <> 's'),
walk(conv_id, i, g, w) AS (
  SELECT conv_id, 0::BIGINT, 0, {'c': 0::BIGINT, 'l': '', 'r': ''} FROM counted
  UNION ALL
  SELECT f.conv_id, f.i, e.g2, min({'c': w.w.c + n.c + e.c + CASE WHEN f.fault = 'truncated' AND e.l <> 'D' THEN 5 ELSE 0 END, 'l': w.w.l || n.l || e.l,
         'r': w.w.r || n.r || CASE e.l WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE e.role || ':' || f.text || chr(10) END})
  FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts n ON n.g = w.g
  JOIN (SELECT g, x, g2, 'K' AS l, 0 AS c, '' AS role FROM grammar
        UNION ALL SELECT g, NULL, g2, 'R', 1, CASE x WHEN 'u' THEN 'user' ELSE 'assistant' END FROM grammar WHERE x <> 's'
        UNION ALL SELECT g, NULL, g, 'D', 2, '' FROM range(4) s(g)) e
    ON e.g = n.g1 AND (e.l = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.l <> 'K' OR e.x = f.initial)
  GROUP BY f.conv_id, f.i, e.g2),
best AS (
  SELECT w.conv_id, min({'c': w.w.c + n.c, 'l': w.w.l || n.l, 'r': w.w.r || n.r}) AS b
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts n ON n.g = w.g AND n.g1 IN (0, 3)
  GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.b.c, 0) AS cost, coalesce(b.b.l, '') AS audit, sha256(coalesce(b.b.r[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
