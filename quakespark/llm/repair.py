"""Conversation structure repair with a graph-structured stack over the grammar of roles.

The grammar is ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of a user's and an assistant's turn. Its
LR automaton has four stack tops: ``start``; ``system``; ``open``, a user's turn that waits for its answer; and
``closed``, a pair that was reduced. A conversation's rows are read once, in order. Before each row turns may be
inserted, then the row is kept, given another role, or deleted. All stacks that come to the same top at the same row
are merged: the one of least cost stays, of equal ones that with the least string of edits. A top holds its cost, its
place among the audits of the tops, a running SHA-256 of the repaired text, and one byte a row to trace its edits
back: memory is four bytes a row and a digest for each different text, never the texts themselves.

No audit is a prefix of another one at the same row, since every audit ends with the row's own letter; so the order of
two audits is settled when they part, and the place of the shorter ones decides for all that is added.

Rows are dealt by conversation and sorted there; a conversation is read as a stream in one task, since a SHA-256 of its
whole text has no other way. A conversation that holds most rows is thus one task's stream, but never in memory.

Defined results: rows go by turn (null first), then role, then text; null roles and texts count as one space, and so
does a null in the hashed key; rows of null ``conv_id`` are one conversation; repeated rows are repeated turns; turns may repeat;
an empty role has no initial; an empty table gives an empty result; columns beyond conv_id, turn, role and text
aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakespark.llm.ordered import running
from quakespark.session import materialise

#: Characters that don't make a row non-blank.
BLANKS = " \t\n\x0b\x0c\r"
RUN = 2048
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5

START, SYSTEM, OPEN, CLOSED = range(4)
#: The automaton: the top after a turn of this role initial is shifted, and reduced where it ends a pair.
SHIFT = {(START, "s"): SYSTEM, (START, "u"): OPEN, (SYSTEM, "u"): OPEN, (OPEN, "a"): CLOSED, (CLOSED, "u"): OPEN}
ACCEPT = (START, CLOSED)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows damaged by crc32(conv_id:turn) % 20.

    0 drops a row (it stays, marked as ``gone``, so that its conversation is known), 1 empties its text, 2 takes away its
    ``[.!?]``, 3 repeats it, 4 makes it a user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def facts(rows: DataFrame) -> DataFrame:
    """The rows with ``blank`` and ``cut``: no character beyond blanks, and the last one isn't of ``[.!?]``."""
    shown = F.rtrim("text", F.lit(BLANKS))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    return rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"),
        F.coalesce(shown == "", F.lit(True)).alias("blank"), F.coalesce(~F.right(shown, F.lit(1)).isin(".", "!", "?"), F.lit(True)).alias("cut"),
    )


def insertions() -> dict[int, list[tuple[int, str]]]:
    """From each top, the tops that inserted turns lead to, with the roles inserted; by fewest turns."""
    out = {}
    for top in (START, SYSTEM, OPEN, CLOSED):
        reached, new = {top: ""}, [top]
        while new:
            old, new = new, []
            for at in old:
                for role in NAMES:
                    to = SHIFT.get((at, role))
                    if to is not None and to not in reached:
                        reached[to] = reached[at] + role
                        new.append(to)
        out[top] = list(reached.items())
    return out


INSERTIONS = insertions()


def actions(initial: str, forced: bool, cut: bool) -> list[list[tuple[int, str, str, int, str | None]]]:
    """Of each top: (next top, edits, roles inserted before, cost, role of the row or None if it is deleted)."""
    out = []
    for top in (START, SYSTEM, OPEN, CLOSED):
        own = []
        for at, put in INSERTIONS[top]:
            base, letters, kept = COSTS["I"] * len(put), "I" * len(put), TRUNCATED_COST * cut
            own.append((at, letters + "D", put, base + COSTS["D"], None))
            if not forced:
                if (at, initial) in SHIFT:
                    own.append((SHIFT[at, initial], letters + "K", put, base + COSTS["K"] + kept, ""))
                own += [(SHIFT[at, r], letters + "R", put, base + COSTS["R"] + kept, NAMES[r]) for r in NAMES if (at, r) in SHIFT]
        out.append(own)
    return out


class Repair:
    """One conversation's graph-structured stack and its counts."""

    tables: dict[tuple[str, bool, bool], list] = {}
    edits: list[tuple[int, str, str]] = []  # (top before, edits, roles of what was put out), by the byte that stands for it
    codes: dict[tuple[int, str, str], int] = {}

    def __init__(self):
        self.tops = {START: (0, 0, hashlib.sha256())}  # top: (cost, place among audits, digest)
        self.trace = bytearray()
        self.seen: set[bytes] = set()
        self.turns: set[int] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def read(self, turn: int | None, role: str, text: str, blank: bool, cut: bool) -> None:
        if turn is not None:
            self.turns.add(turn)
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        line = f"{role}:{text}".encode(errors="surrogatepass")
        mark = hashlib.blake2b(len(role).to_bytes(8, "little") + line, digest_size=16).digest()
        again, cut = mark in self.seen and not blank, cut and not blank
        self.seen.add(mark)
        cut = cut and not again
        self.blank += blank
        self.duplicate += again
        self.truncated += cut
        key = (initial if initial in "sua" else "", blank or again, cut)
        table = self.tables.get(key)
        if table is None:
            table = self.tables[key] = actions(*key)
        best: dict[int, tuple] = {}
        for top, (cost, place, _) in self.tops.items():
            for to, letters, put, price, own in table[top]:
                offer = (cost + price, place, letters, top, put, own)
                if to not in best or offer[:3] < best[to][:3]:
                    best[to] = offer
        tops, codes = {}, [0] * 4
        body = text.encode(errors="surrogatepass")
        order = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        for to, (cost, _, letters, top, put, own) in best.items():
            digest = self.tops[top][2].copy()
            fresh = top == START
            for r in put:
                digest.update(f"{'' if fresh else chr(10)}{NAMES[r]}:".encode())
                fresh = False
            if own is not None:
                digest.update(b"" if fresh else b"\n")
                if own:
                    digest.update(own.encode() + b":")
                    digest.update(body)
                else:
                    digest.update(line)
            tops[to] = (cost, order[to], digest)
            edit = (top, letters, put + ("" if own is None else own[:1] or initial))
            code = self.codes.get(edit)
            if code is None:
                code = self.codes[edit] = len(self.edits)
                self.edits.append(edit)
            codes[to] = code
        self.trace += bytes(codes)
        self.tops = tops

    def ended(self) -> tuple[int, str, str, str]:
        """Cost, audit, role initials and digest of the cheapest repair."""
        offers = []
        for top, (cost, place, digest) in self.tops.items():
            for to, put in INSERTIONS[top]:
                if to in ACCEPT:
                    digest_to = digest.copy()
                    for n, r in enumerate(put):
                        digest_to.update(f"{'' if top == START and n == 0 else chr(10)}{NAMES[r]}:".encode())
                    offers.append((cost + COSTS["I"] * len(put), place, "I" * len(put), top, put, digest_to))
        cost, _, letters, top, roles, digest = min(offers, key=lambda x: x[:3])
        parts, shown = [letters], [roles]
        for i in range(len(self.trace) - 4, -1, -4):
            top, letters, roles = self.edits[self.trace[i + top]]
            parts.append(letters)
            shown.append(roles)
        return cost, "".join(reversed(parts)), "".join(reversed(shown)), digest.hexdigest()

    def result(self) -> tuple:
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        cost, audit, roles, digest = self.ended()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest, roles


LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
STRINGS = ("audit", "repaired_sha256", "repaired_roles")


def repair_report(rows: DataFrame) -> DataFrame:
    """Of every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired_roles.

    rows: conv_id, turn, role, text and, optionally, gone, which only says that the conversation exists.
    """
    id_field = rows.schema["conv_id"]
    schema = T.StructType(
        [T.StructField("conv_id", id_field.dataType)] + [T.StructField(c, T.LongType()) for c in LONGS] + [T.StructField(c, T.StringType()) for c in STRINGS]
    )
    known = facts(rows)
    dealt = known.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "gone")

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, repair, kind = [], None, None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            types = [kind] + [pa.int64()] * len(LONGS) + [pa.string()] * len(STRINGS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, turn, role, text, gone, blank, cut in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "blank", "cut")), strict=True):
                if repair is None or conv != current:
                    if repair is not None:
                        held.append((current, *repair.result()))
                        if len(held) >= RUN:
                            yield batch()
                            held = []
                    current, repair = conv, Repair()
                if not gone:
                    repair.read(turn, role, text, blank, cut)
        if repair is not None:
            held.append((current, *repair.result()))
        if held:
            yield batch()

    return dealt.mapInArrow(streamed, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I).

    Audits are opened to a row for each edit, and joined with the numbered rows by conversation and row: no
    conversation meets in one task.
    """
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    known = facts(rows).where("not gone").select(key.alias("key"), "turn", "role", "text")
    numbered = running(materialise(known, "turns"), ["key"], [F.col("turn"), F.col("role"), F.col("text")], {"row": F.lit(1)})
    report = repair_report(rows).select("conv_id", key.alias("key"), "audit", "repaired_roles")
    edits = materialise(report.where("audit <> ''").select("conv_id", "key", "repaired_roles", F.posexplode(F.split("audit", "")).alias("step", "edit")).where("edit <> ''"), "edits")
    one = lambda on: F.when(on, 1).otherwise(0)
    steps = running(edits, ["key"], [F.col("step")], {"row": one(F.col("edit") != "I"), "place": one(F.col("edit") != "D")}).where("edit <> 'D'")
    own = lambda c: numbered[c]
    joined = steps.join(numbered, (steps["key"] == own("key")) & (steps["row"] == own("row")) & (steps["edit"] != "I"), "left")
    initial: Column = F.substring(steps["repaired_roles"], steps["place"].cast("int") + 1, F.lit(1))
    named = F.when(steps["edit"] == "K", own("role")).when(initial == "u", NAMES["u"]).otherwise(NAMES["a"])
    return joined.select(steps["conv_id"], steps["place"], named.alias("role"), F.coalesce(own("text"), F.lit("")).alias("text"), steps["edit"])


def _oracle() -> str:
    """SQL for op11: whole stacks of strings, one row for each top, moved on by one row of every conversation at a time."""
    values = lambda rows: "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    inserted = values([(p, q, "I" * len(put), "".join("~" + NAMES[r] + ":" for r in put)) for p, own in INSERTIONS.items() for q, put in own])
    shifted = values([(p, x, q) for (p, x), q in SHIFT.items()])
    blanks = r"[\x20\x09-\x0D]"
    ascii_sum = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"
    return f"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, xor({ascii_sum}, 4294967295) % 20 AS kind FROM h), (VALUES (0), (1)) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, left(role, 1) AS x, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?]{blanks}*$') OR NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT *, blank OR again AS forced, CASE WHEN cut AND NOT blank AND NOT again THEN {TRUNCATED_COST} ELSE 0 END AS fee FROM f),
ins(p, q, l, put) AS ({inserted}), sh(p, x, q) AS ({shifted}),
act AS (SELECT ins.p, ins.q, l || 'D' AS l, put, {COSTS['I']} * length(l) + {COSTS['D']} AS price, 'D' AS kind, '' AS x FROM ins
  UNION ALL SELECT ins.p, sh.q, l || 'K', put, {COSTS['I']} * length(l) + {COSTS['K']}, 'K', sh.x FROM ins JOIN sh ON sh.p = ins.q
  UNION ALL SELECT ins.p, sh.q, l || 'R', put, {COSTS['I']} * length(l) + {COSTS['R']}, 'R', sh.x FROM ins JOIN sh ON sh.p = ins.q AND sh.x <> 's'),
r AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {START} AS top, 0 AS cost, '' AS audit, '' AS shown FROM h
  UNION ALL
  SELECT conv_id, i, top, cost, audit, shown FROM (
    SELECT r.conv_id, g.i, act.q AS top, r.cost + price + CASE act.kind WHEN 'D' THEN 0 ELSE fee END AS cost, r.audit || l AS audit,
      r.shown || replace(put, '~', chr(10)) || CASE act.kind WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE act.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text END AS shown,
      row_number() OVER (PARTITION BY r.conv_id, act.q ORDER BY r.cost + price + CASE act.kind WHEN 'D' THEN 0 ELSE fee END, r.audit || l) AS k
    FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1 JOIN act ON act.p = r.top AND (act.kind = 'D' OR NOT forced AND (act.kind = 'R' OR act.x = g.x))) WHERE k = 1),
e AS (SELECT r.conv_id, r.cost + {COSTS['I']} * length(l) AS cost, audit || l AS audit, shown || replace(put, '~', chr(10)) AS shown FROM r JOIN ins ON ins.p = r.top AND ins.q IN {ACCEPT}
  WHERE r.i = (SELECT count(*) FROM g WHERE g.conv_id IS NOT DISTINCT FROM r.conv_id)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS k FROM e) WHERE k = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE fee > 0) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN {LEGAL}) AS illegal FROM g GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.cost::BIGINT AS cost, b.audit, sha256(substr(shown, 2)) AS repaired_sha256 FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE = _oracle()
