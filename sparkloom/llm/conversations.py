"""Repair of conversations whose rows are missing, empty, cut off, repeated or under a wrong role.

A conversation's rows become a signature of one character a row: the initial of its role (s, u, a, other roles o), in upper
case if its text is truncated, D if it has to go (blank or a duplicate). Conversations share signatures, so each distinct one
is solved once, by memoised recursion, and its audit is joined back to all conversations that have it. The audits then go
to the rows, which are edited in order.

* ``damage``: conversations with faults put in by a checksum of their keys.
* ``inspected``: the rows of conversations in order, each with its first fault.
* ``summaries``: of each conversation its faults' counts and its signature.
* ``audited``: the summaries with the cheapest audit of their signatures and its cost.
* ``repaired``: the repaired rows; ``digests``: a hash of each repaired conversation.

Rows are shuffled by conversation and sorted there, and tasks pass over them row by row: of a conversation no task holds
more than the signature, the audit and a batch, however many rows it has. Signatures that many conversations share are
joined by broadcast, so that they fill no task.

Defined results: a null role or text is one space. Rows go by turn, nulls first, then role, text (by bytes) and copy, so ties
have one order and equal rows stand next to each other. Repeated rows are duplicates. Rows without a conv_id form one
conversation of their own. A conversation without rows has no faults, cost 0, an empty audit and the hash of an empty
text. Other columns are not looked at. An empty table gives no rows. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.llm.arrow import bounded, pieces
from sparkloom.storage import materialize

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, UNFINISHED = 2, 5, 5
#: Signatures of at most so many characters that more than one in SHARE conversations have (at most SHARE of them) are
#: joined by broadcast: no more than 8 MB.
SHARE, BROADCAST_LENGTH = 1000, 4096
#: How deep the recursion goes before earlier results are taken from the memo.
DEPTH = 400
#: What may follow: nothing yet, a system row, a user row, an assistant row. Of each: what a kept row's initial, a rewritten
#: row and an inserted row lead to. A conversation ends before its first row or after an assistant row.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ENDS = (True, False, False, True)
#: More than any cost that counts.
NEVER = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows dropped, emptied, cut, repeated or given to the user by crc32('conv_id:turn') % 20."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def inspected(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copy) with pos (place in the conversation from 1 on), sign (the row's character of
    the signature), illegal (its role may not follow the one before) and fresh (the first row with its turn). Sorted by
    conversation and place in each partition, all rows of a conversation in one."""
    dealt = rows.repartition("conv_id")
    # one shuffle: the windows below only sort, as their keys begin with the conversation
    alike = Window.partitionBy("conv_id", "_h", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "copy")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    before = F.lag(initial).over(order)
    counted = dealt.withColumn("_h", F.xxhash64("role", "text")).withColumn("_again", F.row_number().over(alike) > 1)
    return counted.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.row_number().over(order).cast("long").alias("pos"),
        F.when(bare == "", "b").when(F.col("_again"), "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.upper(kind)).otherwise(kind).alias("sign"),
        F.coalesce(~F.concat(before, initial).isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.lag("turn").over(order), F.lit(False))).alias("fresh"),
    )


def summaries(rows: DataFrame) -> DataFrame:
    """Of each conversation of inspected(): gaps, blank, duplicate, truncated, illegal, signature."""
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign, low, high, fresh, illegal = None, bytearray(), None, None, 0, 0
        done: list[tuple] = []

        def close() -> None:
            s = sign.decode()
            gaps = high - low + 1 - fresh if fresh else 0
            done.append((at, gaps, s.count("b"), s.count("d"), sum(map(s.count, "SUAO")), illegal, s.replace("b", "D").replace("d", "D")))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [kind, *[pa.int64()] * 5, pa.string()], strict=True)], names=names)
            done.clear()
            return made

        for batch in pieces(batches, 4096):
            for conv, turn, pos, mark, wrong, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos == 1:
                    if sign:
                        close()
                    at, sign, low, high, fresh, illegal = conv, bytearray(), turn, turn, 0, 0
                sign += mark.encode()
                illegal += wrong
                if turn is not None:  # in order, nulls first
                    low, high, fresh = turn if low is None else low, turn, fresh + first
            if done:
                yield out()
        if sign:
            close()
            yield out()

    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    return rows.select("conv_id", "turn", "pos", "sign", "illegal", "fresh").mapInArrow(run, schema)


def solve(signature: str) -> tuple[int, str]:
    """The cheapest edits that make a signature's roles (s?(ua)+)?, the ASCII-least of equally cheap ones: their cost and their
    initials in order."""
    n = len(signature)
    memo = [array("q", [-1]) * (n + 1) for _ in ENDS]

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """The edits there are, ASCII-least first: initial, cost, next row, next state."""
        c = signature[i] if i < n else ""
        if c:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, NEXT[state]
        if c and c != "D":
            left = UNFINISHED * c.isupper()
            if c.lower() in KEEP[state]:
                yield "K", left, i + 1, KEEP[state][c.lower()]
            yield "R", 1 + left, i + 1, NEXT[state]

    def cost(i: int, state: int, inserted: int = 0) -> int:
        """Of the rest from row i on; after three inserted rows another can't be cheaper than none of them."""
        found = memo[state][i]
        if found >= 0:
            return found
        best = 0 if i == n and ENDS[state] else NEVER
        for edit, price, j, following in moves(i, state):
            if edit != "I":
                best = min(best, price + cost(j, following))
            elif inserted < 3:
                best = min(best, price + cost(i, following, inserted + 1))
        if not inserted:  # what was found after inserted rows may have been cut off
            memo[state][i] = best
        return best

    for i in range(n, -1, -DEPTH):  # so that no recursion goes deeper
        for state in range(len(ENDS)):
            cost(i, state)
    i, state, audit = 0, 0, []
    total = left = cost(0, 0)
    while not (i == n and ENDS[state] and left == 0):
        edit, price, i, state = next(m for m in moves(i, state) if m[1] + cost(m[2], m[3]) == left)
        left -= price
        audit.append(edit)
    return total, "".join(audit)


def audited(found: DataFrame) -> DataFrame:
    """The summaries (a table) with cost and audit. Each distinct signature is solved once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            costs, audits = zip(*map(solve, batch.column(0).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "convs", "cost", "audit"])

    solved = materialize(found.groupBy("signature").agg(F.count("*").alias("convs")).mapInArrow(run, "signature string, convs long, cost long, audit string"), "audits")
    total = solved.agg(F.sum("convs")).first()[0] or 0
    frequent = (F.col("convs") * SHARE > total) & (F.length("signature") <= BROADCAST_LENGTH)
    shared, others = F.broadcast(solved.filter(frequent).drop("convs")), solved.filter(~frequent).drop("convs")
    return found.join(shared, "signature").unionByName(found.join(F.broadcast(shared.select("signature")), "signature", "left_anti").join(others, "signature"))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired rows of inspected() rows by the audits of their conversations: conv_id, place (from 1 on), role, text, edit.
    Sorted by conversation and place in each partition, all rows of a conversation in one."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    given = rows.select("conv_id", "pos", "role", "text").unionByName(audits.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text")))
    ordered = given.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    out = f"conv_id {conv}, place long, role string, text string, edit string"
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, k, place, state, fresh = None, "", 0, 0, 0, True

        for batch in pieces(batches):
            made: list[tuple] = []

            def inserted() -> None:
                nonlocal k, place, state
                while k < len(audit) and audit[k] == "I":
                    state = NEXT[state]
                    k, place = k + 1, place + 1
                    made.append((conv, place, "user" if state == 2 else "assistant", "", "I"))

            for own, pos, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos == 0:  # the audit comes first
                    conv, audit, k, place, state, fresh = own, text, 0, 0, 0, False
                    inserted()
                    continue
                if fresh or conv != own:
                    raise ValueError(f"no audit for conversation {own}")
                edit = audit[k]
                k += 1
                if edit != "D":
                    state = KEEP[state][role[:1]] if edit == "K" else NEXT[state]
                    place += 1
                    made.append((own, place, role if edit == "K" else "user" if state == 2 else "assistant", text, edit))
                inserted()  # those before the next row
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [kind, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    return bounded(ordered).mapInArrow(run, out)


def digests(rows: DataFrame) -> DataFrame:
    """Of each conversation of repaired(): repaired_sha256, of its rows as role:text, joined by newlines."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed = None, None
        for batch in pieces(batches):
            done = []
            for own, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 1:
                    if hashed:
                        done.append((conv, hashed.hexdigest()))
                    conv, hashed = own, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hashed.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, schema)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them: of each conv_id of the table gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    rows = inspected(damage(conversations))
    audits = materialize(audited(materialize(summaries(rows), "conversations")), "audits")
    done = digests(repaired(rows, audits))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(audits, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    return found.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


#: The same rows. The checksum and the cheapest edits are worked out row by row: of each state (before the first row, after a
#: system, user or assistant row) the least (cost, audit) is carried along, with up to two rows inserted before each row.
SQL = r"""
WITH RECURSIVE
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
checked AS (SELECT * EXCLUDE (place), xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(place, '')]),
                   lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, o: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM given),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM checked WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
                   substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ordered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
never AS (SELECT {'cost': 1000000000000, 'audit': ''} AS x),
steps AS (
  SELECT conv_id, 0::BIGINT AS pos, {'cost': 0::BIGINT, 'audit': ''} AS s0, {'cost': 1000000000000::BIGINT, 'audit': ''} AS s1,
         {'cost': 1000000000000::BIGINT, 'audit': ''} AS s2, {'cost': 1000000000000::BIGINT, 'audit': ''} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, pos,
         {'cost': i0.cost + 2, 'audit': i0.audit || 'D'},
         least({'cost': i1.cost + 2, 'audit': i1.audit || 'D'}, CASE WHEN stays AND initial = 's' THEN {'cost': i0.cost + late, 'audit': i0.audit || 'K'} ELSE x END),
         least({'cost': i2.cost + 2, 'audit': i2.audit || 'D'},
               CASE WHEN stays AND initial = 'u' THEN least({'cost': i0.cost + late, 'audit': i0.audit || 'K'}, {'cost': i1.cost + late, 'audit': i1.audit || 'K'}, {'cost': i3.cost + late, 'audit': i3.audit || 'K'}) ELSE x END,
               CASE WHEN stays THEN least({'cost': i0.cost + late + 1, 'audit': i0.audit || 'R'}, {'cost': i1.cost + late + 1, 'audit': i1.audit || 'R'}, {'cost': i3.cost + late + 1, 'audit': i3.audit || 'R'}) ELSE x END),
         least({'cost': i3.cost + 2, 'audit': i3.audit || 'D'}, CASE WHEN stays AND initial = 'a' THEN {'cost': i2.cost + late, 'audit': i2.audit || 'K'} ELSE x END,
               CASE WHEN stays THEN {'cost': i2.cost + late + 1, 'audit': i2.audit || 'R'} ELSE x END)
  FROM (SELECT s.conv_id, f.pos, f.initial, f.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS late, x, s0 AS i0, s1 AS i1,
               least(s2, {'cost': s0.cost + 5, 'audit': s0.audit || 'I'}, {'cost': s1.cost + 5, 'audit': s1.audit || 'I'}, {'cost': s3.cost + 5, 'audit': s3.audit || 'I'}) AS i2,
               least(s3, {'cost': s2.cost + 5, 'audit': s2.audit || 'I'}, {'cost': s0.cost + 10, 'audit': s0.audit || 'II'}, {'cost': s1.cost + 10, 'audit': s1.audit || 'II'}) AS i3
        FROM steps s JOIN faults f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = s.pos + 1, never)),
solved AS (SELECT s.conv_id, least(s0, s3, {'cost': s2.cost + 5, 'audit': s2.audit || 'I'}, {'cost': s1.cost + 10, 'audit': s1.audit || 'II'}) AS best
           FROM steps s JOIN counts c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.pos = c.n),
edits AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS k FROM solved WHERE best.audit <> ''),
placed AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS pos, sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY k) AS place FROM edits),
made AS (SELECT p.conv_id, p.k, p.edit, p.place, f.role, CASE WHEN p.edit = 'I' THEN '' ELSE f.text END AS text,
                max(CASE WHEN p.edit = 'K' AND p.place = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
         FROM placed p LEFT JOIN faults f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.pos = f.pos AND p.edit <> 'I'),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS repaired FROM made WHERE edit <> 'D' GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(s.best.cost, 0)::BIGINT AS cost, coalesce(s.best.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN texts t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
"""
