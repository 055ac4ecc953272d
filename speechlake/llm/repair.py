"""Conversations made to alternate again, by the cheapest edits, found with an auction for shortest paths."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

#: Fixed by the contract: costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the repaired text so far: nothing, or the initial of its last role. What may follow is (s?(ua)+)?
STATES = "-sua"
FOLLOWS = {0: "su", 1: "u", 2: "a", 3: "u"}
#: The only role that an edit may set after a state.
EDITED = {0: 2, 1: 2, 2: 3, 3: 2}
ROLES = {2: "user", 3: "assistant"}
#: Cost to the end of the repaired text from a state, and the inserts that it takes.
ENDS, TAILS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: No way leads on.
FAR = 1 << 60
#: Columns between origins of the auction: a path is never longer than this before it meets settled prices.
STRIDE = 32
#: Rows of a piece, as bits of a row's place.
PIECE_BITS = 12


def row_arcs(signature: str):
    """arcs(column, state) -> [(label, cost, column, state)] of edits, labels ascending.

    A row is `b` or `d` (blank or a duplicate: only Delete), or its role's initial (x: any other), a capital one
    if its text is truncated.
    """

    @lru_cache(maxsize=None)
    def of(c: str, q: int) -> tuple:
        out = [("D", DELETE, 1, q)]
        if c not in "bd":
            more = TRUNCATED if c.isupper() else 0
            if c.lower() in FOLLOWS[q]:
                out.append(("K", more, 1, STATES.index(c.lower())))
            out.append(("R", REROLE + more, 1, EDITED[q]))
        out.insert(1, ("I", INSERT, 0, EDITED[q]))
        return tuple(out)

    return lambda k, q: [(label, cost, k + step, to) for label, cost, step, to in of(signature[k], q)]


def least_of(signature: str) -> list[int]:
    """The least cost of each row, whatever its state."""
    return [DELETE if c in "bd" else TRUNCATED if c.isupper() else 0 for c in signature]


def auction(n: int, arcs, least: list[int], exits) -> list[list[int]]:
    """Prices of the lattice's n + 1 columns of four states: exact costs to the exits for column 0, where reachable.

    Prices start as the sum of the least costs ahead, so that no arc is cheaper than the fall of price along it;
    this holds throughout. From an origin the path is extended over the arc with the least cost plus price at its
    head; where that sum is above the price of the path's end, the price is raised to it and the path contracted by
    that end. A path that reaches a settled node, at first the exits, settles all its nodes. Origins go from the
    last columns to the first, so a path meets settled prices after STRIDE columns. Prices that are settled are
    exact; the others are never too high, so that arcs of every cheapest way are tight.
    """
    ahead, price = min(exits), [[0, 0, 0, 0] for _ in range(n)] + [list(exits)]
    for k in range(n - 1, -1, -1):
        ahead = min(FAR, ahead + least[k])
        price[k] = [ahead] * 4
        if exits[2] >= FAR and exits[3] >= FAR:  # turns of user and assistant go on as such
            price[k][2] = price[k][3] = FAR
    settled = {(n, q) for q in range(4)}
    for column in range((n - 1) // STRIDE * STRIDE, -1, -STRIDE):
        for origin in ((column, q) for q in range(4)):
            path = [origin]
            while path[-1] not in settled:
                k, q = path[-1]
                sums = [(cost + price[to][state], to, state) for _, cost, to, state in arcs(k, q)]
                best = min(sums, default=(FAR, n, 0))
                if price[k][q] < min(best[0], FAR):
                    price[k][q] = min(best[0], FAR)
                    if len(path) > 1:
                        path.pop()
                elif price[k][q] >= FAR:
                    settled.add(path.pop())
                    if not path:
                        break
                else:
                    path.append(best[1:])
            settled.update(path)
    return price


def trace(n: int, arcs, price: list[list[int]], q: int) -> tuple[str, int] | None:
    """The ASCII-least labels of a way of tight arcs from column 0, and the state where it ends; None: there is none."""
    if price[0][q] >= FAR:
        return None
    labels, stack, dead = [], [((0, q), None)], set()
    while stack:
        (k, q), left = stack[-1]
        if k == n:
            return "".join(labels), q
        if left is None:
            left = iter([(label, (to, state)) for label, cost, to, state in arcs(k, q) if cost + price[to][state] == price[k][q] < FAR])
            stack[-1] = ((k, q), left)
        step = next((s for s in left if s[1] not in dead), None)
        if step is None:
            dead.add((k, q))
            stack.pop()
            if labels:
                labels.pop()
        else:
            labels.append(step[0])
            stack.append((step[1], None))
    return None


@lru_cache(maxsize=4096)
def repair(signature: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    arcs, n = row_arcs(signature), len(signature)
    price = auction(n, arcs, least_of(signature), ENDS)
    labels, end = trace(n, arcs, price, 0)
    return price[0][0], labels + TAILS[end]


def piece_costs(signature: str) -> list[int]:
    """Cost from each state before a piece to each state after it, 16 numbers; FAR where no way leads."""
    out = [[FAR] * 4 for _ in range(4)]
    for end in range(4):
        price = auction(len(signature), row_arcs(signature), least_of(signature), [0 if q == end else FAR for q in range(4)])
        for q in range(4):
            out[q][end] = price[0][q]
    return sum(out, [])


def piece_exits(costs: list[list[int]]) -> tuple[int, list[list[int]]]:
    """Cost of a conversation from its pieces' costs, and each piece's prices after it: FAR for a state that no cheapest way takes."""
    n = len(costs)

    def arcs(k: int, q: int):
        return [("", costs[k][4 * q + to], k + 1, to) for to in range(4) if costs[k][4 * q + to] < FAR]

    price = auction(n, arcs, [min(c) for c in costs], ENDS)
    alive, out = [True] * 4, []
    for k in range(n - 1, -1, -1):
        out.append([price[k + 1][q] if alive[q] else FAR for q in range(4)])
        alive = [any(cost + price[to][state] == price[k][q] < FAR and alive[state] for _, cost, to, state in arcs(k, q)) for q in range(4)]
    return price[0][0], out[::-1]


def piece_ways(signature: str, exits: list[int]) -> tuple[list[str], list[int]]:
    """From each state before a piece: its ASCII-least labels towards the exits, and the state after it (-1: none)."""
    arcs, n = row_arcs(signature), len(signature)
    ways = [trace(n, arcs, auction(n, arcs, least_of(signature), exits), q) for q in range(4)]
    return [w[0] if w else "" for w in ways], [w[1] if w else -1 for w in ways]


def whole_repairs(batches):
    for pdf in batches:
        found = [repair(s) for s in pdf["signature"]]
        yield pd.DataFrame({"conv": pdf["conv"], "cost": [c for c, _ in found], "audit": [a for _, a in found]})


def costs_of_pieces(batches):
    for pdf in batches:
        yield pd.DataFrame({"conv": pdf["conv"], "piece": pdf["piece"], "costs": [piece_costs(s) for s in pdf["signature"]]})


def exits_of_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("piece")
    cost, exits = piece_exits([list(map(int, c)) for c in pdf["costs"]])
    return pd.DataFrame({"conv": pdf["conv"], "piece": pdf["piece"], "cost": cost, "exits": exits})


def ways_of_pieces(batches):
    for pdf in batches:
        found = [piece_ways(s, list(map(int, e))) for s, e in zip(pdf["signature"], pdf["exits"])]
        yield pd.DataFrame({"conv": pdf["conv"], "piece": pdf["piece"], "cost": pdf["cost"], "ways": [w for w, _ in found], "ends": [e for _, e in found]})


def joined_ways(pdf: pd.DataFrame) -> pd.DataFrame:
    state, labels = 0, []
    pdf = pdf.sort_values("piece")
    for ways, ends in zip(pdf["ways"], pdf["ends"]):
        labels.append(ways[state])
        state = int(ends[state])
    return pd.DataFrame({"conv": pdf["conv"].head(1), "cost": pdf["cost"].head(1), "audit": ["".join(labels) + TAILS[state]]})


def audits(pieces: DataFrame) -> DataFrame:
    """conv, piece, signature -> conv, cost, audit.

    A conversation of one piece is repaired at once. The pieces of a longer one are auctioned by themselves, between
    all states; a second auction over these 16 costs a piece gives the prices at their borders, and with them each
    piece traces its own part. So no task but the one that puts the audit together sees a long conversation.
    """
    many = pieces.groupBy("conv").agg(F.count("*").alias("n_pieces")).where("n_pieces > 1").select("conv")
    single = pieces.join(many, "conv", "left_anti").mapInPandas(whole_repairs, "conv string, cost long, audit string")
    parts = pieces.join(many, "conv", "left_semi")
    exits = parts.mapInPandas(costs_of_pieces, "conv string, piece long, costs array<long>").groupBy("conv").applyInPandas(exits_of_pieces, "conv string, piece long, cost long, exits array<long>")
    ways = parts.join(exits, ["conv", "piece"]).mapInPandas(ways_of_pieces, "conv string, piece long, cost long, ways array<string>, ends array<int>")
    return single.unionByName(ways.groupBy("conv").applyInPandas(joined_ways, "conv string, cost long, audit string"))


def conv_key(conv_id: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def placed(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, at: rows dealt by ranges of (conversation, turn, role, text), numbered in that order.

    A long conversation lies in many ranges. Written once, so that a task that runs again finds the same places.
    """
    rows = turns.select(conv_key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    folder = shared_folder(turns.sparkSession, "turns")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    return turns.sparkSession.read.schema("conv string, turn long, role string, text string, at long").parquet(folder)


def marked(rows: DataFrame) -> DataFrame:
    """conv, at, mark of placed rows, without their texts: the row's letter in a signature."""
    shown = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    own = F.when(shown == "", "b").when(shown.isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    narrow = rows.select("conv", "at", own.alias("mark"), digest.alias("digest"))
    # only keys that repeat come back, so that rows of unlike texts meet nothing
    seen = narrow.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = narrow.join(seen, ["conv", "digest"], "left")
    return joined.select("conv", "at", F.when((F.col("mark") != "b") & (F.col("at") > F.col("first")), "d").otherwise(F.col("mark")).alias("mark"))


def edited(batches, digest: bool):
    """For mapInArrow over rows sorted by (conv, at): a heading with the audit first, then the conversation's rows.

    Streams, holding one conversation's audit at most. With digest, a row per conversation: its gaps, its illegal
    pairs and a running hash of the repaired `role:text` lines; else each row of the repaired conversation.
    """
    conv = None
    out: list = []

    def insert():
        nonlocal state, place
        state = EDITED[state]
        emit("I", ROLES[state], "")

    def emit(edit, role, text):
        nonlocal place
        if digest:
            hashed.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        else:
            out.append((conv, place, edit, role, text))
        place += 1

    def close():
        if conv is None:
            return
        for _ in audit[edit_at:]:
            insert()
        if digest:
            gaps = high - low + 1 - distinct if distinct else 0
            out.append((conv, gaps, illegal, hashed.hexdigest()))

    def made():
        names = ["conv", "gaps", "illegal", "repaired_sha256"] if digest else ["conv", "place", "edit", "role", "text"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)
        out.clear()
        return batch

    for batch in batches:
        for c, at, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if at < 0:
                close()
                conv, audit, edit_at, state, place = c, text, 0, 0, 0
                low = high = last = before = None
                distinct = illegal = 0
                hashed = hashlib.sha256()
                continue
            if turn is not None:
                low, high = (turn if low is None else low), turn
                distinct += turn != last
                last = turn
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            while audit[edit_at] == "I":
                insert()
                edit_at += 1
            edit = audit[edit_at]
            edit_at += 1
            if edit == "K":
                state = STATES.index(role[:1])
                emit(edit, role, text)
            elif edit == "R":
                state = EDITED[state]
                emit(edit, ROLES[state], text)
            if len(out) >= 4096:
                yield made()
        if out:
            yield made()
    close()
    if out:
        yield made()


def repaired(turns: DataFrame, conversations: DataFrame, digest: bool = False) -> DataFrame:
    """Repairs conv_id, turn, role, text; `conversations` holds in conv_id all ids that the result is to have.

    Returns the rows of the repaired conversations (conv_id, place from 0, edit, role, text); with digest one row
    per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (nulls first), then role and text. A null role or text is one space; a null conv_id is a
    conversation of its own; equal rows are duplicates of the first. Conversations without rows, and so empty
    tables, have zeros, an empty audit and the hash of nothing. Other columns aren't used. Conversations of any
    length are auctioned in pieces (see `audits`); only the last pass over a conversation's texts, which hashes or
    writes them one after another, is one task's stream, as the hash demands.
    """
    rows = placed(turns)
    piece = F.shiftright("at", PIECE_BITS)
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "mark"))), lambda m: m["mark"]), "")
    folder = shared_folder(turns.sparkSession, "signatures")
    marked(rows).groupBy("conv", piece.alias("piece")).agg(letters.alias("signature")).write.parquet(folder)
    pieces = turns.sparkSession.read.schema("conv string, piece long, signature string").parquet(folder)
    found = audits(pieces)
    ids = conversations.select("conv_id", conv_key(F.col("conv_id")).alias("conv")).distinct()
    counts = pieces.groupBy("conv").agg(*(F.sum(F.length("signature") - F.length(F.translate("signature", letters, ""))).alias(name) for name, letters in (("blank", "b"), ("duplicate", "d"), ("truncated", "SUAX"))))
    heads = ids.join(found, "conv", "left").select("conv", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.coalesce("audit", F.lit("")).alias("text"))
    both = heads.unionByName(rows.select("conv", "at", "turn", "role", "text")).repartition("conv").sortWithinPartitions("conv", "at")
    schema = "conv string, gaps long, illegal long, repaired_sha256 string" if digest else "conv string, place long, edit string, role string, text string"
    done = both.mapInArrow(lambda batches: edited(batches, digest), schema)
    if not digest:
        return ids.join(done, "conv").select("conv_id", "place", "edit", "role", "text")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    whole = ids.join(done, "conv").join(counts, "conv", "left").join(found, "conv", "left")
    return whole.select("conv_id", "gaps", zero("blank"), zero("duplicate"), zero("truncated"), "illegal", zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the contract's faults, by crc32(`conv_id:turn`) % 20; a null is one space there too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), code.alias("code")).where("code <> 0")
    bad = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), bad.alias("text"), "code")
    return rows.withColumn("code", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("code")


def op11_auction_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; nulls, ties, empty tables and long conversations as in `repaired`."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damaged(table), table, digest=True)


#: Best edits by a table over rows and states; crc32 is spelt out, as that engine has none.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (
  SELECT k, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS code
  FROM (SELECT DISTINCT k FROM t)),
d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM t JOIN c USING (k) WHERE code <> 0),
r AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         lag(role[1]) OVER w || role[1] AS pair, regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS shown
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
m AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN shown NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
n AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
f AS (
  SELECT conv_id, 0::BIGINT AS i, '-' AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM n
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT m.conv_id, m.i, s.cost + a.cost AS cost, s.audit || a.edit AS audit, a.q AS q, CASE WHEN a.line IS NULL THEN s.lines ELSE list_append(s.lines, a.line) END AS lines
    FROM (SELECT conv_id, i, unnest([{'q': q, 'cost': cost, 'audit': audit, 'lines': lines},
                 {'q': CASE q WHEN 'u' THEN 'a' ELSE 'u' END, 'cost': cost + 2, 'audit': audit || 'I', 'lines': list_append(lines, CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END)},
                 {'q': CASE q WHEN 'u' THEN 'u' ELSE 'a' END, 'cost': cost + 4, 'audit': audit || 'II', 'lines': list_concat(lines, CASE q WHEN 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)}]) AS s FROM f) f
    JOIN m ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i + 1,
    LATERAL (SELECT s.q AS q, 3 AS cost, 'D' AS edit, NULL AS line
      UNION ALL SELECT role[1], (fault = 'truncated')::INT, 'K', role || ':' || text WHERE fault NOT IN ('blank', 'duplicate') AND ((s.q = '-' AND role[1] IN ('s', 'u')) OR (s.q IN ('s', 'a') AND role[1] = 'u') OR (s.q = 'u' AND role[1] = 'a'))
      UNION ALL SELECT CASE s.q WHEN 'u' THEN 'a' ELSE 'u' END, 2 + (fault = 'truncated')::INT, 'R', CASE s.q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text WHERE fault NOT IN ('blank', 'duplicate')) a)
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
e AS (
  SELECT f.conv_id, cost + CASE q WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
         list_concat(lines, CASE q WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE []::VARCHAR[] END) AS lines
  FROM f JOIN n ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.n),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON o.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
"""
