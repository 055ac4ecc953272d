"""Conversations rebuilt from an event log and rendered for training."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and all control strings that a text may not contain unescaped.

    A turn is role_open, role, role_close, text, end. Every control string starts with one of its own first
    characters, none of which occurs again in its rest; `escape` puts a backslash after that character, before
    any that stand there already, and `unescape` takes one away. So texts come back exactly.
    """

    begin: str = "<s>"
    role_open: str = "[INST]"
    role_close: str = "[/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)

    def pattern(self, least: str) -> str:
        controls = (self.begin, self.role_open, self.role_close, self.end)
        firsts = "".join(sorted({re.escape(c[0]) for c in controls}))
        return rf"([{firsts}]){least}(\\*)({'|'.join(re.escape(c[1:]) for c in controls)})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(""), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(r"\\"), "$1$2$3")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> an event log: each row opens a message and streams its text as one delta.

    Rows that share conv_id and turn are messages of their own, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    two = F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("text")), F.struct(F.lit("delta").alias("kind"), F.coalesce("text", F.lit("")).alias("text")))
    return numbered.select("conv_id", "message", "role", F.posexplode(two).alias("part", "event")).select("conv_id", "message", (F.col("message") * 2 + F.col("part")).alias("seq"), "event.kind", "role", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, seq, kind, role, text -> conv_id, turns array<struct<role, text>>, the final messages.

    Kinds: `open` starts a message (its role counts), `delta` appends its text, `edit` replaces all text so
    far, `regenerate` drops the text so far and every later message that was begun before it, `delete` drops
    the message. Events are taken by seq, ties by kind and text; null seq comes first, null text is empty, and
    unknown kinds do nothing. A message's events become one row before a conversation's messages meet. A
    message that has only been deleted or dropped is gone; an opened one without text stays, empty.
    """
    text = F.coalesce("text", F.lit(""))
    event = F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "kind", text.alias("text"))
    each = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"), F.min_by("role", "seq").alias("role"), F.min("seq").alias("began"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"))
    resets = F.filter(F.col("log"), lambda e: e["kind"].isin("edit", "regenerate", "delete", "open"))
    last = F.coalesce(F.try_element_at(resets, F.lit(-1)), F.struct(F.lit(-2).cast("long").alias("seq"), F.lit("open").alias("kind"), F.lit("").alias("text")))
    each = each.withColumn("last", last)
    after = F.filter(F.col("log"), lambda e: (e["kind"] == "delta") & (e["seq"] >= F.col("last.seq")))
    folded = each.select("conv_id", "message", "role", "began", "redone", (F.col("last.kind") == "delete").alias("gone"), F.concat(F.col("last.text"), F.array_join(F.transform(after, lambda e: e["text"]), "")).alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    valid = folded.withColumn("cut", F.max("redone").over(earlier)).where("not gone and (cut is null or began >= cut)")
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), "text")
    return valid.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns -> conv_id, formatted, loss_spans array<struct<turn, start, length>>.

    loss_spans mark, per turn of a loss role, the code points of its (escaped) text, counted from the start of
    the turn (the text between two end marks).
    """
    t = template
    parts = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), t.escape(x["role"]).alias("head"), t.escape(x["text"]).alias("body")))
    made = conversations.select("conv_id", parts.alias("parts"))
    body = F.array_join(F.transform("parts", lambda x: F.concat(F.lit(t.role_open), x["head"], F.lit(t.role_close), x["body"], F.lit(t.end))), "")
    spans = F.transform("parts", lambda x, i: F.when(x["role"].isin(*t.loss_roles), F.struct(i.alias("turn"), (F.length(x["head"]) + len(t.role_open) + len(t.role_close)).alias("start"), F.length(x["body"]).alias("length"))))
    return made.select("conv_id", F.concat(F.lit(t.begin), body).alias("formatted"), F.array_compact(spans).alias("loss_spans"))


def read_back(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text: what the formatted strings and masks say."""
    t = template
    inner = F.substr(F.col("formatted"), F.lit(len(t.begin) + 1))
    pieces = F.split(inner, re.escape(t.end), -1)
    rows = rendered.select("conv_id", "loss_spans", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))
    cut = F.transform("pieces", lambda p: F.struct(p.alias("piece"), F.instr(p, t.role_close).alias("at")))
    opened, closed = len(t.role_open), len(t.role_close)
    turns = F.transform(cut, lambda x: F.struct(t.unescape(F.substr(x["piece"], F.lit(opened + 1), x["at"] - opened - 1)).alias("role"), t.unescape(F.substr(x["piece"], x["at"] + closed)).alias("text")))
    # the mask is read through lambda variables only, so the pieces are split once
    masked = F.array_join(F.transform(F.arrays_zip(F.transform("loss_spans", lambda s: F.element_at(F.col("pieces"), s["turn"] + 1)).alias("piece"), F.col("loss_spans").alias("span")), lambda z: t.unescape(F.substr(z["piece"], z["span"]["start"] + 1, z["span"]["length"]))), "")
    return rows.select("conv_id", turns.alias("turns"), masked.alias("loss_text"))


#: The conversation that the contract adds.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_event_fold(spark, sf_dir: str) -> DataFrame:
    """All conversations and the contract's own, logged, folded, rendered and read back; null texts are empty."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = table.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    return digest(render(fold(events_of_turns(turns))))


def digest(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """The contract's columns, read back from the formatted strings."""
    back = read_back(rendered.withColumn("conv_id", F.struct("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))), template)
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id.conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "conv_id.formatted_chars",
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(s>|INST\]|/INST\]|/s>)', '\1\\\2\3', 'g') AS erole,
         regexp_replace(text, '([<\[])(\\*)(s>|INST\]|/INST\]|/s>)', '\1\\\2\3', 'g') AS etext FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(6 + length(erole) + 7 + length(etext) + 4))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
