"""Chat formatting from an event log.

The log has one row for each event of a conversation: conv_id, seq, turn, event, role,
text. Read in the order of seq,

* message sets what the turn says (text may be a first part);
* delta appends text to it (a streamed reply);
* edit replaces it, and everything in later turns is gone;
* regenerate empties it, likewise, for deltas to fill again.

The fold needs no user code: an event counts if no edit or regeneration of an earlier turn
comes after it, and a turn says what its events from its last message, edit or
regeneration on say together. Logs are shuffled once, by conversation.

Messages are rendered in the order of turns as "<|role|>\\ntext<|end|>\\n"; "<|" inside a text
or role becomes "< |", so that no text can pose as a marker.

Defined cases: events with NULL conv_id, seq or turn, or of another kind, are ignored. A
row delivered twice counts once. Different events with one seq are applied as message,
edit, regenerate, delta, then by text, then by turn. A NULL text is empty; a turn's role is the last that was
given, "user" if none was. A turn without events that count is no message, and a
conversation without messages is not in the result; a message may be empty. Other columns
are not read. An empty log gives an empty result. A conversation is one row of the result, so it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "edit", "regenerate", "delta")


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): what every turn says in the end."""
    kind = F.coalesce(*[F.when(F.col("event") == k, i) for i, k in enumerate(KINDS)])
    ev = log.select("conv_id", "turn", F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    ev = ev.where("conv_id is not null and turn is not null and e.seq is not null and e.kind is not null").repartition("conv_id")
    nth = F.struct("e.seq", "e.kind", "e.text", "turn")
    turns = ev.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_set("e")).alias("events"), F.max(F.when(F.col("e.kind").isin(1, 2), nth)).alias("cut"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("gone", F.max("cut").over(earlier))
    turns = turns.withColumn("alive", F.when(F.col("gone").isNull(), F.col("events")).otherwise(F.filter("events", lambda e: F.struct(e.seq, e.kind, e.text, F.col("turn")) > F.col("gone")))).where(F.size("alive") > 0)
    last = F.coalesce(F.array_max(F.transform("alive", lambda e, i: F.when(e.kind < 3, i))), F.lit(0))
    said = F.slice("alive", last + 1, F.size("alive"))
    text = F.array_join(F.transform(said, lambda e: F.when(e.kind != 2, e.text).otherwise("")), "")
    roles = F.filter(F.transform("events", lambda e: e.role), lambda r: r.isNotNull())
    return turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("user")).alias("role"), text.alias("text"))


def _plain(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def render(log: DataFrame) -> DataFrame:
    """(conv_id, n_messages, chat) for every conversation."""
    one = F.struct("turn", "role", "text")
    conv = messages(log).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    parts = F.transform("m", lambda m: F.concat(F.lit("<|"), _plain(m.role), F.lit("|>\n"), _plain(m.text), F.lit("<|end|>\n")))
    return conv.select("conv_id", F.size("m").cast("bigint").alias("n_messages"), F.array_join(parts, "").alias("chat"))


def as_log(conversations: DataFrame) -> DataFrame:
    """The log that would have led to a table of messages: replies are streamed, broken off and regenerated; other messages are sent half written and edited."""
    t, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    a, b = F.substr(t, F.lit(1), half), F.substr(t, half + 1, F.length(t))
    event = lambda i, kind, text: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("event"), text.alias("text"))
    reply = F.array(event(0, "message", F.lit("")), event(1, "delta", a), event(2, "regenerate", F.lit(None).cast("string")), event(3, "delta", a), event(4, "delta", b))
    other = F.array(event(0, "message", a), event(1, "edit", t))
    rows = conversations.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "assistant", reply).otherwise(other)).alias("e"))
    return rows.select("conv_id", (F.col("turn") * 10 + F.col("e.i")).alias("seq"), "turn", "e.event", "role", "e.text")


SQL = r"""
select conv_id, count(*)::bigint as n_messages,
  string_agg('<|' || replace(coalesce(role, 'user'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), '' order by turn) as chat
from conversations where conv_id is not null and turn is not null group by conv_id
"""
