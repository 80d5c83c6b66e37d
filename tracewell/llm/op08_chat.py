"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation is written once, turn after turn, as `<turn>` role, a line break, text, `</turn>` and a line break. Roles and
texts are escaped so that no `<` of theirs remains: `\\` becomes `\\s`, `<` becomes `\\l` (and a line break in a role `\\n`);
plain replacement undoes it. Every assistant turn is then exploded into an example of its own: the conversation up to the
end of that turn, where only the reply's text is trainable.

Results: turns are ordered by turn (null first), role and text as they are before escaping, so ties and repeated rows have a
fixed order and all stay; a null text or role is the empty one; a null conv_id is a conversation; a conversation without an assistant turn has a
formatted text and no example; an empty table gives no rows. Columns of the input besides the four are ignored. A
conversation's text must fit into one row (2 GB), as its examples do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import _shared

OPEN, CLOSE, TARGET = "<turn>", "</turn>\n", "assistant"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def role_out(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\n"))


def role_in(c: Column) -> Column:
    return unescaped(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_conversations(df: DataFrame, target: str = TARGET) -> DataFrame:
    """conv_id, formatted string, targets array<struct<loss_start, loss_end, end>>: offsets in code points from 0.

    A target's text is formatted[loss_start:loss_end], its example formatted[0:end].
    """
    raw = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    ordered = raw.select("conv_id", F.transform("turns", lambda t: F.struct(role_out(t.role).alias("role"), escaped(t.text).alias("text"))).alias("turns"))
    written = ordered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t.role, F.lit("\n"), t.text, F.lit(CLOSE))), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct((t.role == target).alias("hit"), F.length(t.role).alias("role"), F.length(t.text).alias("text"))).alias("turns"),
    )
    fixed = len(OPEN) + 1 + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<loss_start:int,loss_end:int,end:int>>)").alias("out"))

    def step(acc, t):
        begin = acc.at + len(OPEN) + 1 + t.role
        stop = acc.at + fixed + t.role + t.text
        span = F.struct(begin.cast("int").alias("loss_start"), (begin + t.text).cast("int").alias("loss_end"), stop.cast("int").alias("end"))
        return F.struct(stop.cast("int").alias("at"), F.when(t.hit, F.array_append(acc.out, span)).otherwise(acc.out).alias("out"))

    return written.select("conv_id", "formatted", F.aggregate("turns", start, step).out.alias("targets"))


def expand_examples(formatted: DataFrame, keep_all: bool = False) -> DataFrame:
    """One row for each assistant turn: conv_id, example (from 0), text (context and reply), loss_start, loss_end.

    With keep_all, conversations without an assistant turn have a row too, with nulls, and the first row of each
    conversation carries it whole as formatted.
    """
    explode = F.posexplode_outer if keep_all else F.posexplode
    rows = formatted.select("conv_id", "formatted", explode("targets").alias("example", "t"))
    whole = [F.when(F.coalesce("example", F.lit(0)) == 0, F.col("formatted")).alias("formatted")] if keep_all else []
    return rows.select("conv_id", *whole, "example", F.substr("formatted", F.lit(1), F.col("t.end")).alias("text"), "t.loss_start", "t.loss_end")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(body, lambda b: F.struct(
        role_in(F.substring_index(b, "\n", 1)).alias("role"), unescaped(F.substr(b, F.instr(b, "\n") + 1)).alias("text")))


def digests(df: DataFrame) -> DataFrame:
    """Read back from the output: turns from the formatted conversations, losses from the exploded examples."""
    formatted = format_conversations(df)
    examples = expand_examples(formatted, keep_all=True)
    loss = unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = examples.groupBy("conv_id").agg(
        F.max("formatted").alias("formatted"), F.count("text").alias("n_examples"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("example_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("example", loss.alias("loss"))))), lambda x: x.loss), "").alias("loss"),
    )
    turns = read_turns(F.col("formatted"))
    return per.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_examples", "example_chars",
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(_shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


QUERIES = {"op8_chat": op8_chat}
ORACLES = {
    "op8_chat": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(replace(replace(replace(role, '\', '\s'), '<', '\l'), chr(10), '\n')) + length(replace(replace(text, '\', '\s'), '<', '\l')) + 15 as chars from rows
), placed as (
  select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto from sized
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars, count(*) filter (role = 'assistant') as n_examples,
  cast(coalesce(sum(upto) filter (role = 'assistant'), 0) as bigint) as example_chars
from placed group by conv_id"""
}
