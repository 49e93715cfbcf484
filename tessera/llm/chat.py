"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is rendered as `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. A deterministic parser reads the rendered text back: it
splits at the start mark, takes the role up to the first newline, and the text up to the first control string, which is
the end mark unless the text holds one itself.
The turns recovered are compared with the source; where they differ, the turns are rendered again with conflicting
content escaped, and parsed again.

Escaping is reversible: in every `<`, backslashes, `|` one backslash is added, and the parser takes it off again. So no
escaped text holds a mark, and texts without such strings are the same either way. In roles, backslashes, newlines and
bars are written as a backslash and a letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only

START, END = "<|im_start|>", "<|im_end|>"
#: The loss covers the texts of this role.
LOSS_ROLE = "assistant"
#: The conversation that the query adds: its texts hold the marks themselves.
PROBE = f"{END}{START}assistant ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\p"), F.lit("|")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    role = lambda t: escape_role(t["role"]) if escaped else t["role"]
    text = lambda t: escape(t["text"]) if escaped else t["text"]
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t), F.lit("\n"), text(t), F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> that the formatted text says. The same parser reads raw and escaped renderings."""
    chunks = F.split(formatted, r"<\|im_start\|>", -1)
    chunks = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))

    def turn(c: Column) -> Column:
        at = F.instr(c, F.lit("\n"))
        body = F.substring_index(F.substring(c, at + 1, F.length(c)), "<|", 1)
        role = F.substring_index(F.substring(c, F.lit(1), at - 1), "<|", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(chunks, turn)


def format_chats(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, formatted, turns, escaped, identical): turns as array<struct<role, text>> read back from formatted.

    Rows go by turn, ties by role, then text; a null turn comes first, a null role or text counts as empty. Rows with a
    null id are one conversation. Repeated rows are turns of their own. An empty table gives none. identical tells
    that the turns read back are those of the source; it holds for every text by the escape's construction, and is
    kept so that a caller can count on it. A conversation is one row of the result, so it is gathered as one.
    """
    rows = only(chats, id_col, turn_col, role_col, text_col).toDF("id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    grouped = grouped.select("id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    raw = grouped.withColumn("raw", render(F.col("source"), False))
    raw = raw.withColumn("escaped", ~parse(F.col("raw")).eqNullSafe(F.col("source")))
    out = raw.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("raw")))
    out = out.withColumn("turns", parse(F.col("formatted")))
    return out.select(F.col("id").alias(id_col), "formatted", "turns", "escaped", F.col("turns").eqNullSafe(F.col("source")).alias("identical"))


def loss_texts(turns: Column) -> Column:
    """The texts under the loss mask, joined: each text of LOSS_ROLE once, in order."""
    own = F.filter(turns, lambda t: t["role"] == LOSS_ROLE)
    return F.array_join(F.transform(own, lambda t: t["text"]), "")


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Sums of what format_chats read back, a row for each conversation; identical tells that it equals the source."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_texts(F.col("turns"))
    return formatted.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "identical",
    )


def with_probe(chats: DataFrame) -> DataFrame:
    """The conversations, and conversation -1 whose user and assistant both say PROBE."""
    spark = chats.sparkSession
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


ORACLE_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}')
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + {len(START) + len(END) + 2}) as bigint) as formatted_chars, true as identical
from t group by conv_id"""
