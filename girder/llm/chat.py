"""Chat formatting in DataFrame functions only: a state machine over roles and a declarative template.

Edge cases: null text and null role are empty; rows of equal turn are ordered by
role, then text; a null turn comes last; rows of a null conv_id form one
conversation; invalid turn orders are formatted too and marked; an empty table
gives an empty result; extra columns are ignored.  A conversation becomes one
value, so its size is bounded by that of a value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import table


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles are learned, and which role may follow which state."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    #: state>role -> state; a missing entry is an error.
    moves: dict[str, str] = field(default_factory=lambda: {"start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"})
    accepts: tuple[str, ...] = ("assistant",)
    #: Applied in this order and undone in reverse; each control string above holds one of the characters.
    #: No escape's letter starts another, so undoing is exact.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)

    def escape(self, text: Column, role: bool = False) -> Column:
        for plain, safe in self.escapes + (self.role_escapes if role else ()):
            text = F.replace(text, F.lit(plain), F.lit(safe))
        return text

    def unescape(self, text: Column, role: bool = False) -> Column:
        for plain, safe in reversed(self.escapes + (self.role_escapes if role else ())):
            text = F.replace(text, F.lit(safe), F.lit(plain))
        return text


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (array of role, text, loss), formatted, valid, bad_turn of each conversation.

    The segments' texts in order are the formatted text; loss is set on what the
    learned roles say.  bad_turn is the first turn that the state machine refuses.
    """
    turn = F.struct(F.col("turn").isNull().alias("no_turn"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*(F.lit(x) for kv in template.moves.items() for x in kv))
    step = lambda acc, t: F.struct(
        F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit(">"), t["role"])), F.lit("error")).alias("state"),
        (acc["n"] + F.when(acc["state"] == "error", 0).otherwise(1)).alias("n"))
    run = F.aggregate("turns", F.struct(F.lit("start").alias("state"), F.lit(0).alias("n")), step)
    segment = lambda role, text, loss: F.struct(role.alias("role"), text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(t["role"], F.concat(F.lit(template.open), template.escape(t["role"], True), F.lit(template.after_role)), F.lit(False)),
        segment(t["role"], template.escape(t["text"]), t["role"].isin(*template.learned)),
        segment(t["role"], F.lit(template.close), F.lit(False)))))
    out = convs.select("conv_id", run.alias("run"), segments.alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("run.state").isin(*template.accepts).alias("valid"), F.when(F.col("run.state") == "error", F.col("run.n") - 1).alias("bad_turn"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array of (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, template.close)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(template.open) + 1, 2**31 - 1)
        role = F.substring_index(body, template.after_role, 1)
        text = F.substr(body, F.length(role) + len(template.after_role) + 1)
        return F.struct(template.unescape(role, True).alias("role"), template.unescape(text).alias("text"))

    return F.transform(pieces, turn)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: digests of what is read back from the formatted conversations."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    template = Template()
    out = format_chats(rows.unionByName(probe), template).withColumn("turns", read_turns(F.col("formatted"), template))
    out = out.withColumn("learned", F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*template.learned)), lambda t: t["text"]), ""))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         string_agg(role, ' ' ORDER BY turn NULLS LAST, role, text) AS roles,
         sum(14 + length(regexp_replace(role, '([\\#<:])', '\1\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\1\1', 'g')))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
       regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid
FROM g
"""
