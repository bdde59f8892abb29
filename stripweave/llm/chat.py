"""Chat formatting as a grammar round trip, in column expressions only.

Grammar of the output::

    conversation := turn*
    turn         := '<turn:' role '>' text '</turn>' '\\n'

Control strings are ``<turn:`` and ``</turn>``; ``\\`` starts an escape: ``\\s`` is ``\\``, ``\\l`` is ``<``, ``\\g`` is ``>``.
Each turn is first rendered with its text as it is and parsed again. If the parser does not give back exactly that turn, its
text is escaped (no ``<`` and no bare ``\\`` is left in it) and parsed once more; a turn that even then differs is an error,
never a silent change. Roles are always escaped. Most texts stay as they are, and every text comes back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn:", "</turn>"
TRAINED_ROLE = "assistant"


def _swap(column: Column, find: str, by: str) -> Column:
    return F.replace(column, F.lit(find), F.lit(by))


def escape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\", "\\s"), "<", "\\l"), ">", "\\g")


def unescape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\l", "<"), "\\g", ">"), "\\s", "\\")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(">"), body, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of ``role, text, ok``. ``ok`` is false where the grammar does not hold: a second
    header in a turn, or something between two turns."""
    pieces = F.split(formatted, CLOSE + "\n", -1)

    def turn(piece: Column) -> Column:
        after = F.substr(piece, F.lit(len(OPEN) + 1))
        role = F.substring_index(after, ">", 1)
        text = F.substr(after, F.length(role) + 2)
        ok = piece.startswith(OPEN) & after.contains(">") & ~after.contains(OPEN) & ~after.contains(CLOSE)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), ok.alias("ok"))

    # What follows the last end mark must be empty; it is not a turn.
    return F.when(F.element_at(pieces, -1) == "", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)).otherwise(
        F.array(F.struct(F.lit("").alias("role"), formatted.alias("text"), F.lit(False).alias("ok")))
    )


def _comes_back(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse(rendered)
    first = F.get(turns, F.lit(0))
    return (F.size(turns) == 1) & first["ok"] & (first["role"] == role) & (first["text"] == text)


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and the rendered turn, ``escaped`` telling whether its text had to be escaped.
    Null roles and texts count as empty."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    rows = rows.withColumn("_plain", render_turn(role, text))
    rows = rows.withColumn("escaped", ~_comes_back(F.col("_plain"), role, text))
    rows = rows.withColumn("_rendered", F.when(F.col("escaped"), render_turn(role, escape(text))).otherwise(F.col("_plain")))
    safe = ~F.col("escaped") | _comes_back(F.col("_rendered"), role, text)
    rendered = F.when(safe, F.col("_rendered")).otherwise(F.raise_error(F.lit("chat format: a turn does not come back")).cast("string"))
    return rows.select("conv_id", "turn", "role", "text", "escaped", rendered.alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, n_escaped``: one row per conversation, turns in order of turn, then role, then text.

    Rows with a null ``conv_id`` form one conversation; a null turn comes first; repeated turns are kept. Other columns are
    ignored, an empty table gives no rows. Turns are rendered and checked one by one before they meet, so what a
    conversation's one task does is put ready strings in order.
    """
    rows = format_turns(turns)
    kept = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "role", "text", "rendered")))
    out = rows.groupBy("conv_id").agg(kept.alias("_turns"), F.count_if("escaped").alias("n_escaped"))
    return out.select("conv_id", F.array_join(F.transform("_turns", lambda t: t["rendered"]), "").alias("formatted"), "n_escaped")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text``: parsed from the formatted text alone. ``loss_text`` joins the texts under the loss mask."""
    out = formatted.withColumn("turns", parse(F.col("formatted")))
    broken = F.exists("turns", lambda t: ~t["ok"])
    out = out.withColumn("turns", F.when(broken, F.raise_error(F.lit("chat format: output breaks the grammar"))).otherwise(F.col("turns")))
    trained = F.filter("turns", lambda t: t["role"] == TRAINED_ROLE)
    return out.withColumn("loss_text", F.array_join(F.transform(trained, lambda t: t["text"]), ""))


def digests(formatted: DataFrame) -> DataFrame:
    rows = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode(F.col("loss_text"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.col("n_escaped").cast("long").alias("n_escaped"),
    )


PROBE_TEXT = "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """The given conversations and conversation -7, whose texts hold control strings."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, contains(text, '<turn:') OR contains(text, '</turn>') OR contains(text, '\l') OR contains(text, '\g') OR contains(text, '\s') AS escaped,
    replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS r2, replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g') AS t2 FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + length(r2) + 1 + length(CASE WHEN escaped THEN t2 ELSE text END) + 8)::BIGINT AS formatted_chars,
  count(*) FILTER (escaped) AS n_escaped
FROM r GROUP BY conv_id
"""
