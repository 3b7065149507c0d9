"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and only its text trainable.  A conversation
that does not end with an assistant turn gives one more example without a trainable part, so that the output holds
every turn.

A turn is written ``<|turn|>role<|text|>text<|end|>``; ``&``, ``<`` and ``[`` inside roles and texts are written
``&amp;``, ``&lt;`` and ``&#91;``, so no control string of this or the bracket templates can occur in them, and undoing
the three in reverse order gives the text back exactly.

Defined cases: a null role or text is empty; turns are ordered by turn, then role, then text, repeated rows stay; a row
without conv_id is a conversation of its own, told apart by ``lone``; an empty table gives no example; other columns are
ignored, whatever their names.

An example is one string by nature, so a conversation is one too: it may have 2^31 - 1 bytes, and examples of a
conversation of n turns have characters in proportion to n^2.  The examples of a conversation are cut from its one string
as rows, without copies of the turns beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]


def escape(c: Column) -> Column:
    for raw, written in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for raw, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(raw))
    return c


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, lone, example (from 0), last (the conversation's longest example), formatted, loss_start, loss_chars.

    The conversation is formatted once; an example is its beginning up to the end of the example's turn, and the
    trainable text is given by code point offsets.
    """
    empty = F.lit("")
    turns = turns.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone"), "turn",
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    laid = turns.select(
        "conv_id", "lone", "turn", "role", "text", (F.col("role") == "assistant").alias("train"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"),
    )
    order = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumns({
        "k": F.row_number().over(Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")),
        # characters up to and with the turn
        "end": F.sum(F.length("head") + F.length("body") + len(END)).over(order).cast("int"),
    })
    turn = F.struct("k", "train", F.length("body").alias("chars"), "end", F.concat("head", "body", F.lit(END)).alias("written"))
    laid = laid.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list(turn)).alias("w"))
    laid = laid.select("conv_id", "lone", "w", F.concat_ws("", F.col("w.written")).alias("full"), F.size("w").alias("n"))
    targets = F.filter(
        F.transform("w", lambda t: t.dropFields("written")), lambda t: t["train"] | (t["k"] == F.col("n"))
    )
    examples = laid.select("conv_id", "lone", "full", "n", F.posexplode(targets).alias("example", "t"))
    return examples.select(
        "conv_id",
        "lone",
        "example",
        (F.col("t.k") == F.col("n")).alias("last"),
        F.substring("full", F.lit(1), F.col("t.end")).alias("formatted"),
        F.when(F.col("t.train"), F.col("t.end") - len(END) - F.col("t.chars")).alias("loss_start"),
        F.when(F.col("t.train"), F.col("t.chars")).otherwise(0).alias("loss_chars"),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped; empty without one."""
    return F.coalesce(unescape(F.substring(formatted, start + 1, chars)), F.lit(""))


def parse(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    parts = F.split(formatted, r"<\|turn\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], turns.schema)
    out = expand(turns.unionByName(extra))
    told = F.concat_ws("", F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = out.select(
        "conv_id",
        "lone",
        F.when(F.col("last"), F.struct(F.size(parse(F.col("formatted"))).alias("n"), F.sha2(told.cast("binary"), 256).alias("sha"))).alias("turns"),
        F.struct("example", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id", "lone").agg(
        F.max("turns").alias("turns"), F.array_sort(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars")
    ).withColumn("loss", F.concat_ws("", F.col("loss.text")))
    return whole.select(
        "conv_id",
        F.col("turns.n").cast("long").alias("n_turns"),
        F.col("turns.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), w AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(8 + 8 + 7 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
      + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')))
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
