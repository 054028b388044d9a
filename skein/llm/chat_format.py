r"""Chat formatting with Spark expressions only.

Rows of one conversation are collected as structs, sorted by turn, and merged where
neighbours have the same role; the formatted string and the spans of its assistant texts
follow from array functions. The template is

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

with <|im_sep|> between the texts of merged turns. Inside roles and texts a caret becomes
`^0` and each control string gets `^1` after its first character, so none survives there and
`unescape` gives the texts back exactly.

Null roles and texts count as empty, a null turn sorts first, ties sort by role and text, and
repeated rows are turns of their own. Rows with a null conv_id make one conversation. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and other common chat templates; no text may hold one unescaped.
CONTROL = [START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>"]
_PATTERN = "([<\\[])(" + "|".join(sorted({c[1:].replace("|", "\\|").replace("[", "\\[").replace("]", "\\]") for c in CONTROL}, key=lambda c: (-len(c), c))) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("^"), F.lit("^0")), _PATTERN, "$1^1$2")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("^1"), F.lit("")), F.lit("^0"), F.lit("^"))


def format_chat(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for each conversation of rows (conv_id, turn, role, text).

    loss_spans has start and end (exclusive), in code points of formatted, of each assistant
    text, in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # each turn with the markers that stand before it: a new block, or a separator inside the block of its role
    own = own.withColumn("rs", F.transform("ts", lambda t: t["role"])).withColumn(
        "ps",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                F.when(
                    (i > 0) & (F.get("rs", i - 1) == t["role"]), F.lit(SEP)
                ).otherwise(F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(START), escape(t["role"]), F.lit("\n"))).alias("before"),
                escape(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ),
    )
    # running lengths: where each body begins
    at = F.aggregate(
        "ps",
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:bigint,end:bigint,loss:boolean>>").alias("spans")),
        lambda a, p: F.struct(
            (a["n"] + F.length(p["before"]) + F.length(p["body"])).alias("n"),
            F.array_append(a["spans"], F.struct((a["n"] + F.length(p["before"])).alias("start"), (a["n"] + F.length(p["before"]) + F.length(p["body"])).alias("end"), p["loss"].alias("loss"))).alias("spans"),
        ),
    )
    spans = F.transform(F.filter(at["spans"], lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    whole = F.concat(F.array_join(F.transform("ps", lambda p: F.concat(p["before"], p["body"])), ""), F.lit(END + "\n"))
    return own.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of structs role, text."""
    blocks = F.filter(F.split(formatted, "<\\|im_end\\|>\n"), lambda b: b != "")
    bodies = F.transform(blocks, lambda b: F.substring(b, F.lit(len(START) + 1), F.length(b)))
    return F.flatten(
        F.transform(
            bodies,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, "\n") + 1, F.length(b)), "<\\|im_sep\\|>"),
                lambda t: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_chat(rows.unionByName(probe))
    turns = done.withColumn("turns", read_chat(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_CONTROL_SQL = _PATTERN.replace("'", "''")
ORACLE_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS merged,
         regexp_replace(replace(role, '^', '^0'), '{_CONTROL_SQL}', '\1^1\2', 'g') AS erole,
         regexp_replace(replace(text, '^', '^0'), '{_CONTROL_SQL}', '\1^1\2', 'g') AS etext
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN merged THEN {len(SEP)} ELSE {len(START) + len(END) + 2} + length(erole) END + length(etext)) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
