"""Chat formatting: typed content parts flattened into one marked-up string per conversation.

A turn is written ``### role: body</turn>``. Bodies and roles are escaped with
backslashes, character by character, so that no control string survives inside them
or comes about between two parts; dropping the backslashes undoes it. Everything is
built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
HEAD, SEP, END = "### ", ": ", "</turn>"
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens that one placeholder expands to.
TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 1, 25, 512


def escaped(text: Column) -> Column:
    r"""Backslash before ``\`` and ``#``, and behind ``<``.

    Every character is escaped by itself, so escaped pieces may be joined: no ``</turn>``,
    ``<|`` or ``### `` can come about where two parts of a turn meet.
    """
    return F.replace(F.regexp_replace(text, r"[\\#]", r"\\$0"), F.lit("<"), F.lit("<\\"))


def escaped_role(role: Column) -> Column:
    """As ``escaped``, and a backslash before ``:``, which ends a role."""
    return F.replace(F.regexp_replace(role, r"[\\#:]", r"\\$0"), F.lit("<"), F.lit("<\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(<)\\|\\(.)", "$1$2")


def text_part(text: Column) -> Column:
    """A content list of one text part; null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens a part's placeholder expands to: image tiles, audio seconds, document pages; missing sizes count as one unit."""
    tiles = lambda size: F.ceil(F.coalesce(size, F.lit(TILE)) / F.lit(float(TILE)))
    return (
        F.when(part["type"] == "image", tiles(part["width"]) * tiles(part["height"]) * TOKENS_PER_TILE)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * TOKENS_PER_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)).cast("bigint") * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def visited(parts: Column) -> Column:
    """The parts of one turn, in order, as (body, attachments, tokens).

    Text parts are escaped; each other part becomes a placeholder numbered within
    its turn, and its reference is recorded with the tokens that it expands to. A
    null list or part counts as empty text, a null type as text. A placeholder begins
    with ``<|``, which no text part can produce.
    """
    listed = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull())
    media = F.filter(listed, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    numbers = F.transform(
        listed,
        lambda p, i: F.size(F.filter(F.slice(listed, 1, i + 1), lambda q: F.coalesce(q["type"], F.lit("text")) != "text")),
    )
    bodies = F.zip_with(
        listed,
        numbers,
        lambda p, n: F.when(F.coalesce(p["type"], F.lit("text")) == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escaped(p["type"]), F.lit("_"), n.cast("string"), F.lit("|>"))),
    )
    attachments = F.transform(media, lambda p, i: F.struct((i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return F.struct(F.array_join(bodies, "").alias("body"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("tokens"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """One row per conversation: (conv_id, formatted, loss_spans, attachments, expanded_tokens, n_turns).

    ``loss_spans`` has, for each trained turn, its index and the start and length
    of its body inside the turn's piece, in code points; a piece is what stands
    before each ``</turn>``. Turns are ordered by number, then role, then body,
    nulls first; repeated rows are all kept. A null role is written empty, a null
    conversation id is a conversation of its own, and an empty table gives no
    rows. Turns are escaped and laid out before the shuffle. A conversation is
    one string by contract, so it has to fit into one row.
    """
    laid = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visited(F.col(parts)).alias("v")).select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            F.col("v.body").alias("body"),
            F.col("v.attachments").alias("attachments"),
            F.col("v.tokens").alias("tokens"),
        ).alias("t"),
    )
    grouped = laid.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(HEAD), escaped_role(t["role"]), F.lit(SEP))
    spans = F.transform(
        F.filter(F.transform(F.col("ts"), lambda t, i: F.struct(i.alias("turn"), t.alias("t"))), lambda x: x["t"]["role"] == trained),
        lambda x: F.struct(x["turn"].alias("turn"), (F.length(head(x["t"])) + 1).alias("start"), F.length(x["t"]["body"]).alias("length")),
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"),
        F.size("ts").cast("bigint").alias("n_turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the trained text, parsed from ``formatted`` and ``loss_spans`` alone.

    Adds ``turns`` (role, text: unescaped; placeholders as written) and
    ``loss_texts``, one for each span.
    """
    pieces = F.split("formatted", END, -1)
    head = r"(?s)^### ((?:<\\|\\.|[^\\:<]++)*+): (.*)$"
    return (
        formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
        .withColumn("turns", F.transform("pieces", lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text"))))
        .withColumn("loss_texts", F.transform("loss_spans", lambda s: unescaped(F.substring(F.element_at("pieces", s["turn"] + 1), s["start"], s["length"]))))
        .drop("pieces")
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """Contract query 7: every conversation formatted, and digests of what reads back from it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    told = read_back(format_conversations(rows.unionByName(probe).withColumn("parts", text_part(F.col("text")))))
    loss = F.array_join("loss_texts", "")
    return told.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "expanded_tokens",
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), u AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 13 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS expanded_tokens
FROM u GROUP BY conv_id
"""
