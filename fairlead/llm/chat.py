"""Chat formatting with typed content parts, DataFrame functions only.

A conversation is rows (conv_id, turn, role, parts); a part is text, image, audio or document. Its parts are flattened
in order: text is escaped, an attachment becomes a placeholder and an entry in `attachments` with its expanded token
count. Rows are put in order of turn, then role, then body; repeated rows are turns of their own; null turn comes
first; null role, text or parts count as empty; an empty table gives an empty result. A formatted conversation is one
value, so a single conversation is bounded by the engine's 2 GB a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template's marks, and strings that chat models read as control strings.
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = ("<|", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
#: Tokens an attachment expands to: a 14-pixel patch grid, 25 frames a second, 512 tokens a page.
PATCH, FRAMES, PAGE_TOKENS = 14, 25, 512
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Double each backslash, then put one behind the first character of every control string. Undone by unescape."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROL, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role ends at the first line break, so breaks inside it are written as backslash, n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])


def _tokens(p: Column) -> Column:
    image = F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)
    audio = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * FRAMES)
    return F.when(p["kind"] == "image", image).when(p["kind"] == "audio", audio).when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS).otherwise(0).cast("long")


def _visit(p: Column) -> Column:
    """What a part leaves in the body; a part of an unknown kind counts as text."""
    out = escape(F.coalesce(p["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(p["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts array<PART>) to conv_id, formatted, mask, turn_mask, attachments, attachment_tokens.

    mask: code-point spans (start, length) of the assistant bodies in `formatted`. Offsets are running sums over the
    turns of a conversation, so a long conversation costs in proportion to its length. turn_mask: one entry a turn, the
    same spans counted from the start of the turn, NULL for turns without loss.
    """
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    t = t.select("conv_id", "turn", "role", F.array_join(F.transform("parts", _visit), "").alias("body"), F.filter("parts", lambda p: p["kind"].isin(*PLACEHOLDERS)).alias("held"))
    t = t.select("*", F.concat(F.lit(START), escape_role(F.col("role")), F.lit(BREAK)).alias("head"))
    own = F.length("head") + F.length("body") + len(END)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")]
    inside = W.partitionBy("conv_id").orderBy(*order)
    t = t.withColumn("nth", F.row_number().over(inside)).withColumn("at", F.sum(own).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.length("body") - len(END))
    seen = F.transform("held", lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    piece = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("s"), F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length"), F.length("head").cast("long").alias("inner"))).alias("m"), seen.alias("a"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return c.select(
        "conv_id",
        F.array_join(F.col("p.s"), "").alias("formatted"),
        F.transform(F.filter(F.col("p.m"), lambda m: m.isNotNull()), lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))).alias("mask"),
        F.transform(F.col("p.m"), lambda m: F.when(m.isNotNull(), F.struct(m["inner"].alias("start"), m["length"].alias("length")))).alias("turn_mask"),
        F.flatten(F.col("p.a")).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of formatted conversations: adds turns array<struct<role,text>> and loss_text (all text under the mask).

    Each turn is cut out once and its role, text and masked text are taken from it, so a conversation is read in
    proportion to its length.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda s: s != "")

    def turn(s: Column, m: Column) -> Column:
        body = F.substr(s, F.lit(len(START) + 1))
        masked = F.when(m.isNotNull(), unescape(F.substr(s, (m["start"] + 1).cast("int"), m["length"].cast("int"))))
        return F.struct(unescape_role(F.substring_index(body, BREAK, 1)).alias("role"), unescape(F.substr(body, F.instr(body, F.lit(BREAK)) + 1)).alias("text"), masked.alias("masked"))

    read = formatted.withColumn("__read", F.zip_with(pieces, "turn_mask", turn))
    turns = F.transform("__read", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    return read.withColumn("turns", turns).withColumn("loss_text", F.array_join(F.col("__read.masked"), "")).drop("__read")


def _sql_escape(text: str) -> str:
    return reduce(lambda c, s: f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')", CONTROL, f"replace({text}, '\\', '\\\\')")


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_sql_escape("text")} AS body, replace({_sql_escape("role")}, chr(10), '\\n') AS r FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS whole,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '') AS loss,
             sum(length(body) + length(r) + {len(START) + len(BREAK) + len(END)}) AS formatted_chars FROM e GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
