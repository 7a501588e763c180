"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor takes the parts of a turn in order: text stays, escaped; image, audio and document parts become placeholders,
whose references and expanded token counts are recorded. The template is

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

for each turn, in order of turn. Control strings inside texts get a backslash after their first character, and backslashes
are doubled, so parse_chats reads back exactly what went in. Roles are percent-encoded.

Null text: empty. Null role: the empty role. A null conversation id is a conversation of its own. Null turns come first;
equal turns go by role and text. Repeated rows are repeated turns. An empty table gives no rows. Other columns are not read.
A conversation is one string in one row, so its size bounds a row; the work on its texts is done before rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of this template and of other common ones, fixed values.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
START, END = CONTROL[0], CONTROL[1] + "\n"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\.[]{}()<>*+-=!?^$|/" else c for c in text)


def escape(text: Column) -> Column:
    broken = "|".join(f"(?<={_quoted(c[0])})(?={_quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), broken, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def flatten_parts(parts: Column, patch: int = 14, audio_rate: int = 25, page_tokens: int = 512) -> tuple[Column, Column]:
    """The visitor. parts: array of struct(kind, text, ref, width, height, seconds, pages). Returns the content, and the
    attachments as an array of struct(kind, ref, tokens): images have a token for each patch, audio audio_rate a second,
    documents page_tokens a page; a null or unknown size counts as one unit. Parts of unknown kind keep their text."""
    at_least = lambda c: F.greatest(F.coalesce(c, F.lit(1)).cast("long"), F.lit(1).cast("long"))
    tokens = lambda p: (F.when(p["kind"] == "image", at_least(F.ceil(p["width"] / patch)) * at_least(F.ceil(p["height"] / patch)))
                        .when(p["kind"] == "audio", at_least(F.ceil(p["seconds"] * audio_rate))).otherwise(at_least(p["pages"]) * page_tokens))
    attached = F.filter(parts, lambda p: F.coalesce(p["kind"], F.lit("text")).isin("image", "audio", "document"))
    media = lambda p: F.coalesce(p["kind"], F.lit("text")).isin("image", "audio", "document")
    # a text that ends in the first character of a control string may not join with the next part
    text = lambda p, i: F.regexp_replace(escape(F.coalesce(p["text"], F.lit(""))), F.when(i < F.size(parts) - 1, F.lit(r"(?<=[<\[])$")).otherwise(F.lit("(?!)")), r"\\")
    content = F.array_join(F.transform(parts, lambda p, i: F.when(media(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(text(p, i))), "")
    return content, F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def text_part(text: Column) -> Column:
    names = ["ref", "width", "height", "seconds", "pages"]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).alias(n) for n in names]).cast(PART))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """For each conversation: conv_id, n_turns, formatted, sizes (for each turn the characters of its head and content, and
    whether the content is under the loss mask; see loss_spans) and attachments in order. parts_col: an array of parts
    instead of text_col."""
    parts = F.col(parts_col) if parts_col else text_part(F.col(text_col).cast("string"))
    content, attached = flatten_parts(F.coalesce(parts, F.array().cast(f"array<{PART}>")))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), content.alias("content"), head.alias("head"), role.isin(*loss_roles).alias("loss"), attached.alias("attached")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    sizes = F.transform("ts", lambda t: F.struct(F.length(t["head"]).cast("long").alias("h"), F.length(t["content"]).cast("long").alias("c"), t["loss"].alias("loss")))
    conv = conv.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"), sizes.alias("sizes"), F.flatten(F.transform("ts", lambda t: t["attached"])).alias("attachments"))
    return conv.select("conv_id", "n_turns", "formatted", "sizes", "attachments")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """A row for each content under the loss mask: conv_id, start, end in characters of formatted."""
    from pyspark.sql import Window

    rows = formatted.select("conv_id", F.posexplode("sizes").alias("k", "s")).withColumn("end", F.sum(F.col("s.h") + F.col("s.c") + len(END)).over(Window.partitionBy("conv_id").orderBy("k")) - len(END))
    return rows.where("s.loss").select("conv_id", (F.col("end") - F.col("s.c")).alias("start"), "end")


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of struct(role, text)."""
    chunks = F.split(formatted, _quoted(CONTROL[1]) + "\n")
    turns = F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    role = lambda x: F.substring_index(body(x), "\n", 1)
    return F.transform(turns, lambda x: F.struct(F.url_decode(role(x)).alias("role"), unescape(F.substring(body(x), F.length(role(x)) + 2, F.length(x))).alias("text")))


SQL = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\|im_start\|>|\|im_end\|>|\|image\|>|\|audio\|>|\|document\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g') AS content FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(content) + length(role) + 12 + 1 + 11)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
"""
