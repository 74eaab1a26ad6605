"""Chat formatting with typed content parts.

A message holds an ordered list of parts: ``text``, ``image``, ``audio`` or ``document``. A visitor
(one expression per kind) turns each part into its rendered form: escaped text, or a placeholder that
names the kind and the part's place (turn and part number). It records the attachment's reference and
the number of tokens that the placeholder stands for. Turns are rendered where they are; only the
finished pieces of a conversation meet, to be joined in order.

Template of a turn: ``<|turn|>role\\ncontent<|end|>\\n``. Inside roles and texts, ``\\``, ``<``, ``[``
and the line feed of a role are written as ``\\0``, ``\\1``, ``\\2`` and ``\\3``, so no control string can
appear in them and ``unescape`` restores them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN, END = "<|turn|>", "<|end|>\n"
PATCH_PIXELS = 28
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 800
_CODES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for raw, code in _CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\3"))


def _plain_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\3"), F.lit("\n")))


def _expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for; unknown measures count as the least that is possible."""
    side = lambda x: F.greatest(F.ceil(F.coalesce(x, F.lit(1)) / PATCH_PIXELS), F.lit(1))
    return (
        F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND), F.lit(1)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * TOKENS_PER_PAGE)
        .otherwise(0)
        .cast("long")
    )


def _visit(part: Column, place: Column, turn: Column) -> Column:
    """One part -> (rendered, ref, tokens); an unknown kind is text."""
    attached = part["kind"].isin("image", "audio", "document")
    mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), turn.cast("string"), F.lit("."), place.cast("string"), F.lit("|>"))
    return F.struct(
        F.when(attached, mark).otherwise(escape(part["text"])).alias("rendered"),
        F.when(attached, F.concat(mark, F.lit("="), F.coalesce(part["ref"], F.lit("")))).alias("ref"),
        _expanded(part).alias("tokens"),
    )


def with_text_part(turns: DataFrame) -> DataFrame:
    """Plain ``(conv_id, turn, role, text)`` rows as messages of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).alias(k) for k in ("ref", "width", "height", "seconds", "pages")))
    return turns.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, mask, refs, expanded_tokens)``, one row per conversation.

    ``messages`` has ``conv_id, turn, role, parts`` (``PART`` structs); other columns are ignored.
    Turns are ordered by turn, then role, then content, so ties and repeated rows have a fixed place
    and each keeps its own turn. Null ids form one conversation; null roles, texts and part lists are
    empty. ``mask`` holds ``(start, length)`` in code points (from 1) of every assistant content, in
    order. No messages, no rows.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    turns = messages.select("conv_id", "turn", "role", parts.alias("parts"))
    key = W.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts"))
    turns = turns.withColumn("nth", F.row_number().over(key))
    seen = F.transform("parts", lambda p, i: _visit(p, i, F.col("nth")))
    turns = turns.withColumn("seen", seen).withColumn("content", F.array_join(F.transform("seen", lambda v: v["rendered"]), ""))
    head = F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("size", F.length("head") + F.length("content") + len(END))
    before = F.sum("size").over(W.partitionBy("conv_id").orderBy("nth").rowsBetween(W.unboundedPreceding, -1))
    turns = turns.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head") + 1)
    piece = F.struct(
        "nth",
        F.concat("head", "content", F.lit(END)).alias("piece"),
        F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("int").alias("start"), F.length("content").alias("length"))).alias("span"),
        F.filter(F.transform("seen", lambda v: v["ref"]), lambda r: r.isNotNull()).alias("refs"),
    )
    made = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.sum(F.aggregate("seen", F.lit(0).cast("long"), lambda n, v: n + v["tokens"])).alias("expanded_tokens"),
    )
    return made.select(
        "conv_id",
        F.array_join("pieces.piece", "").alias("formatted"),
        F.filter("pieces.span", lambda s: s.isNotNull()).alias("mask"),
        F.flatten("pieces.refs").alias("refs"),
        "expanded_tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say: turns, and the text under the loss mask.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, expanded_tokens)``.
    """
    cut_up = F.split("formatted", r"\Q" + TURN + r"\E", -1)
    pieces = F.slice(cut_up, F.lit(2), F.size(cut_up))

    def turn(piece: Column) -> Column:
        piece = F.substring(piece, F.lit(1), F.length(piece) - len(END))
        cut = F.instr(piece, "\n")
        role, content = F.substring(piece, F.lit(1), cut - 1), F.substring(piece, cut + 1, F.length(piece))
        return F.concat(_plain_role(role), F.lit("\n"), unescape(content), F.lit("\n"))

    loss = F.transform("mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    found = formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss", F.array_join(loss, ""))
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("refs").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )
