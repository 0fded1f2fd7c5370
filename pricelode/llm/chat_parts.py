"""Chat formatting of typed content parts, in DataFrame functions only.

A message has an array of parts; a visitor has one method per kind (text, image, audio, document) and turns every part
into a piece of text: escaped text, or a placeholder of the template that stands for an attachment.  Attachments keep
their reference, place and expanded token count (what a model puts in place of the placeholder).

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Escaping is reversible and leaves no control string in a text:
a backslash becomes ``\\b``; ``\\z`` goes behind the first character of every control string; a line end in a role
becomes ``\\n``.  The loss mask is a list of spans of the formatted text that cover exactly the assistant texts.

Turns are ordered by (turn, role, text), nulls first; repeated turns stay.  Null roles and texts are empty, null parts
are none, rows of a null conversation are one conversation; an unknown kind counts as a document.  A conversation is one
output row, so it must fit a row.  Further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings with a meaning in common chat templates.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
CONTROL = (OPEN, CLOSE.strip(), *PLACEHOLDERS.values(), *FOREIGN)
PART_TYPE = "struct<kind:string,text:string,ref:string,width:double,height:double,seconds:double,pages:double>"


def escape(text: Column) -> Column:
    starts = "(?s)(?=" + "|".join(re.escape(c) for c in CONTROL) + ")(.)"
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), starts, "$1\\\\z")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\z"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


@dataclass(frozen=True)
class Visitor:
    """One method per kind; each gives (piece, kind, ref, tokens).  Override the methods or the rates for another model."""

    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: float = 800.0

    def image(self, part: Column) -> Column:
        side = lambda c: F.ceil(F.coalesce(part[c], F.lit(0.0)) / self.patch)
        return self._attachment("image", part, F.greatest(F.lit(1), side("width") * side("height")))

    def audio(self, part: Column) -> Column:
        return self._attachment("audio", part, F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_tokens_per_second))

    def document(self, part: Column) -> Column:
        return self._attachment("document", part, F.ceil(F.coalesce(part["pages"], F.lit(1.0)) * self.tokens_per_page))

    def text(self, part: Column) -> Column:
        none = F.lit(None).cast("string")
        return self._piece(escape(F.coalesce(part["text"], F.lit(""))), none, none, F.lit(0))

    def visit(self, part: Column) -> Column:
        """The piece of a part, by its kind; a part without a kind is text."""
        return (
            F.when(part["kind"].isNull() | (part["kind"] == "text"), self.text(part))
            .when(part["kind"] == "image", self.image(part))
            .when(part["kind"] == "audio", self.audio(part))
            .otherwise(self.document(part))
        )

    def _attachment(self, kind: str, part: Column, tokens: Column) -> Column:
        return self._piece(F.lit(PLACEHOLDERS[kind]), F.lit(kind), part["ref"], tokens)

    @staticmethod
    def _piece(piece: Column, kind: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(piece.alias("piece"), kind.alias("kind"), ref.alias("ref"), tokens.cast("long").alias("tokens"))


def text_part(text: Column) -> Column:
    """Parts of a message that has text only."""
    none = lambda kind: F.lit(None).cast(kind)
    fields = [none("string").alias("ref"), *[none("double").alias(c) for c in ("width", "height", "seconds", "pages")]]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *fields))


def format_chats(messages: DataFrame, visitor: Visitor = Visitor(), trained_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``messages`` (conv_id, turn, role, parts).

    formatted; loss: spans (start, length) in code points from 0; attachments: (turn, kind, ref, start, tokens) in order of
    their placeholders; expanded_tokens: the attachments' tokens in all.
    """
    pieces = F.transform(F.coalesce("parts", F.lit(None).cast(f"array<{PART_TYPE}>"), F.array().cast(f"array<{PART_TYPE}>")), visitor.visit)
    turns = messages.select("conv_id", "turn", "role", pieces.alias("pieces")).select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("trained"),
        F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("body"),
        F.transform(
            "pieces",
            lambda p, i: F.struct(
                p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"),
                F.length(F.array_join(F.transform(F.slice("pieces", 1, i), lambda q: q["piece"]), "")).alias("offset"),
            ),
        ).alias("placed"),
    )
    size = F.length("head") + F.length("body") + len(CLOSE)
    order = Window.partitionBy("conv_id").orderBy("turn", "head", "body")
    placed = turns.withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "turn", "trained", "head", "body", "placed"))).alias("turns")
    )
    trained = F.filter("turns", lambda t: t["trained"])
    attachments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                F.filter(t["placed"], lambda p: p["kind"].isNotNull()),
                lambda p: F.struct(
                    t["turn"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"),
                    (t["start"] + F.length(t["head"]) + p["offset"]).alias("start"), p["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(
            trained, lambda t: F.struct((t["start"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))
        ).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn, from the formatted text alone."""
    parts = F.split(formatted, re.escape(CLOSE))
    whole = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1))
    return F.transform(
        whole,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(p.substr(F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), s["length"]))), "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Formats ``conversations`` and the control-string conversation -7, and reads everything back."""
    kinds = dict(conversations.dtypes)
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = format_chats(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    back = chats.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned")
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 12 + length(role) + 1 + length(text) + 11 + length(text) - length(replace(text, '\', ''))
    + 2 * len(regexp_extract_all(text,
        '<\|im_start\|>|<\|im_end\|>|<\|image\|>|<\|audio\|>|<\|document\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>'))
    AS chars FROM rows
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS learned,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM chats
"""
