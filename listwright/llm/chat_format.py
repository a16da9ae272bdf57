"""Chat formatting: typed content parts flattened by a visitor into one marked string per talk.

A message is an array of parts (type, text, ref, amount). The visitor, one native expression, turns
text parts into escaped text and image, audio and document parts into numbered placeholders, and
records each attachment's reference with the tokens its placeholder stands for. Turns are marked as
``<|im_start|>role`` newline, content, ``<|im_end|>`` newline.

Control strings inside texts and roles are escaped reversibly: a backslash is doubled and ``<|``
becomes ``<\\|``; in roles a line feed gets a backslash too. A text part after another begins with an escaped
bar if it begins with a bar, as the part before may end in ``<``. So ``<|`` never stands in escaped text, however
it is cut into parts, and ``parse`` reads roles and texts back from the output alone, where placeholders are
what begins with ``<|``. Texts under the loss mask are the assistant's, without marks and placeholders.

``media_parts`` finds the typed parts of a plain text: the text itself, then what its links to media name.

Defined results: null text and null role count as empty; very long texts are formatted whole; turns go by turn number (null first), ties
by role, then text; repeated rows are turns each; a null conv_id is one conversation; an empty table
gives an empty table. Only the named columns are read. A conversation's turns meet in one row, as
the output is one string per conversation; rows are pre-sorted by no one and need not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import before, let

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
#: Tokens that one unit of an attachment expands to: a tile, a second, a page.
EXPANSION = {"image": 256, "audio": 25, "document": 600}
PART = "struct<type:string,text:string,ref:string,amount:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


PLACEHOLDER = r"<\|(?:" + "|".join(EXPANSION) + r"):\d+\|>"


def visit(parts: Column) -> Column:
    """struct<content, runs, attachments> of a message's parts: its string, where its texts lie in it
    (start, length), and its attachments (type, ref, tokens)."""
    is_typed = lambda p: F.coalesce(p["type"].isin(*EXPANSION), F.lit(False))

    def tokens(p: Column) -> Column:
        rate = F.lit(0)
        for name, each in EXPANSION.items():
            rate = F.when(p["type"] == name, F.lit(each)).otherwise(rate)
        return (rate * F.coalesce(p["amount"], F.lit(1))).cast("long")

    def pieces(seen: Column) -> Column:
        """``seen`` has the number of attachments before each part."""

        def piece(p: Column, i: Column) -> Column:
            mark = F.concat(F.lit("<|"), p["type"], F.lit(":"), (F.get(seen, i) + 1).cast("string"), F.lit("|>"))
            text = escape(F.coalesce(p["text"], F.lit("")))
            text = F.when((i > 0) & text.startswith("|"), F.concat(F.lit("\\"), text)).otherwise(text)
            return F.struct(F.when(is_typed(p), mark).otherwise(text).alias("text"), is_typed(p).alias("mark"))

        return F.transform(parts, piece)

    def shown(found: Column) -> Column:
        starts = before(F.transform(found, lambda x: F.length(x["text"]).cast("long")))
        placed = F.zip_with(starts, found, lambda at, x: F.struct(at.alias("start"), F.length(x["text"]).cast("long").alias("length"), x["mark"].alias("mark")))
        texts = F.transform(F.filter(placed, lambda x: ~x["mark"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
        return F.struct(F.array_join(F.transform(found, lambda x: x["text"]), "").alias("content"), texts.alias("runs"))

    counts = F.transform(parts, lambda p: is_typed(p).cast("long"))
    typed = F.transform(F.filter(parts, is_typed), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    both = let(let(before(counts), pieces), shown)
    return let(both, lambda x: F.struct(x["content"].alias("content"), x["runs"].alias("runs"), typed.alias("attachments")))


def text_parts(text: Column) -> Column:
    """A plain text as its one part."""
    none = F.lit(None)
    return F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("amount"))
    )


#: Links that name media, by the ending of their path.
MEDIA = {"image": "png|jpe?g|gif|webp", "audio": "wav|mp3|ogg|flac", "document": "pdf|docx?"}
MEDIA_LINK = r"https?://[^\x00-\x20<>\"')\]]+?\.(?:" + "|".join(MEDIA.values()) + r")\b"


def media_parts(text: Column) -> Column:
    """A plain text as its text part, whole, and a typed part for each link to media in it, in their order."""

    def typed(link: Column) -> Column:
        kind = F.lit("document")
        for name in ("audio", "image"):
            kind = F.when(link.rlike(rf"\.(?:{MEDIA[name]})$"), F.lit(name)).otherwise(kind)
        return F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"), link.alias("ref"), F.lit(None).cast("bigint").alias("amount"))

    links = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MEDIA_LINK), F.lit(0))
    return F.concat(text_parts(text), F.transform(links, typed))


def format_chats(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` as conv_id, formatted, loss (start, length), attachments."""
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts")).alias("seen")
    )
    talks = messages.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        text = F.concat(head, t["seen"]["content"], F.lit(END + "\n"))
        return F.struct(text.alias("text"), F.length(head).cast("long").alias("head"), t["seen"]["runs"].alias("runs"), t["role"].alias("role"))

    pieces = talks.select("conv_id", F.transform("turns", piece).alias("p"), F.flatten(F.transform("turns", lambda t: t["seen"]["attachments"])).alias("attachments"))

    def mask(p: Column) -> Column:
        starts = before(F.transform(p, lambda x: F.length(x["text"]).cast("long")))
        runs = lambda at, x: F.transform(x["runs"], lambda r: F.struct((at + x["head"] + r["start"]).alias("start"), r["length"].alias("length")))
        return F.flatten(F.zip_with(starts, p, lambda at, x: F.when(x["role"] == LOSS_ROLE, runs(at, x)).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))))

    return pieces.select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"), let(F.col("p"), mask).alias("loss"), "attachments"
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string, without placeholders."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        pattern = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)<\|im_end\|>\n$"
        return F.struct(
            unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_replace(F.regexp_extract(x, pattern, 2), PLACEHOLDER, "")).alias("text")
        )

    return F.transform(turns, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(loss, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), ""
    )


def digests(chats: DataFrame) -> DataFrame:
    """What reading the formatted strings back gives, per conversation."""
    counts = (F.size("attachments").cast("long").alias("n_attachments"), F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))
    read = chats.select("conv_id", "formatted", *counts, parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachments",
        "attachment_tokens",
    )
