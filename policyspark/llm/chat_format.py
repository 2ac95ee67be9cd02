"""Chat formatting of typed content parts, with DataFrame functions only.

A turn's content is a list of parts (PART): text, image, audio or document.  A visitor flattens them in order: text is
escaped, every other part becomes a placeholder, and its reference, place and expanded token count go to the attachment
list.  Turns are marked ``<|im_start|>role\\n`` ... ``<|im_end|>\\n``.

Escapes make the marks unforgeable and are reversible: a backslash becomes ``\\s`` and ``<|`` becomes ``<\\p``, in a role also
a line end ``\\n``; a part that ends in ``<`` gets ``\\e`` behind it if another follows.  So what is between marks holds no ``<|``.
Every backslash of escaped text starts one of the four, so each replacement is undone exactly, ``\\s`` last.

The loss mask covers assistant text (not marks, roles or placeholders) as (offset, length) in code points within each
turn, beside the turn's own offset in the conversation, so that reading it back is one pass.

Defined results: null text or role is empty; null content has no parts; turns are ordered by (turn, role, text), nulls
first, and repeated rows stay repeated turns; a null ``conv_id`` is a conversation of its own; an empty table gives an
empty result; other columns are ignored.  A conversation is one string, so its size bounds a row's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: an image takes one for each PATCH x PATCH pixels begun, audio and documents by length.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\e"), F.lit("")), F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(f"array<{PART}>")


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; text and unknown sizes count 0."""
    n = (
        F.when(part["kind"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["kind"] == "document", part["pages"] * PAGE_TOKENS)
    )
    return F.coalesce(n, F.lit(0)).cast("long")


def placeholder(part: Column) -> Column:
    return F.concat(F.lit("<|"), F.when(part["kind"].isin("image", "audio", "document"), part["kind"]).otherwise("attachment"), F.lit("|>"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"] == "text", F.lit(False))


def rendered(turns: DataFrame) -> DataFrame:
    """Per turn: conv_id, ordinal, segment (its formatted string), start (its offset), loss (array of (offset, length) in
    the segment), attachments.  ``turns`` has conv_id, turn, role and content (array of PART).
    """
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.array().cast(f"array<{PART}>")).alias("content"))
    df = own.withColumn("pieces", F.transform("content", lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p))))
    df = df.withColumn("pieces", F.transform("pieces", lambda s, i: F.when(s.endswith("<") & (i < F.size("pieces") - 1), F.concat(s, F.lit("\\e"))).otherwise(s)))
    df = df.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    df = df.withColumn("segment", F.concat("head", F.array_join("pieces", ""), F.lit(f"{END}\n")))
    # where each piece starts: one part mostly, so the sums over the pieces before stay short
    df = df.withColumn("at", F.transform("pieces", lambda p, i: F.length("head") + F.aggregate(F.slice("pieces", 1, i), F.lit(0), lambda a, x: a + F.length(x))))
    spans = F.filter(F.arrays_zip("content", "pieces", "at"), lambda z: _is_text(z["content"]))
    loss = F.when(F.col("role") == "assistant", F.transform(spans, lambda z: F.struct(z["at"].alias("offset"), F.length(z["pieces"]).alias("length")))).otherwise(F.array().cast("array<struct<offset:int,length:int>>"))
    attached = F.transform(F.filter("content", lambda p: ~_is_text(p)), lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens")))
    df = df.withColumn("loss", loss).withColumn("attached", attached)
    plain = F.array_join(F.transform(F.filter("content", _is_text), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    df = df.withColumn("plain", plain)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain", "segment")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return df.select("conv_id", F.row_number().over(order).alias("ordinal"), "segment", F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0)).alias("start"), "loss", "attached")


def formatted(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, turn_starts, loss (a list for each turn), attachments, n_attachments, attachment_tokens."""
    rows = rendered(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "segment", "start", "loss", "attached"))).alias("t"))
    return rows.select(
        "conv_id",
        F.array_join(F.col("t.segment"), "").alias("formatted"),
        F.col("t.start").alias("turn_starts"),
        F.col("t.loss").alias("loss"),
        F.flatten(F.transform("t", lambda x: F.transform(x["attached"], lambda a: F.struct(x["ordinal"].alias("turn"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).select("*", F.size("attachments").cast("long").alias("n_attachments"), F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_back(output: DataFrame) -> DataFrame:
    """Adds, parsed from ``formatted`` and the mask: turns (array of (role, text); placeholders as they stand), loss_texts."""
    segments = F.split("formatted", r"<\|im_end\|>\n")
    df = output.withColumn("__seg", F.slice(segments, 1, F.size(segments) - 1))
    heads = F.transform("__seg", lambda s: F.substring_index(s, "\n", 1))
    df = df.withColumn("__z", F.arrays_zip(F.col("__seg").alias("s"), heads.alias("h"), F.col("loss").alias("m")))
    turns = F.transform(
        "__z",
        lambda z: F.struct(
            unescape_role(F.substr(z["h"], F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(z["s"], F.length(z["h"]) + 2)).alias("text"),
        ),
    )
    masked = F.flatten(F.transform("__z", lambda z: F.transform(z["m"], lambda m: unescape(F.substr(z["s"], m["offset"] + 1, m["length"])))))
    return df.withColumn("turns", turns).withColumn("loss_texts", masked).drop("__seg", "__z")


def digest(conversations: DataFrame) -> DataFrame:
    """Formats text turns (conv_id, turn, role, text), reads the output back and digests what was read."""
    turns = conversations.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("content"))
    back = read_back(formatted(turns))
    loss = F.array_join("loss_texts", "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
