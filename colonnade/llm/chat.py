"""Chat formatting in DataFrame functions: typed content parts, a reversible template and a loss mask.

A turn's content is a text or a list of typed parts (kind, text, ref, units). A
visitor flattens the parts in order: text is escaped, and an image, audio or
document part becomes a placeholder; the k-th placeholder of a conversation is
the k-th entry of its ``attachments``, with the reference and the number of
tokens that it expands to (units times TOKENS of its kind).

A turn is <|im_start|>role, a line end, the content, <|im_end|>, a line end.
Inside texts, '<', backslashes and '|' get one more backslash, which reading
takes away again; roles are URL-encoded. So no text can hold a control string.
The output keeps segments, each under the loss mask or not; the formatted
conversation is their concatenation.

Defined results: null text, role or parts are empty; turns of one number are
ordered by role, then by their parts as given (kind, text, ref, units); repeated rows are turns each time; unknown kinds of
parts keep their placeholder under "document"; a null conv_id is a conversation
of its own; extra columns are ignored; an empty table gives no rows. One
conversation is one output row, so it has to fit in one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TOKENS = {"image": 1, "audio": 1, "document": 800}
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin(*TOKENS), p["kind"]).otherwise(F.lit("document"))


def visit(parts: Column) -> Column:
    """The content of a turn: texts escaped, other parts as placeholders, in order.

    Texts that follow one another are joined before they are escaped, so that a
    control string can't be put together from several parts.
    """
    state = "struct<out:array<string>,open:array<string>>"
    joined = lambda a: escaped(F.array_join(a, ""))

    def step(a: Column, p: Column) -> Column:
        text = F.struct(a["out"].alias("out"), F.concat(a["open"], F.array(F.coalesce(p["text"], F.lit("")))).alias("open"))
        other = F.struct(F.concat(a["out"], F.array(joined(a["open"]), F.concat(F.lit("<|"), _kind(p), F.lit("|>")))).alias("out"), F.array().cast("array<string>").alias("open"))
        return F.when(p["kind"] == "text", text).otherwise(other).cast(state)

    none = F.array().cast("array<string>")
    return F.aggregate(parts, F.struct(none.alias("out"), none.alias("open")).cast(state), step, lambda a: F.concat(F.array_join(a["out"], ""), joined(a["open"])))


def attachments(parts: Column) -> Column:
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.coalesce(*(F.when(_kind(p) == k, F.lit(n)) for k, n in TOKENS.items()))
    others = F.filter(parts, lambda p: ~F.coalesce(p["kind"] == "text", F.lit(False)))
    return F.transform(others, lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens")))


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, and text or parts) -> conv_id, segments, attachments, expanded_tokens."""
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    else:
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))
    role = F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), parts.alias("parts")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
    no = F.lit(False)
    of = lambda t: F.array(segment(head(t), no), segment(visit(t["parts"]), t["role"] == "assistant"), segment(F.lit(END + "\n"), no))
    attached = F.flatten(F.transform("turns", lambda t: attachments(t["parts"])))
    out = chats.select("conv_id", F.flatten(F.transform("turns", of)).alias("segments"), attached.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def plain(body: Column) -> Column:
    """The text of a formatted content: placeholders gone, escapes undone."""
    return unescaped(F.regexp_replace(body, r"<\|(?:image|audio|document)\|>", ""))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; as read from the formatted string), loss_text, formatted."""
    pieces = F.split(F.col("formatted"), r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
    role = lambda p: F.url_decode(F.substring_index(p, "\n", 1))
    body = lambda p: F.regexp_extract(p, r"(?s)\A[^\n]*\n(.*)<\|im_end\|>\n\z", 1)
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), plain(body(p)).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: plain(s["text"])), "")
    return chats.withColumn("formatted", formatted(F.col("segments"))).select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(chats: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    length = lambda c: F.length(c).cast("long")
    return read_chats(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), length("loss_text").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"), length("formatted").alias("formatted_chars"),
    )
