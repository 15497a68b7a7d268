"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor over each turn's parts flattens them in order: text as it is, image, audio and document parts as numbered
placeholders; it records each attachment (turn, number, kind, reference, tokens) and the tokens that its placeholder
stands for when expanded: ceil(w/28) * ceil(h/28) for an image, 25 a second for audio, 512 a page for a document.

The template marks turns: <|im_start|>role NEWLINE text <|im_end|> NEWLINE. Inside texts and roles one backslash is put
between < and | wherever only backslashes lie between them, which one removal undoes, so no text can open or close a
turn or a placeholder. The loss mask is a span in code points of each assistant turn's text, within its turn.

Cases: null text is empty; a null role is an empty role; a line break or percent sign in a role is percent-coded. Null
or empty parts add nothing, and an unknown kind is flattened as text. Turns are ordered by turn (null first), then
role, then text; repeated rows are turns of their own. Rows with a null conversation id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def part_tokens(p: Column) -> Column:
    """Tokens that the placeholder of a part is expanded to; 0 for text."""
    image = F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)
    return F.when(p["kind"] == "image", image).when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE)).when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PAGE_TOKENS).otherwise(F.lit(0)).cast("long")


def is_attachment(p: Column) -> Column:
    return F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))


def visit(parts: Column) -> Column:
    """The flattened text of a turn's parts: an accumulator with the text so far and the attachments met."""
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<|"), p["kind"], F.lit(":"), acc["n"].cast("string"), F.lit("|>"))
        return F.struct(F.concat(acc["text"], F.when(is_attachment(p), mark).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("text"), (acc["n"] + is_attachment(p).cast("int")).alias("n"))

    return F.aggregate(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), empty, step, lambda acc: acc["text"])


def text_parts(text: Column) -> Column:
    """A text as the parts of a turn: one text part."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none("string", "ref"), none("int", "width"), none("int", "height"), none("double", "seconds"), none("int", "pages")))


def format_turns(turns: DataFrame, parts_col: str = "parts", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, with no shuffle: conv_id, turn, role, formatted, loss (struct start, end in the turn, or null), attachments, tokens."""
    p, body, head = F.col(parts_col), F.col("_body"), F.col("_head")
    number = F.filter(F.coalesce(p, F.array().cast(f"array<{PART}>")), lambda x: x.isNotNull() & is_attachment(x))
    attachments = F.transform(number, lambda x, i: F.struct(i.alias("number"), x["kind"].alias("kind"), x["ref"].alias("ref"), part_tokens(x).alias("tokens")))
    out = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), visit(p).alias("_body"), F.concat(F.lit(START), _role(F.col(role_col)), F.lit("\n")).alias("_head"), attachments.alias("attachments"))
    span = F.struct(F.char_length(head).alias("start"), (F.char_length(head) + F.char_length(body)).alias("end"))
    return out.select("conv_id", "turn", "role", F.concat(head, body, F.lit(END + "\n")).alias("formatted"), F.when(F.col("role").isin(*loss_roles), span).alias("loss"), "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def assemble(turns: DataFrame) -> DataFrame:
    """Conversations from format_turns: formatted text, loss spans (turn number and offsets in that turn), attachments.

    A conversation is one string, so its turns meet in one row.
    """
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "formatted", "loss", "attachments", "attachment_tokens"))).alias("t"))
    spans = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("turn"), x["loss"]["start"].alias("start"), x["loss"]["end"].alias("end"))), lambda s: s["start"].isNotNull())
    refs = F.flatten(F.transform("t", lambda x, i: F.transform(x["attachments"], lambda a: F.struct(i.alias("turn"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return held.select("conv_id", F.concat_ws("", F.col("t.formatted")).alias("formatted"), spans.alias("loss_spans"), refs.alias("attachments"), F.aggregate("t.attachment_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("attachment_tokens"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, each as it stands in it (its own markers included)."""
    return F.transform(F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>"))), lambda t: F.concat(F.lit(START), t))


def turn_role(block: Column) -> Column:
    return _plain_role(F.substring_index(F.substring(block, len(START) + 1, 1 << 30), "\n", 1))


def turn_text(block: Column) -> Column:
    """A turn's text, unescaped; placeholders stay as they are."""
    head = F.instr(block, "\n")
    return unescape(F.substring(block, head + 1, F.char_length(block) - head - len(END) - 1))


def masked(blocks: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(F.get(blocks, s["turn"]), s["start"] + 1, s["end"] - s["start"])))
