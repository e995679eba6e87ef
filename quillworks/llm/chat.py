"""Conversations as training text: turns between marks, control strings escaped, a loss mask. DataFrame functions only.

A turn is ``<|im_start|>role\ntext<|im_end|>\n``. Within a text ``<|`` opens a mark, so escaping puts a backslash between both, one more
where there are some already; no escaped text holds ``<|``, and taking one backslash away gives the text back. Roles are escaped alike, with
their line ends as ``<n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<(\\*)([|n])", r"<\\$1$2"), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n"), F.lit("\n")), r"<\\(\\*)([|n])", r"<$1$2")


def pieces(role: Column, text: Column, loss: Column) -> Column:
    """A rendered turn as (text, loss): its head, its body, its tail."""
    piece = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    return F.array(piece(F.concat(F.lit(OPEN), role, F.lit("\n")), F.lit(False)), piece(text, loss), piece(F.lit(CLOSE), F.lit(False)))


def _turn(raw: Column) -> Column:
    """What the grammar makes of the text after one opening mark: (role, text), or null where it is not a turn."""
    line = F.instr(raw, "\n")
    body = F.substring(raw, line + 1, F.length(raw) - line - len(CLOSE))
    role = F.substring(raw, F.lit(1), line - 1)
    good = (line > 0) & F.endswith(raw, F.lit(CLOSE)) & (F.length(raw) >= line + len(CLOSE)) & ~F.contains(body, F.lit("<|")) & ~F.contains(role, F.lit("<|"))
    return F.when(good, F.struct(unescape_role(role).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, array<struct<role, text>>; an element is null where the text is not a turn.

    Deterministic: opening marks cut the text, each part has to be one line with the role, a body without ``<|``, and the closing mark.
    The empty text has no turns; text before the first mark gives a null turn. Null gives null.
    """
    parts = F.split(formatted, r"<\|im_start\|>")
    turns = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _turn)
    return F.when(parts[0] == "", turns).otherwise(F.concat(F.array(F.lit(None).cast(TURN)), turns))


def formatted(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: its id, and pieces, array<struct<text, loss>>: the rendered text end to end and the loss mask on it.

    Each turn is rendered as it is and parsed again. Where the grammar does not give it back, its conflicting content is escaped, and
    it is parsed again; so is the conversation as a whole, and one that does not come back is an error. Only bodies of ``loss_roles`` are under the mask.

    Turns go by number, nulls first, then by role and text, so rows that repeat a turn stay, in an order of their own. Null role or text: empty.
    Null conversation: one of its own. An empty table gives no rows. Other columns are ignored, whatever their names. Rows move once, by
    conversation; one has to fit a cell (2 GB), as everything that reads it does so at once.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    same = lambda r, t: F.coalesce(parse(formatted(pieces(r, t, F.lit(False)))) == F.array(F.struct("role", "text")), F.lit(False))
    rows = rows.withColumn("as_is", same(F.col("role"), F.col("text")))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "as_is"))).alias("turns"))
    mine = lambda t: F.when(t["as_is"], pieces(t["role"], t["text"], t["role"].isin(*loss_roles))).otherwise(pieces(escape_role(t["role"]), escape(t["text"]), t["role"].isin(*loss_roles)))
    out = grouped.select("conv", "turns", F.flatten(F.transform("turns", mine)).alias("pieces"))
    back = parse(formatted(F.col("pieces"))) == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(F.coalesce(back, F.lit(False)), F.col("pieces")).otherwise(F.raise_error(F.lit("a conversation does not come back from its rendered text")))
    return out.select(F.col("conv").alias(conv_col), checked.alias("pieces"))


def read_back(output: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation of ``output`` (id, pieces), from what is written there alone: id, turns, loss_text (all text under the mask, unescaped), formatted_chars."""
    whole = output.select(F.col(f"`{conv_col}`").alias(conv_col), formatted(F.col("pieces")).alias("_whole"), F.filter("pieces", lambda p: p["loss"]).alias("_loss"))
    loss = F.array_join(F.transform("_loss", lambda p: unescape(p["text"])), "")
    return whole.select(conv_col, parse(F.col("_whole")).alias("turns"), loss.alias("loss_text"), F.length("_whole").cast("long").alias("formatted_chars"))
