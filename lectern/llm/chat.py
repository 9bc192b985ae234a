"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into turn-aligned windows from prefix sums of its turns' token estimates. Every
window repeats the system turn and a limited history; only turns new to a window are trained on there,
so the loss mask covers each assistant text exactly once. Control strings inside texts are escaped
reversibly, so marks in the output are always the template's own.

Turns are dealt once, by conversation and block of turns, and everything but a small table of blocks
stays where it is: windows lie within blocks, prefix sums are made within blocks and then over blocks,
and a block gets the last turns before it as its first history. So a conversation that holds a
third of all turns is spread over many tasks, and texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import require

WINDOW_TOKENS, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
#: Turn numbers that share a block, and characters that count as a token.
BLOCK_TURNS, TOKEN_CHARS, TURN_TOKENS = 256, 4, 4
#: Control strings of common chat templates. The template's own marks start with the first.
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_OPEN, _CLOSE, _END = "<|", "|>", "<|end|>"


def escape(text: Column) -> Column:
    """A tilde becomes ``~0`` and the k-th control string ``~k``."""
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for k, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(control), F.lit(f"~{k}"))
    return out


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    out = text
    for k, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(f"~{k}"), F.lit(control))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def _turn(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def _placed(turns: DataFrame, history_turns: int) -> DataFrame:
    """Turns with their number ``n`` and the tokens before them in their block, and what the block needs to know.

    That is the turns before the block, the conversation's system turn or null, and the last turns before
    the block, nearest first, from however many blocks.
    """
    cut = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))
    order = Window.partitionBy("cid", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("n", F.row_number().over(order).cast("long") - 1).withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    tail = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("left") <= history_turns, _turn("n", "role", "text", "tokens"))))), 1, max(history_turns, 1))
    left = F.count("*").over(Window.partitionBy("cid", "block")) - F.col("n")
    head = F.min(F.when(F.col("n") == 0, _turn("role", "text", "tokens")))
    blocks = local.withColumn("left", left).groupBy("cid", "block").agg(F.count("*").alias("rows"), head.alias("head"), tail.alias("tail"))
    # one row per 256 turns of a conversation; every block has a turn, so the last turns lie in as many blocks
    over = Window.partitionBy("cid").orderBy("block")
    first = F.first("head").over(over)
    none = F.array().cast(blocks.schema["tail"].dataType)
    tails = [F.coalesce(F.lag("tail", k).over(over), none) for k in range(1, history_turns + 1)]
    rows_before = F.coalesce(F.sum("rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = blocks.select(
        F.col("cid").alias("base_cid"),
        F.col("block").alias("base_block"),
        rows_before.alias("rows_before"),
        F.when(first["role"] == "system", first).alias("system"),
        (F.slice(F.concat(*tails), 1, history_turns) if tails else none).alias("tail"),
    )
    return local.join(bases, F.expr("cid = base_cid and block = base_block")).drop("base_cid", "base_block")


def windows(
    conversations: DataFrame, budget: int = WINDOW_TOKENS, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None,
) -> DataFrame:
    """Formatted windows: ``conv_id, first_turn, n_turns, n_repeated, n_tokens, formatted, loss``.

    A window starts with ``n_repeated`` turns seen before (the system turn, then at most
    ``history_turns`` turns of at most ``history_tokens`` together) and goes on with ``n_turns`` new ones,
    the first of which is the conversation's ``first_turn``-th. ``loss`` lists start and length, in code
    points of ``formatted``, of the new assistant texts. Windows keep to ``budget`` tokens; a turn that
    can't is a window of its own, whole. Windows don't cross blocks of 256 turn numbers; history does.
    ``tokens_col`` holds the tokens of each text (null: none); without it four bytes are taken as one.
    The template's marks count as ``TURN_TOKENS`` more.

    Null texts and roles count as empty, turns are ordered by number, role and text, null numbers first,
    so repeated rows follow each other. Null conversation ids form one conversation. No rows give no
    windows; other columns are not looked at.
    """
    require(conversations, id_col, turn_col, role_col, text_col, *([tokens_col] if tokens_col else []))
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    conv = F.col(id_col).cast("long")
    given = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)) if tokens_col else None
    guessed = F.floor((F.octet_length(text) + (TOKEN_CHARS - 1)) / TOKEN_CHARS)
    turns = conversations.select(
        conv.alias("conv_id"),
        F.coalesce(conv.cast("string"), F.lit("")).alias("cid"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        ((guessed if given is None else given) + TURN_TOKENS).cast("long").alias("tokens"),
    )
    placed = _placed(turns, history_turns)
    room = F.greatest(F.lit(2), F.lit(budget - history_tokens) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    # new turns of a window begin within a step that leaves room for the block's longest; where that is more
    # than half the room, the step is half, and a longer turn reaches beyond its step and stands alone
    half = F.floor(room / 2)
    longest = F.max("tokens").over(Window.partitionBy("cid", "block"))
    placed = placed.withColumn("step", room - F.least(half, longest))
    placed = placed.withColumn("cell", F.floor(F.col("before") / F.col("step")) * 2 + (F.col("tokens") > half).cast("long"))
    # the turns before the block serve its first turns only, so only they carry them
    none = F.array().cast(placed.schema["tail"].dataType)
    placed = placed.withColumn("tail", F.when(F.col("n") < history_turns, F.col("tail")).otherwise(none))
    order = Window.partitionBy("cid", "block").orderBy("n")
    lags = [F.lag(_turn("n", "role", "text", "tokens"), k).over(order) for k in range(1, history_turns + 1)]
    past = F.slice(F.concat(F.filter(F.array(*lags), lambda h: h.isNotNull()), "tail"), 1, history_turns) if lags else none
    starts = ~F.lag("cell").over(order).eqNullSafe(F.col("cell"))
    marked = placed.withColumn("past", F.when(starts, past))
    # a window holds at most its budget, or one long turn with its repeats
    whole = marked.groupBy("cid", "block", "cell").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(_turn("n", "role", "text"))).alias("turns"), F.sum("tokens").alias("tokens"), F.first("system").alias("system"),
        F.first("rows_before").alias("rows_before"), F.coalesce(F.first("past", ignorenulls=True), none).alias("past"),
    )
    whole = whole.withColumn("first_turn", F.col("rows_before") + F.get("turns", F.lit(0))["n"])
    # history is nearest first, so its k-th turn has this number; turn 0 is repeated as the system turn already
    number = lambda k: F.col("first_turn") - 1 - k
    whole = whole.withColumn("past", F.filter("past", lambda h, k: F.col("system").isNull() | (number(k) > 0)))
    # until its tokens are used up
    spent = lambda i: F.aggregate(F.slice("past", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, h: a + h["tokens"])
    whole = whole.withColumn("past", F.reverse(F.filter("past", lambda h, i: spent(i) <= history_tokens)))
    has_system = F.col("system").isNotNull() & (F.col("first_turn") > 0)
    part = lambda t, repeated: F.struct(
        F.concat(F.lit(_OPEN), escape(t["role"]), F.lit(_CLOSE)).alias("begin"), escape(t["text"]).alias("body"), F.lit(repeated).alias("repeated"), ((t["role"] == "assistant") & F.lit(not repeated)).alias("loss")
    )
    old = F.concat(F.when(has_system, F.array(F.struct("system.role", "system.text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>")), F.transform("past", lambda h: F.struct(h["role"].alias("role"), h["text"].alias("text"))))
    made = whole.withColumn("pieces", F.concat(F.transform(old, lambda t: part(t, True)), F.transform("turns", lambda t: part(t, False))))
    full = lambda p: F.length(p["begin"]) + F.length(p["body"]) + len(_END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, p: F.struct(
        (a["at"] + full(p)).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["begin"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
    )
    old_tokens = F.aggregate("past", F.lit(0).cast("long"), lambda a, h: a + h["tokens"]) + F.when(has_system, F.col("system.tokens")).otherwise(0)
    return made.select(
        F.col("conv_id").alias(id_col), "first_turn", F.size("turns").cast("long").alias("n_turns"), (F.size("pieces") - F.size("turns")).cast("long").alias("n_repeated"), (F.col("tokens") + old_tokens).alias("n_tokens"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["begin"], p["body"], F.lit(_END))), "").alias("formatted"),
        F.aggregate("pieces", start, step, lambda a: a["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Windows read from their text: ``conv_id, first_turn, turns, targets, n_chars``.

    ``turns`` are the new turns' role and text in order, ``targets`` the unescaped texts under the loss
    mask; both come from ``formatted`` alone, with ``n_repeated`` and ``loss`` as bounds.

    Every window gives one row, repeated ones too; null ids stay null, empty texts come back empty and no
    windows give no rows. Null ``formatted`` or bounds give null turns; other columns are not looked at.
    """
    sections = F.slice(F.split("formatted", r"<\|end\|>", -1), F.lit(1), (F.col("n_repeated") + F.col("n_turns")).cast("int"))
    headed = F.transform(sections, lambda x: F.struct(F.substring_index(x, _CLOSE, 1).alias("head"), x.alias("all")))
    parsed = F.transform(
        headed,
        lambda s: F.struct(
            unescape(F.substring(s["head"], F.lit(len(_OPEN) + 1), F.length(s["head"]))).alias("role"),
            unescape(F.substring(s["all"], F.length(s["head"]) + len(_CLOSE) + 1, F.length(s["all"]))).alias("text"),
        ),
    )
    fresh = F.slice(parsed, F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int"))
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(id_col, "first_turn", fresh.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("n_chars"))
