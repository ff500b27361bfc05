"""Chat formatting: turns of a conversation as one training text with a loss mask.

Relational formatting in built-in SQL functions only: the turns of a
conversation are collected as structs and sorted, neighbours of one role are
merged into one block (array functions over the run borders), every block takes
the marks of its role, and the pieces are joined.

The template::

    <s> [INST]user text[/INST] [SYS]system text[/SYS] assistant text</s> [ROLE]name[NAME]other text[/ROLE]

without the spaces; ``[NEXT]`` stands between the merged turns of a block.  A
control string inside a role or text is told apart by backslashes after its first
character: ``[INST]`` is written ``[\\INST]``, ``[\\INST]`` becomes
``[\\\\INST]``.  No control string is left in an escaped text, the first
characters occur in control strings only at their start, so matches never
overlap and taking one backslash away gives the text back.

Results hold the formatted text, the loss mask as code point spans of the
assistant's (escaped) texts, and :func:`turns_of`, :func:`under_mask` read both back.

Scale: one shuffle by conversation, which the result needs, as a conversation is
one text; the sort, the merge and the joins work inside the row.  Cumulated
lengths and cuts work in chunks of the square root of their number, so a
conversation of n turns costs n to the power 1.5 at most.  A conversation must
fit into one value (2 GB), as its text does.

Defined cases: a null or empty text is an empty turn; a null role is an empty
role name; turns are ordered by turn number (null first), then role, then text,
and repeated rows are turns of their own; rows without a conversation id are one
conversation; further columns are left out, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let

BEGIN, NEXT, NAME = "<s>", "[NEXT]", "[NAME]"
# Opening and closing mark of a role; any other role takes OTHER and its name.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
TRAINED = "assistant"
CLOSING = r"\[/INST\]|\[/SYS\]|</s>|\[/ROLE\]"
# A superset of the control strings: first character, backslashes, rest.
CONTROL = r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|(?:NAME|NEXT)\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|(?:NAME|NEXT)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def chunked(values: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of slices of about the square root of the number of values, as an array of its results."""
    def slices(v: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda k: body(F.slice(v, k * step + 1, step)))

    return let(values, lambda v: F.when(F.size(v) > 0, slices(v)))


def running(values: Column) -> Column:
    """The sum of the long values before each place."""
    def inside(chunk: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        sums = F.aggregate(chunk, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return sums  # one longer than the chunk: the last is its total

    def joined(chunks: Column) -> Column:
        bases = inside(F.transform(chunks, lambda c: F.element_at(c, -1)))
        moved = let(bases, lambda b: F.transform(chunks, lambda c, k: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: x + F.get(b, k))))
        return F.flatten(moved)

    return F.coalesce(let(chunked(values, inside), joined), F.array().cast("array<long>"))


def blocks_of(turns: Column) -> Column:
    """Turns (role, text) to blocks (role, texts): neighbours of one role become one block."""
    def merge(ts: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ts) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]))

        def block(s: Column, start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(s, k + 1), F.size(ts))
            texts = F.transform(F.slice(ts, start + 1, stop - start), lambda t: t["text"])
            return F.struct(F.get(ts, start)["role"].alias("role"), texts.alias("texts"))

        return let(starts, lambda s: F.transform(s, lambda start, k: block(s, start, k)))

    return let(turns, lambda ts: F.when(F.size(ts) > 0, merge(ts)).otherwise(F.array().cast("array<struct<role:string,texts:array<string>>>")))


def pieces_of(blocks: Column) -> Column:
    """The blocks as pieces (text, trained) whose texts joined are the formatted conversation."""
    def mark(role: Column, end: int) -> Column:
        given = F.when(F.lit(False), F.lit(""))
        for name, marks in MARKS.items():
            given = given.when(role == name, F.lit(marks[end]))
        return given.otherwise(F.lit(OTHER[end]))

    def opening(role: Column) -> Column:
        return F.when(role.isin(*MARKS), mark(role, 0)).otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(NAME)))

    def piece(text: Column, trained: Column) -> Column:
        return F.struct(text.alias("text"), trained.alias("trained"))

    def of(b: Column) -> Column:
        trained = b["role"] == TRAINED
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), piece(escape(t), trained))))
        return F.concat(F.array(piece(opening(b["role"]), F.lit(False))), texts, F.array(piece(mark(b["role"], 1), F.lit(False))))

    return F.concat(F.array(piece(F.lit(BEGIN), F.lit(False))), F.flatten(F.transform(blocks, of)))


def formatted_of(pieces: Column) -> Column:
    """Pieces to (formatted, loss): the text, and the code point spans (start, stop) that the loss counts."""
    def body(ps: Column) -> Column:
        starts = running(F.transform(ps, lambda p: F.length(p["text"]).cast("long")))
        spans = let(starts, lambda s: F.transform(ps, lambda p, i: F.struct(
            F.get(s, i).alias("start"), (F.get(s, i) + F.length(p["text"])).alias("stop"), p["trained"].alias("trained"))))
        loss = F.transform(F.filter(spans, lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
        return F.struct(F.array_join(F.transform(ps, lambda p: p["text"]), "").alias("formatted"), loss.alias("loss"))

    return let(pieces, body)


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    def turns(block: Column) -> Column:
        named = F.substring_index(F.substr(block, F.lit(len(OTHER[0]) + 1)), NAME, 1)
        role = F.when(F.startswith(block, F.lit(OTHER[0])), unescape(named))
        start = F.when(F.startswith(block, F.lit(OTHER[0])), F.length(named) + len(OTHER[0]) + len(NAME))
        for name, (opening, _) in MARKS.items():
            if opening:
                role = role.when(F.startswith(block, F.lit(opening)), F.lit(name))
                start = start.when(F.startswith(block, F.lit(opening)), F.lit(len(opening)))
        bare = next(name for name, (opening, _) in MARKS.items() if not opening)
        texts = F.split(F.substr(block, start.otherwise(F.lit(0)) + 1), r"\[NEXT\]", -1)
        return F.transform(texts, lambda t: F.struct(role.otherwise(F.lit(bare)).alias("role"), unescape(t).alias("text")))

    blocks = F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), CLOSING, -1)
    return F.flatten(F.transform(let(blocks, lambda b: F.slice(b, 1, F.size(b) - 1)), turns))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one for each span."""
    def cut(chunk: Column) -> Column:
        base = F.get(chunk, F.lit(0))["start"]
        whole = F.substr(formatted, (base + 1).cast("int"), (F.element_at(chunk, -1)["stop"] - base).cast("int"))
        return let(whole, lambda w: F.transform(chunk, lambda s: unescape(F.substr(w, (s["start"] - base + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))))

    return F.coalesce(F.flatten(chunked(loss, cut)), F.array().cast("array<string>"))


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (conv, formatted, loss), see the module."""
    c = lambda name: F.col(f"`{name}`")
    one = F.struct(c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"))
    collected = rows.select(c(conv).alias("conv"), one.alias("one")).groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    made = collected.select("conv", formatted_of(pieces_of(blocks_of(F.col("turns")))).alias("made"))
    return made.select(F.col("conv").alias(conv), "made.formatted", "made.loss")


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests, all read back from ``formatted`` and ``loss`` of :func:`format_turns`."""
    turns, trained = turns_of(F.col("formatted")), under_mask(F.col("formatted"), F.col("loss"))
    read = chats.select(F.col(f"`{conv}`").alias("conv"), F.length("formatted").cast("long").alias("formatted_chars"),
                        turns.alias("turns"), F.array_join(trained, "").alias("trained"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained"), 256).alias("loss_sha256"), "formatted_chars",
    )
