"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share a header,
and the pieces are concatenated. The template is::

    <|im_start|>role\\n text [<|im_next|> text ...] <|im_end|>\\n

(without the spaces). ``<|im_next|>`` parts the turns that were merged. Inside texts and roles ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|`` (in roles also a line end ``\\n``), so no text can make a marker, and reading
backslash escapes from left to right gives the text back.

Cases: a null or empty text is an empty turn; a null role is an empty role; turns are sorted by number, nulls
first, then role and text, so ties have one order and repeated rows stay repeated. Rows with a null
conversation id form one conversation. An empty table gives an empty result. Extra columns are ignored. A
conversation becomes one string, so it must fit one row; nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A backslash pair is set aside first, so that an escaped backslash before an n is not taken for a line end.
    parts = F.split(role, r"\\\\")
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def before_each(lengths: Column) -> Column:
    """For an array of longs the sum before each entry, in n * sqrt(n) steps."""

    def blocked(ls: Column, side: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), side), lambda b: total(F.slice(ls, b * side + 1, side)))
        starts = lambda ss: F.transform(ss, lambda _, b: total(F.slice(ss, 1, b)))
        entry = lambda i, st: F.element_at(st, F.floor(i / side).cast("int") + 1) + total(F.slice(ls, F.floor(i / side).cast("int") * side + 1, i % side))
        return let(sums, lambda ss: let(starts(ss), lambda st: F.transform(ls, lambda _, i: entry(i, st))))

    return let(lengths, lambda ls: let(F.ceil(F.sqrt(F.size(ls))).cast("int"), lambda side: blocked(ls, side)))


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per conversation: id, ``formatted``, and ``loss_spans``, structs (start from 0, length) in code points of each trained text."""
    rows = turns.select(turns[conv_col].alias("conv"), F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    same = lambda a, b: a["role"] == b["role"]
    ts, n = F.col("ts"), F.size("ts")
    heads = F.transform(ts, lambda t, i: F.when((i > 0) & same(t, ts[F.greatest(i - 1, F.lit(0))]), F.lit(NEXT)).otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))))
    tails = F.transform(ts, lambda t, i: F.when((i < n - 1) & same(t, ts[F.least(i + 1, n - 1)]), F.lit("")).otherwise(F.lit(END)))
    pieces = sorted_turns.select("conv", F.arrays_zip(heads.alias("head"), F.transform(ts, lambda t: escape(t["text"])).alias("text"), tails.alias("tail"), F.transform(ts, lambda t: t["role"] == trained_role).alias("trained")).alias("ps"))
    ps = F.col("ps")

    def laid_out(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p: (F.char_length(p["head"]) + F.char_length(p["text"]) + F.char_length(p["tail"])).cast("long"))
        spans = F.zip_with(ps, before_each(lengths), lambda p, at: F.struct(p["trained"].alias("trained"), (at + F.char_length(p["head"])).alias("start"), F.char_length(p["text"]).cast("long").alias("length")))
        kept = F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
        formatted = F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
        return F.struct(formatted.alias("formatted"), kept.alias("loss_spans"))

    return pieces.select(F.col("conv").alias(conv_col), let(ps, laid_out).alias("out")).select(conv_col, "out.formatted", "out.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that ``chat_format`` wrote."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)

    def chunk_turns(chunk: Column) -> Column:
        role = unescape_role(F.substring_index(chunk, "\n", 1))
        body = F.regexp_replace(F.substring(chunk, F.instr(chunk, "\n") + 1, F.length(chunk)), r"<\|im_end\|>\n\z", "")
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(chunks, chunk_turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
