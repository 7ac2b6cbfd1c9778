"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is under
the loss mask. A turn is written as "### role: text</turn>" and a line feed. The template's control strings inside
texts and roles are escaped reversibly, so a formatted example can be read back turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Code points of examples that one task makes of a conversation; of a longer one several tasks make a share each.
SPREAD = 1 << 28
#: Conversations that are spread, up to which their table is broadcast.
MOST_BROADCAST = 500_000
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and what stands for them inside texts; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
#: A colon ends a role, so roles escape it too.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs: tuple = ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Undo escape(): between doubled backslashes every other one begins a coded control string."""

    def decoded(part: Column) -> Column:
        for plain, coded in ROLE_ESCAPES[1:]:
            part = F.replace(part, F.lit(coded), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), decoded), "\\")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(COLON), escape(text), F.lit(CLOSE))


def expand_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row for each turn whose role is target, with the turns up to it formatted.

    Columns: conv; target_turn, the position of the trained turn from 0; n_turns, the turns in the example; formatted;
    mask_start and mask_chars, the code points under the loss mask; last, true for a conversation's longest example.
    Turns after the last target, or a conversation without one, follow in a row whose target_turn is null and whose
    mask is empty, so that no turn is lost. Turns are ordered by turn, role and text (nulls first); null roles and
    texts are taken as empty; repeated rows are turns of their own; a null conversation id is a conversation. An
    empty table gives an empty one; other columns of df are left out.
    """
    said = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    gathered = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    dealt = _spread(said, target)
    if dealt is None:  # grouped by conversation alone, so that later work by conversation needs no other shuffle
        turns = said.groupBy("conv").agg(gathered).withColumns({"copy": F.lit(0), "copies": F.lit(1)})
    else:
        turns = dealt.groupBy("conv", "copy", "copies").agg(gathered)
    lines = turns.select(
        "conv",
        "copy",
        "copies",
        F.transform("turns", lambda t: rendered(t["role"], t["text"])).alias("lines"),
        F.filter(
            F.transform("turns", lambda t, i: F.struct((i + 1).alias("upto"), (t["role"] == target).alias("trained"), F.char_length(escape(t["text"])).alias("chars"), F.lit(False).alias("last"))),
            lambda t: t["trained"],
        ).alias("targets"),
    )
    n = F.size("lines")
    tail = F.struct(n.alias("upto"), F.lit(False).alias("trained"), F.lit(0).alias("chars"), F.lit(True).alias("last"))
    covered = F.coalesce(F.try_element_at(F.col("targets"), F.lit(-1))["upto"] == n, F.lit(False)) | (F.col("copy") > 0)
    marked = F.transform(F.filter("targets", lambda t, i: i % F.col("copies") == F.col("copy")), lambda t: t.withField("last", t["upto"] == n))
    rows = lines.select("conv", "lines", F.explode(F.when(covered, marked).otherwise(F.concat(marked, F.array(tail)))).alias("t"))
    formatted = F.array_join(F.slice("lines", 1, F.col("t.upto")), "")
    return rows.select("conv", "t", formatted.alias("formatted")).select(
        F.col("conv").alias(conv),
        F.when(F.col("t.trained"), F.col("t.upto") - 1).alias("target_turn"),
        F.col("t.upto").alias("n_turns"),
        "formatted",
        F.when(F.col("t.trained"), F.char_length("formatted") - len(CLOSE) - F.col("t.chars")).otherwise(0).alias("mask_start"),
        F.col("t.chars").alias("mask_chars"),
        F.col("t.last").alias("last"),
    )


def _spread(said: DataFrame, target: str) -> DataFrame | None:
    """Turns with copy and copies: those of a conversation whose examples pass SPREAD code points are repeated for each task.

    None if there is no such conversation. An example holds all turns before it, so a conversation is one value of a row;
    its examples, which grow with the square of its turns, are made by as many tasks as their size asks for.
    """
    chars = F.char_length("role") + F.char_length("text") + len(OPEN + COLON + CLOSE)
    sizes = said.groupBy("conv").agg((F.count_if(F.col("role") == target) * F.sum(chars) / 2).alias("made"))
    long = sizes.where(F.col("made") > SPREAD).select(F.col("conv").alias("long"), F.ceil(F.col("made") / SPREAD).cast("int").alias("copies"))
    long = written(long, "long")
    n = long.count()
    if not n:
        return None
    side = F.broadcast(long) if n <= MOST_BROADCAST else long
    dealt = said.join(side, F.col("conv").eqNullSafe(F.col("long")), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("long")


def trained_text(examples: DataFrame) -> Column:
    """The plain text under the loss mask of an example."""
    return unescape(F.substr("formatted", F.col("mask_start") + 1, F.col("mask_chars")))


def parsed_turns(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text)."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def one(line: Column) -> Column:
        at = F.position(F.lit(COLON), line)
        return F.struct(
            unescape(F.substr(line, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
            unescape(F.substr(line, at + len(COLON), F.char_length(line))).alias("text"),
        )

    return F.transform(lines, one)
