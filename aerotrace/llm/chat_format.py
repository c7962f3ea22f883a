"""Conversations as budgeted training windows, with DataFrame functions alone.

Turns are marked by a template; control strings inside texts and roles are
escaped so that they can be read back exactly.  Running sums of the turns' tokens
cut a conversation into spans that start and end with turns.  Each span
becomes one window: the leading system turn first, then at most ``history`` turns
before the span, as far as the budget has room, then the span itself.
Only assistant texts of the span itself are under the loss mask, so a target that a
later window repeats is masked there and counts once.

Turns are numbered by rank: counts of a conversation's ranges of turn numbers, summed up over the ranges
before each, so any numbers do.  A conversation is then worked on in blocks of ranks, each with the
few turns around it that a window at its edges may need; a window belongs to the block in
which it starts, and what it holds doesn't depend on where blocks end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template's control strings.
OPEN, SHUT, END, START = "[INST]", "[/INST]", "</s>", "<s>"
TARGET, SYSTEM = "assistant", "system"
#: A block of a conversation holds 2**10 ranks, more where a window can be as long; ranges of turn numbers are summed up in two levels of as many.
BLOCK_BITS = 10
#: Tokens of the template around a turn: the least a turn has.
LEAST_TOKENS = 4


def escape(text: Column) -> Column:
    """Doubles backslashes and parts control strings by one backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, SHUT, END, START):
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: its words and other signs, and four for the template."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + LEAST_TOKENS


def ranked(turns: DataFrame) -> DataFrame:
    """turns (key, turn, role, text, n) with at, the rank in the conversation from 1, before, the tokens ahead, and system, a leading system turn.

    Ranks and sums are taken in ranges of turn numbers and carried over from the ranges before, over ranges of ranges first.
    """
    x = turns.withColumn("range", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))))
    by_turn = W.partitionBy("key", "range").orderBy("turn", "role", "text")
    x = x.withColumns({"at": F.row_number().over(by_turn), "before": F.sum("n").over(by_turn.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")})
    sums = x.groupBy("key", "range").agg(F.count("*").alias("turns"), F.sum("n").alias("n"), F.min_by(F.struct("role", "text", "n"), "at").alias("first")).withColumn("wide", F.shiftright("range", BLOCK_BITS))

    def ahead(parts: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
        w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return parts.withColumns({f"{name}_turns": F.coalesce(F.sum("turns").over(w), F.lit(0)), f"{name}_n": F.coalesce(F.sum("n").over(w), F.lit(0))})

    wide = ahead(sums.groupBy("key", "wide").agg(F.sum("turns").alias("turns"), F.sum("n").alias("n"), F.min_by("first", "range").alias("first")), ["key"], "wide", "far")
    system = wide.groupBy("key").agg(F.min_by("first", "wide").alias("system")).filter(F.col("system.role") == SYSTEM)
    carried = ahead(sums, ["key", "wide"], "range", "near").join(wide.select("key", "wide", "far_turns", "far_n"), ["key", "wide"]).join(system, "key", "left")
    carried = carried.select("key", "range", "system", (F.col("near_turns") + F.col("far_turns")).alias("turns_ahead"), (F.col("near_n") + F.col("far_n")).alias("n_ahead"))
    x = x.join(carried, ["key", "range"])
    return x.select("key", "turn", "role", "text", "n", "system", (F.col("at") + F.col("turns_ahead")).alias("at"), (F.col("before") + F.col("n_ahead")).alias("before"))


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 2) -> DataFrame:
    """Windows of conversations: conv_id, block, window, n_context, formatted, mask, tokens.

    Rows of conversations: conv_id, turn, role, text; turns are taken by turn
    number, ties by role and text, and a null number first.  A null text or role
    is empty; a null conv_id is a conversation of its own.  With half of what
    the system turn leaves of the budget as the step, a span is the turns that
    start in one step of the running sum; a turn longer than a step is a
    span by itself, and a turn is never cut.  So tokens exceed the budget only where a single
    turn and the system turn do by themselves.  window is the rank of its first own turn, from 1,
    and block the block of ranks it was made in.  n_context is the number of turns that
    are repeated, mask the (start, length) of targets in formatted, in code
    points.  Other columns are ignored; no rows in, no rows out.
    """
    # a struct, which is equal to itself where conv_id is null
    x = conversations.select(F.struct("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = ranked(x.withColumn("n", turn_tokens(F.col("text"))))
    # a span's turns start in half a budget, so their number is bounded: a block sees that many behind it, and before it those that may be repeated
    longest = max(1, budget // 2 // LEAST_TOKENS + 2)
    bits = max(BLOCK_BITS, (longest + history + 1).bit_length())
    own_block, place = F.shiftright(F.col("at") - 1, bits), (F.col("at") - 1).bitwiseAND((1 << bits) - 1)
    seen_by = F.array_compact(F.array(own_block, F.when((place < longest) & (own_block > 0), own_block - 1), F.when(place >= (1 << bits) - history - 1, own_block + 1)))
    x = x.withColumn("block", F.explode(seen_by))
    by_turn = W.partitionBy("key", "block").orderBy("at")
    upto = by_turn.rowsBetween(W.unboundedPreceding, 0)
    own = F.coalesce("system.n", F.lit(0))
    x = x.withColumns({"room": budget - own, "step": F.floor((budget - own) / 2), "leads": F.col("system").isNotNull()})
    x = x.withColumns({"alone": F.col("n") > F.col("step"), "part": F.when(F.col("step") > 0, F.floor((F.col("before") - own) / F.col("step"))).otherwise(0)})
    cut = F.col("alone") | F.lag("alone").over(by_turn) | (F.col("part") != F.lag("part").over(by_turn))
    # the leading system turn stands in the window of the turn after it
    x = x.withColumn("starts", F.coalesce((F.col("at") == 1) | (cut & ~(F.col("leads") & (F.col("at") == 2))), F.lit(False)))
    x = x.withColumns({"window": F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(upto), "is_system": F.col("leads") & (F.col("at") == 1)})
    x = x.withColumn("room", F.col("room") - F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("n"))).over(W.partitionBy("key", "block", "window")))
    # a turn is repeated before the spans that start within ``history`` turns and have room for all turns from it on
    later = [(F.lead("starts", j).over(by_turn), F.lead("before", j).over(by_turn), F.lead("room", j).over(by_turn), F.lead("window", j).over(by_turn)) for j in range(1, history + 1)]
    again = [F.when(starts & ~F.col("is_system") & (before - F.col("before") <= room), window) for starts, before, room, window in later]
    x = x.withColumn("shown", F.array_compact(F.array("window", *again))).withColumn("shown", F.explode("shown")).filter(F.shiftright(F.col("shown") - 1, bits) == F.col("block"))
    head = lambda role: F.concat(F.lit(OPEN), escape(role), F.lit(SHUT))
    repeated = ~F.col("shown").eqNullSafe(F.col("window"))  # a turn before a block has a window of another block, or none here
    piece = F.struct("at", repeated.alias("again"), (~repeated & (F.col("role") == TARGET)).alias("target"), head(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), "n")
    grouped = x.groupBy("key", "block", F.col("shown").alias("window")).agg(F.array_sort(F.collect_list(piece)).alias("p"), F.first("system").alias("system"))
    lead = F.struct(F.lit(0).alias("at"), F.lit(True).alias("again"), F.lit(False).alias("target"), head(F.col("system.role")).alias("head"), escape(F.col("system.text")).alias("body"), F.col("system.n").alias("n"))
    apart = F.col("system").isNotNull() & (F.col("window") > 1)
    grouped = grouped.withColumn("p", F.when(apart, F.concat(F.array(lead), "p")).otherwise(F.col("p")))
    masks = F.expr(f"""
        aggregate(p, named_struct('at', 0, 'mask', cast(array() as array<struct<start:int,length:int>>)),
            (a, x) -> named_struct('at', a.at + length(x.head) + length(x.body) + {len(END)},
                'mask', IF(x.target, concat(a.mask, array(named_struct('start', a.at + length(x.head), 'length', length(x.body)))), a.mask)),
            a -> a.mask)""")
    return grouped.select(F.col("key.conv_id").alias("conv_id"), "block", "window", F.size(F.filter("p", lambda t: t["again"])).alias("n_context"), F.concat_ws("", F.transform("p", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"), masks.alias("mask"), F.aggregate("p", F.lit(0).cast("long"), lambda a, t: a + t["n"]).alias("tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """What the formatted windows say: conv_id, block, window, turns (array of role, text), targets (texts under the mask)."""
    pieces = F.split("formatted", END, -1)
    own = F.slice(pieces, F.col("n_context") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_context"), F.lit(0)))
    turns = F.transform(own, lambda p: F.struct(unescape(F.regexp_replace(p, r"^(?s:\[INST\](.*?)\[/INST\].*)$", "$1")).alias("role"), unescape(F.regexp_replace(p, r"^(?s:\[INST\].*?\[/INST\])", "")).alias("text")))
    targets = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return windows.select("conv_id", "block", "window", "formatted", turns.alias("turns"), targets.alias("targets"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from read_back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation needs its text in one row, so this check
    gathers each conversation once more; the windows themselves don't.  A null
    conv_id is a conversation of its own; repeated rows are turns of their own;
    no windows, no rows.
    """
    x = read_back(windows).select("conv_id", F.struct("block", "window", F.size("turns").alias("n"), F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("said"), F.concat_ws("", "targets").alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    x = x.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    loss = F.concat_ws("", F.transform("w", lambda w: w["loss"]))
    total = lambda field: F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w[field])
    return x.select("conv_id", total("n").alias("n_turns"), F.sha2(F.concat_ws("", F.transform("w", lambda w: w["said"])), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))
