"""Conversations as training windows of a token budget, with a loss mask. DataFrame functions only.

A conversation's turns are laid on a line by the prefix sums of their tokens,
cut into bins of the room that a window has for new turns. The turns inside a bin are a
window, and a turn that crosses into the next bin is a window of its own; so
windows hold whole turns and keep the budget, but for a turn that is longer
than the room by itself. Every window opens with the system turn, repeats the last
turns before it up to ``history`` tokens, and then gives its new turns. Only
the new turns of the assistant are targets, so each is learned once.

    <turn new assistant>text</turn>

Texts and roles are escaped: ``&`` as ``&amp;``, ``<`` as ``&lt;``, ``>`` in roles as ``&gt;``. No
mark can then occur inside them, and undoing it gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import stored

BUDGET = 1024
HISTORY = 256
#: Turn numbers in one group of the prefix sums; a long conversation is many groups.
TURNS_PER_GROUP = 256
CLOSE = "</turn>\n"
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&gt;"), F.lit(">")))


def approximate_tokens(text: Column) -> Column:
    """A token for every four characters begun, and four for the turn's marks."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def numbered(turns: DataFrame, tokens=approximate_tokens) -> tuple[DataFrame, DataFrame]:
    """Turns with their places, and a stored table of the groups they fall into.

    Turns get ``pos`` (from 0), ``tokens``, ``is_system`` for an opening system turn, ``begin``, the tokens of the turns
    before that are not the opening system turn, ``room_taken``, those of the opening system turn, and
    ``_group``. A row of a group has ``opening``, the first turn of the conversation, and ``n_turns``, the number of
    all its turns. Sums run over groups and groups of groups, so a long conversation is many tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    t = t.withColumn("tokens", F.greatest(F.coalesce(tokens(F.col("text")).cast("long"), F.lit(1)), F.lit(1)))
    t = t.withColumn("_group", F.floor(F.col("turn") / TURNS_PER_GROUP))
    order = ["turn", "role", "text"]
    inside = W.partitionBy("conv_id", "_group").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_pos", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0))).withColumn("_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    groups = t.groupBy("conv_id", "_group").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.min(F.struct(*order, "tokens")).alias("opening"))
    groups = groups.withColumn("_super", F.floor(F.col("_group") / TURNS_PER_GROUP))

    def before(column: str, *by: str) -> Column:
        return F.coalesce(F.sum(column).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    supers = groups.groupBy("conv_id", "_super").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.min("opening").alias("opening"))
    whole = W.partitionBy("conv_id")
    supers = supers.select(
        F.col("conv_id").alias("_conv"), F.col("_super").alias("_of"), before("n", "conv_id", "_super").alias("_n"), before("t", "conv_id", "_super").alias("_t"),
        F.sum("n").over(whole).alias("n_turns"), F.min("opening").over(whole).alias("_opening"),
    )
    mine = groups.select("conv_id", "_group", "_super", before("n", "conv_id", "_super", "_group").alias("n0"), before("t", "conv_id", "_super", "_group").alias("t0"))
    starts = mine.join(supers, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_super").eqNullSafe(F.col("_of")))
    starts = stored(
        starts.select("conv_id", "_group", (F.col("n0") + F.col("_n")).alias("n0"), (F.col("t0") + F.col("_t")).alias("t0"), "n_turns", F.col("_opening").alias("opening")), "chat-groups"
    )
    taken = F.when(F.col("opening.role") == SYSTEM_ROLE, F.col("opening.tokens")).otherwise(0)
    there = starts.select(F.col("conv_id").alias("_conv"), F.col("_group").alias("_of"), "n0", "t0", taken.alias("room_taken"))
    both = t.join(there, _same_group())
    pos = F.col("n0") + F.col("_pos")
    placed = both.select(
        "conv_id", "_group", "role", "text", "tokens", pos.alias("pos"), ((pos == 0) & (F.col("role") == SYSTEM_ROLE)).alias("is_system"),
        (F.col("t0") + F.col("_before") - F.when(pos > 0, F.col("room_taken")).otherwise(0)).alias("begin"), "room_taken",
    )
    return placed, starts


def _same_group() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_group").eqNullSafe(F.col("_of"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=approximate_tokens) -> DataFrame:
    """Windows of all conversations: ``conv_id``, ``window``, ``text``, ``targets``, ``n_tokens``, ``over_budget``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not
    read. Null texts and roles count as empty. Turns come in the order of their
    numbers, null first; equal ones by role and text, and repeated rows are turns of
    their own. A null ``conv_id`` is a conversation. ``tokens`` maps a text's column to its tokens; a turn has at
    least one. ``targets`` lists the begin and length, in characters, of the escaped texts that a loss is taken on.
    """
    room = F.greatest(F.lit(budget - history) - F.col("room_taken"), F.lit(max(history, 1)))
    t, starts = numbered(turns, tokens)
    t = t.withColumn("room", room)
    end = F.col("begin") + F.col("tokens") - 1
    t = t.withColumn("bin", F.when(F.col("is_system"), -1).otherwise(F.floor(F.col("begin") / F.col("room"))))
    t = t.withColumn("window", F.when(F.col("is_system"), -1).otherwise(2 * F.col("bin") + (F.floor(end / F.col("room")) != F.col("bin")).cast("int")))
    mine = t.groupBy("conv_id", "window", "bin").agg(F.min("begin").alias("first"), F.first("_group").alias("_group"))
    # any group of a conversation tells how it opens
    about = starts.select(F.col("conv_id").alias("_conv"), F.col("_group").alias("_of"), "n_turns", "opening")
    opening = mine.join(about, _same_group()).select(
        F.col("conv_id").alias("_conv"), F.col("window").alias("_window"), F.col("bin").alias("_bin"), "first", "opening",
        # the window that opens the conversation; the system turn's own if nothing follows
        F.when(F.col("window") >= 0, F.col("first") == 0).otherwise(F.col("n_turns") == 1).alias("opens"),
    )
    row = ["_window", "pos", "new", "role", "text", "tokens"]
    new = t.filter("not is_system").select("conv_id", F.col("window").alias("_window"), "pos", F.lit(True).alias("new"), "role", "text", "tokens")
    # the system turn stands in every window, and is new in the one that opens the conversation
    system = opening.filter((F.col("opening.role") == SYSTEM_ROLE) & ((F.col("_window") >= 0) | F.col("opens")))
    system = system.select(F.col("_conv").alias("conv_id"), "_window", F.lit(0).cast("long").alias("pos"), F.col("opens").alias("new"), "opening.role", "opening.text", "opening.tokens")
    # a bin is at least as long as the history, so it reaches back into one bin before at most
    back = t.filter("not is_system").withColumn("_in", F.explode(F.array("bin", F.col("bin") + 1)))
    near = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_in") == F.col("_bin")) & (F.col("begin") < F.col("first")) & (F.col("first") - F.col("begin") <= history)
    old = back.join(opening.filter("_window >= 0"), near).select("conv_id", "_window", "pos", F.lit(False).alias("new"), "role", "text", "tokens")
    rows = new.unionByName(system).unionByName(old)
    packed = rows.groupBy("conv_id", "_window").agg(
        F.sort_array(F.collect_list(F.struct(*row[1:]))).alias("t"), F.sum("tokens").alias("n_tokens")
    )
    head = lambda x: F.concat(F.lit("<turn "), F.when(x["new"], F.lit("new ")).otherwise(F.lit("old ")), escape_role(x["role"]), F.lit(">"))
    pieces = F.transform("t", lambda x: F.struct(x["new"].alias("new"), x["role"].alias("role"), head(x).alias("head"), escape(x["text"]).alias("body")))
    packed = packed.withColumn("p", pieces)
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)
    packed = packed.withColumn("sizes", F.transform("p", size))
    begin = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b)
    spans = F.transform("p", lambda x, i: F.struct(x["new"].alias("new"), x["role"].alias("role"), (begin(i) + F.length(x["head"])).alias("begin"), F.length(x["body"]).alias("length")))
    targets = F.transform(F.filter(spans, lambda x: x["new"] & (x["role"] == TARGET_ROLE)), lambda x: F.struct(x["begin"], x["length"]))
    body = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return packed.select(
        "conv_id", F.col("_window").cast("long").alias("window"), body.alias("text"), targets.alias("targets"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget")
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Windows with ``turns`` (role and text of the new turns) and ``loss`` (the targets' texts), read from the text alone."""
    pieces = F.filter(F.split("text", CLOSE, -1), lambda x: x != "")
    head = lambda x: F.substring_index(x, ">", 1)
    body = lambda x: F.substr(x, F.length(head(x)) + F.lit(2))
    fresh = F.filter(pieces, lambda x: F.startswith(x, F.lit("<turn new ")))
    role = lambda x: F.substr(head(x), F.lit(len("<turn new ") + 1))
    turns = F.transform(fresh, lambda x: F.struct(unescape_role(role(x)).alias("role"), unescape(body(x)).alias("text")))
    loss = F.transform("targets", lambda x: unescape(F.substr("text", x["begin"] + 1, x["length"])))
    return formatted.withColumn("turns", turns).withColumn("loss", loss)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows: turns and loss texts as counts and sha256, and the characters written."""
    per = read_turns(formatted).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum(F.length("text")).cast("long").alias("formatted_chars")
    )
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["loss"])), "")
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
