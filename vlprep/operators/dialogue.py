"""Dialogues: turn pairing, validation, sample assembly and prompt history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vlprep.config import MAX_PAIRS, SYSTEM_PROMPT
from vlprep.functions.text import generation_suffix, message, render_chat, render_message, system_message
from vlprep.operators.filters import require_images
from vlprep.operators.ranking import null_safe_join, rank_in_group, take_per_group

TURN_WIDTH = 1024
HISTORY_CHUNK = 64


def first_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", max_pairs: int | None = MAX_PAIRS, keep: list[str] | None = None) -> DataFrame:
    """One row per conversation with its first ``2 * max_pairs`` messages, system ones left out.

    Later turns never change the outcome (see :func:`checked_pairs`), so each
    task drops them before the shuffle and the lists stay short however long a
    conversation is. With ``max_pairs=None`` the lists are whole, for uses that need every
    message in one row. A null role is kept, so that validation sees it.
    """
    spoken = turns.filter(~F.col(role).eqNullSafe("system")).select(conv, turn, role, text, *(keep or []))
    first = spoken if max_pairs is None else take_per_group(spoken, conv, turn, 2 * max_pairs)
    item = F.struct(F.col(turn), F.col(role).alias("role"), F.col(text).alias("content"))
    return first.groupBy(conv, *(keep or [])).agg(F.sort_array(F.collect_list(item)).alias("_items")).select(
        conv,
        *(keep or []),
        F.transform("_items", lambda m: message(m["role"], m["content"])).alias("messages"),
    )


def checked_pairs(messages: Column, max_pairs: int = MAX_PAIRS, roles: tuple[str, str] = ("user", "assistant"),
                  on_dangling: str = "skip") -> tuple[Column, Column]:
    """The pairs used of a message list, and whether they are valid.

    Only the first ``max_pairs`` pairs are used and checked: each is a question
    and an answer by ``roles`` in this order, neither empty. A message without
    an answer among them makes the list invalid (``skip``) or is left out
    (``truncate``); beyond them it is not looked at.
    """
    if on_dangling not in ("skip", "truncate"):
        raise ValueError(f"on_dangling must be 'skip' or 'truncate', got {on_dangling!r}")
    used = F.slice(messages, 1, 2 * max_pairs)
    whole = F.slice(used, F.lit(1), F.size(used) - F.size(used) % 2)

    def fits(m: Column, i: Column) -> Column:
        expected = F.when(i % 2 == 0, roles[0]).otherwise(roles[1])
        return F.coalesce((m["role"] == expected) & (F.length(m["content"]) > 0), F.lit(False))

    checks = F.transform(whole, fits)
    valid = F.forall(checks, lambda ok: ok)
    if on_dangling == "skip":
        valid = valid & (F.size(used) % 2 == 0)
    return whole, valid


def assemble(df: DataFrame, messages: str = "messages", max_pairs: int = MAX_PAIRS,
             roles: tuple[str, str] = ("user", "assistant"), on_dangling: str = "skip",
             keep_empty: bool = False, system: str = SYSTEM_PROMPT) -> DataFrame:
    """Valid dialogues with column ``n_pairs``, chat messages and rendered text."""
    pairs, valid = checked_pairs(F.col(messages), max_pairs, roles, on_dangling)
    out = df.filter(F.col(messages).isNotNull() & valid).withColumn("_pairs", pairs)
    if not keep_empty:
        out = out.filter(F.size("_pairs") > 0)
    chat = F.concat(
        F.array(system_message(system)),
        F.transform("_pairs", lambda m, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), m["content"])),
    )
    return (
        out.withColumn("n_pairs", (F.size("_pairs") / 2).cast("bigint"))
        .withColumn("chat", chat)
        .withColumn("text", render_chat(F.col("chat")))
        .drop("_pairs")
    )


def dialogue_samples(turns: DataFrame, images: DataFrame | None = None, conv: str = "conv_id",
                     image: str = "conv_id", **options) -> DataFrame:
    """Samples from a table of turns; conversations without their image are left out.

    The image test follows the reduction to the first turns, so a very long
    conversation is already small when it reaches the join.
    """
    keep = [] if image == conv else [image]
    lists = first_messages(turns, conv, max_pairs=options.get("max_pairs", MAX_PAIRS), keep=keep)
    if images is not None:
        lists = require_images(lists, images, image)
    return assemble(lists, **options)


def nested_samples(dialogues: DataFrame, images: DataFrame | None = None, roles: tuple[str, str] = ("user", "gpt"),
                   **options) -> DataFrame:
    """Samples from nested dialogue documents. Lists are already whole: no shuffle but the image join's."""
    kept = require_images(dialogues, images) if images is not None else dialogues
    each = kept.select("image_id", F.posexplode("conversations").alias("conv_no", "_conv")).withColumn(
        "conv_no", F.col("conv_no").cast("bigint")
    )
    lists = each.select(
        "image_id",
        "conv_no",
        F.col("_conv.topic").alias("topic"),
        F.transform("_conv.content", lambda m: message(m["from"], m["value"])).alias("messages"),
    )
    return assemble(lists, roles=roles, **options)


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Turns without system messages, numbered from zero in each conversation (column ``at``)."""
    return rank_in_group(turns.filter(~F.col(role).eqNullSafe("system")), conv, turn, "at", width=TURN_WIDTH)


def pair_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Questions with the message that follows, one row per pair; a last one without answer has nulls.

    Grouped by (conversation, pair), never by conversation alone.
    """
    at = numbered_turns(turns, conv, turn, role)
    first, second = F.col("at") % 2 == 0, F.col("at") % 2 == 1
    return (
        at.withColumn("pair", F.expr("at div 2"))
        .groupBy(conv, "pair")
        .agg(
            F.max(F.when(first, F.col(role))).alias("question_role"),
            F.max(F.when(first, F.col(text))).alias("question"),
            F.max(F.when(second, F.col(role))).alias("answer_role"),
            F.max(F.when(second, F.col(text))).alias("answer"),
        )
    )


def _chunks(turns: DataFrame, conv: str, turn: str, role: str, text: str, chunk: int) -> DataFrame:
    at = numbered_turns(turns, conv, turn, role)
    piece = render_message(F.col(role), F.col(text))
    item = F.struct("at", F.col(turn).alias("turn"), F.col(role).alias("role"), piece.alias("piece"))
    return (
        at.withColumn("chunk", F.expr(f"at div {int(chunk)}"))
        .groupBy(conv, "chunk")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )


def history_prompts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                    chunk: int = HISTORY_CHUNK, system: str = SYSTEM_PROMPT, answer_role: str = "assistant") -> DataFrame:
    """The end of the prompt of every answer: the messages of its chunk before it, ready for generation.

    The whole prompt is the text of the first ``prior_chunks`` rows of
    :func:`transcript_chunks`, followed by ``prompt_tail``; :func:`whole_prompts` puts
    them together for chosen answers. So no task ever gathers more than ``chunk``
    messages, and a conversation of any length gives output linear in its length.
    """
    chunks = _chunks(turns, conv, turn, role, text, chunk)
    head = F.when(F.col("chunk") == 0, render_chat(F.array(system_message(system)))).otherwise(F.lit(""))
    answers = chunks.select(conv, "chunk", "items", F.explode("items").alias("m")).filter(F.col("m.role") == answer_role)
    before = F.slice("items", F.lit(1), (F.col("m.at") - F.col("chunk") * chunk).cast("int"))
    return answers.select(
        conv,
        F.col("m.turn").alias(turn),
        F.col("chunk").alias("prior_chunks"),
        F.col("m.at").alias("n_messages"),
        F.concat(head, F.array_join(F.transform(before, lambda x: x["piece"]), ""), generation_suffix()).alias("prompt_tail"),
    )


def transcript_chunks(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      chunk: int = HISTORY_CHUNK, system: str = SYSTEM_PROMPT) -> DataFrame:
    """Rendered conversations in rows of ``chunk`` messages; the first one starts with the system message."""
    head = F.when(F.col("chunk") == 0, render_chat(F.array(system_message(system)))).otherwise(F.lit(""))
    return _chunks(turns, conv, turn, role, text, chunk).select(
        conv, "chunk", F.concat(head, F.array_join(F.transform("items", lambda x: x["piece"]), "")).alias("text")
    )


def whole_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                chunk: int = HISTORY_CHUNK, add_generation_prompt: bool = False) -> DataFrame:
    """The rendered text of each conversation, system turns included, as ``chat``.

    Messages are rendered in the tasks that read them and joined by (conversation, range of ``chunk`` turns), then by
    ranges of ``chunk`` ranges; only the last step works on a conversation as a whole, on few long pieces.
    """
    pieces = turns.select(conv, F.col(turn).alias("_at"), render_message(F.col(role), F.col(text)).alias("_piece"))

    def joined(rows: DataFrame, *by: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("_at", "_piece")))
        return rows.groupBy(conv, *by).agg(F.array_join(F.transform(parts, lambda x: x["_piece"]), "").alias("_piece"))

    for _ in range(2):
        ranged = pieces.withColumn("_range", F.floor(F.col("_at") / chunk))
        pieces = joined(ranged, "_range").withColumnRenamed("_range", "_at")
    end = generation_suffix() if add_generation_prompt else F.lit("")
    return joined(pieces).select(conv, F.concat("_piece", end).alias("chat"))


def whole_prompts(history: DataFrame, chunks: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Chosen rows of :func:`history_prompts` with ``prompt``: all messages before the answer.

    ``chunks`` are the conversations' :func:`transcript_chunks` of the same chunk size. A prompt
    is as long as the dialogue before it, so choose the answers to be generated.
    """
    wanted = history.filter("prior_chunks > 0").select(conv, "n_messages", "prior_chunks")
    before = null_safe_join(chunks, wanted, [conv]).filter("chunk < prior_chunks")
    parts = F.sort_array(F.collect_list(F.struct("chunk", "text")))
    heads = before.groupBy(conv, "n_messages").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("_head"))
    joined = null_safe_join(history, heads, [conv, "n_messages"], "left")
    return joined.withColumn("prompt", F.concat(F.coalesce("_head", F.lit("")), "prompt_tail")).drop("_head", "prior_chunks", "prompt_tail")


def opening_prompts(messages: Column, system: str = SYSTEM_PROMPT) -> Column:
    """Prompt text of the first question: what stands before its answer."""
    first = F.get(messages, F.lit(0))
    return render_chat(
        F.array(system_message(system), message("user", first["content"])), add_generation_prompt=True
    )
