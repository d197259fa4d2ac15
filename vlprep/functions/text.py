"""Text expressions: words, token ids, prompts and chat rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vlprep.config import (
    CLASS_TEMPLATE,
    MESSAGE_END,
    MESSAGE_START,
    SYSTEM_PROMPT,
    WORD_PATTERN,
)
from vlprep.functions.arrays import length_between
from vlprep.functions.keys import hash_key, key_choice, key_number

MATCH_LIMIT = 1024  # repetitions a match nests


def words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """All matches of ``pattern`` in the whole text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def at_least_words(text: Column, n: int) -> Column:
    """Whether a text has ``n`` white-space separated words or more; reading stops at the ``n``-th."""
    if n <= 0:
        return F.lit(True)
    return text.rlike(rf"^\s*+(?:\S++\s++){{{n - 1}}}\S")


def words_between(text: Column, low: int, high: int, pattern: str = WORD_PATTERN) -> Column:
    """``low < number of words < high``.

    For plain words a match decides, which ends as soon as the limit is passed;
    other patterns are counted.
    """
    if pattern == WORD_PATTERN and high <= MATCH_LIMIT:
        return at_least_words(text, low + 1) & ~at_least_words(text, high)
    return length_between(count_words(text, pattern), low, high)


def has_text(text: Column) -> Column:
    """Not null and not empty. White space alone counts as text."""
    return text.isNotNull() & (text != "")


def hash_ids(tokens: Column, size: int, first: int = 0) -> Column:
    """Ids of words without a vocabulary table: ``first + hash(word) mod size``."""
    return F.transform(
        tokens,
        lambda w: (F.pmod(key_number(F.md5(w)), F.lit(size).cast("bigint")) + F.lit(first)).cast("int"),
    )


def with_end(ids: Column, end_id: int) -> Column:
    """Append the end-of-text id."""
    return F.concat(ids, F.array(F.lit(end_id).cast("int")))


def message(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    content = F.lit(content) if isinstance(content, str) else content
    return F.struct(role.alias("role"), content.alias("content"))


def system_message(text: str = SYSTEM_PROMPT) -> Column:
    return message("system", text)


def render_message(role: Column, content: Column) -> Column:
    return F.concat(F.lit(MESSAGE_START), role, F.lit("\n"), content, F.lit(f"{MESSAGE_END}\n"))


def generation_suffix() -> Column:
    return F.lit(f"{MESSAGE_START}assistant\n")


def render_chat(messages: Column, add_generation_prompt: bool = False, template=render_message) -> Column:
    """Chat text of an ``array<struct<role, content>>``.

    ``template`` turns the two columns of one message into its text.
    """
    text = F.array_join(F.transform(messages, lambda m: template(m["role"], m["content"])), "")
    return F.concat(text, generation_suffix()) if add_generation_prompt else text


def pick_prompt(row_id, prompts: Sequence[str], seed=0) -> Column:
    """One of ``prompts`` per row, drawn by a seeded key of its id."""
    choice = key_choice(hash_key(seed, row_id), len(prompts))
    return F.get(F.array(*[F.lit(p) for p in prompts]), choice.cast("int"))


def class_prompt(name: Column, template: str = CLASS_TEMPLATE) -> Column:
    return F.format_string(template, name)


def clean_response(response: Column, prompt_chars: Column | int = 0) -> Column:
    """Answer text of a response: prompt dropped, trimmed, turn marks taken off.

    The trim comes first and is not repeated after the marks are removed.
    """
    start = F.lit(prompt_chars) if isinstance(prompt_chars, int) else prompt_chars
    body = F.regexp_replace(response.substr(start.cast("int") + 1, F.length(response)), r"^\s+|\s+$", "")
    body = F.when(
        body.startswith(MESSAGE_START), body.substr(F.lit(len(MESSAGE_START) + 1), F.length(body))
    ).otherwise(body)
    return F.when(
        body.endswith(MESSAGE_END), body.substr(F.lit(1), F.length(body) - F.lit(len(MESSAGE_END)))
    ).otherwise(body)


def json_member(json: Column, name: str, kind: str) -> Column:
    """One member of a JSON object with a declared type; malformed text gives null."""
    return F.from_json(json, f"`{name}` {kind}")[name]
