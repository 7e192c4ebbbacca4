"""Chat formatting by prefix targets: every assistant turn becomes an example with all turns before it as context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The template: fixed control strings around each turn.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN ", "[/TURN]")
_CONTROL = r"/?(?:INST|SYS)\]|/?TURN[ \]]|/?s>"
_ESCAPE = re.compile(rf"([\[<])(\\*(?:{_CONTROL}))")
_UNESCAPE = re.compile(rf"([\[<])\\(\\*(?:{_CONTROL}))")
_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[TURN (?P<role>.*?)\](?P<other>.*?)\[/TURN\]", re.S)
EXAMPLES = "conv_id long, example int, text string, loss_start int, loss_end int"
#: Characters after which a batch of examples is handed on.
BATCH_CHARS = 4_000_000


def escaped(text: str) -> str:
    """Control strings get one backslash more after their first character; unescaped() takes one away, so the pair is reversible for any text."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role_escaped(role: str) -> str:
    return role.replace("%", "%25").replace("]", "%5D").replace("[", "%5B").replace("<", "%3C")


def _role_unescaped(role: str) -> str:
    return role.replace("%3C", "<").replace("%5B", "[").replace("%5D", "]").replace("%25", "%")


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends there."""
    mark = MARKS.get(role)
    opening, closing = mark if mark else (f"{OTHER[0]}{_role_escaped(role)}]", OTHER[1])
    body = escaped(text)
    return opening + body + closing, len(opening), len(opening) + len(body)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted example."""
    turns = []
    for m in _TURN.finditer(text):
        role = m.lastgroup
        if role == "other":
            turns.append((_role_unescaped(m["role"]), unescaped(m["other"])))
        else:
            turns.append((role, unescaped(m[role])))
    return turns


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; only the running context of one conversation is held."""
    out: list[tuple] = []
    held = 0
    conv, context, number, open_turns = object(), "", 0, False

    def flush() -> pa.RecordBatch:
        nonlocal out, held
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        out, held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "example", "text", "loss_start", "loss_end"])

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
            if conv_id != conv:
                if open_turns:
                    out.append((conv, number, context, len(context), len(context)))
                    held += len(context)
                conv, context, number, open_turns = conv_id, "", 0, False
            turn, start, end = formatted_turn(role, text)
            before, context, open_turns = len(context), context + turn, True
            if role == "assistant":
                out.append((conv, number, context, before + start, before + end))
                held, number, open_turns = held + len(context), number + 1, False
            if held > BATCH_CHARS:
                yield flush()
    if open_turns:
        out.append((conv, number, context, len(context), len(context)))
    yield flush()


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as training examples (conv_id, example, text, loss_start, loss_end).

    Each assistant turn gives one example: all turns before it as context, and only its own text under the loss mask (code points from
    loss_start to loss_end of the formatted text). Turns after the last reply give one more example with an empty mask, so that no turn is lost.
    A null text or role is empty; turns with equal numbers follow role and text; a null conv_id is a conversation of its own. Other columns of
    the input are not read. Conversations are dealt out by a hash and streamed in order: what a task holds is the context of one example.
    """
    narrow = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_examples, EXAMPLES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its examples, which follow each other; hashes are fed as the examples pass."""
    rows: list[tuple] = []
    conv, last, loss, loss_chars, chars = object(), None, hashlib.sha256(), 0, 0

    def close() -> None:
        turns = parsed(last)
        digest = hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        rows.append((conv, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for conv_id, _, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv_id != conv:
                if last is not None:
                    close()
                conv, loss, loss_chars, chars = conv_id, hashlib.sha256(), 0, 0
            target = unescaped(text[start:end])
            loss.update(target.encode())
            last, loss_chars, chars = text, loss_chars + len(target), chars + len(text)
    if last is not None:
        close()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=names)


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples hold, per conversation: its turns from the longest example, the trained text from the masks of all.

    The examples must come as prefix_target_examples() leaves them: a conversation's examples in one partition, in order.
    """
    return examples.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return read_back(prefix_target_examples(turns.unionByName(more)))
