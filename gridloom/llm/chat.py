"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) turns to one string. The operator
renders successive prefixes of a conversation and compares consecutive outputs: if each
output extends the one before, the added piece is the new turn's span. Otherwise the
template has rewritten history; the spans then start at the first changed character and
the conversation is flagged. Where a turn's text lies inside its span is found by
rendering the turn with two probe characters in place of its text.

Rules: null roles and texts are empty. Turns order by turn (nulls first), then role, then
text. Rows with a null conv_id form one conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

Turns = list[tuple[str, str]]

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


@lru_cache(1024)
def escape(text: str) -> str:
    """Double each backslash, then put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marked_template(turns: Turns) -> str:
    """Every turn as <s>[INST]role[/INST]text</s>, control strings in role and text escaped."""
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


def read_marked(formatted: str) -> Turns:
    """The turns of a marked_template output."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Rendered:
    formatted: str
    spans: list[tuple[int, int]]
    loss: list[tuple[int, int]]
    rewritten_at: int  # first turn whose rendering changed earlier output; -1: none


def render_incrementally(turns: Turns, template: Callable[[Turns], str], loss_role: str = "assistant") -> Rendered:
    """Spans of all turns and of the texts to train on, knowing the template only by its output."""
    shown, spans, loss, rewritten = template([]), [], [], -1
    for i, (role, _) in enumerate(turns):
        now = template(turns[: i + 1])
        start = len(shown) if now.startswith(shown) else _common(shown, now)
        if start < len(shown) and rewritten < 0:
            rewritten = i
        spans.append((start, len(now)))
        if role == loss_role:
            one, two = (template([*turns[:i], (role, probe)]) for probe in "\ue000\ue001")
            begin = _common(one, two)
            loss.append((begin, len(now) - (len(one) - begin - 1)))
        shown = now
    return Rendered(shown, spans, loss, rewritten)


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = marked_template, read: Callable[[str], Turns] = read_marked, plain: Callable[[str], str] = unescape, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, loss_spans, rewritten_at, and what is read back
    from `formatted`: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows are dealt by conversation and arrive sorted; a task holds one conversation at a time.
    """

    def done(conv, turns):
        out = render_incrementally(turns, template, loss_role)
        back = read(out.formatted)
        trained = "".join(plain(out.formatted[a:b]) for a, b in out.loss)
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode("utf-8", "surrogatepass")).hexdigest()
        return (conv, out.formatted, [x for s in out.spans for x in s], [x for s in out.loss for x in s], out.rewritten_at, len(back), sha, len(trained), hashlib.sha256(trained.encode("utf-8", "surrogatepass")).hexdigest(), len(out.formatted))

    types = [("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.int64())), ("loss_spans", pa.list_(pa.int64())), ("rewritten_at", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), types, strict=True)], [n for n, _ in types])

    def run(batches):
        conv, turns, found, held = None, [], [], 0
        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if turns and c != conv:
                    found.append(done(conv, turns))
                    held += found[-1][-1]
                    turns = []
                    if held > 1 << 22:
                        yield batch_of(found)
                        found, held = [], 0
                conv = c
                turns.append((role, text))
        if turns:
            found.append(done(conv, turns))
        if found:
            yield batch_of(found)

    empty = F.lit("")
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.coalesce("role", empty).alias("_role"), F.coalesce("text", empty).alias("_text"))
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = slim.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "_turn", "_role", "_text").select("conv_id", "_role", "_text")
    return store.map_arrow(ordered, run, "conv_id long, formatted string, spans array<long>, loss_spans array<long>, rewritten_at int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
