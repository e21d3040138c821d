"""Several values packed in one field: a quote-aware finite-state tokenizer."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that may stand between values, open or close a list, or quote a value.
DELIMITERS = frozenset(";,|\t\n\r\uff1b\uff0c\u3001")
OPENING, CLOSING, QUOTES = frozenset("[({"), frozenset("])}"), frozenset("\"'")
BLANKS = frozenset(" \u00a0\u2002\u2003\u2009\u200b\u202f\u3000\ufeff")
_BLANKS = "".join(BLANKS)
ABSENT = ("", "NOT_PRESENTED", "NO_ANSWER_SELECTED")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    """The value of the quoted run that begins at ``at`` and the place after it; None if it isn't one."""
    quote, out, i, n = text[at], [], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            follower = text[i + 1]
            if follower == "u" and i + 5 < n:
                try:
                    out.append(chr(int(text[i + 2 : i + 6], 16)))
                    i += 6
                    continue
                except ValueError:
                    pass
            out.append(_ESCAPES.get(follower, follower))
            i += 2
        elif c == quote:
            if i + 1 < n and text[i + 1] == quote:
                out.append(quote)
                i += 2
            elif _ends(text, i + 1) or _next_quoted(text, i + 1, quote):
                return "".join(out), i + 1
            else:
                out.append(c)
                i += 1
        else:
            out.append(c)
            i += 1
    return None


def _next_quoted(text: str, at: int, quote: str) -> bool:
    """Whether blanks alone part a closed value from another quoted one."""
    start, n = at, len(text)
    while at < n and text[at] in BLANKS:
        at += 1
    return start < at < n and text[at] == quote


def _ends(text: str, at: int) -> bool:
    """Whether a value may end before place ``at``: blanks, then a delimiter, a closing mark or the end."""
    n = len(text)
    while at < n and text[at] in BLANKS:
        at += 1
    return at >= n or text[at] in DELIMITERS or text[at] in CLOSING


class Choices(frozenset):
    """Listed choices and the length of the longest."""

    def __init__(self, choices: Iterable[str] = ()):
        self.longest = max(map(len, self), default=0)


def _joined(text: str, at: int, ends: Sequence[int], first: int, allowed: Choices) -> tuple[str, int] | None:
    """The longest run of plain pieces from ``at`` that together are a listed choice, and its end; ``ends[first]`` is the first piece's."""
    found = None
    for k in range(first, len(ends)):
        value = text[at : ends[k]]
        bare = value.rstrip(_BLANKS)
        if len(bare) > allowed.longest:
            break
        if value in allowed or bare in allowed:
            found = (value if value in allowed else bare), ends[k]
    return found


def tokenize(text: str | None, choices: Iterable[str] = ()) -> list[str]:
    """The values of ``text`` in their order.

    States: between values (blanks and delimiters are passed, list marks change the depth), in a
    quoted value (escapes and doubled quotes are resolved) and in a plain one, which ends at a
    delimiter or, within a list, at a closing mark. With ``choices``, values that are none are
    handled as follows: the pieces of plain values are put together again as long as a choice
    that holds delimiters of its own can come of them, the longest first; a quoted run that
    holds several choices is taken apart, and one that holds none may be the beginning of a
    plain value; what is still no choice is left out. Null, blank and absent markers give no value.
    """
    if text is None or text.strip() in ABSENT:
        return []
    allowed = choices if isinstance(choices, Choices) else Choices(choices)
    ends = [*(k for k, c in enumerate(text) if c in DELIMITERS or c in CLOSING), len(text)]  # where a plain value may end
    out: list[str] = []
    i, n, depth = 0, len(text), 0
    while i < n:
        c = text[i]
        if c in BLANKS or c in DELIMITERS:
            i += 1
            continue
        if c in CLOSING and depth:
            depth -= 1
            i += 1
            continue
        if c in QUOTES and (got := _quoted(text, i)):
            value, end = got
            inner = [value] if not allowed or value in allowed else [value.strip()] if value.strip() in allowed else tokenize(value, allowed)
            if inner or not allowed:
                out += inner
                i = end
                continue
        first = bisect_left(ends, i)
        whole = _joined(text, i, ends, first, allowed) if allowed else None
        if whole is not None:
            out.append(whole[0])
            i = whole[1]
        elif c in OPENING:
            depth += 1
            i += 1
        else:
            end = next(ends[k] for k in range(first, len(ends)) if ends[k] > i and (ends[k] == n or text[ends[k]] in DELIMITERS or depth))
            if not allowed:
                out.append(text[i:end].strip())
            i = end
    return out


def listed_choices(history: DataFrame) -> DataFrame:
    """``question_id, choices``: every answer text that any version lists.

    Null, empty and broken ``survey_json`` list nothing.
    """
    schema = "array<struct<question_id:string,answers:array<struct<text:string>>>>"
    return (
        history.select(F.explode(F.from_json("survey_json", schema)).alias("q"))
        .select("q.question_id", F.explode("q.answers.text").alias("text"))
        .where(F.col("question_id").isNotNull() & (F.trim("text") != ""))
        .groupBy("question_id")
        .agg(F.collect_set("text").alias("choices"))
    )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each field; a group's choices are read once a task, fields seen before come from a bounded table."""
    listed: dict[str | None, Choices] = {}
    known: dict[tuple, list[str]] = {}
    for batch in batches:
        fields, groups = batch.column("value").to_pylist(), batch.column("choices_of").to_pylist()
        origin, places, values = [], [], []
        for row, key in enumerate(zip(groups, fields, strict=True)):
            if (got := known.get(key)) is None:
                if key[0] not in listed:
                    listed[key[0]] = Choices(batch.column("choices")[row].as_py())
                if len(known) > 50_000:
                    known.clear()
                got = known[key] = tokenize(key[1], listed[key[0]])
            origin += [row] * len(got)
            places += range(1, len(got) + 1)
            values += got
        keep = batch.select([x for x in batch.schema.names if x not in ("value", "choices", "choices_of")]).take(pa.array(origin, pa.int64()))
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(places, pa.int64()), pa.array(values, pa.string())], names=[*keep.schema.names, "pos", "val"])


def packed_choices(answers: DataFrame, history: DataFrame, answers_ms) -> DataFrame:
    """One row per choice in ``answer_options`` and ``answer`` of radio and checkbox questions.

    Returns ``participant, survey_id, answers_ms, question_id, field, pos, val``; ``pos``
    counts the choices of the field from 1. Repeated rows count once; null, blank,
    "NOT_PRESENTED" and "NO_ANSWER_SELECTED" fields and questions without listed choices give
    no row; null participants, surveys and times are kept as null. Empty tables give an empty
    result; extra columns are ignored except that they make rows distinct no more.
    """
    kinds = F.lower(F.coalesce("question_type", F.lit("")))
    rows = (
        answers.where(kinds.contains("radio") | kinds.contains("checkbox"))
        .select("participant", "survey_id", answers_ms.alias("answers_ms"), "question_id", "question_type", "question_text", "answer_options", "answer")
        .distinct()
        .drop("question_type", "question_text")
    )
    fields = (
        rows.join(listed_choices(history), "question_id")
        .select("participant", "survey_id", "answers_ms", "question_id", F.col("question_id").alias("choices_of"), "choices", F.explode(F.create_map(F.lit("answer_options"), F.col("answer_options"), F.lit("answer"), F.col("answer"))).alias("field", "value"))
        .where(F.col("value").isNotNull() & ~F.trim("value").isin(*ABSENT))
    )
    return fields.mapInArrow(
        _split, "participant string, survey_id string, answers_ms long, question_id string, field string, pos long, val string"
    )


def split_values(df: DataFrame, field: str, keys: Sequence[str]) -> DataFrame:
    """Values of any packed ``field`` without a list of choices: ``*keys, pos, val``."""
    columns = df.select(*keys, F.col(field).alias("value"), F.lit("").alias("choices_of"), F.array().cast("array<string>").alias("choices"))
    kinds = dict(columns.dtypes)
    return columns.where(F.col("value").isNotNull()).mapInArrow(_split, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pos long, val string")
