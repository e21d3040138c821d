from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators.packed import packed_choices, split_values, tokenize

CHOICES = sorted(["Less than 5; more than calm", "At the gym, alone", "Gym | indoors", 'I felt "calm"', "Can't tell (calm)", "Bored", "1,210 steps"], key=lambda c: (-len(c), c))


def notations(values):
    doubled = lambda v: '"' + v.replace('"', '""') + '"'
    for mark in (";", "; ", ",", ", ", "|", " | ", "\t", "\n", "；", " ;"):
        yield mark.join(values)
        yield f"[{mark.join(values)}]"
        yield mark.join(map(doubled, values))
    yield " ".join(map(doubled, values))
    yield json.dumps(values)
    yield repr(values)
    yield "; ;".join(values) + " ; "
    yield ";" + ";".join(values) + ";;"


def test_every_notation_gives_the_choices_back():
    rnd = random.Random(2)
    for _ in range(40):
        values = rnd.sample(CHOICES, rnd.randrange(1, len(CHOICES)))
        for text in notations(values):
            assert tokenize(text, CHOICES) == values, text


@pytest.mark.parametrize("text", [None, "", "  ", "NOT_PRESENTED", "NO_ANSWER_SELECTED", "[]", ";;;", "unknown thing"])
def test_nothing(text):
    assert tokenize(text, CHOICES) == []


def test_without_choices_and_damaged_quotes():
    assert tokenize("a; 'b;c' ;\"d\"\"e\"") == ["a", "b;c", 'd"e']
    assert tokenize("'open; b") == ["'open", "b"]
    assert tokenize(r"['it\'s', 'x']") == ["it's", "x"]
    assert len(tokenize("ab;" * 20_000)) == 20_000


def test_table(spark):
    history = spark.createDataFrame(
        [("s", json.dumps([{"question_id": "q", "answers": [{"text": c} for c in CHOICES]}])), ("s", None), ("s", "[]"), ("s", "{broken"), ("s", '[{"question_id": "r"}]')], "survey_id string, survey_json string"
    )
    row = ("p", "s", "q", "checkbox", None, "Bored;At the gym, alone", "[Bored]")
    rows = [row, row, ("p", None, "q", "Radio Button Question", None, None, "NOT_PRESENTED"), ("p", "s", "q", "slider", None, "Bored", "Bored"), ("p", "s", None, "checkbox", None, "Bored", "Bored"), ("p", "s", "r", None, None, "Bored", "Bored")]
    answers = spark.createDataFrame(rows, "participant string, survey_id string, question_id string, question_type string, question_text string, answer_options string, answer string")
    answers = answers.withColumn("choices", F.lit("clash")).withColumn("value", F.lit(1))
    got = sorted((r.field, r.pos, r.val) for r in packed_choices(answers, history, F.lit(7).cast("long")).collect())
    assert got == [("answer", 1, "Bored"), ("answer_options", 1, "Bored"), ("answer_options", 2, "At the gym, alone")]
    assert packed_choices(answers.limit(0), history, F.lit(7).cast("long")).count() == 0
    assert split_values(answers.limit(1), "answer_options", ["participant"]).count() == 3
