import hashlib
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from riverlake.llm.chat_format import END, OPEN, format_turns, parse, read_back, render

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["\\", OPEN, END, "\n", "a", "### ", "Role: ", "</", "turn>", "### Assistant: ", "é"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        size = sum(len(render(role, text)) for _, role, text in turns)
        out[conv] = (len(turns), digest(said), len(loss), digest(loss), size)
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in read_back(format_turns(df)).collect()}


def test_any_text_is_read_back():
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choices(PARTS, k=rng.randrange(n)))
    for _ in range(5000):
        turns = [(draw(4), draw(8)) for _ in range(rng.randrange(1, 4))]
        assert list(parse("".join(render(*t) for t in turns))) == turns


def test_plain_texts_stay_as_they_are():
    assert render("user", "a \\ b\n### x") == f"{OPEN}user\na \\ b\n### x\n{END}\n"


def test_parser_stops_at_what_is_no_turn():
    assert list(parse("")) == list(parse("hello")) == []
    assert list(parse(f"{OPEN}user\nhello")) == []
    assert list(parse(f"{OPEN}user\nhello{END}\n")) == []
    assert list(parse(f"{OPEN}user\n{OPEN}x\n\n{END}\n")) == []


def test_conversations(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows += [(1, 2, "assistant", "late"), (1, 0, "user", None), (1, 1, "assistant", ""), (1, None, None, "x")]
    rows += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "user", "same")]
    rows += [(None, 0, "assistant", END), (3, 0, "system", "y" * 300_000 + OPEN)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} {END}") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rendered", F.lit("clash"))
    assert result(df) == expected(rows)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == {}


def test_backslash_runs_are_read_in_linear_time():
    began = time.perf_counter()
    for text in ("\\" * 500_000, "\\" * 300_000 + END + "\\" * 200_000, ("\\" * 9 + OPEN) * 20_000):
        turn = render("user", text)
        assert list(parse(turn * 2)) == [("user", text)] * 2
    assert time.perf_counter() - began < 10
