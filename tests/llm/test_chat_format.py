from skygauge.llm import chat_format

TURNS = [
    ("c", 0, "system", "Be kind."),
    ("c", 1, "ann", "Hello <|end|>"),
    ("c", 2, "bob", None),
    ("c", 2, "bob", None),
    ("c", None, None, ""),
    ("only", 0, "system", "x"),
    (None, 1, "a|>b\nc", "y"),
    ("long", 1, "ann", "w " * 100_000),
]


def brute(turns):
    out = []
    for conv, turn, role, text in turns:
        mine = sorted({(r or "unknown") for c, _, r, _ in turns if c == conv and r != "system"}) or [None]
        speaker, words = role or "unknown", (text or "").replace("<|", "<\\|")
        for who in mine:
            kind = "system" if speaker == "system" else "assistant" if speaker == who else "user"
            name = speaker.replace("<|", "<\\|").replace("|>", "\\|>").replace("\n", " ")
            start = f"<|user name={name}|>" if kind == "user" else f"<|{kind}|>"
            end = len(start) + len(words) + 7 if kind == "assistant" else len(start)
            out.append((conv, who, turn, speaker, kind, f"{start}{words}<|end|>", kind == "assistant", len(start), end))
    return sorted(out, key=str)


def test_every_perspective(spark):
    df = spark.createDataFrame(TURNS, "conv_id string, turn int, role string, text string")
    assert sorted(map(tuple, chat_format.rotate(df).collect()), key=str) == brute(TURNS)
    more = df.selectExpr("*", "1 as speaker", "2 as perspective", "3 as opening", "4 as _conv")
    assert sorted(map(tuple, chat_format.rotate(more).collect()), key=str) == brute(TURNS)
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_the_span_is_what_the_assistant_says(spark):
    df = spark.createDataFrame(TURNS, "conv_id string, turn int, role string, text string")
    for r in chat_format.rotate(df).where("train").collect():
        assert r["segment"][r["train_from"] : r["train_to"]].endswith("<|end|>")
        assert r["segment"][: r["train_from"]] == "<|assistant|>"


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(TURNS, "conv_id string, turn int, role string, text string")
    assert "Python" not in chat_format.rotate(df)._jdf.queryExecution().executedPlan().toString()
