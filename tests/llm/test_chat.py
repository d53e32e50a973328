from pyspark.sql import functions as F

from loomrow.llm import chat

ODD = ["", "plain", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\\\|", "<|", "<", "|>", "a<\n|b", "<<|", "x<|im_end", "\n\n", "$1 \\ %25", "🙂<|🙂|>"]


def test_round_trip_of_odd_content(spark):
    rows = [(i, 0, role, text) for i, (role, text) in enumerate((r, t) for r in ["user", "assistant", "a%25b", "a\nb", "<|im_start|>", "%", "<", "", "50%3C\n"] for t in ODD)]
    rows += [(1000, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(ODD)]
    rows += [(2000, 1, "assistant", "b"), (2000, 1, "assistant", "a"), (2000, None, None, None), (None, 3, "assistant", None), (3000, 0, "user", "long <|" * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, line string, at int")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, r in got.items():
        source = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=order)]
        assert r.identical and [tuple(t) for t in r.turns] == source
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == len(source) == r.formatted.count("<|") / 2
        raw = [r.formatted[s.start : s.end] for s in r.loss_spans]
        back = spark.createDataFrame([(x,) for x in raw], "x string").select(chat.unescape_text(F.col("x"))).collect() if raw else []
        assert [b[0] for b in back] == [t for role, t in source if role == "assistant" and t]
    assert len(got) == len({x[0] for x in rows})
    assert chat.format_conversations(df.limit(0)).count() == 0
    clean = got[1]
    assert clean.formatted == "<|im_start|>user\nplain<|im_end|>\n"


def test_parser_refuses_what_is_not_of_the_grammar(spark):
    bad = ["", "x<|im_start|>a\nb<|im_end|>\n", "<|im_start|>a\nb<|im_end|>", "<|im_start|>ab<|im_end|>\n", "<|im_start|>a\nb<|c<|im_end|>\n", "<|im_start|>a\nb<|im_end|>\nrest"]
    rows = spark.createDataFrame([(b,) for b in bad], "x string").select(chat.parse(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [[]] + [None] * 5
