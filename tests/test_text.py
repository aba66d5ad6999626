import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave import vocab
from tallyweave.functions import dates as d, jsons as js, text as tx
from tallyweave.functions.text import overlapping_spans
from tallyweave.operators import matching as mt


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_short_text_is_one_chunk(spark):
    assert one(spark, tx.chunk_text("t", 10, 3), t="Short text") == ["Short text"]


def test_sentences(spark):
    got = one(spark, tx.chunk_text("t", 16), t="First part. Second part. Third section.")
    assert got == ["First part.", "Second part.", "Third section."]


def test_overlap_ends_and_covers(spark):
    text = "First segment. Second segment. Third segment."
    got = one(spark, tx.chunk_text("t", 15, 5), t=text)
    assert got[0] == "First segment." and got[-1].endswith("segment.")
    assert all(got) and len(got) < len(text)


def test_newlines(spark):
    got = one(spark, tx.chunk_text("t", 10, 3), t="Line one\nLine two\nLine three")
    assert all(c.strip() for c in got)


def holds(chunks, text, size, overlap):
    """Chunks (begin, end) keep the rule: in order, covering, bounded, ended on the last break within reach."""
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text)
    assert all(end - begin <= size + 1 for begin, end in chunks)
    assert all(b[0] == a[1] - overlap and b[0] > a[0] for a, b in zip(chunks, chunks[1:]))
    for begin, end in chunks[:-1]:
        assert end - begin > overlap
        breaks = [i + 1 for i in range(begin + max(1, overlap), begin + size + 1) if text[i:i + 1] in (".", "\n")]
        assert end == (breaks[-1] if breaks else begin + size)


@settings(max_examples=300, suppress_health_check=list(HealthCheck))
@given(st.text("ab. \n", min_size=13, max_size=80), st.integers(3, 12), st.data())
def test_overlap_properties(text, size, data):
    overlap = data.draw(st.integers(1, size - 1))
    holds(overlapping_spans(text, size, overlap), text, size, overlap)


def test_no_tiny_chunks_before_a_long_run():
    text = "Twenty-one character." + "x" * 2000
    assert all(end - begin > 50 for begin, end in overlapping_spans(text, 500, 50)[:-1])


def test_chunk_rule(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab.\né") for _ in range(rnd.randrange(18, 120))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size in (2, 5, 17):
        rule = F.regexp_extract_all("t", F.lit(rf"(?s).{{1,{size - 1}}}\z|.{{1,{size}}}[.\n]|.{{{size}}}"), F.lit(0))
        for x in df.select("t", tx.chunk_text("t", size).alias("c"), rule.alias("r")).collect():
            assert "".join(x.r) == x.t and [p.strip() for p in x.r] == x.c
            ends = [sum(map(len, x.r[:k])) for k in range(len(x.r) + 1)]
            holds(list(zip(ends, ends[1:])), x.t, size, 0)


def test_overlap_in_spark(spark):
    text = "One. Two three four. Five\nsix seven eight nine. Ten."
    got = one(spark, tx.chunk_text("t", 12, 4), t=text)
    assert got == [text[a:b].strip() for a, b in overlapping_spans(text, 12, 4)]


def test_budget_is_met(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcd .") for _ in range(rnd.randrange(0, 9000))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chars in (3, 4, 5):
        fitted = tx.fit_budget("t", 60, lambda c, chars=chars: F.ceil(F.length(c) / chars))
        for x in df.select("t", fitted.alias("f")).collect():
            assert x.t.startswith(x.f.lstrip()) or x.f.strip() in x.t
            assert math.ceil(len(x.f) / chars) <= 60 or len(x.f) == 140
            assert x.f == x.t or math.ceil(len(x.t) / chars) > 60
    assert one(spark, tx.fit_budget(F.lit(None).cast("string"), 5)) == ""


def test_markup(spark):
    assert one(spark, tx.strip_html("t"), t=" <p>a &amp;lt; b</p> ") == "a < b"
    assert one(spark, tx.strip_html(F.lit(None).cast("string"))) == ""
    html = one(spark, tx.markdown_to_html("t"), t="**b** *i* $$x$$")
    assert "<strong>b</strong> <em>i</em>" in html and '<span class="math"></span>' in html
    assert '<div class="math">x</div>' in one(spark, tx.markdown_to_html("t", display_math_first=True), t="$$x$$")


def test_small_formats(spark):
    assert one(spark, tx.slugify("t"), t=" Hello, World! ") == "hello-world"
    assert one(spark, tx.truncate("t", 3), t="abcd") == "abc..."
    assert one(spark, tx.format_currency(F.lit(-1234.5), "USD")) == "-$1,234.50"
    assert one(spark, tx.format_currency(F.lit(1234.5), "JPY")) == "¥1,235"
    assert one(spark, tx.format_number(F.lit(1000.0))) == "1,000"
    assert one(spark, tx.format_number(F.lit(1234.5678))) == "1,234.568"
    assert one(spark, tx.is_strong_password("t"), t="Passw0rd!") and not one(spark, tx.is_strong_password("t"), t="Passw0rd")
    assert not one(spark, tx.is_valid_email("t"), t="a@b.c\n")
    assert one(spark, tx.highlight("t", ["zz"]), t="abc") is None
    assert one(spark, tx.bullets("t"), t="x\n - one\n--two\n-  three ") == ["one", "-two", "three"]
    assert one(spark, tx.numbered_list(F.split("t", ",")), t="a,b") == "1. a\n2. b"


def test_answers(spark):
    text = "complexity:  HIGH\nReasoning: short\nrest"
    assert one(spark, tx.labelled_field("t", "complexity"), t=text) == "high"
    assert one(spark, tx.labelled_field("t", "message"), t=text) == text
    assert one(spark, tx.labelled_field("t", "complexity"), t="none") == "low"
    assert one(spark, tx.priority("t"), t="Continue, but URGENT") == "high"
    assert one(spark, tx.escalate(F.lit("low"), "t"), t="signs of Ketoacidosis") == "high"
    assert one(spark, tx.valid_outcome(F.lit("sales"), "t"), t=" NoSale\n") == "NoSale"
    assert one(spark, tx.valid_outcome(F.lit("support"), "t"), t="NoSale") is None
    assert one(spark, tx.mention_notes("t"), t="Rice and beans")[0].startswith("- beans: Low")


def test_routing_is_literal(spark):
    # "and" is a word of one role, so any text with "and" in it counts for that role.
    scores = {s["role"]: s["score"] for s in one(spark, mt.routing_scores("t"), t="sandwich")}
    assert scores[vocab.ROLES[2]] == 5 and scores[vocab.ROLES[0]] == 0
    scores = {s["role"]: s["score"] for s in one(spark, mt.routing_scores("t"), t="chronic pain and diet")}
    assert scores[vocab.ROLES[0]] == 10 and scores[vocab.ROLES[4]] == 3
    top = one(spark, mt.route_topk("t", 2), t="nothing")
    assert [x["role"] for x in top] == vocab.ROLES[:2]


def test_coverage(spark):
    got = one(spark, mt.coverage("t"), t="An MRI scan at a Specialist")
    assert got["coverage"] == 80 and got["requires_preauth"] and got["approval_rate"] == 85.0
    got = one(spark, mt.coverage("t"), t="Specialist visit")
    assert got["notes"].endswith("(Requires referral)") and got["requires_preauth"]
    got = one(spark, mt.coverage("t"), t="hello")
    assert not got["covered"] and got["coverage"] == 0


def test_dates(spark):
    day = F.lit("2024-05-03 04:05:06").cast("timestamp")
    assert one(spark, d.format_date(day, "MMMM MMM MM dddd 'x' DD/HH:mm:ss")) == "May May 05 Friday 'x' 03/04:05:06"
    assert one(spark, d.duration_mmss(F.lit(125))) == "2:05"
    assert one(spark, d.is_valid_date("t"), t="2024-02-30") is False
    due = spark.createDataFrame([("a", "2024-01-31", "monthly"), ("b", "2024-03-05", None)], "id string, due_date string, repeat string")
    got = d.expand_reminders(due, "2024-02-01", "2024-03-31").orderBy("id", "occurrence").collect()
    assert [str(x.occurrence) for x in got] == ["2024-02-29", "2024-03-31", "2024-03-05"]


def test_tool_calls(spark):
    assert one(spark, js.extract_tool_call("t"), t="plain") is None
    bad = one(spark, js.extract_tool_call("t"), t="[SKILL_START]{oops[SKILL_END]")
    assert bad["error"] == "PARSE_ERROR" and bad["name"] is None
    assert one(spark, js.parse_command("t"), t="not json")["intent"] == "unknown"
    merged = one(spark, js.merge_preferences(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"),
                                             F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))))
    assert merged == {"a": "2", "b": "3"}
