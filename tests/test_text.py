"""Text rules on literal rows that the given tables cannot show."""

import pytest
from pyspark.sql import functions as F

from turnloom import fixed_values as fv
from turnloom.functions import text, tokens
from turnloom.operators import labels


def plain(x):
    return x.replace("\xa0", " ").replace("  ", " ").strip()


@pytest.mark.parametrize("value", [
    "\xa0both ends\xa0", "three   blanks", "", "   ", "a \xa0 b", " em　", "\x1ctail\x1f",
    "line\n", "a\xa0\xa0\xa0b",
])
def test_norm_space_is_one_pass_and_unicode(one, value):
    assert one(text.norm_space("x"), "x string", value) == plain(value)
    assert one(text.norm_topic("x"), "x string", value.upper()) == plain(value.upper()).lower()


@pytest.mark.parametrize("value", ['A  "B"\xa0 c ', "\xa0\xa0x", 'say "hi"'])
def test_norm_answer_replaces_blanks_before_nbsp(one, value):
    want = value.replace("  ", " ").replace("\xa0", " ").lower().strip()
    assert one(text.norm_answer("x"), "x string", value) == want
    want = value.replace("  ", " ").replace("\xa0", " ").replace('"', "").lower().strip()
    assert one(text.norm_answer("x", True), "x string", value) == want


@pytest.mark.parametrize("value, want", [
    ("a[SEP]b[SEP]", "a\nb"), ("[SEP]", ""), ("", ""), ("a[SEP][SEP]", "a\n"), ("a", "a"),
    ("a\n", "a"),
])
def test_dialog_text_drops_one_newline(one, value, want):
    assert one(text.dialog_text("x"), "x string", value) == want


def test_response_text(one):
    assert one(text.response_text("x"), "x string", "a[SEP]b[SEP]") == "ab"


@pytest.mark.parametrize("value, want", [
    ("age: 3", "None"), ("", "None"),
    ("age: 3|Accepted movies: X | rejected music: Y|job", "Accepted movies: X | rejected music: Y"),
    ("ACCEPTED food: a\xa0", "ACCEPTED food: a"),
])
def test_profile_filter(one, value, want):
    assert one(text.profile_filter("x"), "x string", value) == want


def test_rationale_and_tail_with_two_markers(one):
    value = " why. Therefore, a. Therefore, b"
    assert one(text.rationale("x"), "x string", value) == "why."
    assert one(text.after_last("x", "Therefore"), "x string", value) == ", b"
    assert one(text.after_last("x", "Therefore"), "x string", "none") == "none"
    assert one(text.parse_response("x"), "x string", "p ### Response: q ### Response: r \n") == "r"


def test_whitespace_set_and_shorthand_agree(spark):
    """The shorthand class of the token patterns is the white space of the strip."""
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, x string")
    rows = df.select("c", F.rlike("x", F.lit(r"(?U)^" + tokens._W + "$")).alias("m"),
                     (text.strip("x") == "").alias("s")).collect()
    assert {r.c for r in rows if r.m} == {ord(w) for w in fv.WHITESPACE}
    assert {r.c for r in rows if r.s} == {ord(w) for w in fv.WHITESPACE}
    assert all(chr(r.c).isspace() == r.m for r in rows)


CUTS = ["a b c", "  a\nb  c ", "a\xa0b　c d", "", "   ", "one", "a b c   ", "a\n\nb\n\nc"]


def cut_head(x, n):
    import re
    found = re.findall(r"\s*\S+", x)
    return x if len(found) <= n else "".join(found[:n])


def cut_tail(x, n):
    import re
    found = re.findall(r"\S+\s*", x)
    return x if len(found) <= n else "".join(found[-n:])


@pytest.mark.parametrize("value", CUTS)
@pytest.mark.parametrize("n", [1, 2, 3])
def test_cuts_keep_inner_white_space(one, value, n):
    assert one(tokens.truncate_head("x", n), "x string", value) == cut_head(value, n)
    assert one(tokens.truncate_tail("x", n), "x string", value) == cut_tail(value, n)


def test_tail_zero_keeps_everything(one):
    assert one(tokens.truncate_tail("x", 0), "x string", "a b c") == "a b c"
    assert one(tokens.truncate_head("x", 0), "x string", "a b c") == ""


def test_long_text_is_cut_without_deep_recursion(one):
    value = "word " * 50_000
    assert one(F.length(tokens.truncate_head("x", 20_000)), "x string", value) == 99_999


def test_user_tokenizer(spark):
    vocab = tokens.Tokenizer(
        encode=lambda s: [ord(c) for c in s], decode=lambda ids: "".join(map(chr, ids)), eos_id=0)
    df = spark.createDataFrame([("abcdef", [["abc", " d "], []])], "x string, ls array<array<string>>")
    row = df.select(
        tokens.truncate_head("x", 2, vocab).alias("h"), tokens.truncate_tail("x", 2, vocab).alias("t"),
        tokens.truncate_lists("ls", 2, vocab).alias("ls"), tokens.input_ids("x", True, vocab).alias("ids"),
    ).collect()[0]
    assert (row.h, row.t, row.ls) == ("ab", "ef", [["ab", "d"], []])
    assert row.ids == [97, 98, 99, 100, 101, 102, 0]


def test_start_token_in_examples_not_in_cuts(spark):
    vocab = tokens.Tokenizer(
        encode=lambda s: [ord(c) for c in s], decode=lambda ids: "".join(map(chr, ids)), eos_id=0, bos_id=1)
    df = spark.createDataFrame([("abc", "ab"), ("", ""), (None, None)], "example string, prompt string")
    out = labels.mask_prompt(labels.tokenize_example(df, tok=vocab), tok=vocab)
    rows = out.select("input_ids", "attention_mask", "labels", tokens.truncate_head("example", 2, vocab)).collect()
    assert tuple(rows[0]) == ([1, 97, 98, 99, 0], [1] * 5, [-100, -100, -100, 99, 0], "ab")
    assert tuple(rows[1]) == ([1, 0], [1, 1], [-100, 0], "")
    assert rows[2][0] is None and rows[2][3] is None


def test_eos_is_added_once(one):
    assert one(tokens.input_ids("x", True), "x string", "a b") == ["a", " b", "</s>"]
    assert one(tokens.input_ids("x", True), "x string", "a</s> b") == ["a</s>", " b", "</s>"]
    assert one(tokens.input_ids("x", False), "x string", "") == []
    assert one(tokens.input_ids("x", True), "x string", "</s>") == ["</s>"]


def test_mask(one):
    ids = ["a", "b", "c"]
    out = one(tokens.mask_prompt_labels("x", F.lit(2)), "x array<string>", ids)
    assert out == ["-100", "-100", "c"]
    assert one(tokens.mask_prompt_labels("x", F.lit(9)), "x array<string>", ids) == ["-100"] * 3
