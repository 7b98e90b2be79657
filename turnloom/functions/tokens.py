"""Token cuts and token arrays.

The native token is a word with the white space before it, so a cut keeps the text inside it
unchanged (line breaks between turns survive). A ``Tokenizer`` replaces it with a subword
vocabulary through one Arrow-batched pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from turnloom.fixed_values import IGNORED_LABEL
from turnloom.functions.text import col, strip

# The white space set as a shorthand class, which Java tests about eight times as fast as the
# list of its characters; the separators 1c to 1f are no Unicode white space.
_W = r"[\s\x1c-\x1f]"
_S = r"[^\s\x1c-\x1f]"
WORD = f"(?U){_S}+"
EOS = "</s>"


@dataclass(frozen=True)
class Tokenizer:
    """A user's vocabulary; both functions must be picklable and take one text or id list.

    ``encode`` leaves out any start token; ``bos_id`` is the one that ids for training begin with
    (cut texts never have it).
    """

    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]
    eos_id: int
    bos_id: int | None = None

    def cut(self, c: Column, n: int, tail: bool = False) -> Column:
        encode, decode = self.encode, self.decode

        def one(text):
            if text is None:
                return None
            ids = encode(text)
            return decode(ids[-n:] if tail else ids[:n])

        @F.pandas_udf("string")
        def cut_batch(texts: pd.Series) -> pd.Series:
            return texts.map(one)

        return cut_batch(c)

    def cut_list(self, c: Column, n: int) -> Column:
        encode, decode = self.encode, self.decode

        def cut(xs):
            return None if xs is None else [decode(encode(x)[:n]).strip() for x in xs]

        @F.pandas_udf("array<string>")
        def cut_batch(lists: pd.Series) -> pd.Series:
            return lists.map(cut)

        return cut_batch(c)

    def cut_lists(self, c: Column, n: int) -> Column:
        encode, decode = self.encode, self.decode

        def cut(lists):
            if lists is None:
                return None
            return [[decode(encode(x)[:n]).strip() for x in xs] for xs in lists]

        @F.pandas_udf("array<array<string>>")
        def cut_batch(rows: pd.Series) -> pd.Series:
            return rows.map(cut)

        return cut_batch(c)

    def ids(self, c: Column) -> Column:
        """Ids of a text, after the start token if there is one."""
        encode = self.encode
        start = [] if self.bos_id is None else [self.bos_id]

        @F.pandas_udf("array<int>")
        def encode_batch(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else start + list(encode(t)))

        return encode_batch(c)


def words(c: Column | str) -> Column:
    """Words without white space, as used for n-grams."""
    return F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Native tokens: each word with the white space before it."""
    return F.regexp_extract_all(col(c), F.lit(f"(?U){_W}*{_S}+"), F.lit(0))


def _first_tokens(c: Column, n: int) -> Column:
    # Possessive, so the match is a loop that stops after n words whatever the text's length.
    return F.regexp_extract(c, rf"(?U)\A(?:{_W}*+{_S}++){{0,{n}}}+(?:{_W}*+\z)?", 0)


def truncate_head(c: Column | str, n: int, tok: Tokenizer | None = None) -> Column:
    """The first ``n`` tokens; a text that fits is unchanged."""
    return tok.cut(col(c), n) if tok else _first_tokens(col(c), n)


def truncate_tail(c: Column | str, n: int, tok: Tokenizer | None = None) -> Column:
    """The last ``n`` tokens; a text that fits is unchanged, and so is every text for n = 0."""
    if n == 0:
        return col(c)
    if tok:
        return tok.cut(col(c), n, tail=True)
    return F.reverse(_first_tokens(F.reverse(col(c)), n))


def truncate_list(arr: Column | str, n: int, tok: Tokenizer | None = None) -> Column:
    """Every passage cut to ``n`` tokens and stripped."""
    if tok:
        return tok.cut_list(col(arr), n)
    return F.transform(col(arr), lambda p: strip(_first_tokens(p, n)))


def truncate_lists(arr: Column | str, n: int, tok: Tokenizer | None = None) -> Column:
    """The same for a list per topic."""
    if tok:
        return tok.cut_lists(col(arr), n)
    return F.transform(col(arr), lambda ps: truncate_list(ps, n))


def truncate_profile(c: Column | str, n: int = 200, tok: Tokenizer | None = None) -> Column:
    return truncate_head(c, n, tok)


def truncate_instructions(
    c: Column | str, n: int, reverse: bool = False, tok: Tokenizer | None = None
) -> Column:
    return truncate_tail(c, n, tok) if reverse else truncate_head(c, n, tok)


def input_ids(c: Column | str, add_eos: bool, tok: Tokenizer | None = None) -> Column:
    """Tokens of a text; the end token is added only if asked for and missing."""
    ids = tok.ids(col(c)) if tok else tokens(c)
    if not add_eos:
        return ids
    eos = F.lit(tok.eos_id if tok else EOS)
    has_eos = F.coalesce(F.get(ids, F.size(ids) - 1) == eos, F.lit(False))
    return F.when(has_eos, ids).otherwise(F.concat(ids, F.array(eos)))


def attention_mask(ids: Column | str) -> Column:
    return F.transform(col(ids), lambda _: F.lit(1))


def mask_prompt_labels(ids: Column | str, n_prompt: Column | str, element: str = "string") -> Column:
    """Labels with the first ``n_prompt`` positions ignored."""
    n = F.least(col(n_prompt), F.size(col(ids)))
    ignored = F.array_repeat(F.lit(IGNORED_LABEL).cast(element), n)
    return F.concat(ignored, F.slice(col(ids), n + 1, F.size(col(ids))))
