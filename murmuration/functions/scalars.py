"""Scalar functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks of silence; the frame hop in seconds.
SILENCE = ("sil", "sp", "", "spn", "nan")
HOP_S = 0.02


def _items(phones: Column) -> Column:
    return F.split(F.coalesce(phones, F.lit("")), ",")


def clean_phones_eval(phones: Column) -> Column:
    """Items that are silence once trimmed go first; then 0, 1 and 2 are deleted. Items aren't trimmed. Null gives no items."""
    return F.transform(F.filter(_items(phones), lambda x: ~F.trim(x).isin(*SILENCE)), lambda x: F.regexp_replace(x, "[012]", ""))


def clean_phones_graph(phones: Column) -> Column:
    """Digits are deleted and items trimmed first; then silence goes. Null gives no items."""
    return F.filter(F.transform(_items(phones), lambda x: F.trim(F.regexp_replace(x, r"\d+", ""))), lambda x: ~x.isin(*SILENCE))


def is_spoken(phones: Column) -> Column:
    """Whether anything but silence is left."""
    return F.size(clean_phones_graph(phones)) > 0


def speaker_of(filename: Column, sep: str = "-") -> Column:
    return F.split_part(filename, F.lit(sep), F.lit(1))


def compose_key(filename: Column, word_id: Column) -> Column:
    return F.concat_ws("_", filename, word_id.cast("string"))


def base_of(key: Column) -> Column:
    """The utterance of `utterance_wordid`; null unless there are exactly two parts."""
    return F.when(F.size(F.split(key, "_")) == 2, F.split_part(key, F.lit("_"), F.lit(1)))


def word_id_of(key: Column) -> Column:
    return F.when(F.size(F.split(key, "_")) == 2, F.split_part(key, F.lit("_"), F.lit(2)).try_cast("int"))


def vertex_name(key: Column) -> Column:
    return F.translate(F.trim(key), "'", "")


def frame_index(seconds: Column) -> Column:
    """Truncating division by the hop. (A product with its inverse differs on some hundredths.)"""
    return (seconds / F.lit(HOP_S)).cast("int")


def frame_number(seconds: Column, rate: int, frame_ms: int) -> Column:
    hop = max(frame_ms * rate // 1000, 1)
    return F.floor(seconds * rate / hop).cast("int")


def is_text(text: Column) -> Column:
    return text.isNotNull() & ~text.isin("", "<unk>", "nan")


def check_boundary(gold_begin: Column, gold_end: Column, begin: Column, end: Column) -> Column:
    """Whether a gold interval holds a found one, or they overlap enough: 0.03 s, or over half of a gold interval under 0.06 s."""
    duration = F.bround(gold_end - gold_begin, 2)
    overlap = F.bround(F.greatest(F.lit(0.0), F.least(gold_end, end) - F.greatest(gold_begin, begin)), 2)
    share = F.when(duration > 0, overlap / duration).otherwise(F.lit(0.0))
    return ((gold_begin <= begin) & (gold_end >= end)) | ((duration >= 0.06) & (overlap >= 0.03)) | ((duration < 0.06) & (share > 0.5))


def pair_type(text1: Column, text2: Column, speaker1: Column, speaker2: Column) -> Column:
    return F.when((text1 == text2) & (speaker1 == speaker2), "C1").when(text1 == text2, "C2").when(speaker1 == speaker2, "C3").otherwise("C4")


def ned(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Edit distance over the longer length, of strings whose characters are the tokens. Two empty strings give both_empty; so does one, as its distance is its length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(both_empty)).otherwise(F.levenshtein(a, b) / longer)


def code_string(codes: Column) -> Column:
    """A string with a character for each code; codes up to 40000 fit one UTF-16 unit from U+4E00."""
    return F.array_join(F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex((c + 0x4E00).cast("long")), 4, "0")), "UTF-16BE")), "")


def euclidean(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def edge_weight(distance: Column) -> Column:
    return F.greatest(distance, F.lit(1e-10).cast("float"))


def pad_right(text: Column, width: int) -> Column:
    """Spaces up to the width; longer text stays whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def two_places(x: Column) -> Column:
    """What printf("%.2f") and Python write: the double's exact value rounded, exact ties to even, and a minus sign for what is negative before rounding."""
    x = x.cast("double")
    whole = F.floor(F.abs(x))
    part = F.abs(x) - whole.cast("double")
    near = part * 100
    # The error of that product, exactly, from two halves of the factor: on which side of a tie the double lies.
    high = part * 134217729.0 - (part * 134217729.0 - part)
    error = (high * 100 - near) + (part - high) * 100
    half = near - F.floor(near) == 0.5
    n = F.when(half & (error > 0), F.ceil(near)).when(half & (error < 0), F.floor(near)).otherwise(F.rint(near).cast("long"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    exact = F.concat(sign, (whole + F.floor(n / 100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    # From 2^53 doubles are whole; null, NaN and infinity stay what they were.
    return F.when(F.abs(x) < 9007199254740992.0, exact).otherwise(F.format_string("%.2f", x))


def draw_key(seed: int, key: Column) -> Column:
    """The order of a seeded draw: the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sequences_of(pairs: int) -> int:
    """How many sequences have so many pairs."""
    return (1 + math.isqrt(1 + 8 * pairs)) // 2


def pairs_of(n: int) -> int:
    return n * (n - 1) // 2


def chunks_of(pairs: int, limit: int = 5_000_000) -> int:
    return -(-pairs // limit)
