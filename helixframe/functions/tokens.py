"""Character tokens of residue strings: encoding, truncation, padding, and reductions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import sequence as S

#: Ids of padding, end and unknown; the letters follow.
PAD, EOS, UNK, FIRST = 0, 1, 2, 3
IGNORED = -100  # fixed value: label of padding


def encode(c: Column, eos: bool = True) -> Column:
    """ids of the characters, with the end token; letters outside the alphabet are unknown."""
    ids = F.transform(S.letters(c), _id)
    return F.concat(ids, F.array(F.lit(EOS))) if eos else ids


def _id(x: Column) -> Column:
    at = F.position(x, F.lit(S.RESIDUES))
    return F.when(at > 0, at + FIRST - 1).otherwise(UNK).cast("int")


def decode(ids: Column) -> Column:
    """Text of the ids; special and filler ids give nothing."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i.between(FIRST, FIRST + len(S.RESIDUES) - 1)), lambda i: F.substring(F.lit(S.RESIDUES), i - FIRST + 1, 1)), "")


def example(c: Column, max_length: int, eos: bool = True) -> Column:
    """struct of a training example: ids cut to max_length with the end token last, lengths, and whether it was cut."""
    raw = encode(c, eos)
    cut = F.size(raw) > max_length
    ids = F.when(cut, F.concat(F.slice(raw, 1, max_length - 1), F.array(F.lit(EOS)))).otherwise(raw) if eos else F.slice(raw, 1, max_length)
    return F.struct(ids.alias("input_ids"), F.length(c).alias("original_length"), F.size(raw).alias("raw_tokenized_length"), F.size(ids).alias("tokenized_length"), cut.alias("truncated"), F.array_contains(ids, EOS).alias("has_eos"))


def padded(ids: Column, batch: Column) -> tuple[Column, Column, Column]:
    """(input_ids, attention_mask, labels), padded to the longest of the batch."""
    short = F.max(F.size(ids)).over(Window.partitionBy(batch)) - F.size(ids)
    fill = lambda v: F.array_repeat(F.lit(v), short)
    return F.concat(ids, fill(PAD)), F.concat(F.transform(ids, lambda _: F.lit(1)), fill(0)), F.concat(ids, fill(IGNORED))


def masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m, v.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def masked_count(mask: Column) -> Column:
    """Tokens that count, at least 1."""
    return F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))
