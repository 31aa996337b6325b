"""Segmentation of worked solutions into ordered text and display-math units, as columns."""

from __future__ import annotations

from pyspark.sql import Column

from quillmark.functions import units as U

UNIT = U.UNIT


def split_math_blocks(x: Column, compat: bool = False) -> Column:
    """array<struct<type, content>>: display math and the text around it, in order.

    Environments hide what they contain; they stay in the text around them.
    Inside display math an environment is restored, or with ``compat`` left as
    a numbered mark.
    """
    return U.blocks_of(x, compat)


def raw_units(x: Column, max_chars: int = 220, keep_math: bool = True, compat: bool = False) -> Column:
    """Units before short ones are merged."""
    return U.units_of(lambda t: U.raw(t, max_chars, keep_math, compat), x)


def merge_short_units(units: Column, min_chars: int = 60) -> Column:
    """Every text unit shorter than ``min_chars`` joins the shorter text neighbour of its paragraph, on a tie the next one."""
    return U.merge_units(units, min_chars)


def fine_segment(x: Column, max_chars: int = 220, keep_math: bool = True, min_chars: int = 60, compat: bool = False) -> Column:
    """Ordered units of one solution."""
    return U.units_of(lambda t: U.merged(U.raw(t, max_chars, keep_math, compat), min_chars), x)


def sentence_count(x: Column, count_math: bool = False) -> Column:
    """Sentences of the text blocks of all paragraphs; display math counts one each with ``count_math``."""
    return U.count_of(x, count_math)
