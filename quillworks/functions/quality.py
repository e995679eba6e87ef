"""Scores and profiles of texts as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens


def count_chars(text: Column, klass: str) -> Column:
    """How many characters are in a class, given as it stands within brackets."""
    return F.length(F.regexp_replace(text, f"(?U)[^{klass}]", ""))


def hangul(text: Column) -> Column:
    """Hangul syllables and the rest of their block, U+AC00 to U+D7AF."""
    return count_chars(text, r"가-힯")


def latin(text: Column) -> Column:
    return count_chars(text, "A-Za-z")


def corrections(before: Column, after: Column) -> Column:
    """Characters lost, plus words gained or lost. May be negative."""
    return F.length(before) - F.length(after) + F.abs(F.size(tokens(before)) - F.size(tokens(after)))


def text_quality(text: Column) -> Column:
    """0 for no text; else 0.8, up to 0.1 for Hangul, 0.05 for sentences of 10 to 100 characters, less 0.01 for each full-width mark; within 0 to 1."""
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    stops = F.regexp_count(text, F.lit(r"\."))
    mean = F.try_divide(F.length(text), stops)
    score = 0.8 + F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^가-힣]", "")), solid), F.lit(0.0)) * 0.1
    score = score + F.when((stops > 0) & (mean >= 10) & (mean <= 100), 0.05).otherwise(0.0)
    score = score - F.regexp_count(text, F.lit("[？！，；：]")) * 0.01
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def image_quality(sharpness: Column, spread: Column, mean: Column) -> Column:
    """From a Laplacian's variance, the standard deviation and the mean of a grey image, 0 to 1."""
    return F.least(F.lit(1.0), sharpness / 1000) * 0.4 + spread / 255 * 0.4 + (1 - F.abs(mean / 255 - 0.5) * 2) * 0.2


def change_rate(before: Column, after: Column) -> Column:
    """Percent by which a length changed; null where it was 0."""
    return F.try_divide((after - before) * F.lit(100.0), before)
