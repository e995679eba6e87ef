"""JSON for readers that take ASCII alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters with an escape of their own.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped(c: Column) -> Column:
    """One character as ASCII; one beyond 16 bits as the two halves that UTF-16 has."""
    code = F.ascii(c)
    out = F.when(code > 0xFFFF, F.concat(_hex4(F.shiftright(code - 0x10000, 10) + 0xD800), _hex4((code - 0x10000).bitwiseAND(0x3FF) + 0xDC00)))
    out = out.when((code < 0x20) | (code > 0x7E), _hex4(code)).otherwise(c)
    for plain, put in SHORT.items():
        out = F.when(c == plain, F.lit(put)).otherwise(out)
    return out


def ascii_string(text: Column) -> Column:
    """The text as a JSON string of ASCII characters, marks included; null is null as JSON. Plain texts are not taken apart."""
    apart = F.array_join(F.transform(F.split(text, ""), _escaped), "")
    body = F.when(text.rlike(r'[^\x20-\x7E]|["\\]'), apart).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def unicode_escape(text: Column) -> Column:
    r"""The text as ASCII with \n, \r, \t, \\, \xhh, \uhhhh and \Uhhhhhhhh for all else."""

    def one(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(code > 0xFFFF, F.concat(F.lit("\\U"), F.lower(F.lpad(F.hex(code), 8, "0")))).when(code > 0xFF, _hex4(code))
        out = out.when((code < 0x20) | (code > 0x7E), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(code), 2, "0")))).otherwise(c)
        for plain in ("\\", "\n", "\r", "\t"):
            out = F.when(c == plain, F.lit(SHORT[plain])).otherwise(out)
        return out

    return F.when(text.rlike(r"[^\x20-\x7E]|\\"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


#: What a text may hold to go through a character set as it is.
CHARSETS = {"us-ascii": r"\A[\x00-\x7F]*\z", "iso-8859-1": r"\A[\x00-\xFF]*\z", "utf-8": r"(?s)\A.*\z"}


def representable(text: Column, charset: str = "utf-8") -> Column:
    """Whether a character set has all characters of a text: one of CHARSETS, or a regular expression that such texts match. A null text has none that it lacks."""
    return F.coalesce(text.rlike(CHARSETS.get(charset.lower(), charset)), F.lit(True))


def safe_json(df: DataFrame, text: str, charset: str = "utf-8") -> DataFrame:
    """(value): each row as JSON as it is, or with ``text`` in ASCII, and last, where ``charset`` lacks one of its characters. Null fields go, as in JSON that Spark writes."""
    names = [c for c in df.columns if c != text]
    rest = F.to_json(F.struct(*names)) if names else F.lit("{}")
    field = F.concat(F.lit(f'"{text}":'), ascii_string(F.col(text)), F.lit("}"))
    joined = F.when(rest == "{}", F.concat(F.lit("{"), field)).otherwise(F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(","), field))
    return df.select(F.when(representable(F.col(text), charset), F.to_json(F.struct(*names, text))).otherwise(joined).alias("value"))
