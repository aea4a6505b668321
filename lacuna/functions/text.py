"""Number formats, and the reading of lengths such as ``151.7241 µm``, as columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- formats ----------------------------------------------------------------------------------


def fixed(x: Column, digits: int) -> Column:
    """With so many decimals, rounded half to even on the exact binary value; ``inf`` for infinity."""
    x = x.cast("double")
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(F.isnan(x), "nan").otherwise(F.call_function("format_number", x, F.lit(pattern)))


def percent(x: Column, digits: int) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def general(value: float) -> str:
    """A parameter as shown in texts: six significant digits, no trailing zeros."""
    return f"{value:g}"


#: Powers of ten from which on a number has one digit more before the point; between the first and ``_PLAIN`` no exponent is shown.
_TENS = np.array([float(f"1e{k}") for k in range(-4, 6)])
_PLAIN = 999_999.0


def six_digits(values: pa.Array) -> pa.Array:
    """As ``significant6``, of an array of doubles.

    Numbers are scaled to six digits before the point and rounded; what comes out has the digits asked for as its shortest form. Where the
    rounding error of the scaling could matter (half way between two numbers), or an exponent is shown, a number is formatted by itself.
    """
    x = values.to_numpy(zero_copy_only=False)
    size = np.abs(x)
    plain = (size == 0) | ((size >= _TENS[0]) & (size < _PLAIN))
    scale = 10.0 ** np.clip(10 - np.searchsorted(_TENS, size, "right"), 0, 9)
    scaled = np.where(plain, x, 0.0) * scale
    digits = np.rint(scaled)
    plain &= np.abs(np.abs(scaled - digits) - 0.5) > 1e-6
    out = pa.array(digits / scale).cast(pa.string())
    if not plain.all():
        out = pc.replace_with_mask(out, pa.array(~plain), pa.array(["" if v != v else f"{v:.6g}" for v in x[~plain].tolist()], pa.string()))
    return pc.replace_substring(out, ".", ",")


@F.arrow_udf(T.StringType())
def significant6(values: pa.Array) -> pa.Array:
    """Six significant digits, no trailing zeros, decimal comma; empty for null. For output files only."""
    return six_digits(values)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "ja").otherwise("nein")


def rounded(x: Column, digits: int) -> Column:
    """Half-even; null for NaN and infinity."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.bround(x, digits))


# -- units ------------------------------------------------------------------------------------

# Micrometres in a unit.
UNITS_UM = {
    "angstrom": 1e-4,
    "nm": 1e-3,
    "um": 1.0,
    "mm": 1e3,
    "cm": 1e4,
    "dm": 1e5,
    "m": 1e6,
    "km": 1e9,
    "mil": 25.4,
    "in": 25400.0,
    "inch": 25400.0,
}
# Characters that stand for micro, in order of trial misreadings and what they mean,
# and units in full.
MICRO = "µμρᵘ"
MISREAD = [
    ("rn", "m"),
    ("nun", "mm"),
    ("yum", "um"),
    ("jum", "um"),
    ("pum", "um"),
    ("pm", "um"),
    ("jm", "um"),
    ("im", "um"),
    ("lm", "um"),
    ("vm", "um"),
    ("ym", "um"),
]
IN_FULL = {
    "micron": "um",
    "microns": "um",
    "micrometer": "um",
    "micrometre": "um",
    "mikrometer": "um",
    "nanometer": "nm",
    "nanometre": "nm",
    "millimeter": "mm",
    "millimetre": "mm",
}


def _known(unit: Column) -> Column:
    return unit.isin(*UNITS_UM)


def _letters(raw: Column) -> Column:
    micro_as_u = F.translate(raw, MICRO + "Â", "u" * len(MICRO))
    return F.regexp_replace(F.lower(micro_as_u), "[^a-z]", "")


def _repaired(letters: Column) -> Column:
    return reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), MISREAD, letters)


def normalize_unit(raw: Column) -> Column:
    """The unit that a text names, after known misreadings if need be; null if none is sure."""
    s = _letters(raw)
    in_full = reduce(lambda c, k: c.when(s == k, IN_FULL[k]), IN_FULL, F.when(F.lit(False), ""))
    return F.when(_known(s), s).when(_known(_repaired(s)), _repaired(s)).otherwise(in_full)


def unit_was_repaired(raw: Column) -> Column:
    s = _letters(raw)
    return (s != "") & ~_known(s) & (_repaired(s) != s) & _known(_repaired(s))


def unit_note(raw: Column) -> Column:
    """What was repaired, in words; null if nothing was."""
    s = _letters(raw)
    return F.when(unit_was_repaired(raw), F.concat(F.lit("Einheit '"), s, F.lit("' als '"), _repaired(s), F.lit("' gelesen")))


def unit_factor(unit: Column) -> Column:
    return reduce(lambda c, k: c.when(unit == k, UNITS_UM[k]), UNITS_UM, F.when(F.lit(False), 0.0))


def parse_number(raw: Column) -> Column:
    """A number with decimal point or comma and thousands separators; null if it is none."""
    s = F.regexp_replace(raw, r"[\s']", "")
    commas, dots = F.length(s) - F.length(F.replace(s, F.lit(","))), F.length(s) - F.length(F.replace(s, F.lit(".")))
    comma_last = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    both = F.when(comma_last, F.replace(F.replace(s, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(",")))
    thousands = s.rlike(r"^[^.]*(\.[^.]{3})+$")
    last = F.length(s) - F.instr(F.reverse(s), ".")
    many_dots = F.when(thousands, F.replace(s, F.lit("."))).otherwise(F.concat(F.replace(F.substring(s, F.lit(1), last), F.lit(".")), F.substring(s, last + 1, F.length(s))))
    text = (
        F.when((commas > 0) & (dots > 0), both)
        .when(commas == 1, F.replace(s, F.lit(","), F.lit(".")))
        .when(commas > 1, F.replace(s, F.lit(",")))
        .when(dots > 1, many_dots)
        .otherwise(s)
    )
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


#: A number without blanks in it, then a unit of up to 12 characters that are neither blanks nor digits (fixed value).
LENGTH = r"[0-9]+(?:[.,][0-9]+)*\s*[^\s0-9]{1,12}"
NUMBER_PART = r"^[0-9]+(?:[.,][0-9]+)*"


def parse_length(text: Column) -> Column:
    """The first number with a known unit and a value above zero: struct<value, unit, value_um, raw, note>; else null."""

    def read(m: Column) -> Column:
        number = F.regexp_extract(m, NUMBER_PART, 0)
        unit_text = F.regexp_replace(m, NUMBER_PART, "")
        value, unit = parse_number(number), normalize_unit(unit_text)
        return F.struct(value.alias("value"), unit.alias("unit"), (value * unit_factor(unit)).alias("value_um"), F.trim(m).alias("raw"), unit_note(unit_text).alias("note"))

    found = F.transform(F.regexp_extract_all(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), F.lit(LENGTH), 0), read)
    good = F.filter(found, lambda r: (r["value"] > 0) & r["unit"].isNotNull())
    return F.get(good, F.lit(0))


# Units that lengths are shown in, from so many micrometres on.
SHOWN_IN = [(1e9, "km"), (1e6, "m"), (1e3, "mm"), (1.0, "µm"), (1e-3, "nm")]


def shown_unit(value_um: Column) -> tuple[Column, Column]:
    """The value in the unit it is shown in, and that unit."""
    size = F.abs(value_um)
    unit = reduce(lambda c, u: c.when(size >= u[0], u[1]), SHOWN_IN, F.when(F.lit(False), "")).otherwise("nm")
    factor = reduce(lambda c, u: c.when(size >= u[0], u[0]), SHOWN_IN, F.when(F.lit(False), 0.0)).otherwise(1e-3)
    return value_um / factor, unit


@F.pandas_udf(T.StringType())
def _significant4(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.4g}")


def format_um(value_um: Column) -> Column:
    """Four significant digits in a fitting unit."""
    value, unit = shown_unit(value_um)
    return F.when(value_um == 0, "0 µm").otherwise(F.concat(_significant4(value), F.lit(" "), unit))


# -- one line for a result ----------------------------------------------------------------------
# The words of these lines.


def describe_image(pore_count: Column, porosity_pct: Column, diameter_um: Column, diameter_px: Column, rejected: Column) -> Column:
    """How many objects, porosity, the largest of them, how many were rejected; what is unknown is left out."""
    largest = F.coalesce(F.concat(fixed(diameter_um, 1), F.lit(" µm")), F.concat(fixed(diameter_px, 0), F.lit(" px")))
    parts = F.concat(pore_count.cast("string"), F.lit(" Poren")), F.concat(fixed(porosity_pct, 2), F.lit(" % Porosität")), F.concat(F.lit("größte "), largest)
    return F.concat_ws(", ", *parts, F.when(rejected > 0, F.concat(rejected.cast("string"), F.lit(" verworfen"))))


@F.pandas_udf(T.StringType())
def _general(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else general(v))


def describe_scale(um_per_px: Column, label: Column, bar_px: Column, value_um: Column, source: Column, confidence: Column) -> Column:
    """The scale, what was read, the bar's length and what it stands for, where it comes from. An empty label and a bar of no length are left out."""
    parts = (
        F.concat(_general(um_per_px.cast("double")), F.lit(" µm/px")),
        F.when(label != "", F.concat(F.lit('"'), label, F.lit('"'))),
        F.when(bar_px != 0, F.concat(F.lit("Balken "), _general(bar_px.cast("double")), F.lit(" px"))),
        F.concat(F.lit("= "), format_um(value_um)),
        F.concat(F.lit("["), source, F.lit(", "), percent(confidence, 0), F.lit("]")),
    )
    return F.concat_ws("  ", *parts)
