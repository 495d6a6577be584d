"""Column functions on result rows: canonical key cells, band selections, relabelling, fingerprints, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"


def canonical_cell(value: Column | str) -> Column:
    """Trimmed text in which numbers with integral values are written as integers; null is the empty text."""
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    number = F.when((F.ascii(text) < 58) & text.rlike(NUMBER), text.try_cast("double"))  # signs, the point and digits come before 58
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.coalesce(F.when(whole, number.cast("decimal(38,0)").cast("string")), text, F.lit(""))


def bands_text(bands: Column) -> Column:
    """A band selection as text: null is ``all``, a list keeps its order."""
    return F.when(bands.isNull(), "all").otherwise(F.concat_ws(",", bands))


def parse_bands(text: Column) -> Column:
    """The list of band names in a comma text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def relabel(name: Column, normalization: Column, prefix: str, old: str, new: str) -> Column:
    """The normalisation label of one family of models, corrected."""
    return F.when(name.startswith(prefix) & (normalization == old), new).otherwise(normalization)


def fingerprint(settings: dict[str, Column]) -> Column:
    """16 hex digits of the SHA-256 of the settings as JSON with sorted keys; nulls are kept as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.concat(F.lit('"'), settings[k].cast("string"), F.lit('"')), F.lit("null"))) for k in sorted(settings)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 16)


def safe_name(name: Column) -> Column:
    """A name that is safe as a file name: other characters become one underscore, dots and underscores at the ends go."""
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def floored(metric: Column, value: Column, name: str = "r2", floor: float = -1.0) -> Column:
    """Scores of one metric held above a floor before they are averaged."""
    return F.when(metric == name, F.greatest(value, F.lit(floor))).otherwise(value)


def clean(value: Column) -> Column:
    """NaN as null, for aggregates that skip missing values."""
    return F.when(~F.isnan(value), value)


def kind_of(method: Column) -> Column:
    """Which side table a row belongs to, by its method."""
    return F.when(method == "profile", "profiles").when(method == "intrinsic_dim", "intrinsic_dim").otherwise("models")
