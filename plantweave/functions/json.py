"""JSON text from columns, with a space after each comma and colon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """JSON string literal of a text column, NULL for NULL."""
    # The literal starts and ends with a quote, so only the list brackets are trimmed.
    return F.when(text.isNotNull(), F.btrim(F.to_json(F.array(text)), F.lit("[]")))


def or_null(json: Column) -> Column:
    """The JSON text, or the JSON word ``null``."""
    return F.coalesce(json, F.lit("null"))


def string_list(items: Column) -> Column:
    """JSON list of strings."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def json_object(*fields: tuple[str, Column]) -> Column:
    """Object from (key, JSON text) pairs; pairs whose text is NULL are left out."""
    entries = [F.concat(F.lit(f'"{key}": '), value.cast("string")) for key, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}"))
