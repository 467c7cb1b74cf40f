"""XSD type names, message type codes and typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantweave.functions.json import quoted

# Message type code per XSD type name in lower case.
XSD_CODES = {
    "xs:string": 12,
    "xs:boolean": 11,
    "xs:int": 3,
    "xs:integer": 4,
    "xs:long": 4,
    "xs:short": 2,
    "xs:byte": 1,
    "xs:unsignedint": 7,
    "xs:unsignedlong": 8,
    "xs:unsignedshort": 6,
    "xs:unsignedbyte": 5,
    "xs:float": 9,
    "xs:double": 10,
    "xs:datetime": 13,
    "xs:date": 13,
    "xs:time": 13,
    "xs:decimal": 10,
    "xs:base64binary": 17,
    "xs:hexbinary": 17,
    "xs:anyuri": 12,
}
STRING_CODE = 12
# Codes by the slot a value goes into.
INT_CODES = [1, 2, 3, 5, 6, 7]
LONG_CODES = [4, 8, 13]

# Names that are not simply the XSD name in lower case.
XSD_NAMES = {
    "xs:integer": "xs:int",
    "xs:normalizedstring": "xs:string",
    "xs:anyuri": "xs:anyURI",
}
INTEGER_NAMES = [
    "xs:int",
    "xs:long",
    "xs:short",
    "xs:byte",
    "xs:unsignedint",
    "xs:unsignedlong",
    "xs:unsignedshort",
    "xs:unsignedbyte",
    "xs:positiveinteger",
    "xs:negativeinteger",
    "xs:nonnegativeinteger",
    "xs:nonpositiveinteger",
]
FLOAT_NAMES = ["xs:double", "xs:float"]


def _lookup(table: dict, key: Column) -> Column:
    out = None
    for value in dict.fromkeys(table.values()):
        keys = [k for k, v in table.items() if v == value]
        out = (F if out is None else out).when(key.isin(keys), F.lit(value))
    return out


def xsd_code(type_name: Column) -> Column:
    """Message type code of an XSD type name; unknown names count as strings."""
    return _lookup(XSD_CODES, F.lower(type_name)).otherwise(STRING_CODE)


def xsd_name(raw: Column) -> Column:
    """Normal form of an XSD type name; a missing name is ``xs:string``."""
    bare = F.lower(F.regexp_replace(raw, "^xsd?:", ""))
    name = F.concat(F.lit("xs:"), bare)
    return F.coalesce(_lookup(XSD_NAMES, name), name, F.lit("xs:string"))


def infer_code(value_json: Column) -> Column:
    """Type code inferred from a JSON literal."""
    whole = value_json.try_cast("decimal(38,0)")
    return (
        F.when(value_json.isNull() | (value_json == "null"), 0)
        .when(value_json.isin("true", "false"), 11)
        .when(value_json.startswith('"'), STRING_CODE)
        .when(value_json.rlike(r"^-?[0-9]+$") & whole.between(-2147483648, 2147483647), 3)
        .when(value_json.rlike(r"^-?[0-9]+$"), 4)
        .when(value_json.rlike(r"^-?[0-9]"), 10)
        .otherwise(STRING_CODE)
    )


def typed_value(value_type: Column, literal: Column) -> dict[str, Column]:
    """``value``, ``value_num``, ``value_bool`` and ``value_json`` of a literal."""
    is_bool = value_type == "xs:boolean"
    is_int = value_type.isin(INTEGER_NAMES)
    is_float = value_type.isin(FLOAT_NAMES)
    is_decimal = value_type == "xs:decimal"
    flag = F.when(is_bool, F.lower(F.trim(literal)).isin("true", "1"))
    whole = F.trim(literal).try_cast("decimal(38,0)")
    real = F.trim(literal).try_cast("double")
    exact = F.trim(literal).try_cast("decimal(38,18)")
    number = (
        F.when(is_bool, flag.cast("double"))
        .when(is_int, whole.cast("double"))
        .when(is_float, real)
        .when(is_decimal, exact.cast("double"))
    )
    text = (
        F.when(is_bool, flag.cast("string"))
        .when(is_int, whole.cast("string"))
        .when(is_float, real.cast("string"))
        .otherwise(literal)
    )
    as_json = F.when(is_bool | is_int | is_float, text).otherwise(quoted(literal))
    return {
        "value": text,
        "value_num": F.when(literal.isNotNull(), number),
        "value_bool": F.when(literal.isNotNull(), flag),
        "value_json": F.coalesce(as_json, F.lit("null")),
    }
