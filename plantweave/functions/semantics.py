"""Semantic identifiers, contexts, payloads and property maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantweave.functions.json import json_object, or_null, quoted, string_list


def pointer_hash(semantic_id: Column) -> Column:
    return F.substring(F.sha2(semantic_id, 256), 1, 16)


def dictionary(semantic_id: Column) -> Column:
    """Name of the dictionary an identifier belongs to; the order of the tests matters."""
    lowered = F.lower(semantic_id)
    is_web = semantic_id.startswith("http://") | semantic_id.startswith("https://")
    return (
        F.when(semantic_id.isNull() | (semantic_id == ""), "unknown")
        .when(semantic_id.startswith("0173-1#") | semantic_id.startswith("0173-1---"), "ECLASS")
        .when(semantic_id.startswith("0112/"), "IEC_CDD")
        .when(is_web & lowered.contains("eclass"), "ECLASS")
        .when(is_web & (lowered.contains("iec") | lowered.contains("cdd")), "IEC_CDD")
        .when(is_web & semantic_id.contains("admin-shell.io"), "IDTA")
        .when(is_web, "IRI")
        .otherwise("custom")
    )


def version(semantic_id: Column) -> Column:
    """Last ``#`` part when there are at least three, else ``1.0``."""
    parts = F.split(semantic_id, "#")
    return F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 1)).otherwise("1.0")


def hierarchy(semantic_id: Column, keys: Column) -> Column:
    """All keys, with the identifier put in front when it is missing."""
    keys = F.coalesce(keys, F.array().cast("array<string>"))
    known = F.array_contains(keys, semantic_id) | (semantic_id == "")
    return F.when(known, keys).otherwise(F.array_prepend(keys, semantic_id))


def context_json(ctx: dict[str, Column]) -> Column:
    """The eight-key JSON form of a context."""
    return json_object(
        ("semanticId", or_null(quoted(ctx["semantic_id"]))),
        ("dictionary", or_null(quoted(ctx["dictionary"]))),
        ("version", or_null(quoted(ctx["version"]))),
        ("definition", or_null(quoted(ctx["definition"]))),
        ("preferredName", or_null(quoted(ctx["preferred_name"]))),
        ("unit", or_null(quoted(ctx["unit"]))),
        ("dataType", or_null(quoted(ctx["data_type"]))),
        ("hierarchy", string_list(ctx["hierarchy"])),
    )


def _head() -> list[tuple[str, Column]]:
    return [("value", F.col("value_json")), ("timestamp", F.col("timestamp_ms"))]


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _source(uri: Column | None) -> Column:
    return F.col("aas_source") if uri is None else F.coalesce(_filled(uri), F.col("aas_source"))


def inline_payload(uri: Column | None, source_name: str, include_metadata: bool = True) -> Column:
    """Payload that carries its metadata."""
    fields = _head()
    if include_metadata:
        fields += [
            ("semanticId", or_null(quoted(F.col("semantic_id")))),
            ("unit", or_null(quoted(F.col("unit")))),
            ("valueType", or_null(quoted(F.col("value_type")))),
            ("source", quoted(F.lit(source_name))),
            ("aasUri", or_null(quoted(_source(uri)))),
        ]
    return json_object(*fields)


def pointer_payload() -> Column:
    """Payload that carries the pointer instead of the metadata."""
    return json_object(*_head(), ("ptr", quoted(pointer_hash(F.col("semantic_id")))))


def hybrid_payload() -> Column:
    """Pointer payload with unit and type where they are filled."""
    return json_object(
        *_head(),
        ("ptr", quoted(pointer_hash(F.col("semantic_id")))),
        ("unit", quoted(_filled(F.col("unit")))),
        ("valueType", quoted(_filled(F.col("value_type")))),
    )


def payload(
    mode: str,
    uri: Column | None,
    source_name: str,
    use_properties: bool = False,
    metadata_fallback: bool = True,
) -> Column:
    """Payload in the chosen mode; rows without an identifier fall back to inline."""
    inline = inline_payload(uri, source_name, not use_properties or metadata_fallback)
    has_id = F.col("semantic_id").isNotNull() & (F.col("semantic_id") != "")
    if mode == "inline":
        return inline
    short = {"pointer": pointer_payload, "hybrid": hybrid_payload}[mode]()
    return F.when(has_id, short).otherwise(inline)


def _filled_map(**entries: Column) -> Column:
    flat = [c for key, value in entries.items() for c in (F.lit("aas:" + key), value)]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull() & (v != ""))


def user_properties(mode: str, uri: Column | None) -> Column:
    """Header map of a message: metadata when inline, pointer parts otherwise."""
    inline = _filled_map(
        semanticId=F.col("semantic_id"),
        unit=F.col("unit"),
        valueType=F.col("value_type"),
        aasType=F.col("aas_type"),
        source=_source(uri),
    )
    if mode == "inline":
        return inline
    pointer = _filled_map(
        ptr=pointer_hash(F.col("semantic_id")),
        dict=dictionary(F.col("semantic_id")),
        ver=version(F.col("semantic_id")),
    )
    has_id = F.col("semantic_id").isNotNull() & (F.col("semantic_id") != "")
    return F.when(has_id, pointer).otherwise(inline)


def _several(keys: Column) -> Column:
    return F.when(F.size(keys) > 1, string_list(keys))


def metric_properties(score: Column | None = None) -> Column:
    """Property map of a metric; the fidelity score is optional."""
    extra = {} if score is None else {"fidelityScore": score.cast("string")}
    return _filled_map(
        semanticId=F.col("semantic_id"),
        semanticKeys=_several(F.col("semantic_keys")),
        unit=F.col("unit"),
        aasType=F.col("aas_type"),
        aasSource=F.col("aas_source"),
        submodelSemanticId=F.col("submodel_semantic_id"),
        **extra,
    )


def context_properties(include_hash: bool = True) -> Column:
    """Property map of a context row."""
    extra = {"semanticHash": F.col("hash")} if include_hash else {}
    return _filled_map(
        semanticId=F.col("semantic_id"),
        semanticDictionary=F.col("dictionary"),
        semanticVersion=F.col("version"),
        **extra,
        unit=F.col("unit"),
        semanticKeys=_several(F.col("hierarchy")),
    )
