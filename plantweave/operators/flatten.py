"""Nested asset documents to metric rows.

Each document is parsed once and walked level by level inside its own row: an
``aggregate`` over the possible depths holds the elements of the current level and
the leaves found so far. Nothing is shuffled until the asset ids are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantweave.functions import types
from plantweave.operators.ordered import latest_per_key


# An element's members: scalars as text, nested parts as variants.
_ELEMENT = (
    "struct<modelType:string,idShort:string,valueType:string,value:variant,min:string,max:string,"
    "semanticId:variant,embeddedDataSpecifications:variant,entityType:string,globalAssetId:string,"
    "statements:variant,first:variant,second:variant>"
)
_FRONTIER = f"array<struct<el:{_ELEMENT},path:string,ord:string>>"
_LEAVES = (
    "array<struct<path:string,aas_type:string,value_type:string,literal:string,"
    "keys:array<string>,unit:string,ord:string>>"
)

_KIND = "e.el.modelType"
_VALUE = "try_variant_get(e.el.value, '$', 'string')"


def _key_values(part: str) -> str:
    """Key values of a reference; most elements have none and skip the lookup."""
    keys = f"try_variant_get({part}, '$.keys', 'array<struct<value:string>>')"
    return (
        f"if({part} is null, array(), "
        f"filter(transform(coalesce({keys}, array()), k -> k.value), v -> v is not null))"
    )


_KEYS = _key_values("e.el.semanticId")
_UNIT = (
    "if(e.el.embeddedDataSpecifications is null, null, get(filter(coalesce(try_variant_get("
    "e.el.embeddedDataSpecifications, '$', "
    "'array<struct<dataSpecificationContent:struct<unit:string>>>'), array()), "
    "s -> s.dataSpecificationContent.unit <> ''), 0).dataSpecificationContent.unit)"
)


def _reference(part: str) -> str:
    return f"nullif(concat_ws('/', {_key_values('e.el.' + part)}), '')"


def _leaf(path: str, kind: str, value_type: str, literal: str) -> str:
    return (
        f"named_struct('path', {path}, 'aas_type', {kind}, 'value_type', {value_type}, "
        f"'literal', {literal}, 'keys', {_KEYS}, 'unit', {_UNIT}, 'ord', e.ord)"
    )


def _language_text(language: str) -> str:
    entries = "try_variant_get(e.el.value, '$', 'array<struct<language:string,text:string>>')"
    wanted = language.replace("'", "''")
    return (
        f"coalesce(get(filter({entries}, t -> t.language = '{wanted}'), 0).text, "
        f"get({entries}, 0).text)"
    )


def _leaves_of(language: str) -> str:
    """Rows an element contributes itself."""
    string = "'xs:string'"
    typed = "e.el.valueType"
    value = (
        f"case {_KIND} when 'Property' then {_VALUE} "
        f"when 'MultiLanguageProperty' then {_language_text(language)} end"
    )
    value_type = f"case when {_KIND} = 'Property' then {typed} else {string} end"
    # SelfManagedEntity reads SELF_MANAGED_ENTITY.
    entity = (
        "coalesce(upper(regexp_replace(e.el.entityType, '([a-z])([A-Z])', '$1_$2')), 'SELF_MANAGED')"
    )
    relation = f"concat(coalesce({_reference('first')}, ''), ' -> ', coalesce({_reference('second')}, ''))"
    range_rows = ", ".join(
        _leaf(f"concat(e.path, '.{b}')", f"'Range.{b}'", typed, f"e.el.{b}") for b in ("min", "max")
    )
    entity_rows = ", ".join(
        [
            _leaf("concat(e.path, '.entityType')", "'Entity.entityType'", string, entity),
            _leaf("concat(e.path, '.globalAssetId')", "'Entity.globalAssetId'", string,
                  "nullif(e.el.globalAssetId, '')"),
        ]
    )
    return f"""case
      when {_KIND} is null or {_KIND} in ('File', 'Blob', 'SubmodelElementCollection', 'SubmodelElementList')
        then cast(array() as {_LEAVES})
      when {_KIND} = 'Range' then filter(array({range_rows}), r -> r.literal is not null)
      when {_KIND} = 'Entity' then filter(array({entity_rows}), r -> r.literal is not null)
      when {_KIND} = 'ReferenceElement' then array({_leaf('e.path', "'ReferenceElement'", string, _reference('value'))})
      when {_KIND} in ('RelationshipElement', 'AnnotatedRelationshipElement')
        then array({_leaf('e.path', "'RelationshipElement'", string, relation)})
      else array({_leaf('e.path', _KIND, value_type, value)})
    end"""


def _placed(parts: str, path: str, order: str) -> str:
    """Listed elements with their paths; ``c`` is the element, ``i`` its position."""
    return (
        f"transform({parts}, (c, i) -> named_struct('el', c, 'path', {path}, "
        f"'ord', concat({order}, '/', lpad(i, 10, '0'))))"
    )


def _members(source: str, path: str, order: str) -> str:
    """Elements of a list variant, read in one cast: a variant taken out of another is built anew."""
    return _placed(f"coalesce(try_variant_get({source}, '$', 'array<{_ELEMENT}>'), array())", path, order)


def _children_of() -> str:
    """Elements one level down."""
    named = "concat(e.path, '.', coalesce(nullif(c.idShort, ''), 'unnamed'))"
    return f"""case {_KIND}
      when 'SubmodelElementCollection' then {_members('e.el.value', named, 'e.ord')}
      when 'SubmodelElementList' then {_members('e.el.value', "concat(e.path, '[', i, ']')", 'e.ord')}
      when 'Entity' then {_members('e.el.statements', named, 'e.ord')}
      else cast(array() as {_FRONTIER})
    end"""


#: Levels that are walked before the brackets of the text are counted.
_SHALLOW = 6


def walk(elements: str, root: str, language: str = "en") -> Column:
    """All leaves below a list of elements, however deep.

    Each level opens a list, so the brackets of the text bound the levels; they are only counted
    where elements are left after the first few levels.
    """
    named = f"concat({root}, '.', coalesce(nullif(c.idShort, ''), 'unnamed'))"
    start = _placed(f"coalesce({elements}, array())", named, "''")
    step = f"""(acc, depth) -> if(size(acc.todo) = 0, acc, named_struct(
        'todo', cast(flatten(transform(acc.todo, e -> {_children_of()})) as {_FRONTIER}),
        'found', cast(concat(acc.found, flatten(transform(acc.todo, e -> {_leaves_of(language)}))) as {_LEAVES})))"""
    begin = f"named_struct('todo', cast({start} as {_FRONTIER}), 'found', cast(array() as {_LEAVES}))"
    top = f"aggregate(sequence(1, {_SHALLOW}), {begin}, {step})"
    levels = f"sequence(1, size(split(to_json({elements}), '\\\\[')))"
    rest = f"aggregate(if(size(t.todo) = 0, cast(array() as array<int>), {levels}), t, {step}, acc -> acc.found)"
    return F.expr(f"get(transform(array({top}), t -> {rest}), 0)")


def shells(documents: DataFrame) -> DataFrame:
    """(source, pos, asset_id, submodel_id): first key of each submodel reference."""
    exploded = F.posexplode(
        F.expr("try_variant_get(doc, '$.assetAdministrationShells', 'array<variant>')")
    ).alias("pos", "shell")
    refs = F.expr(
        "transform(try_variant_get(shell, '$.submodels', "
        "'array<struct<keys:array<struct<value:string>>>>'), r -> get(r.keys, 0).value)"
    )
    asset = F.expr("nullif(try_variant_get(shell, '$.assetInformation.globalAssetId', 'string'), '')")
    return (
        documents.select("source", exploded)
        .select("source", "pos", asset.alias("asset_id"), F.explode(refs).alias("submodel_id"))
        .filter("asset_id IS NOT NULL AND submodel_id IS NOT NULL")
    )


def submodel_assets(documents: DataFrame) -> DataFrame:
    """Asset of each referenced submodel; of several shells the last one counts.

    For snapshots that spread shells and submodels over documents; within one
    document :func:`submodels` finds the asset in place.
    """
    order = ["source", "pos", "asset_id"]
    return latest_per_key(shells(documents), ["submodel_id"], order).select("submodel_id", "asset_id")


# Members that are read of a submodel and of a shell.
_SUBMODEL = (
    "struct<id:string,idShort:string,semanticId:struct<keys:array<struct<value:string>>>,"
    f"submodelElements:array<{_ELEMENT}>>"
)
_SHELL = (
    "struct<assetInformation:struct<globalAssetId:string>,"
    "submodels:array<struct<keys:array<struct<value:string>>>>>"
)


def _submodel_rows(documents: DataFrame) -> DataFrame:
    first_key = F.expr("get(filter(transform(sm.semanticId.keys, k -> k.value), v -> v is not null), 0)")
    # Links and submodels of a document share a row, so the lookup needs no join.
    links = F.expr(
        f"flatten(transform(coalesce(try_variant_get(doc, '$.assetAdministrationShells', 'array<{_SHELL}>'), array()), "
        "s -> transform(coalesce(s.submodels, array()), r -> named_struct("
        "'submodel', get(r.keys, 0).value, 'asset', nullif(s.assetInformation.globalAssetId, '')))))"
    )
    asset = F.expr(
        "try_element_at(filter(links, l -> l.asset is not null and l.submodel = sm.id), -1).asset"
    )
    # Only the links travel with each submodel, not the whole document. The list is exploded as it is read:
    # from a column Spark would infer a filter and parse the document once more for it.
    members = F.posexplode(F.expr(f"try_variant_get(doc, '$.submodels', 'array<{_SUBMODEL}>')"))
    return documents.select("source", "event_ts", links.alias("links"), members.alias("sm_pos", "sm")).select(
        "source",
        "event_ts",
        "sm_pos",
        asset.alias("asset_id"),
        F.col("sm.id").alias("submodel_id"),
        F.col("sm.idShort").alias("submodel"),
        first_key.alias("submodel_semantic_id"),
        F.col("sm.submodelElements").alias("elements"),
    )


def submodels(documents: DataFrame) -> DataFrame:
    """One row per submodel of each document, with its asset or NULL."""
    return _submodel_rows(documents)


def flatten_documents(documents: DataFrame, language: str = "en") -> DataFrame:
    """Metric rows of parsed documents; submodels without a name are skipped.

    ``documents`` has source, event_ts and doc (a variant, NULL when quarantined).
    """
    named = _submodel_rows(documents).filter(F.coalesce(F.col("submodel"), F.lit("")) != "")
    linked = named.withColumn("leaf", F.explode(walk("elements", "submodel", language)))
    value_type = types.xsd_name(F.col("leaf.value_type"))
    typed = types.typed_value(F.col("value_type"), F.col("leaf.literal"))
    return linked.withColumn("value_type", value_type).select(
        "asset_id",
        "submodel",
        "leaf.path",
        *[c.alias(name) for name, c in typed.items()],
        "leaf.aas_type",
        "value_type",
        F.get("leaf.keys", F.lit(0)).alias("semantic_id"),
        F.col("leaf.keys").alias("semantic_keys"),
        "leaf.unit",
        F.col("source").alias("aas_source"),
        F.col("event_ts").alias("timestamp_ms"),
        "submodel_semantic_id",
        F.concat(F.lpad(F.col("sm_pos").cast("string"), 10, "0"), F.col("leaf.ord")).alias("elem_order"),
    )
