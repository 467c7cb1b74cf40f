"""Asset documents: parsing, flattening, change tests, and the whole publishing pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantweave.operators import flatten
from plantweave.plans import views as v
from plantweave.plans.registry import query
from plantweave.sources import documents

_GOOD = "p_partkey % 97 <> 0 AND p_partkey % 89 <> 0"
_ASSET = "CASE WHEN p_partkey % 11 <> 0 THEN 'https://example.com/aas/part-' || p_partkey WHEN p_partkey % 7 = 0 THEN 'https://example.com/aas/part-' || p_partkey || '-old' END"


@query(
    "documents_parsed",
    f"SELECT 'part-' || p_partkey || '.json' AS source, {_GOOD} AS ok FROM part",
)
def documents_parsed(spark, sf):
    return documents.parse_states(v.documents_json(spark, sf))


@query("submodel_links", f"SELECT 'urn:sm:' || p_partkey AS submodel_id, {_ASSET} AS asset_id FROM part WHERE {_GOOD}")
def submodel_links(spark, sf):
    return flatten.submodels(documents.with_doc(v.documents_json(spark, sf))).select("submodel_id", "asset_id")


@query(
    "submodel_assets",
    f"SELECT 'urn:sm:' || p_partkey AS submodel_id, {_ASSET} AS asset_id FROM part WHERE {_GOOD} AND (p_partkey % 11 <> 0 OR p_partkey % 7 = 0)",
)
def submodel_assets(spark, sf):
    return flatten.submodel_assets(documents.with_doc(v.documents_json(spark, sf)))


_T = "'TechnicalData."
_LINES = """lines AS (SELECT l_partkey, min(l_quantity) AS qmin, max(l_quantity) AS qmax, list(l_quantity ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS qs
  FROM lineitem GROUP BY l_partkey),
p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS pk FROM part LEFT JOIN lines ON p_partkey = l_partkey WHERE """ + _GOOD + ")"


def _row(path, kind, value_type, value, json, sid="NULL", unit="NULL", where="true"):
    return (
        f"SELECT p_partkey, {path} AS path, '{kind}' AS aas_type, '{value_type}' AS value_type, {value} AS value, {json} AS value_json, "
        f"CAST({sid} AS VARCHAR) AS semantic_id, CAST({unit} AS VARCHAR) AS unit FROM p WHERE {where}"
    )


def _str(path, kind, value, where="true"):
    js = f"coalesce(CAST(to_json(CAST({value} AS VARCHAR)) AS VARCHAR), 'null')"
    return _row(path, kind, "xs:string", value, js, where=where)


def _num(path, kind, value_type, value, unit="NULL", where="true"):
    return _row(path, kind, value_type, f"CAST({value} AS VARCHAR)", f"CAST({value} AS VARCHAR)", unit=unit, where=where)


_FLAT = f"""{_LINES}, flat AS (
  {_row(_T + "Name'", 'Property', 'xs:string', 'p_name', "CAST(to_json(p_name) AS VARCHAR)", "'0173-1#02-AAO677#002'")}
  UNION ALL {_num(_T + "Price'", 'Property', 'xs:double', 'p_retailprice', "'EUR'")}
  UNION ALL {_str(_T + "Title'", 'MultiLanguageProperty', "CASE WHEN p_partkey % 2 = 0 THEN 'Part ' ELSE 'Teil ' END || pk")}
  UNION ALL {_num(_T + "Dimensions.Size'", 'Property', 'xs:int', 'p_size')}
  UNION ALL {_num(_T + "Dimensions.Quantity.min'", 'Range.min', 'xs:double', 'qmin', where='qmin IS NOT NULL')}
  UNION ALL {_num(_T + "Dimensions.Quantity.max'", 'Range.max', 'xs:double', 'qmax', where='qmax IS NOT NULL AND p_partkey % 3 <> 0')}
  UNION ALL {_num(_T + "Dimensions.unnamed.Large'", 'Property', 'xs:boolean', '(p_size > 25)')}
  UNION ALL SELECT p_partkey, {_T}Quantities[' || (i - 1) || ']', 'Property', 'xs:double', CAST(qs[i] AS VARCHAR), CAST(qs[i] AS VARCHAR), NULL, NULL
    FROM (SELECT *, unnest(range(1, len(qs) + 1)) AS i FROM p WHERE qs IS NOT NULL)
  UNION ALL {_str(_T + "Brand'", 'ReferenceElement', "'urn:brand/' || p_brand")}
  UNION ALL {_str(_T + "Maker.entityType'", 'Entity.entityType', "'SELF_MANAGED_ENTITY'")}
  UNION ALL {_str(_T + "Maker.globalAssetId'", 'Entity.globalAssetId', "'urn:maker:' || pk", 'p_partkey % 2 = 0')}
  UNION ALL {_str(_T + "Maker.Type'", 'Property', 'p_type')}
  UNION ALL {_str(_T + "MadeBy'", 'RelationshipElement', "pk || ' -> ' || CASE WHEN p_partkey % 2 = 1 THEN p_brand ELSE '' END")}
  UNION ALL {_row(_T + "Grip'", 'Capability', 'xs:string', 'NULL', "'null'")})"""


def flattened(spark, sf):
    return flatten.flatten_documents(documents.with_doc(v.documents_json(spark, sf)))


@query(
    "documents_flattened",
    f"""WITH {_FLAT} SELECT {_ASSET} AS asset_id, path, aas_type, value_type, value, value_json, semantic_id, unit,
      CASE WHEN semantic_id IS NOT NULL THEN 2 ELSE 0 END AS keys, 'https://admin-shell.io/idta/TechnicalData/1/2' AS submodel_semantic_id,
      1704067200000 + p_partkey AS timestamp_ms, 'part-' || p_partkey || '.json' AS aas_source FROM flat""",
)
def documents_flattened(spark, sf):
    rows = flattened(spark, sf)
    return rows.select(
        "asset_id", "path", "aas_type", "value_type", "value", "value_json", "semantic_id", "unit",
        F.size("semantic_keys").alias("keys"), "submodel_semantic_id", "timestamp_ms", "aas_source",
    )


@query(
    "element_kinds",
    f"WITH {_FLAT} SELECT aas_type, value_type, count(*) AS n FROM flat GROUP BY ALL",
)
def element_kinds(spark, sf):
    return flattened(spark, sf).groupBy("aas_type", "value_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "changed_files",
    "SELECT 'doc-' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0",
)
def changed_files(spark, sf):
    files = v.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("hash"), "doc_id"
    )
    known = files.filter("doc_id % 3 <> 2").select(
        "path", F.when(F.col("doc_id") % 3 == 1, F.lit("old")).otherwise(F.col("hash")).alias("hash")
    )
    return documents.changed_files(files.drop("doc_id"), known)


_OBJECTS = """SELECT url, CASE page_id % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE true END AS changed FROM pages"""


def object_flags(spark, sf):
    pages = v.table(spark, sf, "pages").select("page_id", "url", F.col("html").alias("content"))
    tag = F.concat(F.lit("v"), F.col("page_id"))
    current = pages.select(
        "page_id", "url", F.when(F.col("page_id") % 4 == 0, tag).alias("version_tag"), "content"
    )
    # Same tag but other text; no tag and same text; no tag and other text; not seen before.
    previous = pages.filter("page_id % 4 <> 3").select(
        "page_id",
        F.when(F.col("page_id") % 4 == 0, tag).alias("version_tag"),
        F.when(F.col("page_id") % 4 == 1, F.col("content")).otherwise("old").alias("content"),
    )
    # Several pages may have one url; each is an object of its own.
    return documents.changed_objects(current, previous, ["page_id"])


@query("changed_objects", _OBJECTS)
def changed_objects(spark, sf):
    return object_flags(spark, sf)


@query("any_object_changed", f"SELECT bool_or(changed) AS any_changed FROM ({_OBJECTS})")
def any_object_changed(spark, sf):
    return documents.any_changed(object_flags(spark, sf))
