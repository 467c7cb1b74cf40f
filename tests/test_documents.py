import json

from plantweave.operators import flatten
from plantweave.sources import documents


def prop(name, value, kind="xs:string", **more):
    return {"modelType": "Property", "idShort": name, "valueType": kind, "value": value, **more}


def coll(name, *items):
    return {"modelType": "SubmodelElementCollection", "idShort": name, "value": list(items)}


def listed(name, *items):
    return {"modelType": "SubmodelElementList", "idShort": name, "value": list(items)}


def environment(*elements, submodel="S", asset="urn:a"):
    return {
        "assetAdministrationShells": [
            {"modelType": "AssetAdministrationShell", "id": "urn:s", "assetInformation": {"globalAssetId": asset},
             "submodels": [{"type": "ModelReference", "keys": [{"type": "Submodel", "value": "urn:sm"}]}]}
        ],
        "submodels": [{"modelType": "Submodel", "idShort": submodel, "id": "urn:sm", "submodelElements": list(elements)}],
    }


def load(spark, *contents):
    texts = [c if isinstance(c, str) else json.dumps(c) for c in contents]
    return spark.createDataFrame([(f"d{i}", 100 + i, t) for i, t in enumerate(texts)], "source string, event_ts bigint, content string")


def flat(spark, *contents, **options):
    rows = flatten.flatten_documents(documents.with_doc(load(spark, *contents)), **options).collect()
    return {r.path: r for r in sorted(rows, key=lambda r: r.elem_order)}


def test_paths_values_and_links(spark):
    got = flat(spark, environment(
        prop("a", "1.50", "xs:double", semanticId={"keys": [{"type": "G", "value": "k1"}, {"type": "G", "value": "k2"}]},
             embeddedDataSpecifications=[{"dataSpecificationContent": {}}, {"dataSpecificationContent": {"unit": "mm"}}]),
        coll("c", prop(None, 7, "xs:int"), coll("d", prop("e", "true", "xs:boolean"))),
        listed("l", prop(None, "x"), coll(None, prop("y", "2")), listed(None, prop(None, "deep"), prop(None, "deeper"))),
        {"modelType": "MultiLanguageProperty", "idShort": "m", "value": [{"language": "de", "text": "ja"}, {"language": "en", "text": "yes"}]},
        {"modelType": "Range", "idShort": "r", "valueType": "xs:int", "min": "1"},
        {"modelType": "ReferenceElement", "idShort": "f", "value": {"keys": [{"value": "p"}, {"value": "q"}]}},
        {"modelType": "Entity", "idShort": "n", "entityType": "CoManagedEntity", "statements": [prop("s", "v")]},
        {"modelType": "RelationshipElement", "idShort": "rel", "first": {"keys": [{"value": "A"}]}},
        {"modelType": "File", "idShort": "file", "value": "x"}, {"modelType": "Capability", "idShort": "cap"},
        coll("empty"), listed("none"),
    ))
    assert {p: r.value for p, r in got.items()} == {
        "S.a": "1.5", "S.c.unnamed": "7", "S.c.d.e": "true", "S.l[0]": "x", "S.l[1].y": "2", "S.l[2][0]": "deep",
        "S.l[2][1]": "deeper", "S.m": "yes", "S.r.min": "1", "S.f": "p/q", "S.n.entityType": "CO_MANAGED_ENTITY",
        "S.n.s": "v", "S.rel": "A -> ", "S.cap": None,
    }
    a = got["S.a"]
    assert (a.asset_id, a.unit, a.semantic_id, a.semantic_keys, a.value_num) == ("urn:a", "mm", "k1", ["k1", "k2"], 1.5)
    assert got["S.c.d.e"].value_num == 1.0 and got["S.cap"].aas_type == "Capability" and got["S.cap"].value_json == "null"
    assert flat(spark, environment({"modelType": "MultiLanguageProperty", "idShort": "m", "value": [{"language": "fr", "text": "oui"}]}))["S.m"].value == "oui"


def test_bad_documents_are_set_apart(spark):
    good = environment(prop("a", "1"))
    docs = load(spark, good, "{broken", "", json.dumps(good) + "{", '"text"', "[1]", "null", "1,2")
    ok, bad = documents.parse_documents(docs)
    assert [r.source for r in ok.collect()] == ["d0"] and bad.count() == 7
    assert list(flat(spark, good, "{broken", json.dumps(good) + " x")) == ["S.a"]


def test_deep_documents_keep_all_rows(spark):
    nested = prop("leaf", "1")
    for i in range(200):
        nested = coll(f"c{i}", nested)
    rows = flat(spark, environment(nested), environment(prop("[[a", "1")))
    assert sorted(len(path.split(".")) for path in rows) == [2, 202]


def test_unlinked_and_relinked_submodels(spark):
    doc = environment(prop("a", "1"))
    doc["assetAdministrationShells"].append(dict(doc["assetAdministrationShells"][0], assetInformation={"globalAssetId": "urn:b"}))
    assert flat(spark, doc)["S.a"].asset_id == "urn:b"
    doc["assetAdministrationShells"] = []
    assert flat(spark, doc)["S.a"].asset_id is None
    assert flat(spark, environment(prop("a", "1"), submodel="")) == {}


def test_large_document(spark):
    groups = [coll(f"Group{g:03d}", *[prop(f"P{g * 50 + i:05d}", str(i), "xs:int") for i in range(50)]) for g in range(100)]
    assert len(flat(spark, environment(*groups))) == 5000


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.json", "sub/b.json"):
        (tmp_path / name).write_text(json.dumps(environment(prop("a", name))))
    (tmp_path / "c.txt").write_text("no")
    read = documents.read_documents(spark, str(tmp_path))
    assert flatten.flatten_documents(documents.with_doc(read)).count() == 2
    before = [tuple(r) for r in documents.read_file_hashes(spark, str(tmp_path), "*.json").collect()]
    (tmp_path / "a.json").write_text("{}")
    manifest = spark.createDataFrame(before, "path string, hash string")
    changed = documents.changed_files(documents.read_file_hashes(spark, str(tmp_path), "*.json"), manifest)
    assert [r.path.rsplit("/", 1)[1] for r in changed.collect()] == ["a.json"]
