"""The service's routes and the command line, on a small graph."""

import pytest

from tessera.__main__ import main
from tessera.functions import vocabulary as V
from tessera.service import Service


@pytest.fixture(scope="module")
def service(spark):
    ns, kind = V.DATASET_NS, V.CLASSES["peptide"]
    rows = [(f"{ns}p{i}", V.RDF_TYPE, kind, "iri", "iri", None, None) for i in range(12)]
    rows += [(f"{ns}p{i}", V.RDFS_LABEL, f"Peptide {i:02d}", "iri", "lit", None, None) for i in range(12)]
    rows += [(f"{ns}p1", f"{V.SCHEMA_NS}sequence", "AAK", "iri", "lit", None, None), (f"{ns}c1", V.RELATIONS["has_part"], f"{ns}p1", "iri", "iri", None, None)]
    return Service(spark.createDataFrame(rows, "s string, p string, o string, s_kind string, o_kind string, o_lang string, o_dt string"))


def test_routes(service):
    assert service.answer("/api/status") == {"ready": True}
    assert service.answer("/api/metrics")["rows"][0][0] == 26
    assert ["peptide", V.CLASSES["peptide"], 12] in service.answer("/api/classes")["rows"]
    page = service.answer("/api/browse", {"class": V.CLASSES["peptide"], "page": "2", "per_page": "10"})
    assert (page["total"], page["pages"], len(page["rows"])) == (12, 2, 2)
    assert service.answer("/api/search", body={"filters": {"sequence": "aa"}})["rows"][0][:2] == [f"{V.DATASET_NS}p1", "Peptide 01"]
    assert "Scan" in service.answer("/api/search/preview", body={"filters": {"sequence": "aa"}})["plan"]
    assert len(service.answer("/api/autocomplete/peptide", {"q": "1"})["rows"]) == 3
    assert service.answer("/api/entity/p1")["iri"] == f"{V.DATASET_NS}p1"
    assert service.answer("/dataset/p1").count("\n") == 3
    assert service.answer("/api/sparql", body={"query": f"SELECT (COUNT(?x) AS ?n) WHERE {{ ?x <{V.RDFS_LABEL}> ?l }}"})["rows"] == [[12]]
    assert service.answer("/sitemap.xml").count("<loc>") == 12 and service.answer("/robots.txt")
    assert len(list(service.answer("/api/download/ttl"))) == 26 and "/api/download/ttl" not in str(service.cache.keys())
    described = service.answer("/dataset/void")
    assert '<http://rdfs.org/ns/void#triples> "26"' in described and described.count("#propertyPartition") == 4
    for bad in ("/api/entity/none", "/nothing"):
        with pytest.raises(KeyError):
            service.answer(bad)
    with pytest.raises(ValueError):
        service.answer("/api/search", body={"filters": {"sequence": " "}})


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    (tmp_path / "t.csv").write_text('Sequence,Cargo Type,Subcellular Localization,Uptake Mechanism\naak-1,"x and y",nucleus,endocytosis\nZ9,a,b,c\n')
    main(["preprocess", f"file://{tmp_path}/t.csv", f"file://{tmp_path}/out", "--columns", "Sequence,Cargo Type,Subcellular Localization,Uptake Mechanism", "--split", "Cargo Type!"])
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() == 2
    (tmp_path / "o.obo").write_text('[Term]\nid: T:1\nname: Red Cell\nsynonym: "rc" EXACT []\n\n[Term]\nid: T:2\nname: blue\n')
    (tmp_path / "m.csv").write_text("Name\nRED\nrc 5nM\nnone\n")
    main(["link", f"file://{tmp_path}/m.csv", f"file://{tmp_path}/linked", "--columns", "Name", "--column", "Name", "--ontology", "T", "--obo", f"file://{tmp_path}/o.obo"])
    got = {r.Name: (r.exact_curie, r.exact_match_type) for r in spark.read.csv(f"file://{tmp_path}/linked", header=True).collect()}
    assert got == {"RED": ("T:1", "exact_pref"), "rc 5nM": ("T:1", "prefix_truncated"), "none": (None, "NIL")}
    main(["link", f"file://{tmp_path}/m.csv", f"file://{tmp_path}/dense", "--columns", "Name", "--column", "Name", "--ontology", "T", "--obo", f"file://{tmp_path}/o.obo", "--methods", "exact,biosyn"])
    got = {r.Name: (r.exact_match_type, r.biosyn_match_type) for r in spark.read.csv(f"file://{tmp_path}/dense", header=True).collect()}
    assert got["RED"] == ("exact_pref", "exact_pref") and got["none"] == ("NIL", "dense_nn")
    with pytest.raises(SystemExit):
        main(["link", f"file://{tmp_path}/m.csv", f"file://{tmp_path}/no", "--columns", "Name", "--column", "Name", "--ontology", "T", "--obo", f"file://{tmp_path}/o.obo", "--methods", "rag"])
    (tmp_path / "g.nt").write_text("<a> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <b> .\n<b> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <c> .\n")
    main(["materialize", f"file://{tmp_path}/g.nt", f"file://{tmp_path}/full"])
    assert spark.read.text(f"file://{tmp_path}/full").count() == 3
    main(["validate", f"file://{tmp_path}/g.nt"])
    main(["query", f"file://{tmp_path}/g.nt", "SELECT ?x WHERE { ?x ?p ?y }"])
