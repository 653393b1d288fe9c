"""Fixed values that results depend on: alphabets, keywords, code lists, relations."""

STANDARD_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
NULL_WORDS = ["", "na", "n/a", "nan", "none", "null"]
BLANK_WORDS = ["", "NIL", "NAN", "NONE"]
OBO = "http://purl.obolibrary.org/obo/"
SIO = "http://semanticscience.org/resource/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
SUB_CLASS_OF = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
ON_PROPERTY = "http://www.w3.org/2002/07/owl#onProperty"
SOME_VALUES_FROM = "http://www.w3.org/2002/07/owl#someValuesFrom"
OWL = "http://www.w3.org/2002/07/owl#"
EXACT_SYNONYM = "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym"
#: own namespaces of graphs that this engine builds; pass others where needed
SCHEMA_NS = "https://example.org/kg/schema#"
DATASET_NS = "https://example.org/kg/dataset/"

# Keyword groups of the uptake classifiers.
ENDOCYTOSIS_KEYWORDS = [
    "endocytosis", "macropinocytosis", "phagocytosis", "pinocytosis", "caveolae", "caveolin", "clathrin", "lipid raft", "raft",
    "receptor-mediated", "rme", "transcytosis", "adsorptive", "ldl-mediated", "tfr1", "nrp-1", "hs-dependent",
]
DIRECT_KEYWORDS = [
    "direct translocation", "direct penetration", "direct membrane", "membrane translocation", "translocation", "membrane damage",
    "membrane disruption", "energy-independent pathway", "non-endocytic", "non-dependent energy", "passive cell penetration",
]
LOCATION_KEYWORDS = {
    "Cytoplasm": ["cytoplasm", "cytosol", "intramembrane", "perinuclear", "around the nucleus", "centrosmal", "periplasm"],
    "Endosomes": ["endosome", "endosomal", "endocytic", "late endosomal"],
    "Vesicles": ["vesicle", "vacuole", "acrosome", "multivesicular"],
    "Mitochondria": ["mitochondria", "mitochondrial", "chloroplast"],
    "Nucleus": ["nucleus", "nuclei", "nuclear", "nucleolar", "nucleoi"],
}

# Code lists.
MAIN_CODES = {
    "Direct penetration": f"{OBO}GO_0022857 , {OBO}GO_0098739",
    "Endocytosis": f"{OBO}GO_0006897",
}
SUB_CODES = {
    "Clathrin-mediated endocytosis": f"{OBO}GO_0072583",
    "Macropinocytosis": f"{OBO}GO_0044351",
    "Phagocytosis": f"{OBO}GO_0006909",
    "Caveolae-mediated endocytosis": f"{OBO}GO_0072584",
    "Clathrin- and caveolae-independent endocytosis": f"{OBO}GO_0160294",
}
LOCATION_CODES = {
    "Cytoplasm": f"{OBO}GO_0005737",
    "Nucleus": f"{OBO}GO_0005634",
    "Vesicles": f"{OBO}GO_0031982",
    "Mitochondria": f"{OBO}GO_0005739",
    "Endosomes": f"{OBO}GO_0005768",
}
ASSAY_CODES = {
    "In vivo": "http://www.bioassayontology.org/bao#BAO_0020009",
    "In vitro": "http://www.bioassayontology.org/bao#BAO_0020008",
    "In situ": "http://www.bioassayontology.org/bao#BAO_0000128",
    "Ex vivo": "http://www.bioassayontology.org/bao#BAO_0020006",
}

# Relations of the public SIO vocabulary.
RELATIONS = {
    "has_attribute": f"{SIO}SIO_000008", "is_attribute_of": f"{SIO}SIO_000011", "is_realized_in": f"{SIO}SIO_000356", "realizes": f"{SIO}SIO_000355",
    "has_part": f"{SIO}SIO_000369", "is_part_of": f"{SIO}SIO_000313", "has_participant": f"{SIO}SIO_000132", "is_participant_in": f"{SIO}SIO_000062",
    "is_located_in": f"{SIO}SIO_000061", "is_about": f"{SIO}SIO_000332", "is_described_by": f"{SIO}SIO_000557", "describes": f"{SIO}SIO_000563",
    "has_evidence": f"{SIO}SIO_000772", "positively_regulates": f"{SIO}SIO_001401", "negatively_regulates": f"{SIO}SIO_001402",
}
INVERSES = {"has_attribute": "is_attribute_of", "is_realized_in": "realizes", "has_part": "is_part_of", "has_participant": "is_participant_in", "is_described_by": "describes"}
CLASSES = {
    "gene": f"{SIO}SIO_010035", "activator_role": f"{SIO}SIO_000804", "up_regulation": f"{SIO}SIO_010295", "inhibitor": f"{SIO}SIO_010435",
    "inhibitor_role": f"{SIO}SIO_000803", "down_regulation": f"{SIO}SIO_010296", "cell_line": f"{SIO}SIO_010054", "subcellular": f"{SIO}SIO_001400",
    "experiment": f"{SIO}SIO_000994", "document": f"{SIO}SIO_000148", "peptide": f"{SCHEMA_NS}Peptide", "cargo": f"{SCHEMA_NS}Cargo",
    "complex": f"{SCHEMA_NS}Complex", "peptide_role": f"{SCHEMA_NS}PeptideRole", "cargo_role": f"{SCHEMA_NS}CargoRole", "mechanism": f"{SCHEMA_NS}UptakeMechanism",
}
# Literal properties of the wide table's columns.
FEATURES = {
    "Sequence": "sequence", "dssp": "dssp", "SMILES": "smiles", "Peptide Name": "peptideName", "Source of Peptide": "sourceOfPeptide", "Chemical Modification": "chemicalModification",
    "N-terminal Modification": "nTerminalModification", "C terminal Modification": "cTerminalModification", "Chirality": "chirality", "Linearity": "linearity", "Ionic State": "ionicState",
    "In-vivo Model": "inVivoModel", "In-vitro model": "inVitroModel", "Uptake Efficiency": "uptakeEfficiency", "Cell Line": "cellLine", "Cargo Type": "cargoType",
}
