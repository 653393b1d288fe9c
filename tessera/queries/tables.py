"""Joins, set operations, order and limits, deduplication and keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import vocabulary as V
from ..operators import annotations as A
from ..plans.graph_build import numbered_pairs
from ..plans.runtime import table as T
from ..sources import readers as S
from ..sources import writers as W
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
line_sql = ", ".join(LINE)

add("split_multi_value", lambda s, d: A.explode_values(T(s, d, "part").select("p_partkey", F.concat("p_type", F.lit(" and "), "p_brand", F.lit(";"), "p_name").alias("v")), {"v": False}), "select p_partkey, unnest(list_filter(list_transform(string_split(replace(replace(p_type || ' and ' || p_brand || ';' || p_name, ' and ', '|'), ';', '|'), '|'), lambda y: trim(y)), lambda z: z <> '')) as v from part")
add("cross_explode", lambda s, d: A.explode_values(T(s, d, "part").select("p_partkey", F.concat("p_type", F.lit(", "), "p_brand").alias("a"), F.expr("'x or y'").alias("b")), {"a": False, "b": True}), "select p_partkey, a, b from (select p_partkey, unnest([p_type, p_brand]) a from part), (select unnest(['x','y']) b)")
add("dedup_keep_first", lambda s, d: A.keep_first(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], LINE).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {line_sql}) = 1")
add("first_seen_id", lambda s, d: A.first_seen_ids(T(s, d, "part"), "p_name", ["p_partkey"], f"{V.DATASET_NS}P_00", "id"), f"select p_name, '{V.DATASET_NS}P_00' || printf('%04d', row_number() over (order by k)) as id from (select p_name, min(p_partkey) k from part group by p_name)")
add("complex_ids", lambda s, d: numbered_pairs(T(s, d, "lineitem"), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"], "complex_").select("l_partkey", "l_suppkey", "complex"), "select l_partkey, l_suppkey, 'complex_' || printf('%04d', row_number() over (order by o, n, l_partkey, l_suppkey)) as complex from (select l_partkey, l_suppkey, min(struct_pack(o := l_orderkey, n := l_linenumber)).o o, min(struct_pack(o := l_orderkey, n := l_linenumber)).n n from lineitem group by all)")


def _pipeline(s, d):
    raw = T(s, d, "part").select("p_partkey", F.col("p_name").alias("Sequence"), F.expr("case p_size % 4 when 0 then 'NA' else p_type || ' and ' || p_brand end").alias("Cargo Type"), F.expr("case p_size % 3 when 0 then null else 'nucleus, cytosol' end").alias("Subcellular Localization"), F.expr("case p_size % 2 when 0 then 'none' else 'endocytosis' end").alias("Uptake Mechanism"))
    p = A.Preprocessor(raw).clean_sequences().filter_valid().normalize().filter_required().split({"Cargo Type": True}).classify().deduplicate(["Sequence", "Cargo Type", "Uptake Mechanism"], ["p_partkey"])
    return p.df.select("p_partkey", F.col("Sequence").alias("seq"), F.col("Cargo Type").alias("cargo"), F.col("Main Uptake Mechanism ID").alias("mech"), F.col("Subcellular Delivery ID").alias("loc"))


add("clean_pipeline", _pipeline, f"""
with r as (select p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') seq, case when p_size % 4 = 0 then null else p_type || ' and ' || p_brand end c, case when p_size % 3 = 0 then null else 'x' end l, case when p_size % 2 = 0 then null else 'endocytosis' end m from part),
v as (select * from r where regexp_matches(seq, '^[ACDEFGHIKLMNPQRSTVWY]+$') and (c is not null or l is not null or m is not null)),
e as (select p_partkey, seq, l, m, unnest(case when c is null then [null] else list_filter(list_transform(string_split(replace(c, ' and ', '|'), '|'), lambda y: trim(y)), lambda z: z <> '') end) cargo from v),
k as (select * from e qualify row_number() over (partition by seq, cargo, m order by p_partkey) = 1)
select p_partkey, seq, cargo, case when m is not null then '{V.OBO}GO_0006897' end mech, case when l is not null then '{V.OBO}GO_0005737, {V.OBO}GO_0005634' end loc from k""")

# joins
add("gold_left_join", lambda s, d: T(s, d, "documents").select("doc_id", "lang").join(T(s, d, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id", "left"), "select d.doc_id, lang, quality from documents d left join labels l on d.doc_id = l.doc_id")
add("anti_todo", lambda s, d: T(s, d, "customer").select("c_custkey").join(T(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
add("semi_overlap", lambda s, d: T(s, d, "documents").join(T(s, d, "labels").filter("quality = 0"), "doc_id", "left_semi").agg(F.count("*").alias("n")), "select count(*) n from documents where doc_id in (select doc_id from labels where quality = 0)")
add("composite_key_join", lambda s, d: (lambda l: l.join(l.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1"), ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.sum("n").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")))(T(s, d, "lineitem")), "with p as (select l_partkey, l_suppkey, count(*) n from lineitem group by all having count(*) > 1) select l_partkey, l_suppkey, cast(sum(n) as bigint) n, round(sum(l_quantity), 2) q from lineitem join p using (l_partkey, l_suppkey) group by all")
add("lookup_broadcast", lambda s, d: T(s, d, "supplier").join(F.broadcast(T(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(T(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name"), "select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
add("values_join", lambda s, d: T(s, d, "orders").join(F.broadcast(s.createDataFrame([("1-URGENT", "a"), ("5-LOW", "b")], "o_orderpriority string, tag string")), "o_orderpriority").groupBy("tag").agg(F.count("*").alias("n")), "select tag, count(*) n from orders join (values ('1-URGENT','a'), ('5-LOW','b')) v(o_orderpriority, tag) using (o_orderpriority) group by tag")
add("annotator_join", lambda s, d: T(s, d, "labels").select("doc_id", F.col("quality").alias("a")).join(T(s, d, "labels").select("doc_id", F.col("toxic").alias("b")), "doc_id"), "select doc_id, quality a, toxic b from labels")

# windows, order, limits
add("topk_groups", lambda s, d: T(s, d, "supplier").withColumn("rn", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))).filter("rn <= 2").select("s_nationkey", "s_suppkey", F.col("rn").cast("long").alias("rn")), "select s_nationkey, s_suppkey, rn from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) rn from supplier) where rn <= 2")
add("argmax", lambda s, d: T(s, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("best"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("at")), "select p_brand, max(p_retailprice) best, arg_max(p_partkey, struct_pack(a := p_retailprice, b := -p_partkey)) as at from part group by p_brand")
add("page", lambda s, d: T(s, d, "part").select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_partkey").offset(50).limit(25), "select p_partkey, p_name from part order by lower(p_name), p_partkey limit 25 offset 50")
add("page_count", lambda s, d: T(s, d, "part").filter(C.contains_text(F.col("p_name"), "ring")).agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / 25)).cast("long").alias("pages")), "select count(*) total, greatest(1, cast(ceil(count(*) / 25.0) as bigint)) pages from part where contains(lower(p_name), 'ring')")
add("most_common", lambda s, d: T(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10), "select user_id, count(*) n from events group by user_id order by n desc, user_id limit 10")
add("multi_key_sort", lambda s, d: T(s, d, "nation").orderBy(F.desc("n_regionkey"), "n_name").select("n_regionkey", "n_name"), "select n_regionkey, n_name from nation order by n_regionkey desc, n_name")

# sets
add("union_nodes", lambda s, d: T(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("node")).union(T(s, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey"))).distinct(), "select 'p' || l_partkey node from lineitem union select 's' || l_suppkey from lineitem")
add("except_nodes", lambda s, d: T(s, d, "customer").select("c_custkey").exceptAll(T(s, d, "orders").select("o_custkey").distinct()), "select c_custkey from customer except select o_custkey from orders")
add("intersect_nodes", lambda s, d: T(s, d, "documents").select("doc_id").intersect(T(s, d, "labels").select("doc_id")), "select doc_id from documents intersect select doc_id from labels")
add("union_ids_count", lambda s, d: T(s, d, "nation").select("n_nationkey").union(T(s, d, "supplier").select("s_nationkey")).distinct().agg(F.count("*").alias("n")), "select count(*) n from (select n_nationkey from nation union select s_nationkey from supplier)")

# sampling and fixes
add("clear_spurious", lambda s, d: A.clear_where(T(s, d, "part").selectExpr("p_partkey", "case when p_size % 4 = 0 then ' ' else p_name end src", "p_brand id", "p_type label"), C.is_blank(F.col("src")) & F.col("id").isNotNull(), ["id", "label"]), "select p_partkey, case when p_size % 4 = 0 then ' ' else p_name end src, case when p_size % 4 = 0 then null else p_brand end id, case when p_size % 4 = 0 then null else p_type end as label from part")
add("first_non_null", lambda s, d: A.first_non_null(T(s, d, "part").selectExpr("p_brand", "p_partkey", "case when p_size % 3 = 0 then p_name end a", "case when p_size % 2 = 0 then p_type end b"), "p_brand", ["a", "b"], ["p_partkey"]), "select p_brand, arg_min(p_name, p_partkey) filter (where p_size % 3 = 0) a, arg_min(p_type, p_partkey) filter (where p_size % 2 = 0) b from part group by p_brand")
add("sample_label", lambda s, d: T(s, d, "part").groupBy("p_type").agg(F.min("p_name").alias("label"), F.count("*").alias("n")), "select p_type, min(p_name) as label, count(*) n from part group by p_type")
add("mode_per_group", lambda s, d: T(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("mode")), "select p_brand, arg_max(p_type, struct_pack(n := n, t := p_type)) as mode from (select p_brand, p_type, count(*) n from part group by all) group by p_brand")


def _strata(s, d):
    counts = T(s, d, "events").groupBy("user_id").agg(F.count("*").alias("k")).select(A.band(F.col("k")).alias("band"), "user_id")
    sizes = {r[0]: r[1] for r in counts.groupBy("band").count().collect()}  # four bands
    return A.stratified_sample(counts, "band", "user_id", A.allocate(sizes, 60, 5), 764)


def _allocation(s, d):
    return s.createDataFrame(sorted(A.allocate({"a": 500, "b": 300, "c": 40, "d": 10}, 300).items()), "band string, n long")


add("stratified_sample", _strata)
add("strata_allocation", _allocation, "select * from (values ('a', 165::bigint), ('b', 95::bigint), ('c', 30::bigint), ('d', 10::bigint)) t(band, n)")

RECORDS = "ID   A-1\nSY   A1; A 1\nDR   CLO; CLO_0000001\nDR   X; Y\n//\nID   B\nDR   X; Z\n//\nID   C-3\nDR   CLO; CLO_0000003\n//\n"
OBO = 'format-version: 1.2\n\n[Term]\nid: T:1\nname: top\n\n[Term]\nid: T:2\nname: low thing\nsynonym: "small thing" EXACT []\nis_a: T:1 ! top\n\n[Term]\nid: U:3\nname: other\n\n[Term]\nid: T:4\nname: last\n\n[Typedef]\nid: part_of\nname: part of\nsynonym: "piece" EXACT []\nis_a: T:1\n'
NT = '<http://x/a> <http://x/p> "l \\"q\\""@en .\n<http://x/a> <http://x/p> <http://x/b> .\n_:b1 <http://x/q> "5"^^<http://x/int> .\n# c\n<http://x/a> <http://x/p> <http://x/b> .\n'
TTL = '@prefix x: <http://x/> .\nx:a a x:C ; x:p [ x:q "v"@en ] , x:b .\nx:b x:n 5 .\n'
EDGES = "http://x/1\thttp://x/2\nhttp://x/3\t\nhttp://x/1\thttp://x/4\n"
CSV = 'Term,Id,Note\n"a, b",CHEBI:1,NA\nc,NIL,"x ""y"""\nd,,n\n'


def _file(s, text: str, suffix: str) -> str:
    """A small file in the shared folder, written by Spark's own file system."""
    from ..plans.runtime import fresh_path

    path = fresh_path(s, "fixture") + suffix
    jvm = s._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(s._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode()))
    out.close()
    return path


add("scan_csv", lambda s, d: S.read_csv(s, _file(s, CSV, ".csv"), ["Term", "Id", "Note"]).select(F.col("Term").alias("term"), F.col("Id").alias("id"), F.col("Note").alias("note")), "select * from (values ('a, b','CHEBI:1',null), ('c','NIL','x \"y\"'), ('d',null,'n')) t(term, id, note)")
add("scan_csv_pruned", lambda s, d: S.read_csv(s, _file(s, CSV, ".csv"), ["Term", "Id", "Note"], prune=["Id"]).select(F.col("Id").alias("id")), "select * from (values ('CHEBI:1'), ('NIL'), (null)) t(id)")
add("scan_edges", lambda s, d: S.read_edges(s, _file(s, EDGES, ".tsv")), "select * from (values ('http://x/1','http://x/2'), ('http://x/1','http://x/4')) t(subject, object)")
add("scan_records", lambda s, d: S.read_records(s, _file(s, RECORDS, ".txt")), "select * from (values ('A-1','CLO:0000001'), ('A1','CLO:0000001'), ('A 1','CLO:0000001'), ('C-3','CLO:0000003')) t(name, id)")
add("scan_obo", lambda s, d: S.read_obo(s, _file(s, OBO, ".obo"), "T").select("curie", "label", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("parents", "|").alias("parents")), "select * from (values ('T:1','top','',''), ('T:2','low thing','small thing','T:1'), ('T:4','last','','')) t(curie, label, synonyms, parents)")
add("scan_ntriples", lambda s, d: S.read_ntriples(s, _file(s, NT, ".nt")).select("s", "p", "o", "s_kind", "o_kind", "o_lang", "o_dt"), "select * from (values ('http://x/a','http://x/p','l \"q\"','iri','lit','en',null), ('http://x/a','http://x/p','http://x/b','iri','iri',null,null), ('_:b1','http://x/q','5','bnode','lit',null,'http://x/int')) t(s,p,o,s_kind,o_kind,o_lang,o_dt)")
add("scan_turtle", lambda s, d: S.load_graph(s, ["/no/such.ttl", _file(s, TTL, ".ttl")]).select("s", "p", "o", "o_kind"), "select * from (values ('http://x/a','http://www.w3.org/1999/02/22-rdf-syntax-ns#type','http://x/C','iri'), ('_:b1','http://x/q','v','lit'), ('http://x/a','http://x/p','_:b1','bnode'), ('http://x/a','http://x/p','http://x/b','iri'), ('http://x/b','http://x/n','5','lit')) t(s,p,o,o_kind)")
add("scan_local_names", lambda s, d: S.local_names(s.read.text(_file(s, NT, ".nt")), r"http://x/([a-z]+)>"), "select * from (values ('a'), ('b'), ('p'), ('q'), ('int')) t(name)")
MECH = '[{"GO_identifier":"http://x/GO_1","mechanism_name":"m","associated_genes":[{"ensembl_id":"http://x/E1","name":"g1","PUBMED_ID":"12"},"http://x/E2"],"inhibitors":[{"CheBI":"http://x/C1","pubmed":"7"}],"pathways":[{"associated_genes":[{"ensembl":"http://x/E3"}]}]}]'
add("edges_from_json", lambda s, d: S.read_mechanisms(s, _file(s, MECH, ".json")).select("mechanism", "kind", "item", "pubmed"), "select * from (values ('http://x/GO_1','gene','http://x/E1','12'), ('http://x/GO_1','gene','http://x/E2',null), ('http://x/GO_1','inhibitor','http://x/C1','7'), ('http://x/GO_1','gene','http://x/E3',null)) t(mechanism, kind, item, pubmed)")
XML = '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="http://x/A"><rdfs:label>a</rdfs:label></owl:Class><owl:Class rdf:about="http://x/B"><rdfs:subClassOf rdf:resource="http://x/A"/><rdfs:label>b</rdfs:label></owl:Class></rdf:RDF>'
add("scan_rdf_xml", lambda s, d: S.read_rdf_xml(s, _file(s, XML, ".owl")).select("iri", "label", F.array_join("parents", "|").alias("parents")), "select * from (values ('http://x/A','a',''), ('http://x/B','b','http://x/A')) t(iri, label, parents)")
BINDINGS = '{"head":{"vars":["a","b"]},"results":{"bindings":[{"a":{"value":"1"},"b":{"value":"x"}},{"a":{"value":"2"}}]}}'
add("remote_bindings", lambda s, d: S.sparql_bindings(s, BINDINGS), "select * from (values ('1','x'), ('2',null)) t(a, b)")
add("service_lookup", lambda s, d: S.lookup(T(s, d, "nation").select(F.col("n_name").alias("term")), lambda t: [t.lower()], cache=s.createDataFrame([("NATION_0", ["cached"])], "term string, ids array<string>")).select("term", F.array_join("ids", ",").alias("ids")), "select n_name term, case when n_name = 'NATION_0' then 'cached' else lower(n_name) end ids from nation")


# -- sinks, read back


def _written(s, write, kind: str) -> str:
    from ..plans.runtime import fresh_path

    path = fresh_path(s, kind)
    write(path)
    return path


def _csv(s, d):
    path = _written(s, lambda p: W.write_csv(T(s, d, "part").select("p_name", F.concat(F.lit('say "'), "p_brand", F.lit('", ok')).alias("note")), p), "csv")
    return S.read_csv(s, path, ["p_name", "note"])


def _edges(s, d):
    path = _written(s, lambda p: W.write_edges(T(s, d, "nation").select(F.col("n_name").alias("subject"), F.concat(F.lit("r"), "n_regionkey").alias("object")), p), "edges")
    return S.read_edges(s, path)


def _json(s, d):
    path = _written(s, lambda p: W.write_json(T(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), p), "json")
    return s.read.json(path, schema="p_type string, n long")


def _graph(s, d):
    none = F.lit(None).cast("string")
    rows = T(s, d, "nation").select(F.concat(F.lit("http://x/"), "n_nationkey").alias("s"), F.lit("http://x/label").alias("p"), F.concat("n_name", F.lit(' "q"\n')).alias("o"), F.lit("iri").alias("s_kind"), F.lit("lit").alias("o_kind"), F.lit("en").alias("o_lang"), none.alias("o_dt"))
    path = _written(s, lambda p: W.write_graph(rows, p), "graph")
    return S.read_ntriples(s, path).select("s", "o", "o_lang")


def _cached(s, d):
    make = lambda: T(s, d, "part").select("p_name").distinct()
    from ..plans.runtime import shared_dir

    root = f"{shared_dir(s)}/pool"
    S.cached_by_key(s, root, f"parts of {d}", make)
    return S.cached_by_key(s, root, f"parts of {d}", make)


add("sink_csv", _csv, "select p_name, 'say \"' || p_brand || '\", ok' note from part")
add("sink_edges", _edges, 'select n_name subject, \'r\' || n_regionkey "object" from nation')
add("sink_json", _json, "select p_type, count(*) n from part group by p_type")
add("sink_graph", _graph, "select 'http://x/' || n_nationkey s, n_name || ' \"q\"' || chr(10) o, 'en' o_lang from nation")
add("pool_cache", _cached, "select distinct p_name from part")
add("metadata_enrichment", lambda s, d: T(s, d, "supplier").join(T(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.concat(F.lit("NATION "), "s_nationkey")).alias("label")), "select s_suppkey, coalesce(n_name, 'NATION ' || s_nationkey) as label from supplier left join (select * from nation where n_nationkey < 20) on s_nationkey = n_nationkey")
add("idempotent_add", lambda s, d: (lambda a, b: a.unionByName(b.join(a, a.columns, "left_anti")))(T(s, d, "labels").select("doc_id").filter("doc_id % 2 = 0"), T(s, d, "labels").select("doc_id")), "select doc_id from labels")
add("append_strata", lambda s, d: T(s, d, "part").filter("p_size <= 5").select("p_partkey", F.lit("a").alias("band")).unionByName(T(s, d, "part").filter("p_size > 5 and p_size <= 20").select("p_partkey", F.lit("b").alias("band"))), "select p_partkey, case when p_size <= 5 then 'a' else 'b' end band from part where p_size <= 20")
