"""Scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import vocabulary as V
from ..operators import annotations as A
from ..plans.runtime import table as T
from .registry import Registry

REGISTRY = Registry()


def scalar(name: str, table: str, key: str, source: str, function, sql: str) -> None:
    """One value a row: function over the SQL expression source; sql uses {x} for it."""
    run = lambda s, d: T(s, d, table).select(key, function(F.expr(source)).alias("v"))
    REGISTRY.add(name, run, f"select {key}, {sql.replace('{x}', '(' + source + ')')} as v from {table}")


mark = "p_name || case when p_size % 3 = 0 then ' (x) (b' when p_size % 3 = 1 then ' (aB-1*)' else '' end"
scalar("clean_sequence", "part", "p_partkey", "p_name || '-1*' || p_brand", C.clean_sequence, "regexp_replace(upper({x}), '[^A-Z]', '', 'g')")
scalar("strip_parens", "part", "p_partkey", mark, C.strip_parens, r"regexp_replace({x}, '\s*\(.*?\)', '', 'g')")
na = "case p_size % 7 when 0 then ' NA ' when 1 then 'n/a' when 2 then '' when 3 then 'None' when 4 then null when 5 then ' ' else '  ' || p_name end"
scalar("normalize_na", "part", "p_partkey", na, C.normalize_na, "case when lower(trim({x})) in ('','na','n/a','nan','none','null') then null else trim({x}) end")
scalar("link_key", "part", "p_partkey", "upper(replace(p_name, ' ', '__')) || '  ' || p_brand", C.link_key, r"regexp_replace(lower(replace(coalesce({x},''), '_', ' ')), '\s+', ' ', 'g')")
relax = "upper(p_name) || case p_size % 5 when 0 then ' Cell' when 1 then '  cells.' when 2 then ' cell lines' when 3 then ' cell line.' else '' end"
scalar("relax_suffix", "part", "p_partkey", relax, C.relax_suffix, r"trim(regexp_replace(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), '\s+(cell lines?|cells?)\.?$', ''))")
scalar("sanitize_xml", "part", "p_partkey", "p_name || chr(7) || p_brand || chr(9) || chr(31)", C.sanitize_xml, r"regexp_replace({x}, '[^\t\n\r\x20-\x7e]', '', 'g')")
scalar("curie_to_iri", "part", "p_partkey", "'CHEBI:' || p_partkey", C.curie_to_iri, f"'{V.OBO}' || replace({{x}}, ':', '_')")
scalar("local_name", "pages", "page_id", "url", C.local_name, "list_extract(string_split({x}, '/'), -1)")
scalar("uri_fragment", "pages", "page_id", "url", C.uri_fragment, "coalesce(nullif(regexp_extract({x}, '#([^#]+)$', 1), ''), nullif(regexp_extract({x}, '/([^/]+)$', 1), ''), {x})")
idtext = "case p_size % 6 when 0 then 'CHEBI_' || p_partkey when 1 then 'chebi:' || p_partkey when 2 then 'http://x/CHEBI_' || p_partkey when 3 then 'NIL' when 4 then '' else 'CHEBI:1;CHEBI:' || p_partkey end"
scalar("canon_search", "part", "p_partkey", idtext, lambda c: C.canon_search(c, "CHEBI"), r"'CHEBI:' || nullif(regexp_extract({x}, '(?i)CHEBI[:_]?(\d+)', 1), '')")
scalar("canon_replaced", "part", "p_partkey", idtext, lambda c: C.canon_replaced(c, "CHEBI"), r"'CHEBI:' || nullif(regexp_extract(replace({x}, '_', ':'), '(?i)CHEBI:(\d+)', 1), '')")
scalar("canon_anchored", "part", "p_partkey", idtext, C.canon_anchored, r"regexp_replace(trim({x}), '^(CLO|CHEBI)_(\d+)$', '\1:\2')")
scalar("canon_or_null", "part", "p_partkey", idtext, C.canon_or_null, r"case when upper(trim({x})) in ('NIL','') then null when regexp_matches(trim({x}), '(?i)^(CLO|CHEBI)[_:]\d+$') then upper(replace(trim({x}), '_', ':')) else trim({x}) end")
scalar("canon_or_nil", "part", "p_partkey", idtext, lambda c: C.canon_or_nil(c, "CHEBI"), r"coalesce('CHEBI:' || nullif(regexp_extract(replace({x}, '_', ':'), '(?i)CHEBI:(\d+)', 1), ''), 'NIL')")
scalar("first_candidate", "part", "p_partkey", "case when p_size % 4 = 0 then ';CLO:2' else ' CLO:' || p_size || ' ;CLO:2' end", C.first_candidate, "nullif(trim(string_split({x}, ';')[1]), '')")
scalar("candidate_list", "part", "p_partkey", "'x;CLO_' || p_size || ';CLO:2; clo:3'", lambda c: F.array_join(C.candidates(c, "CLO"), ";"), r"array_to_string(list_filter(list_transform(string_split({x}, ';'), lambda y: 'CLO:' || nullif(regexp_extract(y, '(?i)CLO[:_]?(\d+)', 1), '')), lambda z: z is not null), ';')")
scalar("all_ids", "part", "p_partkey", "'see CLO_' || p_size || ', clo:7 and CLO:7.'", lambda c: F.array_join(C.all_ids(c, "CLO"), ";"), r"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({x}, '(?i)CLO[:_]?(\d+)', 1), lambda y: 'CLO:' || y))), ';')")
scalar("scheme_repair", "pages", "page_id", "replace(url, '://', ':/')", C.scheme_repair, r"regexp_replace({x}, '^(https?):/+', '\1://')")
scalar("safe_iri", "pages", "page_id", "case when page_id % 3 = 0 then url || ' x' when page_id % 3 = 1 then 'no-scheme' else url end", C.is_safe_iri, r"regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:[^<>\s\x22]+$')")
scalar("search_url", "part", "p_partkey", "p_name || ' a&b'", C.search_url, "'https://example.org/search?q=' || replace(url_encode({x}), '%20', '+')")
scalar("net_charge", "part", "p_partkey", "upper(p_name)", C.net_charge, "cast((length({x}) - length(translate({x}, 'KR', ''))) - (length({x}) - length(translate({x}, 'DE', ''))) as bigint)")
scalar("max_residue_fraction", "part", "p_partkey", "case when p_size % 9 = 0 then '' else regexp_replace(upper(p_name), ' ', '') end", C.max_residue_fraction, "case when length({x}) = 0 then 0.0 else list_max(list_transform(range(65, 91), lambda a: length({x}) - length(replace({x}, chr(a::int), '')))) / length({x}) end")
scalar("is_blank", "part", "p_partkey", "case p_size % 5 when 0 then null when 1 then ' nil ' when 2 then 'nan' when 3 then ' ' else p_name end", C.is_blank, "({x} is null or upper(trim({x})) in ('','NIL','NAN','NONE'))")
scalar("padded_id", "orders", "o_orderkey", "cast(o_orderkey as int)", lambda c: C.padded_id("x_", c), "'x_' || printf('%04d', {x})")
scalar("split_values", "part", "p_partkey", "p_type || ' and ' || p_brand || '; ' || p_name || ' or and b, '", lambda c: F.array_join(A.split_values(c), "|"), "array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(replace({x}, ' and ', '|'), ' or ', '|'), ' And ', '|'), ' Or ', '|'), ' AND ', '|'), ' OR ', '|'), ',', '|'), ';', '|'), '|'), lambda y: trim(y)), lambda z: z <> ''), '|')")
scalar("split_conjunctions", "part", "p_partkey", "p_type || ' and ' || p_brand || ', ' || p_name || ' or and b'", lambda c: F.array_join(A.split_values(c, True), "|"), "array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace({x}, ' and ', '|'), ' or ', '|'), ' And ', '|'), ' Or ', '|'), ' AND ', '|'), ' OR ', '|'), '|'), lambda y: trim(y)), lambda z: z <> ''), '|')")
uptake = "case p_size % 11 when 0 then 'Clathrin-Mediated Endocytosis' when 1 then 'direct penetration, lipid raft' when 2 then 'unknown' when 3 then 'clathrin independent' when 4 then 'Macropinocytosis or phagocytosis' when 5 then 'caveolin mediated uptake' when 6 then 'passive cell penetration' when 7 then 'draft' when 8 then null when 9 then 'fluid phase pinocytosis' else p_name end"


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({{x}}), '{w}')" for w in words) + ")"


def _list(*pairs: tuple[str, str]) -> str:
    cases = ", ".join(f"case when {cond} then '{name}' end" for name, cond in pairs)
    return f"nullif(concat_ws(', ', {cases}), '')"


has = lambda *w: _any(list(w))
main_sql = _list(("Direct penetration", _any(V.DIRECT_KEYWORDS)), ("Endocytosis", _any(V.ENDOCYTOSIS_KEYWORDS)))
scalar("categorize_main", "part", "p_partkey", uptake, A.classify_main, main_sql)
place = "case p_size % 8 when 0 then 'Nuclear envelope and cytosol' when 1 then 'late endosomal vesicle' when 2 then 'Mitochondrial' when 3 then null when 4 then 'perinuclear' when 5 then 'none' else p_name || ' vacuole' end"
scalar("categorize_ordered", "part", "p_partkey", place, A.classify_location, _list(*[(k, _any(w)) for k, w in V.LOCATION_KEYWORDS.items()]))
sub_sql = _list(
    ("Macropinocytosis", has("macropinocyt", "fluid phase pinocytosis")),
    ("Phagocytosis", has("phagocytosis", "phagocytic")),
    ("Caveolae-mediated endocytosis", has("caveolae-mediated", "caveolae mediated", "caveolin-mediated", "caveolin mediated")),
    ("Clathrin-mediated endocytosis", has("clathrin") + " and not " + has("independent")),
    ("Clathrin and caveolae independent", has("independent") + " and " + has("clathrin", "caveolin", "caveolae")),
)
scalar("categorize_exclusion", "part", "p_partkey", uptake, A.classify_sub, sub_sql)
codes = "case p_size % 5 when 0 then 'Nucleus, Cytoplasm,Nucleus' when 1 then 'Vesicles' when 2 then 'x, Endosomes' when 3 then null else 'x' end"


def _mapped(table: dict[str, str]) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"(select nullif(string_agg(c, ', ' order by i), '') from (select c, min(i) i from (select case trim(u.v) {whens} end c, u.i from (select unnest(string_split({{x}}, ',')) v, unnest(range(10)[1:len(string_split({{x}}, ','))]) i) u) q where c is not null group by c) r)"


scalar("map_code_list", "part", "p_partkey", codes, lambda c: A.map_codes(c, V.LOCATION_CODES), _mapped(V.LOCATION_CODES))
scalar("map_main_codes", "part", "p_partkey", "case when p_size % 3 = 0 then 'Direct penetration, Endocytosis' when p_size % 3 = 1 then 'Endocytosis' else null end", lambda c: A.map_codes(c, V.MAIN_CODES), _mapped(V.MAIN_CODES))
scalar("map_sub_codes", "part", "p_partkey", "case when p_size % 3 = 0 then 'Clathrin and caveolae independent' when p_size % 3 = 1 then 'Phagocytosis,Macropinocytosis' else 'Clathrin-mediated endocytosis' end", lambda c: A.map_codes(c, V.SUB_CODES), _mapped(V.SUB_CODES))
scalar("map_assay_codes", "part", "p_partkey", "case when p_size % 2 = 0 then 'In vitro, In vivo' else 'in vitro' end", lambda c: A.map_codes(c, V.ASSAY_CODES), _mapped(V.ASSAY_CODES))
scalar("freq_band", "part", "p_partkey", "p_size", lambda c: A.band(c), "case when {x} <= 1 then '1' when {x} <= 5 then '2-5' when {x} <= 20 then '6-20' else '21+' end")

add = REGISTRY.add
add(
    "publication_choice",
    lambda s, d: T(s, d, "part").select("p_partkey", C.publication_iri(F.expr("case p_size % 5 when 0 then null when 1 then '0.0' when 2 then 'x' else p_partkey || '.0' end"), F.expr("case when p_size % 2 = 0 then 'US 12 ' || p_size else '' end")).alias("v")),
    "with t as (select p_partkey, case p_size % 5 when 0 then null when 1 then '0.0' when 2 then 'x' else p_partkey || '.0' end a, case when p_size % 2 = 0 then 'US 12 ' || p_size else '' end b from part) select p_partkey, case when a is not null and trim(a) not in ('','0','0.0') and try_cast(a as double) is not null then 'http://identifiers.org/pubmed:' || cast(cast(a as double) as bigint) else nullif(replace(trim(b), ' ', ''), '') end as v from t",
)
add(
    "coalesce_choice",
    lambda s, d: T(s, d, "part").select("p_partkey", C.coalesce_choice(F.expr("case p_size % 3 when 0 then null when 1 then ' ' else p_brand end"), F.col("p_type")).alias("v")),
    "select p_partkey, coalesce(nullif(trim(case p_size % 3 when 0 then null when 1 then ' ' else p_brand end), ''), p_type) as v from part",
)
add(
    "zip_with_default",
    lambda s, d: T(s, d, "part").select("p_partkey", F.explode(C.zip_with_default(F.expr("'http://x/' || p_size || ', http://x/b ,http://x/c'"), F.col("p_name")).alias("z"))).select("p_partkey", "col.id", "col.label"),
    "select p_partkey, id, label from (select p_partkey, unnest(['http://x/' || p_size, 'http://x/b', 'http://x/c']) id, unnest([p_name, 'b', 'c']) as label from part)",
)
add("valid_alphabet", lambda s, d: T(s, d, "part").withColumn("q", C.clean_sequence(F.col("p_name"))).filter(C.is_valid(F.col("q"))).select("p_partkey", "q"), "select p_partkey, q from (select p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') q from part) where regexp_matches(q, '^[ACDEFGHIKLMNPQRSTVWY]+$')")
nulls = "case when p_size % 3 = 0 then null else p_name end a, case when p_size % 5 = 0 then null else p_brand end b, case when p_size % 2 = 0 then null else p_type end c"
three = lambda s, d: T(s, d, "part").selectExpr("p_partkey", *[x.strip() for x in nulls.replace(" a,", " a;").replace(" b,", " b;").split(";")])
add("any_required", lambda s, d: three(s, d).na.drop(how="all", subset=["a", "b", "c"]), f"select * from (select p_partkey, {nulls} from part) where a is not null or b is not null or c is not null")
add("all_required", lambda s, d: three(s, d).na.drop(how="any", subset=["a", "b", "c"]), f"select * from (select p_partkey, {nulls} from part) where a is not null and b is not null and c is not null")
add("length_bounds", lambda s, d: T(s, d, "part").filter((F.length("p_name") < 9) | (F.length("p_name") > 12) | (C.max_residue_fraction(F.upper("p_name")) > 0.3)).select("p_partkey", F.length("p_name").cast("long").alias("n")), "with t as (select p_partkey, length(p_name) n, list_max(list_transform(range(65, 91), lambda a: length(upper(p_name)) - length(replace(upper(p_name), chr(a::int), '')))) / length(p_name) f from part) select p_partkey, n from t where n < 9 or n > 12 or f > 0.3")
add("substring_filter", lambda s, d: T(s, d, "part").filter(C.contains_text(F.col("p_name"), "RING")).select("p_partkey", "p_name"), "select p_partkey, p_name from part where contains(lower(p_name), 'ring')")
add("prefix_filter", lambda s, d: T(s, d, "customer").filter(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name"), "select c_custkey, c_name from customer where starts_with(c_name, 'Customer#00000001')")
add("lang_filter", lambda s, d: T(s, d, "documents").filter("lang = 'en'").groupBy("source").agg(F.count("*").alias("n")), "select source, count(*) n from documents where lang = 'en' group by source")
add("not_in_filter", lambda s, d: T(s, d, "events").filter(~F.col("event_type").isin("view", "click") & (F.col("user_id") != 1)).select("event_id"), "select event_id from events where event_type not in ('view','click') and user_id <> 1")
add("nested_json", lambda s, d: T(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
add("json_repair", lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(C.json_reply(F.expr("case p_size % 3 when 0 then '{\"a\":{\"curie\":\"X:1\",\"label\":\"l\"}}' when 1 then '{\"a\":{\"curie\":\"X:1\",\"label\":\"l\"},\"b\":{\"cur' else 'sorry' end")))), ",").alias("v")), "select p_partkey, case when p_size % 3 = 2 then '' else 'a' end as v from part")
add("nfkc", lambda s, d: T(s, d, "part").select("p_partkey", C.nfkc(F.expr("'ﬁ α–' || p_name || ' ®'")).alias("v")), "select p_partkey, 'fi alpha-' || p_name as v from part")
