"""Operators over annotation tables: split, classify, map, deduplicate, number, validate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import vocabulary as V
from ..plans.graph_build import dense_number

CONJUNCTIONS = [" and ", " or ", " And ", " Or ", " AND ", " OR "]


def split_values(c: Column, conjunctions_only: bool = False) -> Column:
    """The values of a cell. Separators are replaced one after the other (an alternation would differ where they overlap); none left gives [null]."""
    marked = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("|")), CONJUNCTIONS if conjunctions_only else [*CONJUNCTIONS, ",", ";"], c)
    parts = F.filter(F.transform(F.split(marked, r"\|"), lambda v: F.trim(v)), lambda x: x != "")
    return F.when(c.isNull() | (F.size(parts) == 0), F.array(F.lit(None).cast("string"))).otherwise(parts)


def explode_values(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """A row for each combination of values. columns: name -> conjunctions_only."""
    require(df, list(columns))
    for name, only in columns.items():
        df = df.withColumn(name, F.explode(split_values(F.col(name), only)))
    return df


def require(df: DataFrame, names: list[str]) -> None:
    """Raises for columns that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def classify_main(c: Column) -> Column:
    endo, direct = C.any_keyword(c, V.ENDOCYTOSIS_KEYWORDS), C.any_keyword(c, V.DIRECT_KEYWORDS)
    return F.nullif(F.concat_ws(", ", F.when(direct, "Direct penetration"), F.when(endo, "Endocytosis")), F.lit(""))


def classify_location(c: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.when(C.any_keyword(c, words), name) for name, words in V.LOCATION_KEYWORDS.items()]), F.lit(""))


def classify_sub(c: Column) -> Column:
    low = F.lower(c)
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    rules = [
        ("Macropinocytosis", has("macropinocyt", "fluid phase pinocytosis")),
        ("Phagocytosis", has("phagocytosis", "phagocytic")),
        ("Caveolae-mediated endocytosis", has("caveolae-mediated", "caveolae mediated", "caveolin-mediated", "caveolin mediated")),
        ("Clathrin-mediated endocytosis", has("clathrin") & ~has("independent")),
        ("Clathrin and caveolae independent", has("independent") & has("clathrin", "caveolin", "caveolae")),
    ]
    return F.nullif(F.concat_ws(", ", *[F.when(rule, name) for name, rule in rules]), F.lit(""))


def map_codes(c: Column, codes: dict[str, str]) -> Column:
    """Codes of a comma list: distinct, in order, joined; null if none."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    found = F.transform(F.split(c, ","), lambda p: F.try_element_at(table, F.trim(p)))
    return F.nullif(F.array_join(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), ", "), F.lit(""))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order, which must be total (rows have no order of their own)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_seen_ids(df: DataFrame, value: str, order: list[str], prefix: str, name: str) -> DataFrame:
    """value -> prefix0001, ... by order of first appearance; blank values get none.

    Numbers are dealt out by ranges of the first places, so no task sees all values.
    """
    firsts = df.filter(~F.col(value).isNull() & (F.trim(value) != "")).groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    return dense_number(firsts, ["_at"], "_n").select(value, C.padded_id(prefix, F.col("_n")).alias(name))


def add_sequence_ids(df: DataFrame, value: str, order: list[str], prefix: str, name: str) -> DataFrame:
    return df.join(first_seen_ids(df, value, order, prefix, name), value, "left")


def first_non_null(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The first non-null value of each column in each group."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def clear_where(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(condition, None).otherwise(F.col(c)) for c in columns})


def band(n: Column) -> Column:
    """Frequency bands 1, 2-5, 6-20, 21 and more."""
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+")


def allocate(sizes: dict[str, int], total: int, floor: int = 30) -> dict[str, int]:
    """Proportional shares with a floor, at most the size of each stratum, repaired by ones to the total."""
    everything = sum(sizes.values())
    if not everything:
        return {k: 0 for k in sizes}
    share = {k: min(n, max(min(floor, n), round(total * n / everything))) for k, n in sizes.items()}
    total = min(total, everything)
    by_size = sorted(sizes, key=lambda k: (-sizes[k], k))
    while sum(share.values()) != total:
        before = sum(share.values())
        for k in by_size:
            if sum(share.values()) < total and share[k] < sizes[k]:
                share[k] += 1
            elif sum(share.values()) > total and share[k] > min(floor, sizes[k]):
                share[k] -= 1
        if sum(share.values()) == before:  # the floors alone exceed the total
            k = max(by_size, key=lambda x: share[x])
            share[k] -= 1
    return share


def stratified_sample(df: DataFrame, stratum: str, value: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """The sizes[s] values of each stratum with the smallest seeded hashes: the same on every run and cluster."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map().cast("map<string,int>")
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(value).cast("string")))
    w = Window.partitionBy(stratum).orderBy(draw, value)
    # the literal bound lets tasks drop rows before they are shuffled, so a large stratum is no large task
    first = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(sizes.values(), default=0))
    return first.filter(F.col("_rn") <= F.coalesce(F.try_element_at(want, F.col(stratum)), F.lit(0))).drop("_rn")


class Preprocessor:
    """Chainable steps over an annotation table; each returns a new Preprocessor, nothing runs before an action."""

    def __init__(self, df: DataFrame, sequence: str = "Sequence", required: tuple[str, ...] = ("Cargo Type", "Subcellular Localization", "Uptake Mechanism")):
        require(df, [sequence])
        self.df, self.sequence, self.required = df, sequence, [c for c in required]

    def _with(self, df: DataFrame) -> Preprocessor:
        return Preprocessor(df, self.sequence, tuple(self.required))

    def clean_sequences(self) -> Preprocessor:
        return self._with(self.df.withColumn(self.sequence, C.clean_sequence(F.col(self.sequence))))

    def filter_valid(self) -> Preprocessor:
        return self._with(self.df.filter(C.is_valid(F.col(self.sequence))))

    def normalize(self) -> Preprocessor:
        texts = [c for c, t in self.df.dtypes if t == "string" and c != self.sequence]
        return self._with(self.df.withColumns({c: C.normalize_na(F.col(c)) for c in texts}))

    def filter_required(self) -> Preprocessor:
        require(self.df, self.required)
        return self._with(self.df.na.drop(how="all", subset=self.required))

    def split(self, columns: dict[str, bool]) -> Preprocessor:
        return self._with(explode_values(self.df, columns))

    def classify(self, mechanism: str = "Uptake Mechanism", location: str = "Subcellular Localization", assay: str | None = None) -> Preprocessor:
        df = self.df.withColumns(
            {"Main Uptake Mechanism": classify_main(F.col(mechanism)), "Subcategory Uptake Mechanism": classify_sub(F.col(mechanism)), "Subcellular Localization Category": classify_location(F.col(location))}
        )
        df = df.withColumns(
            {
                "Main Uptake Mechanism ID": map_codes(F.col("Main Uptake Mechanism"), V.MAIN_CODES),
                "Subcategory Uptake Mechanism ID": map_codes(F.col("Subcategory Uptake Mechanism"), V.SUB_CODES),
                "Subcellular Delivery ID": map_codes(F.col("Subcellular Localization Category"), V.LOCATION_CODES),
            }
        )
        return self._with(df.withColumn("Assay ID", map_codes(F.col(assay), V.ASSAY_CODES)) if assay else df)

    def deduplicate(self, keys: list[str], order: list[str]) -> Preprocessor:
        return self._with(keep_first(self.df, keys, order))

    def number(self, order: list[str], prefix: str = f"{V.DATASET_NS}P_00", name: str = "P_ID") -> Preprocessor:
        return self._with(add_sequence_ids(self.df, self.sequence, order, prefix, name))

    def stats(self, initial: DataFrame) -> dict[str, int]:
        return {"initial_count": initial.count(), "final_count": self.df.count()}

    def validate(self, min_len: int = 3, max_len: int = 200, max_fraction: float = 0.8, columns: list[str] | None = None, complete: list[str] | None = None, top: int = 5) -> dict:
        """Length, composition, missingness and completeness in one pass, and the most frequent letters in another."""
        s = F.coalesce(F.col(self.sequence), F.lit(""))
        share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
        columns, complete = columns or [], [c for c in complete or [] if c in self.df.columns]
        present = [c for c in columns if c in self.df.columns]
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in complete], F.lit(bool(complete)))
        checks = {"too_short": F.length(s) < min_len, "too_long": F.length(s) > max_len, "high_single": C.max_residue_fraction(s) > max_fraction, "complete": whole}
        row = self.df.agg(
            F.count("*").alias("n"),
            *[F.count_if(c).alias(f"{k}_count") for k, c in checks.items()],
            *[F.coalesce(share(c), F.lit(0.0)).alias(f"{k}_fraction") for k, c in checks.items()],
            *[F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in present],
            F.countDistinct(F.when(whole, F.col(self.sequence))).alias("unique_complete"),
        ).first()
        letters = self.df.select(F.explode(F.split(s, "")).alias("a")).filter("a <> ''").groupBy("a").count()
        out = row.asDict()
        out["column_missing"] = [c for c in columns if c not in self.df.columns]
        out["top_letters"] = [tuple(r) for r in letters.orderBy(F.desc("count"), "a").limit(top).collect()]
        return out
