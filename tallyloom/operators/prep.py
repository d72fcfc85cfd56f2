"""Fit on training rows, apply anywhere: column kinds, imputation, encoding, scaling, oversampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.expr import col, flag, hash_key, unit_interval
from tallyloom.functions.scale import (
    BROADCAST_ROWS, bounded_rows, hash_rank, materialise, new_path, running_total, store,
)
from tallyloom.operators import profile
from tallyloom.operators.neighbors import nearest, same_class_neighbors

MAX_CATEGORIES = 10_000   # classes, or one-hot columns of one nominal column; dictionaries have no bound


# ---------------------------------------------------------------- column kinds

@dataclass
class ColumnKinds:
    numerical: list[str] = field(default_factory=list)
    nominal: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)


def column_kinds(df: DataFrame, num_classes: int = 5) -> ColumnKinds:
    """Numeric columns with at least ``num_classes`` distinct values are numerical, other columns
    nominal; ordinal ones are named 'ordinal' (or by a number) and hold at most that many."""
    counts = {r["feature"]: r["n_distinct"] for r in bounded_rows(
        profile.distinct_counts(df, df.columns, sure_above=num_classes + 1), len(df.columns), "columns")}
    out = ColumnKinds()
    for f in df.schema.fields:
        n = counts.get(f.name, 0)
        if isinstance(f.dataType, T.NumericType) and n >= num_classes:
            out.numerical.append(f.name)
        elif isinstance(f.dataType, (T.NumericType, T.StringType)):
            out.nominal.append(f.name)
        if ("ordinal" in f.name or f.name.isdigit()) and n <= num_classes:
            out.ordinal.append(f.name)
    return out


def kinds_table(df: DataFrame, num_classes: int = 5) -> DataFrame:
    """(feature, kind) rows of ``column_kinds``."""
    kinds = column_kinds(df, num_classes)
    rows = [(c, k) for k in ("numerical", "nominal", "ordinal") for c in getattr(kinds, k)]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string")


def first_appearance(df: DataFrame, column: str, key: str) -> DataFrame:
    """(value, first_key, code): distinct values in the order they first occur by ``key``."""
    seen = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(
        F.min(key).alias("first_key"))
    order = Window.partitionBy().orderBy("first_key")          # at most num_classes rows
    return seen.withColumn("code", F.row_number().over(order) - 1)


# ---------------------------------------------------------------- imputation

def fill_statistics(df: DataFrame, columns: Sequence[str], strategy: str) -> DataFrame:
    """(feature, value as text): mean, median or most frequent value (ties to the smallest)."""
    if strategy == "mean":
        one = df.agg(*[F.avg(col(c)).alias(c) for c in columns])
        return one.unpivot([], list(columns), "feature", "value")
    if strategy == "median":
        q = profile.exact_quantiles(df, columns, [0.5])
        return q.select("feature", F.get("q", F.lit(0)).alias("value"))
    if strategy == "most_frequent":
        counts = profile.value_counts(df, columns)
        return counts.groupBy("feature").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    raise ValueError(f"unknown strategy {strategy}")


class DataImputer:
    """Fills the columns that hold nulls in the training rows; all others pass unchanged."""

    def __init__(self, numerical_strategy: str = "knn", categorical_strategy: str = "most_frequent",
                 knn_neighbors: int = 5, fill_value: str = "missing", key: str = "id_log",
                 **neighbor_options):
        if numerical_strategy not in ("knn", "mean", "median"):
            raise ValueError(f"unknown numerical strategy {numerical_strategy}")
        if categorical_strategy not in ("most_frequent", "constant"):
            raise ValueError(f"unknown categorical strategy {categorical_strategy}")
        self.numerical_strategy = numerical_strategy
        self.categorical_strategy = categorical_strategy
        self.k, self.fill_value, self.key = knn_neighbors, fill_value, key
        self.neighbor_options = neighbor_options
        self.fitted = False

    def fit(self, df: DataFrame) -> "DataImputer":
        candidates = [c for c in df.columns if c != self.key]
        holes = profile.columns_with_nulls(df, candidates).where("has_null")
        names = {r[0] for r in bounded_rows(holes.select("column"), len(df.columns), "columns")}
        self.numeric = [c for c in candidates if c in names and profile.is_numeric(df, c)]
        self.text = [c for c in candidates if c in names and not profile.is_numeric(df, c)]
        self.fills: dict[str, object] = {}
        if self.numeric:
            kind = "median" if self.numerical_strategy == "median" else "mean"
            self._keep(fill_statistics(df, self.numeric, kind))
        if self.text:
            if self.categorical_strategy == "constant":
                self.fills.update({c: self.fill_value for c in self.text})
            else:
                self._keep(fill_statistics(df, self.text, "most_frequent"))
        self.donors = None
        if self.numeric and self.numerical_strategy == "knn":
            self.donors = materialise(df.select(self.key, *self.numeric), "donors")
        self.fitted = True
        return self

    def _keep(self, table: DataFrame) -> None:
        rows = bounded_rows(table.select("feature", "value"), MAX_CATEGORIES, "fill values")
        self.fills.update({r[0]: r[1] for r in rows})

    def _vector(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.key).alias("key"), F.lit("").alias("block"),
                         F.lit(None).cast("double").alias("payload"),
                         F.array(*[col(c).cast("double") for c in self.numeric]).alias("vec"))

    def _holes(self, df: DataFrame) -> DataFrame:
        """(key, target, vec, ask): one row per missing cell; equal questions share ``ask``."""
        places = F.sequence(F.lit(0), F.lit(len(self.numeric) - 1))
        holes = F.filter(places, lambda i: F.get(F.col("vec"), i).isNull())
        return (self._vector(df).withColumn("target", F.explode(holes))
                .withColumn("ask", F.md5(F.to_json(F.struct("target", "vec"))))
                .select("key", "target", "vec", "ask"))

    def _answers(self, holes: DataFrame) -> DataFrame:
        """The neighbours of every distinct question, searched once however often it is asked."""
        asked = holes.select(F.col("ask").alias("key"), F.lit("").alias("block"), "target", "vec"
                             ).dropDuplicates(["key"])
        return nearest(asked, self._vector(self.donors), self.k, **self.neighbor_options)

    def neighbors(self, df: DataFrame) -> DataFrame:
        """The donors found for every missing cell: (q_key, target, rank, d_key, distance, payload)."""
        holes = self._holes(df)
        found = self._answers(holes).withColumnRenamed("q_key", "ask").drop("target")
        return holes.select(F.col("key").alias("q_key"), "target", "ask").join(found, "ask").drop("ask")

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError("fit the imputer first")
        out = df
        if self.donors is not None:
            holes = self._holes(df)
            means = self._answers(holes).groupBy(F.col("q_key").alias("ask")).agg(
                F.avg("payload").alias("v"))
            values = (holes.join(means, "ask").groupBy(F.col("key").alias(self.key))
                      .pivot("target", list(range(len(self.numeric)))).agg(F.first("v")))
            values = values.withColumnsRenamed({str(i): f"_v{i}" for i in range(len(self.numeric))})
            out = out.join(values, self.key, "left")
        filled = {}
        for i, c in enumerate(self.numeric):
            x = col(c).cast("double")
            near = [F.col(f"_v{i}")] if self.donors is not None else []
            filled[c] = F.coalesce(x, *near, F.lit(self.fills.get(c)).cast("double"))
        for c in self.text:
            filled[c] = F.coalesce(col(c), F.lit(self.fills.get(c)).cast("string"))
        return out.withColumns(filled).select(*df.columns) if filled else out

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


# ---------------------------------------------------------------- dictionaries and labels

def sorted_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Distinct non-null values of each column in natural order (numbers as numbers), for columns
    whose values become expressions: classes and one-hot columns."""
    found = profile.long_text(df, columns).where(F.col("value").isNotNull()).distinct()
    rows = bounded_rows(found, MAX_CATEGORIES * len(columns), "categories")
    out: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        out[r["feature"]].append(r["value"])
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            out[c] = sorted(int(v) for v in out[c])
        elif isinstance(kind, T.NumericType):
            out[c] = sorted(float(v) for v in out[c])
        else:
            out[c] = sorted(out[c])
    return out


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, code, value): codes by natural order of the distinct values, however many there are."""
    whole = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    real = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType) and c not in whole]
    found = profile.long_text(df, columns).where(F.col("value").isNotNull()).distinct()
    keyed = found.withColumns({
        "_whole": F.when(F.col("feature").isin(whole), F.col("value")).cast("decimal(20,0)"),
        "_real": F.when(F.col("feature").isin(real), F.col("value")).cast("double")})
    ranked = running_total(keyed, ["feature"], ["_whole", "_real", "value"], "_code")
    return ranked.select("feature", (F.col("_code") - 1).cast("int").alias("code"), "value")


def _position(values: list, x: Column, what: str, column: str) -> Column:
    place = F.array_position(F.array(*[F.lit(v) for v in values]), x) - 1
    unknown = F.raise_error(F.concat(F.lit(f"{what}: unknown value in {column}: "), x.cast("string")))
    return (F.when(x.isNull(), F.lit(None).cast("int"))
             .when(place >= 0, place.cast("int")).otherwise(unknown.cast("int")))


class LabelCodes:
    """Label <-> code by sorted label; unknown labels are an error."""

    def __init__(self, target: str):
        self.target, self.classes = target, None

    def fit(self, df: DataFrame) -> "LabelCodes":
        self.classes = sorted_values(df, [self.target])[self.target]
        return self

    def _need(self) -> list:
        if self.classes is None:
            raise ValueError("fit the label codes first")
        return self.classes

    def transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        return df.withColumn(out, _position(self._need(), col(self.target), "label", self.target))

    def fit_transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        return self.fit(df).transform(df, out)

    def inverse(self, df: DataFrame, code: str, out: str) -> DataFrame:
        names = F.array(*[F.lit(c) for c in self._need()])
        return df.withColumn(out, F.get(names, col(code).cast("int")))

    @property
    def class_mapping(self) -> dict:
        return {c: i for i, c in enumerate(self._need())}

    @property
    def n_classes(self) -> int:
        return len(self._need())


# ---------------------------------------------------------------- scaling and encoding

def scale_statistics(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    cells = [F.struct(F.avg(col(c)).cast("double").alias("mean"), F.stddev_pop(col(c)).alias("std"),
                      F.min(col(c)).cast("double").alias("lo"),
                      F.max(col(c)).cast("double").alias("hi")).alias(c) for c in columns]
    row = df.agg(*cells).first()
    return {c: row[c].asDict() for c in columns}


def standard(c: str, s: dict) -> Column:
    """(x - mean) / population deviation; a constant column gives 0."""
    return (col(c).cast("double") - F.lit(s["mean"])) / F.lit(s["std"] or 1.0)


def min_max(c: str, s: dict) -> Column:
    """To [0, 1]; a constant column gives 0."""
    width = (s["hi"] - s["lo"]) if s["lo"] is not None else None
    return (col(c).cast("double") - F.lit(s["lo"])) / F.lit(width or 1.0)


class DataEncoder:
    """Scaled numeric block, one-hot nominal block (first category dropped), ordinal codes, rest.

    ``scaling``: standard, minmax, both (columns suffixed ``_std`` / ``_mm``) or none.
    """

    def __init__(self, numerical: Sequence[str] = (), nominal: Sequence[str] = (),
                 ordinal: dict[str, list] | None = None, scaling: str = "standard"):
        if scaling not in ("standard", "minmax", "both", "none"):
            raise ValueError(f"unknown scaling {scaling}")
        self.numerical, self.nominal = list(numerical), list(nominal)
        self.ordinal, self.scaling = dict(ordinal or {}), scaling
        self.mapping: DataFrame | None = None
        self.stats: dict | None = None

    def fit(self, df: DataFrame) -> "DataEncoder":
        """Statistics and one dictionary table for all nominal columns, of any number of values."""
        self.stats = scale_statistics(df, self.numerical) if self.numerical else {}
        self.mapping = materialise(dictionary(df, self.nominal), "dictionary") if self.nominal else None
        self.kinds = {c: df.schema[c].dataType for c in self.nominal}
        self._categories: dict[str, list] | None = None
        return self

    @property
    def categories(self) -> dict[str, list]:
        """Values per nominal column in code order, for one-hot columns; ``sparse`` needs no such list."""
        if self.stats is None:
            raise ValueError("fit the encoder first")
        if self._categories is None:
            out: dict[str, list] = {c: [] for c in self.nominal}
            if self.nominal:
                sizes = self.mapping.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
                wide = sizes.where(F.col("n") > MAX_CATEGORIES).first()
                if wide is not None:
                    raise ValueError(f"{wide['feature']} has {wide['n']} values: encode it with sparse()")
                for r in bounded_rows(self.mapping.orderBy("feature", "code"),
                                      MAX_CATEGORIES * len(self.nominal), "categories"):
                    kind = self.kinds[r["feature"]]
                    number = int if isinstance(kind, T.IntegralType) else float
                    out[r["feature"]].append(number(r["value"]) if isinstance(kind, T.NumericType) else r["value"])
            self._categories = out
        return self._categories

    def sparse(self, df: DataFrame, key: str) -> DataFrame:
        """(key, index, value) of the non-zero entries: scaled numbers, then the one-hot blocks in column order.

        The first category of a column and unknown values have no entry. Dictionaries are joined, so columns may have
        any number of values.
        """
        if self.stats is None:
            raise ValueError("fit the encoder first")
        made = self._numbers()
        numbers = F.array(*[F.struct(F.lit(i).cast("long").alias("index"), x.cast("double").alias("value"))
                            for i, x in enumerate(made.values())]) if made else None
        parts = []
        if made:
            parts.append(df.select(col(key).alias("key"), F.explode(numbers).alias("e")).select("key", "e.*")
                           .where(F.col("value") != 0))
        if self.nominal:
            order = F.create_map(*[F.lit(v) for i, c in enumerate(self.nominal) for v in (c, i)])
            sizes = self.mapping.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))   # one row per column
            before = Window.partitionBy().orderBy(order[F.col("feature")]).rowsBetween(Window.unboundedPreceding, -1)
            starts = sizes.select("feature", F.coalesce(F.sum(F.col("n") - 1).over(before), F.lit(0)).alias("start"))
            # few values mean many rows of each: those rows stay where they are, only wide columns are shuffled
            narrow, room = [], BROADCAST_ROWS
            for c, n in sorted(self.widths().items(), key=lambda item: item[1]):
                if n <= room:
                    narrow.append(c)
                    room -= n
            for columns in (narrow, [c for c in self.nominal if c not in narrow]):
                if not columns:
                    continue
                long = df.select(col(key).alias("key"), *[col(c).cast("string").alias(c) for c in columns]).unpivot(
                    ["key"], columns, "feature", "value")
                codes = self.mapping.where((F.col("code") > 0) & F.col("feature").isin(columns))
                hot = (long.join(F.broadcast(codes) if columns is narrow else codes, ["feature", "value"])
                       .join(F.broadcast(starts), "feature"))
                parts.append(hot.select("key", (F.col("start") + F.col("code") - 1 + len(made)).alias("index"),
                                        F.lit(1.0).alias("value")))
        return reduce(DataFrame.unionByName, parts)

    def widths(self) -> dict[str, int]:
        """Values per nominal column, counted in the dictionary table (a row per column comes back)."""
        if not self.nominal:
            return {}
        sizes = self.mapping.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        found = {r["feature"]: r["n"] for r in bounded_rows(sizes, len(self.nominal), "columns")}
        return {c: found.get(c, 0) for c in self.nominal}

    def sparse_columns(self) -> list[str]:
        """Names of the positions of ``sparse_vectors``; one-hot positions go by their category's code."""
        return [*self._numbers(), *[f"{c}[{i}]" for c, n in self.widths().items() for i in range(1, n)],
                *[f"{c}_code" for c in self.ordinal]]

    def sparse_vectors(self, df: DataFrame, key: str, out: str = "features") -> DataFrame:
        """The rest of the columns, the key and a sparse vector in the order of the encoded blocks; stored.

        Entries are joined and gathered as (index, value) arrays per row, at most one per column. The written
        table is read back as vectors, so no dense row and no column per category ever exists. A null number is an error.
        """
        from pyspark.ml.linalg import VectorUDT

        made = self._numbers()
        start = len(made) + sum(max(n - 1, 0) for n in self.widths().values())
        width = start + len(self.ordinal)
        checks = [F.when(x.isNull(), F.raise_error(F.lit(f"null in feature column {c}"))) for c, x in made.items()]
        df = df.withColumn("_null", F.coalesce(*checks, F.lit(None)).cast("string"))
        used = {*self.numerical, *self.nominal, *self.ordinal} - {key}
        rest = df.select(*[col(c) for c in df.columns if c not in used])   # keeps the null checks
        entries = self.sparse(df, key)
        if self.ordinal:
            codes = F.array(*[F.struct(F.lit(start + i).cast("long").alias("index"),
                                       _position(order, col(c), "ordinal", c).cast("double").alias("value"))
                              for i, (c, order) in enumerate(self.ordinal.items())])
            entries = entries.unionByName(df.select(col(key).alias("key"), F.explode(codes).alias("e"))
                                            .select("key", "e.*").where(F.col("value") != 0))
        gathered = entries.groupBy(F.col("key").alias("_key")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("index").cast("int").alias("i"), F.col("value").alias("v")))).alias("_e"))
        # a sparse vector as Spark ML stores it: type 0, size, indices, values
        empty = F.array().cast("array<struct<i: int, v: double>>")
        e = F.coalesce("_e", empty)
        vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(width).alias("size"),
                          F.transform(e, lambda x: x["i"]).alias("indices"), F.transform(e, lambda x: x["v"]).alias("values"))
        joined = rest.join(gathered, rest[key] == gathered["_key"], "left").withColumn(out, vector).where(
            F.col("_null").isNull()).drop("_key", "_e", "_null")
        path = new_path(df.sparkSession, "sparse-vectors")
        joined.write.parquet(path)
        kinds = T.StructType([T.StructField(f.name, VectorUDT() if f.name == out else f.dataType) for f in joined.schema.fields])
        return df.sparkSession.read.schema(kinds).parquet(path)

    def _numbers(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        suffix = {"standard": "", "both": "_std"}
        if self.scaling in suffix:
            out.update({f"{c}{suffix[self.scaling]}": standard(c, self.stats[c]) for c in self.numerical})
        if self.scaling in ("minmax", "both"):
            tail = "_mm" if self.scaling == "both" else ""
            out.update({f"{c}{tail}": min_max(c, self.stats[c]) for c in self.numerical})
        if self.scaling == "none":
            out.update({c: col(c).cast("double") for c in self.numerical})
        return out

    def _blocks(self) -> dict[str, Column]:
        if self.stats is None:
            raise ValueError("fit the encoder first")
        out = self._numbers()
        for c in self.nominal:
            for v in self.categories[c][1:]:
                out[f"{c}_{v}"] = flag(col(c) == F.lit(v))
        for c, order in self.ordinal.items():
            out[f"{c}_code"] = _position(order, col(c), "ordinal", c)
        return out

    @property
    def output_columns(self) -> list[str]:
        return list(self._blocks())

    def transform(self, df: DataFrame) -> DataFrame:
        made = self._blocks()
        used = {*self.numerical, *self.nominal, *self.ordinal}
        rest = [c for c in df.columns if c not in used]
        return df.select(*[v.alias(n) for n, v in made.items()], *[col(c) for c in rest])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def feature_mapping(self, df: DataFrame) -> DataFrame:
        """(feature, code, value) of the nominal columns."""
        if self.stats is None:
            raise ValueError("fit the encoder first")
        if self.mapping is None:
            return df.sparkSession.createDataFrame([], "feature string, code int, value string")
        return self.mapping


def to_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """All listed columns as one vector; a null is an error. Names may hold dots, as in 'x_0.5'."""
    from pyspark.ml.functions import array_to_vector
    def known(c: str) -> Column:
        x = col(c).cast("double")
        return F.when(x.isNotNull(), x).otherwise(
            F.raise_error(F.lit(f"null in feature column {c}")).cast("double"))
    return df.withColumn(out, array_to_vector(F.array(*[known(c) for c in columns])))


# ---------------------------------------------------------------- oversampling

# Names of the oversampling strategies.
STRATEGIES = ["auto", "minority", "majority", "not minority", "not majority", "all"]


def target_counts(counts: dict, strategy: str | float = "auto") -> dict:
    """Wanted rows per class. 'auto' is 'not majority'; a number is the minority/majority ratio
    of a two-class problem; 'majority' would only shrink the rest and is rejected."""
    top, low = max(counts.values()), min(counts.values())
    small = min(c for c, n in counts.items() if n == low)
    big = min(c for c, n in counts.items() if n == top)
    if isinstance(strategy, float):
        if len(counts) != 2:
            raise ValueError("a ratio needs exactly two classes")
        wanted = int(top * strategy)
        if wanted < low:
            raise ValueError("the ratio is below the present one")
        return {c: max(n, wanted if c == small else n) for c, n in counts.items()}
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES} or a ratio")
    if strategy == "majority":
        raise ValueError("'majority' cannot be used for oversampling")
    grown = {"auto": lambda c: c != big, "not majority": lambda c: c != big,
             "minority": lambda c: c == small, "not minority": lambda c: c != small,
             "all": lambda c: True}[strategy]
    return {c: top if grown(c) else n for c, n in counts.items()}


def class_sizes(df: DataFrame, label: str) -> dict:
    rows = bounded_rows(df.where(col(label).isNotNull()).groupBy(label).count(), MAX_CATEGORIES, "classes")
    return {r[0]: r[1] for r in rows}


def target_count_table(df: DataFrame, label: str, strategy: str | float = "auto") -> DataFrame:
    """(class, n, wanted, need): the target counts of a strategy."""
    counts = class_sizes(df, label)
    wanted = target_counts(counts, strategy)
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame(
        [(c, n, wanted[c], wanted[c] - n) for c, n in sorted(counts.items())],
        f"class {kind}, n long, wanted long, need long")


def smote_rows(df: DataFrame, key: str, vector: str, label: str, strategy: str | float = "auto",
               k: int = 5, seed: int = 42, **neighbor_options) -> DataFrame:
    """(label, i, base, neighbor, vec): the synthetic rows only.

    Row i of a class starts at a member drawn by md5 and moves a random share of the way to one of
    its k nearest members; members are numbered by their md5 rank.
    """
    counts = class_sizes(df, label)
    wanted = target_counts(counts, strategy)
    need = {c: wanted[c] - n for c, n in counts.items() if wanted[c] > n}
    k = min(k, min(counts.values()) - 1)
    tiny = sorted(str(c) for c in need if counts[c] < 2)
    if need and (tiny or k < 1):
        raise ValueError(f"classes too small to oversample: {tiny or [str(c) for c in counts if counts[c] < 2]}")
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"),
                     F.col(vector).cast("array<double>").alias("vec"))
    if not need:
        return rows.limit(0).select("label", F.lit(0).cast("long").alias("i"), F.col("key").alias("base"),
                                    F.col("key").alias("neighbor"), "vec")
    members, _ = store(rows.where(F.col("label").isin(list(need))), "members")
    numbered = hash_rank(members.select("key", "label"), "key", f"{seed}-m", ["label"], "place", "size")
    near = materialise(same_class_neighbors(members, "key", "vec", "label", k, **neighbor_options), "near")
    # numbers 1..need of every class, spread by block before they are expanded
    block = 65_536
    classes = spark.createDataFrame([(c, int(n)) for c, n in need.items()], f"label {kind}, need long")
    blocks = classes.withColumn("b", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("need") - 1) / block)))).repartition("label", "b")
    numbers = blocks.withColumn("i", F.explode(F.sequence(
        F.col("b") * block + 1, F.least(F.col("need"), (F.col("b") + 1) * block)))).select("label", "i")
    def draw(tag: str) -> Column:
        name = F.concat_ws("-", F.col("label").cast("string"), F.col("i").cast("string"), F.lit(tag))
        return unit_interval(hash_key(name, seed))
    sizes = spark.createDataFrame([(c, int(counts[c])) for c in need], f"label {kind}, size long")
    drawn = numbers.join(F.broadcast(sizes), "label").select(   # one row per class, at most 10 000
        "label", "i", (F.floor(draw("a") * F.col("size")) + 1).alias("place"),
        (F.floor(draw("b") * k) + 1).cast("int").alias("rank"), draw("c").alias("gap"))
    picked = (drawn.join(numbered.select("label", "place", F.col("key").alias("base")), ["label", "place"])
              .join(near.select(F.col("q_key").alias("base"), "rank", F.col("d_key").alias("neighbor")),
                    ["base", "rank"]))
    a = members.select(F.col("key").alias("base"), F.col("vec").alias("x"))
    b = members.select(F.col("key").alias("neighbor"), F.col("vec").alias("y"))
    full = picked.join(a, "base").join(b, "neighbor")
    vec = F.transform(F.arrays_zip("x", "y"), lambda p: p["x"] + F.col("gap") * (p["y"] - p["x"]))
    return full.select("label", "i", "base", "neighbor", vec.alias("vec"))


def balance_data(df: DataFrame, key: str, vector: str, label: str, strategy: str | float = "auto",
                 k: int = 5, seed: int = 42, name_rows: bool = False, **neighbor_options) -> DataFrame:
    """Originals and synthetic rows: (key, label, vec, synthetic).

    Synthetic rows have no key; with ``name_rows`` keys are texts and theirs are '<label>-<i>-made'.
    """
    made = smote_rows(df, key, vector, label, strategy, k, seed, **neighbor_options)
    kind = "string" if name_rows else df.schema[key].dataType
    name = F.concat_ws("-", F.col("label").cast("string"), F.col("i").cast("string"), F.lit("made"))
    return (df.select(F.col(key).cast(kind).alias("key"), F.col(label).alias("label"),
                      F.col(vector).cast("array<double>").alias("vec"), F.lit(False).alias("synthetic"))
            .unionByName(made.select((name if name_rows else F.lit(None).cast(kind)).alias("key"), "label", "vec",
                                     F.lit(True).alias("synthetic"))))


def class_weights(df: DataFrame, label: str) -> dict:
    """n / (classes * n_c) for every class."""
    counts = class_sizes(df, label)
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weights = class_weights(df, label)
    table = F.create_map(*[F.lit(v) for c, w in sorted(weights.items()) for v in (c, float(w))])
    return df.withColumn(out, table[col(label)])
