"""What is trained on: a table and the roles of its columns, and that table binned once.

A ``Dataset`` holds bins of all features beside labels, weights, queries and start scores, so that trainings with other parameters, folds and continuations begin
with histograms. Written to a folder, it outlives the session; a fingerprint of its columns and of the parameters of its bins tells what it was made of. Codes of
string columns are kept with it, so other tables are coded alike.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from hashlib import sha256
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import binning, sparse
from thicket.operators.binning import BinMapper
from thicket.plans.params import Params

#: Parameters that decide what the bins are.
BIN_PARAMS = ("max_bin", "min_data_in_bin", "use_missing", "zero_as_missing", "max_bin_by_feature", "bin_construct_sample_cnt", "forcedbins_filename", "data_random_seed", "categorical_feature")
#: Codes that are broadcast; more are joined by shuffle.
FEW_CODES = 200_000


@dataclass
class TrainSet:
    """Rows to train on. row_id: unique; without it one is hashed from all columns, which equal rows share. init_score: start scores, an array for
    several classes. sparse: two array columns that hold the numbers (places in ``features``) and values of each row's features that aren't zero, in
    place of a column a feature. codes: of string columns that have been coded, (value, code) by column."""

    df: DataFrame
    features: list[str]
    label: str = "label"
    weight: str | None = None
    query: str | None = None
    init_score: str | None = None
    row_id: str | None = None
    categorical: list[str] = field(default_factory=list)
    sparse: tuple[str, str] | None = None
    codes: dict[str, DataFrame] = field(default_factory=dict)

    def num_data(self) -> int:
        return self.df.count()

    def num_feature(self) -> int:
        return len(self.features)

    def subset(self, condition: Column | str) -> TrainSet:
        """The rows that meet a condition."""
        return replace(self, df=self.df.where(condition))

    def like(self, df: DataFrame) -> TrainSet:
        """Another table of the same columns, as a validation set."""
        return replace(self, df=df)

    def checked(self) -> TrainSet:
        own = self.sparse if self.sparse else self.features
        gone = [c for c in [*own, self.label, self.weight, self.query, self.init_score, self.row_id] if c and c not in self.df.columns]
        if gone:
            raise ValueError(f"columns are missing: {', '.join(gone)}")
        if not self.features:
            raise ValueError("there are no features")
        return self

    def key(self) -> Column:
        return F.col(self.row_id) if self.row_id else F.xxhash64(*self.df.columns)

    def encode(self, df: DataFrame) -> DataFrame:
        """Another table with its strings coded as this one's were; strings that this one hasn't are null."""
        return encode(df, self.codes)


def encode(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    for c, table in codes.items():
        if dict(df.dtypes).get(c) != "string":
            continue  # coded already
        known = table.select(F.col(table.columns[0]).alias("_value"), F.col("code").cast("double").alias("_code"))
        known = F.broadcast(known) if table.limit(FEW_CODES + 1).count() <= FEW_CODES else known
        columns = df.columns
        df = df.join(known, F.col(f"`{c}`") == F.col("_value"), "left").select(*(F.col("_code").alias(c) if x == c else F.col(f"`{x}`") for x in columns))
    return df


@dataclass
class Dataset:
    """A binned table: _row_id, _y (the label), _weight, _query, _init, a column b0, b1, ... a feature or the arrays _sf and _sb, and, with ``raw``, the features'
    own values _x0, _x1, ..., which linear leaves need."""

    df: DataFrame
    features: list[str]
    mappers: list[BinMapper]
    bins: dict[str, Any]
    weighted: bool = False
    ranked: bool = False
    started: bool = False
    sparse: bool = False
    raw: bool = False
    fingerprint: str = ""
    codes: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def prepare(data: TrainSet, p: Params, rows: int | None = None, raw: bool = False, keep: list[str] | None = None) -> Dataset:
        """Bins ``data``; nothing is written yet. ``rows``: their number, if known; ``keep``: more columns to carry."""
        data.checked()
        df = data.df
        keyed = df.withColumn("_row_id", data.key())
        cats = [*data.categorical, *p.categorical_feature]
        cats = [data.features[int(c)] if c.isdigit() and c not in data.features else c for c in cats]
        if data.sparse:
            if cats or p.forcedbins_filename or raw:
                raise ValueError("sparse features are numeric and have no columns of their own")
            mappers = sparse.fit(keyed, data.features, data.sparse, p.max_bin, p.min_data_in_bin, p.use_missing, p.zero_as_missing, p.bin_construct_sample_cnt, "_row_id", p.data_random_seed, rows)
        else:
            mappers = binning.fit(keyed, data.features, cats, p.max_bin, p.min_data_in_bin, p.use_missing, p.zero_as_missing, p.max_bin_by_feature or None, sample=p.bin_construct_sample_cnt, forced=forced_bounds(p.forcedbins_filename, data.features, cats), key="_row_id", seed=p.data_random_seed, rows=rows)
        own = {"_row_id": data.key(), "_y": F.col(data.label).cast("double"), "_weight": F.col(data.weight).cast("double") if data.weight else F.lit(1.0)}
        if data.query:
            own["_query"] = F.col(data.query)
        own["_init"] = F.col(data.init_score) if data.init_score else F.lit(None).cast("double")
        columns = [c.alias(n) for n, c in own.items()] + [F.col(c) for c in keep or []]
        if data.sparse:
            used = {i for i, m in enumerate(mappers) if not m.trivial}
            table = sparse.binned(df.select(*columns, *(F.col(c).alias(f"_raw_{i}") for i, c in enumerate(data.sparse))), mappers, ("_raw_0", "_raw_1"), used)
        else:
            columns += [binning.bin_column(m, m.name).cast("short" if m.num_bin > 127 else "byte").alias(f"b{i}") for i, m in enumerate(mappers)]
            table = df.select(*columns, *(F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(data.features) if raw))
        bins = {k: getattr(p, k) for k in BIN_PARAMS}
        roles = {k: v for k, v in asdict(replace(data, df=None, codes={})).items() if k != "df"}
        text = json.dumps([roles, bins, raw, sorted(x for x in df.dtypes if x[0] in {*data.features, *(data.sparse or ())})], default=str)
        return Dataset(table, data.features, mappers, bins, data.weight is not None, data.query is not None, data.init_score is not None, data.sparse is not None, raw, sha256(text.encode()).hexdigest(), data.codes)

    @staticmethod
    def build(data: TrainSet, params: dict[str, Any], path: str, raw: bool = False) -> Dataset:
        """Bins ``data`` and writes it to a folder. A folder that holds what the same columns and parameters gave isn't made again, so a folder goes with a state
        of the table; it is an error if it holds something else."""
        p, spark = Params.of(params), data.df.sparkSession
        made = Dataset.prepare(data, p, raw=raw)
        try:
            found = Dataset.load(spark, path)
        except FileNotFoundError:
            pass
        else:
            if found.fingerprint != made.fingerprint:
                raise ValueError(f"{path} holds another data set")
            return found
        made.df.write.parquet(f"{path}/rows")
        for i, table in enumerate(made.codes.values()):
            table.write.parquet(f"{path}/codes-{i}")
        about = {k: getattr(made, k) for k in ("features", "bins", "weighted", "ranked", "started", "sparse", "raw", "fingerprint")} | {"coded": list(made.codes), "schema": made.df.schema.jsonValue()}
        lines = [json.dumps(about), *(m.to_json() for m in made.mappers)]
        # written last: a folder with it is whole
        spark.createDataFrame(list(enumerate(lines)), "i int, value string").coalesce(1).write.parquet(f"{path}/about")
        return Dataset.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dataset:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            raise FileNotFoundError(path)
        from pyspark.sql.types import StructType

        lines = [r["value"] for r in spark.read.parquet(f"{path}/about").orderBy("i").collect()]  # a line a feature
        about = json.loads(lines[0])
        df = spark.read.schema(StructType.fromJson(about.pop("schema"))).parquet(f"{path}/rows")
        codes = {c: spark.read.parquet(f"{path}/codes-{i}") for i, c in enumerate(about.pop("coded"))}
        return Dataset(df, mappers=[BinMapper.from_json(x) for x in lines[1:]], codes=codes, **about)

    def check(self, p: Params) -> None:
        """Raises ValueError for parameters that would have given other bins."""
        other = [k for k in BIN_PARAMS if getattr(p, k) != self.bins[k]]
        if other:
            raise ValueError(f"the data set was binned with other values of {', '.join(other)}")

    def encode(self, df: DataFrame) -> DataFrame:
        """Another table with its strings coded as this one's were."""
        return encode(df, self.codes)


def forced_bounds(text: str, features: list[str], categorical: list[str]) -> dict[str, list[float]]:
    """Bounds by feature from ``forcedbins_filename``: JSON, or a file of it, of {"feature": number, "bin_upper_bound": [...]}."""
    if not text:
        return {}
    if not text.lstrip().startswith("["):
        with open(text) as f:
            text = f.read()
    out: dict[str, list[float]] = {}
    for entry in json.loads(text):
        i = int(entry["feature"])
        if not 0 <= i < len(features):
            raise ValueError(f"forced bins of a feature that isn't there: {i}")
        if features[i] not in categorical:
            out[features[i]] = sorted({float(b) for b in entry["bin_upper_bound"]})
    return out
