"""Readers by kind and by file suffix; every path is one that Spark can open."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import stripped
from quillspark.sources import pickles
from quillspark.sources.tables import dropped, kept


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object, or an array of objects, for each file."""
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path)


def inferred_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The readable lines of a JSON-lines file, with the schema found in them; broken and blank ones are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    schema = spark.read.option("mode", "DROPMALFORMED").json(path).drop("_corrupt_record").schema
    if not len(schema):
        return spark.createDataFrame([], schema)
    return jsonl(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))[0] if not lines.isEmpty() else spark.createDataFrame([], schema)


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines); blank lines are neither."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.filter("r._broken is null").select("r.*").drop("_broken"), parsed.filter("r._broken is not null").select(F.col("value").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one object a line, as Spark writes them; folders of partitions are columns."""
    return spark.read.schema(schema).json(path)


def reports(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """(path, text) of all text files below path, trimmed; empty ones drop out. max_files: the first ones by path.

    Bytes that are no UTF-8 are dropped from the text.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    if max_files is not None:
        names = raw.select("path").orderBy("path").limit(max_files)
        raw = raw.join(F.broadcast(names) if max_files <= 100_000 else names, "path", "left_semi")
    text = stripped(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")))
    return raw.select("path", text.alias("text")).filter("text <> ''")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary in any of the forms that sinks write: a table, a JSON object of words and ids, lines 'id: word'."""
    return {"json": _object, "txt": _lines}.get(_suffix(path), lambda s, p: s.read.parquet(p).select("token", "id"))(spark, path)


def _object(spark: SparkSession, path: str) -> DataFrame:
    """A file's one object, or one object a line: both are maps, of any number of lines."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.trim("value"), r"(?<=\})\s*\n\s*(?=\{)")).alias("value"))
    return t.select(F.explode(F.from_json("value", "map<string,long>")).alias("token", "id"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    found = F.regexp_extract("value", r"^\s*(\d+): (.*)$", 1)
    return spark.read.text(path).filter(found != "").select(F.regexp_extract("value", r"^\s*\d+: (.*)$", 1).alias("token"), found.cast("long").alias("id"))


def index_words(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """(id, token) of an index file (a JSON object of ids and words); where there is none, the reverse of the vocabulary."""
    if exists(spark, path):
        t = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.trim("value"), r"(?<=\})\s*\n\s*(?=\{)")).alias("value"))
        return t.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "token")).select(F.col("id").cast("long").alias("id"), "token")
    if vocab is None:
        raise FileNotFoundError(path)
    return vocab.groupBy(F.col("id").cast("long").alias("id")).agg(F.min("token").alias("token"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def metadata(spark: SparkSession, folder: str, names: tuple[str, ...] = ("enhanced_metadata", "metadata")) -> DataFrame:
    """The rows of the first of the named metadata that the folder holds (as .parquet or .json)."""
    for name in names:
        for suffix in ("parquet", "json"):
            if exists(spark, path := f"{folder.rstrip('/')}/{name}.{suffix}"):
                return spark.read.parquet(path) if suffix == "parquet" else spark.read.json(path)
    raise FileNotFoundError(f"{folder}: none of {', '.join(names)}")


def shards(spark: SparkSession, path: str, split: str | None = None, first: int | None = None, seed: str | None = None) -> DataFrame:
    """Rows of written shards; split prunes partitions; first takes that many in the order of pos, or of a seeded hash."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("split") == split) if split else df
    if first is None:
        return df
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.col("pos").cast("string")))] if seed is not None else []
    return df.orderBy(*order, "pos").limit(first)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below path, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and folders by extension below path."""
    f = files(spark, path).withColumn("ext", F.regexp_extract("path", r"\.([^./]+)$", 1)).withColumn("folder", F.regexp_extract("path", "^(.*)/", 1))
    return f.groupBy("ext").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.countDistinct("folder").alias("folders"), F.min("path").alias("sample"))


def tree(listing: DataFrame, patient: str = r"/(p\d{3,})(?=/)", study: str = r"/(s\d{3,})(?=[/.])", samples: int = 3) -> DataFrame:
    """(level, n, samples): patients, studies and extensions that a listing's paths name; folders with text files are report folders.

    The names are found in one pass and told apart by a shuffle; each level's first samples are kept by every task for
    itself and merged, so no task sorts or numbers a level. Four rows.
    """
    spark, ext = listing.sparkSession, F.regexp_extract("path", r"\.([^./]+)$", 1)
    levels = {"patient": F.regexp_extract("path", patient, 1), "study": F.regexp_extract("path", study, 1), "extension": ext, "report folder": F.when(ext == "txt", F.regexp_extract("path", "^(.*)/", 1))}
    names = listing.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), c.alias("x")) for k, c in levels.items()))).alias("n")).select("n.*").filter("x <> ''").distinct()
    names = kept(names)
    first = {k: [x for (x,) in names.filter(F.col("level") == k).select("x").orderBy("x").limit(samples).collect()] for k in levels}
    rows = [(k, n, first[k]) for k, n in names.groupBy("level").agg(F.count("*").alias("n")).collect()]
    dropped(names)
    return spark.createDataFrame(rows, "level string, n long, samples array<string>")


def shard_sizes(listing: DataFrame, per_shard: int, split: str = r"/split=([^/]+)/") -> DataFrame:
    """(split, shards, mb, samples): files and megabytes of each split, and an estimate of its samples."""
    g = listing.groupBy(F.regexp_extract("path", split, 1).alias("split")).agg(F.count("*").alias("shards"), F.sum("length").alias("bytes"))
    return g.select("split", "shards", F.round(F.col("bytes") / 1e6, 3).alias("mb"), (F.col("shards") * per_shard).alias("samples"))


def described(df: DataFrame) -> DataFrame:
    """(column, type, nulls, least, most, shortest, longest): what a table's columns hold; lengths of texts and arrays."""
    def one(f):
        c = F.col(f"`{f.name}`")
        size = F.size(c) if f.dataType.typeName() in ("array", "map") else F.length(c.cast("string"))
        plain = f.dataType.typeName() not in ("array", "map", "struct", "binary")
        edge = lambda g: g(c).cast("string") if plain else F.lit(None).cast("string")
        return F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(c.isNull()).alias("nulls"), edge(F.min).alias("least"), edge(F.max).alias("most"), F.min(size).cast("long").alias("shortest"), F.max(size).cast("long").alias("longest"))

    return df.agg(F.array(*map(one, df.schema.fields)).alias("x")).select(F.inline("x"))


def images(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """(path, pixels): RGB values in [0, 1], resized; what Spark's decoder cannot read has null pixels."""
    from quillspark.operators.image import resize

    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(frames):
        for f in frames:
            out = []
            for h, w, c, data in zip(f["height"], f["width"], f["nChannels"], f["data"]):
                if h <= 0 or w <= 0 or not data:
                    out.append(None)
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h, w, c)[:, :, :3][:, :, ::-1] / 255.0
                a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a
                out.append(resize(a, height, width).ravel().astype(np.float32).tolist())
            f["pixels"] = out
            yield f[["origin", "pixels"]].rename(columns={"origin": "path"})

    return raw.mapInPandas(run, "path string, pixels array<float>")


def pickled_shards(spark: SparkSession, path: str, trusted: bool = False, schema: str = "study_id string, caption array<int>", names: dict[str, str] | None = None, pattern: str = "*.pkl") -> DataFrame:
    """Rows of pickled dicts of columns, or lists of dicts, in all files below path whose name fits the pattern.

    schema names the columns to be read; names gives the key of a column in the pickle where it is another one (a list of
    keys is tried in order). A dict has as many rows as `images`, or its longest list; a value that is no list, or a
    shorter one, goes to every row, as the layout has it. Unpickling runs code: only for files of one's own. A file goes
    through one task as a whole; the format "pickled_shards" (sources.pickles) deals it out, and asks for no trust.
    """
    if not trusted:
        raise ValueError("pickles execute code when read; pass trusted=True for files of your own")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    keys = {k: [v] if isinstance(v, str) else v for k, v in (names or {}).items()}

    def run(batches):
        for b in batches:
            for data in b.column(0):
                for x in pickles.pickles(io.BytesIO(data.as_buffer()), True):
                    n, columns = pickles.rows_of(x, keys, arrow.names)
                    for a in range(0, n, 1000):
                        at = range(a, min(a + 1000, n))
                        yield pa.RecordBatch.from_arrays([pa.array([pickles.plain(columns[f.name](i), f.type) for i in at], f.type) for f in arrow], schema=arrow)

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("content")
    return raw.mapInArrow(run, schema)


def _suffix(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


#: By file suffix; `load` picks from it, and users may add their own.
LOADERS = {
    "csv": csv,
    "json": json,
    "jsonl": inferred_jsonl,
    "parquet": lambda spark, path: spark.read.parquet(path),
    "txt": reports,
    "pkl": pickled_shards,
}
#: What takes the text out of a row of any loader, by name; users may add their own.
TEXT_KEYS = ["captions", "text", "report", "caption", "findings", "impression", "summary"]


def first_text(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """df with `entry_text`: the first of the named columns that is there and not empty."""
    have = [k for k in keys or TEXT_KEYS if k in df.columns]
    picked = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in have]
    return df.withColumn("entry_text", F.coalesce(*picked) if picked else F.lit(None).cast("string"))


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    suffix = _suffix(path)
    if suffix not in LOADERS:
        raise ValueError(f"no reader for .{suffix}: {sorted(LOADERS)}")
    return LOADERS[suffix](spark, path, **options)
