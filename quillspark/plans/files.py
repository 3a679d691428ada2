"""Queries of readers and writers: what is written is read back, and what a listing of files says."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import files as O
from quillspark.operators import stats, vocab
from quillspark.plans.corpora import _BUILT, FREQ, docs, freq
from quillspark.plans.integrity import SPLIT, routed
from quillspark.plans.registry import query
from quillspark.plans.texts import TOK, WS
from quillspark.sources import pickles, readers, sinks
from quillspark.sources.tables import shared, table


def _folder(spark) -> str:
    return f"{shared(spark)}/files-{uuid.uuid4().hex}"


@query(f"WITH {FREQ}, {_BUILT} SELECT form, token, id FROM b, (VALUES ('table'), ('json'), ('text'), ('index'), ('reverse')) v(form)")
def vocabulary_round_trip(spark, d):
    """A vocabulary in each form it is written in, and the index that is rebuilt where its file is missing."""
    folder = _folder(spark)
    sinks.write_vocabulary(vocab.built(freq(spark, d)), folder)
    t = readers.vocabulary(spark, f"{folder}/vocabulary.parquet")
    forms = {"table": t, "json": readers.vocabulary(spark, f"{folder}/word_index.json"), "text": readers.vocabulary(spark, f"{folder}/vocabulary.txt"), "index": readers.index_words(spark, f"{folder}/index_word.json"), "reverse": readers.index_words(spark, f"{folder}/none.json", t)}
    out = None
    for name, df in forms.items():
        one = df.select(F.lit(name).alias("form"), "token", F.col("id").cast("long").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH r AS (SELECT doc_id, {SPLIT} AS split FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos FROM r) SELECT doc_id, (pos // 10)::INT AS shard_id, pos FROM n WHERE split = 'val'")
def shard_round_trip(spark, d):
    """One split of written shards; only its folder is read."""
    folder = _folder(spark)
    sinks.write_shards(routed(table(spark, d, "documents").select("doc_id")), "doc_id", 10, folder)
    return readers.shards(spark, folder, "val").select("doc_id", "shard_id", "pos")


@query(f"WITH r AS (SELECT doc_id, lang, {SPLIT} AS split FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS image_id FROM r) SELECT split, image_id, split || '_image_' || lpad(image_id::VARCHAR, 6, '0') || '.jpg' AS image, doc_id, lang FROM n")
def export_round_trip(spark, d):
    folder = _folder(spark)
    sinks.write_export(routed(table(spark, d, "documents").select("doc_id", "lang")), "doc_id", ["doc_id", "lang"], folder)
    return readers.json_lines(spark, folder, "split string, image_id long, image string, doc_id long, lang string")


@query("SELECT doc_id, lang, md5(coalesce(text, '')) AS digest, 'en;de' AS labels FROM documents")
def csv_round_trip(spark, d):
    """Texts with line breaks and quotes, and a list as text."""
    folder = _folder(spark)
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", F.array(F.lit("en"), F.lit("de")).alias("labels"))
    sinks.write_csv(rows, folder, ["labels"])
    back = readers.csv(spark, folder, "doc_id long, lang string, text string, labels string")
    return back.select("doc_id", "lang", F.md5(T.blank(F.col("text"))).alias("digest"), "labels")


@query("SELECT doc_id::VARCHAR AS study_id, lang, n_chars, 'all' AS split, [doc_id % 7, doc_id % 11, n_chars % 13]::INT[] AS caption, [doc_id % 5 / 4, n_chars / 8]::FLOAT[] AS image FROM documents")
def pickled_shards(spark, d):
    """Shards written and read by their data source: texts, numbers, arrays of ids and of floats, a value for all rows; other columns are left out."""
    pickles.register(spark)
    folder, n = _folder(spark), F.col("n_chars")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("study_ids"), "lang", "text", "n_chars", F.lit("all").alias("split"), F.array(F.col("doc_id") % 7, F.col("doc_id") % 11, n % 13).cast("array<int>").alias("captions"), F.array(F.col("doc_id") % 5 / 4, n / 8).cast("array<float>").alias("images"))
    rows.write.format(pickles.NAME).option("rows", 500).mode("append").save(folder)
    return spark.read.format(pickles.NAME).option("bytes", 1 << 20).option("rows", 500).schema("study_id string, lang string, n_chars long, split string, caption array<int>, image array<float>").load(folder)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 10 <> 3")
def json_lines_scan(spark, d):
    """Lines cut short, and blank ones, are skipped; the schema is found in the rest."""
    folder = f"{_folder(spark)}/entries.jsonl"
    line = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    bad = F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 12)).otherwise(line)
    table(spark, d, "documents").select(F.explode(F.array(bad, F.lit(" "))).alias("value")).write.text(folder)
    return readers.load(spark, folder).select("doc_id", "lang", "n_chars")


@query(f"SELECT item_id, md5(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) AS digest FROM benchmark WHERE regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') <> ''")
def report_scan(spark, d):
    """A file for each item, below folders; read whole and trimmed."""
    folder = _folder(spark)
    table(spark, d, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(folder)
    return readers.reports(spark, folder).select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.md5("text").alias("digest"))


@query("SELECT count(*) AS rows, 'enhanced' AS kind, 128 AS max_length FROM documents")
def metadata_resolution(spark, d):
    """Of two metadata files of a folder the richer one is read."""
    folder = _folder(spark)
    x = table(spark, d, "documents")
    sinks.write_metadata(x, f"{folder}/metadata.json", kind="plain", max_length=64)
    sinks.write_metadata(x, f"{folder}/enhanced_metadata.json", kind="enhanced", max_length=128)
    return readers.metadata(spark, folder).select("rows", "kind", F.col("max_length").cast("int").alias("max_length"))


_STATS = f"SELECT lang, count(*) AS n, min(n)::BIGINT AS min_len, max(n)::BIGINT AS max_len, sum(n)::BIGINT AS total FROM (SELECT lang, len({TOK}) AS n FROM documents) GROUP BY lang"


@query(f"WITH s AS ({_STATS}) SELECT lang, metric, value FROM s UNPIVOT (value FOR metric IN (n, min_len, max_len, total))")
def report_table(spark, d):
    """Statistics written as JSON, read back, and laid out as (corpus, metric, value)."""
    folder = _folder(spark)
    sinks.write_json(stats.length_stats(docs(spark, d, "lang"), ["lang"], F.size("t")), folder)
    back = readers.json_lines(spark, folder, "lang string, n long, min_len long, max_len long, total long")
    return stats.long_form(back, ["lang"])


_LISTING = "(SELECT '/data/p' || lpad((l_orderkey % 400)::VARCHAR, 4, '0') || '/s' || lpad(l_orderkey::VARCHAR, 6, '0') || CASE WHEN l_linenumber = 1 THEN '.txt' ELSE '/' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '.jpg' ELSE '.dcm' END END AS path, l_partkey AS length FROM lineitem)"


def _listing(spark, d):
    name = F.when(F.col("l_linenumber") == 1, ".txt").otherwise(F.concat(F.lit("/"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".jpg").otherwise(".dcm")))
    path = F.concat(F.lit("/data/p"), F.lpad((F.col("l_orderkey") % 400).cast("string"), 4, "0"), F.lit("/s"), F.lpad(F.col("l_orderkey").cast("string"), 6, "0"), name)
    return table(spark, d, "lineitem").select(path.alias("path"), F.col("l_partkey").alias("length"))


_LEVELS = f"""WITH l AS {_LISTING}, x AS (SELECT DISTINCT 'patient' AS level, regexp_extract(path, '/(p[0-9]{{3,}})/', 1) AS x FROM l UNION SELECT 'study', regexp_extract(path, '/(s[0-9]{{3,}})[/.]', 1) FROM l UNION SELECT 'extension', regexp_extract(path, '\\.([^./]+)$', 1) FROM l UNION SELECT 'report folder', regexp_extract(path, '^(.*)/', 1) FROM l WHERE path LIKE '%.txt')"""


@query(f"{_LEVELS} SELECT level, count(*) AS n, list_sort(list(x))[1:3] AS samples FROM x WHERE x <> '' GROUP BY level")
def tree_walk(spark, d):
    return readers.tree(_listing(spark, d))


@query("SELECT split, count(*) AS shards, round(sum(n_chars) / 1e6, 3) AS mb, count(*) * 100 AS samples FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, n_chars FROM documents) GROUP BY split")
def shard_profile(spark, d):
    """Files and megabytes by split, and the samples they may hold; each document stands for a shard."""
    r = routed(table(spark, d, "documents"))
    return readers.shard_sizes(r.select(F.concat(F.lit("/x/split="), "split", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length")), 100).withColumn("samples", F.col("samples").cast("long"))


@query(f"""WITH l AS {_LISTING}, s AS (SELECT o_orderkey, 'p' || lpad((o_orderkey % 400)::VARCHAR, 4, '0') AS patient, 's' || lpad(o_orderkey::VARCHAR, 6, '0') AS uid FROM orders),
i AS (SELECT o_orderkey, list_sort(list(path)) AS images FROM s JOIN l ON regexp_extract(path, '/(p[0-9]+)/', 1) = patient AND contains(path, uid) AND regexp_matches(path, '\\.(jpg|dcm)$') GROUP BY o_orderkey),
r AS (SELECT regexp_extract(path, '([^/]+)$', 1) AS file, min(path) AS path FROM l WHERE path LIKE '%.txt' GROUP BY 1)
SELECT s.o_orderkey, coalesce(len(images), 0)::INT AS n_images, images[1] AS first_image, r.path AS report FROM s LEFT JOIN i USING (o_orderkey) LEFT JOIN r ON file = uid || '.txt'""")
def study_files(spark, d):
    """Studies with their image files, found by folder and name, and their report file, found by name."""
    key = F.col("o_orderkey").cast("string")
    s = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("p"), F.lpad((F.col("o_orderkey") % 400).cast("string"), 4, "0")).alias("patient"), F.concat(F.lit("s"), F.lpad(key, 6, "0")).alias("uid"))
    x = O.with_reports(O.with_images(s, _listing(spark, d), "patient", "uid"), _listing(spark, d), F.concat("uid", F.lit(".txt")))
    return x.select("o_orderkey", F.size("images").alias("n_images"), F.try_element_at("images", F.lit(1)).alias("first_image"), "report")


@query("SELECT path AS source, '/copy/' || regexp_extract(path, '([^/]+)$', 1) AS target FROM " + _LISTING + " WHERE length % 50 = 0")
def copy_list(spark, d):
    """Sources and targets of a copy of chosen files."""
    return sinks.copy_manifest(_listing(spark, d).filter("length % 50 = 0"), "/copy")


@query(f"WITH e AS (SELECT doc_id, {SPLIT} AS split FROM documents), j AS (SELECT split, count(*) AS expected, count(l.doc_id) AS done FROM e LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY split) SELECT split, expected, done, round(100 * done / expected, 4) AS pct, CASE WHEN done = expected THEN 'complete' WHEN done > 0 THEN 'running' ELSE 'waiting' END AS status FROM j")
def progress_table(spark, d):
    """How far a job has come, by what it has written."""
    return sinks.progress(routed(table(spark, d, "documents").select("doc_id")), table(spark, d, "labels"), "doc_id", "split")


_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) FILTER ({c} IS NULL) AS nulls, min({c})::VARCHAR AS least, max({c})::VARCHAR AS most, min(length({c}::VARCHAR))::BIGINT AS shortest, max(length({c}::VARCHAR))::BIGINT AS longest FROM documents"
    for c, t in (("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
)


@query(_DESCRIBE + " UNION ALL SELECT 'embedding', 'array<float>', count(*) FILTER (embedding IS NULL), NULL, NULL, min(len(embedding))::BIGINT, max(len(embedding))::BIGINT FROM embeddings")
def described_columns(spark, d):
    """Types, nulls, ranges and sizes of the columns of two tables."""
    return readers.described(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")).unionByName(readers.described(table(spark, d, "embeddings").select("embedding")))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def rows_without_nulls(spark, d):
    return table(spark, d, "labels").dropna(subset=["quality", "toxic"]).select("doc_id", "quality", "toxic")
