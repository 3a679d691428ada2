"""Queries of joins, splits, shards and integrity checks; orders are studies, customers are patients, line items are images."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import arrays as A
from quillspark.operators import integrity, splits
from quillspark.operators.numbering import positions
from quillspark.plans.registry import query
from quillspark.sources.tables import table

SPLIT = "CASE doc_id % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


def routed(df, key="doc_id"):
    return df.withColumn("split", F.when(F.col(key) % 7 == 0, "test").when(F.col(key) % 7 == 1, "val").otherwise("train"))


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'")
def study_join(spark, d):
    """Studies with their images of one kind; the filter reaches the scan."""
    images = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(images, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("SELECT l_orderkey, x.a AS l_linenumber, x.b AS l_partkey FROM (SELECT l_orderkey, min({'a': l_linenumber, 'b': l_partkey}) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)")
def first_per_group(spark, d):
    """The first image of each study: an aggregate with a partial step, not a sort."""
    x = table(spark, d, "lineitem").filter("l_returnflag = 'A'")
    return x.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("x")).select("l_orderkey", "x.*")


@query("WITH m AS (SELECT l_orderkey AS k, max({'a': l_linenumber, 'b': l_shipdate}).b AS last_ship FROM lineitem GROUP BY 1) SELECT o_orderkey, last_ship, last_ship IS NULL AS missing FROM orders LEFT JOIN m ON o_orderkey = k")
def manifest_lookup(spark, d):
    """A look-up in which the last row of a key wins; studies without one are kept."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.struct("l_linenumber", "l_shipdate"))["l_shipdate"].alias("last_ship"))
    return table(spark, d, "orders").select("o_orderkey").join(m, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", "last_ship", F.col("last_ship").isNull().alias("missing"))


@query("WITH r AS (SELECT DISTINCT doc_id FROM labels), i AS (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 3 <> 0) SELECT count(*) FILTER (r.doc_id IS NULL AND vec_id IS NOT NULL) AS missing_report, count(*) FILTER (r.doc_id IS NOT NULL AND vec_id IS NULL) AS missing_image, count(*) FILTER (r.doc_id IS NULL AND vec_id IS NULL) AS missing_both, count(*) FILTER (r.doc_id IS NOT NULL AND vec_id IS NOT NULL) AS complete FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN i ON vec_id = d.doc_id")
def missing_parts(spark, d):
    r = table(spark, d, "labels").select(F.col("doc_id").alias("r")).distinct()
    i = table(spark, d, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("i")).distinct()
    x = table(spark, d, "documents").select("doc_id")
    j = x.join(r, x.doc_id == r.r, "left").join(i, x.doc_id == i.i, "left")
    return j.agg(F.expr("count_if(r is null and i is not null)").alias("missing_report"), F.expr("count_if(r is not null and i is null)").alias("missing_image"), F.expr("count_if(r is null and i is null)").alias("missing_both"), F.expr("count_if(r is not null and i is not null)").alias("complete"))


@query("SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND quality = 1)")
def semi_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id AS id, 'documents' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def id_set_difference(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id").distinct()
    return a.join(b, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("documents").alias("only_in")).unionByName(b.join(a, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("labels").alias("only_in")))


_PERM = "p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS pos, count(*) OVER () AS n FROM documents)"


@query(f"WITH {_PERM} SELECT doc_id, CASE WHEN pos <= floor(n * 0.7) THEN 'train' WHEN pos <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM p")
def split_assign(spark, d):
    return splits.assign(table(spark, d, "documents").select("doc_id"), "doc_id", 0.7, 0.15, "42")


_ASSIGNED = f"{_PERM}, s AS (SELECT doc_id, CASE WHEN pos <= floor(n * 0.7) THEN 'train' WHEN pos <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM p)"


@query(f"WITH {_ASSIGNED}, x AS (SELECT * FROM s UNION ALL SELECT doc_id, 'test' FROM s WHERE split = 'train' AND doc_id % 11 = 0), k AS (SELECT doc_id, count(DISTINCT split) AS n FROM s GROUP BY 1), j AS (SELECT doc_id, count(DISTINCT split) AS n FROM x GROUP BY 1) SELECT 'assigned' AS what, count(*) AS ids, count(*) FILTER (n > 1) AS in_two FROM k UNION ALL SELECT 'mixed', count(*), count(*) FILTER (n > 1) FROM j")
def split_disjoint(spark, d):
    """How many ids are in more than one split: of the splits as assigned, and of ones that were mixed on purpose."""
    s = splits.assign(table(spark, d, "documents").select("doc_id"), "doc_id", 0.7, 0.15, "42")
    mixed = s.unionByName(s.filter("split = 'train' and doc_id % 11 = 0").select("doc_id", F.lit("test").alias("split")))
    return splits.overlap(s, "doc_id").select(F.lit("assigned").alias("what"), "*").unionByName(splits.overlap(mixed, "doc_id").select(F.lit("mixed").alias("what"), "*"))


@query(f"WITH {_PERM}, r AS (SELECT any_value(n) AS n, greatest(0.02 * any_value(n), 30) / any_value(n) AS test FROM p), q AS (SELECT 0.8 * (1 - test) / 0.98 AS tr, 0.18 * (1 - test) / 0.98 AS va, n FROM r) SELECT doc_id, CASE WHEN pos <= floor(p.n * tr) THEN 'train' WHEN pos <= floor(p.n * tr) + floor(p.n * va) THEN 'val' ELSE 'test' END AS split FROM p, q")
def split_minimum_test(spark, d):
    """Ratios 0.8, 0.18, 0.02, but 30 test rows at least; the other two are rescaled from their given values."""
    return splits.assign(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8, 0.18, "42", min_test=30)


@query(f"WITH r AS (SELECT doc_id, {SPLIT} AS split FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS pos FROM r) SELECT doc_id, split, ((pos - 1) // 100)::INT AS shard_id, pos - 1 AS image_id, split || '_image_' || lpad((pos - 1)::VARCHAR, 6, '0') || '.jpg' AS image FROM n")
def shard_numbering(spark, d):
    return splits.shards(routed(table(spark, d, "documents").select("doc_id")), "doc_id", 100)


@query(f"WITH r AS (SELECT doc_id, {SPLIT} AS split FROM documents) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY split ORDER BY doc_id) <= 25")
def first_rows_of_split(spark, d):
    r = routed(table(spark, d, "documents").select("doc_id"))
    return r.withColumn("n", F.row_number().over(Window.partitionBy("split").orderBy("doc_id"))).filter("n <= 25").drop("n")


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 50")
def random_rows(spark, d):
    """A sample without replacement that is the same everywhere."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'train' WHEN '2-HIGH' THEN 'val' WHEN '3-MEDIUM' THEN 'test' ELSE 'train' END AS split FROM orders")
def split_routing(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.when(p == "1-URGENT", "train").when(p == "2-HIGH", "val").when(p == "3-MEDIUM", "test").otherwise("train").alias("split"))


_LEAK = f"WITH r AS (SELECT source AS k, {SPLIT} AS split FROM documents)"


@query(f"{_LEAK} SELECT k, count(*) AS n_rows, count(DISTINCT split) AS n_splits, count(*) > 1 AS as_coded, count(DISTINCT split) > 1 AS leaks FROM r GROUP BY k HAVING count(*) > 1")
def leak_by_key(spark, d):
    """Keys met twice (as the check is coded) and in two splits (a true leak)."""
    return splits.leaks(routed(table(spark, d, "documents")), "source", "k")


_TEXT = f"t AS (SELECT DISTINCT md5(text) AS h, {SPLIT} AS split FROM documents WHERE text <> '')"


@query(f"WITH {_TEXT} SELECT a.split AS split_1, b.split AS split_2, count(*) AS shared FROM t a JOIN t b ON a.h = b.h AND a.split < b.split GROUP BY ALL")
def leak_text(spark, d):
    return splits.text_overlap(routed(table(spark, d, "documents")), "text")


@query("WITH s AS (SELECT o_custkey, CASE o_orderkey % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM orders JOIN customer ON o_custkey = c_custkey) SELECT o_custkey AS k, count(*) AS n_rows, count(DISTINCT split) AS n_splits, count(*) > 1 AS as_coded, count(DISTINCT split) > 1 AS leaks FROM s GROUP BY 1 HAVING count(*) > 1")
def leak_patient(spark, d):
    o = routed(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return splits.leaks(o, "o_custkey", "k")


@query(f"WITH l AS (SELECT source, {SPLIT} AS split FROM documents), a AS (SELECT count(*) AS n FROM (SELECT source FROM l GROUP BY 1 HAVING count(DISTINCT split) > 1)), {_TEXT}, b AS (SELECT count(*) AS n FROM (SELECT h FROM t GROUP BY 1 HAVING count(*) > 1)) SELECT a.n > 0 AS key_leak, b.n > 0 AS text_leak, a.n > 0 OR b.n > 0 AS any_leak FROM a, b")
def leak_verdict(spark, d):
    r = routed(table(spark, d, "documents"))
    a = splits.leaks(r, "source", "k").agg(F.coalesce(F.bool_or("leaks"), F.lit(False)).alias("key_leak"))
    b = splits.text_overlap(r, "text").agg((F.coalesce(F.sum("shared"), F.lit(0)) > 0).alias("text_leak"))
    return a.crossJoin(b).withColumn("any_leak", F.col("key_leak") | F.col("text_leak"))


@query(f"SELECT md5(text) AS h, array_to_string(list_sort(list(DISTINCT {SPLIT})), ',') AS splits, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT {SPLIT}) > 1 AS across, count(*) > count(DISTINCT {SPLIT}) AS inside FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    """Exact duplicates, across splits and inside one. Counts per (text, split) come first, so no group is gathered."""
    per = routed(table(spark, d, "documents")).groupBy(F.md5("text").alias("h"), "split").agg(F.count("*").alias("c"), F.min("doc_id").alias("m"))
    g = per.groupBy("h").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.sum("c").alias("n"), F.min("m").alias("first_id"), F.count("*").alias("k"), F.max("c").alias("most"))
    return g.filter("n > 1").select("h", "splits", "n", "first_id", (F.col("k") > 1).alias("across"), (F.col("most") > 1).alias("inside"))


#: Orders are the manifest; their line items are what was processed, with the split that the run wrote down.
_MAN = """WITH m AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS expected FROM orders WHERE o_orderstatus <> 'P'),
p AS (SELECT l_orderkey AS id, CASE WHEN max(l_quantity) > 49 THEN 'test' WHEN l_orderkey % 7 = 0 THEN 'test' WHEN l_orderkey % 7 = 1 THEN 'val' ELSE 'train' END AS actual, count(*) AS n_rows FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey),
j AS (SELECT coalesce(m.id, p.id) AS id, expected, actual FROM m FULL JOIN p ON m.id = p.id)"""


def _manifest(spark, d):
    k = F.col("o_orderkey")
    return routed(table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(k.alias("id")), "id").withColumnRenamed("split", "expected")


def _processed(spark, d):
    g = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("q"))
    return routed(g, "id").select("id", F.when(F.col("q") > 49, "test").otherwise(F.col("split")).alias("actual"))


@query(f"{_MAN} SELECT id, expected, actual FROM j WHERE expected <> actual")
def split_violations(spark, d):
    """Processed studies that lie in another split than the manifest says."""
    return integrity.violations(_manifest(spark, d), _processed(spark, d))


@query(f"""{_MAN}, c AS (SELECT count(*) FILTER (expected IS NOT NULL) AS e, count(*) FILTER (actual IS NOT NULL) AS n, count(*) FILTER (expected IS NOT NULL AND actual IS NOT NULL) AS k, count(*) FILTER (expected IS NULL) AS x, count(*) FILTER (expected = actual) AS ok FROM j)
SELECT e AS expected_n, n AS processed_n, k AS matched, e - k AS missing, x AS extra, k - ok AS misplaced, round(100 * k / e, 6) AS consistency_pct, round(100 * ok / k, 6) AS split_accuracy_pct, 100 * k >= 99 * e AND 100 * ok >= 99 * k AS passes_full, 100 * k >= 95 * e AND 100 * ok >= 95 * k AS passes_sample FROM c""")
def cross_check(spark, d):
    """A manifest against what was processed: missing, extra and misplaced studies, shares and verdicts."""
    return integrity.cross_check(_manifest(spark, d), _processed(spark, d))


@query(f"{_MAN}, s AS (SELECT j.* FROM j JOIN m USING (id) ORDER BY md5('3|' || id), id LIMIT 48) SELECT count(*) FILTER (actual IS NOT NULL) AS found, count(*) FILTER (actual IS NULL) AS missing, count(*) FILTER (expected <> actual) AS misplaced FROM s")
def cross_check_sampled(spark, d):
    """The same for a sample of the manifest, drawn by hash; only the sample's studies are joined."""
    sample = _manifest(spark, d).orderBy(F.md5(F.concat(F.lit("3|"), F.col("id").cast("string"))), "id").limit(48)
    x = integrity.cross_check(sample, _processed(spark, d).join(F.broadcast(sample.select("id")), "id", "left_semi"))
    return x.select(F.col("matched").alias("found"), "missing", "misplaced")


@query(f"{_MAN}, r AS (SELECT count(*) FILTER (expected IS NOT NULL AND actual IS NOT NULL) / count(*) FILTER (expected IS NOT NULL) AS rate FROM j) SELECT expected AS split, count(*) AS expected_n, count(*) FILTER (actual = expected) AS actual_n, floor(count(*) * (SELECT rate FROM r))::BIGINT AS projected_n FROM j WHERE expected IS NOT NULL GROUP BY 1")
def expected_and_actual(spark, d):
    """Counts by split: what the manifest names, what lies there, and what the rate of processing lets expect."""
    j = _manifest(spark, d).join(_processed(spark, d), "id", "left")
    rate = F.broadcast(j.agg((F.count("actual") / F.count("*")).alias("rate")))
    g = j.groupBy(F.col("expected").alias("split")).agg(F.count("*").alias("expected_n"), F.count_if(F.col("actual") == F.col("expected")).alias("actual_n"))
    return g.crossJoin(rate).select("split", "expected_n", "actual_n", F.floor(F.col("expected_n") * F.col("rate")).alias("projected_n"))


@query(f"SELECT md5(text) AS h, {SPLIT} AS split, count(*) AS n, list_sort(list(doc_id))[1:5] AS places FROM documents WHERE text <> '' GROUP BY text, split HAVING count(*) > 1")
def duplicates_inside(spark, d):
    """Texts that a split holds more than once, how often, and the first five places."""
    return splits.repeated(routed(table(spark, d, "documents").filter("text <> ''")), "text", "doc_id", 5)


_LAB = "list_filter(list_transform(string_split(lang || ';' || source || '; ;' || lang, ';'), lambda x: trim(x)), lambda x: x <> '')"


def _labels(spark, d):
    c = F.concat_ws(";", "lang", "source", F.lit(" "), "lang")
    return table(spark, d, "documents").select("doc_id", F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "").alias("l"))


@query(f"SELECT DISTINCT unnest({_LAB}) AS label FROM documents")
def label_set(spark, d):
    return _labels(spark, d).select(F.explode("l").alias("label")).distinct()


@query(f"WITH k AS (SELECT list(label ORDER BY label) AS known FROM (SELECT DISTINCT unnest({_LAB}) AS label FROM documents)) SELECT doc_id, array_to_string({_LAB}, ';') AS labels, list_transform(known, lambda x: list_contains({_LAB}, x)::FLOAT) AS hot FROM documents, k")
def label_multi_hot(spark, d):
    """Rows as vectors over all labels that occur, in order."""
    rows = _labels(spark, d)
    known = A.known_labels(rows, "l")
    return rows.select("doc_id", F.array_join("l", ";").alias("labels"), A.multi_hot(F.col("l"), known).alias("hot"))


@query("SELECT role, count(*) FILTER (text IS NULL) AS absent, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (trim(text) <> '') AS filled FROM conversations GROUP BY role")
def empty_and_absent(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(t.isNull()).alias("absent"), F.count_if(F.trim(t) == "").alias("empty"), F.count_if(F.trim(t) != "").alias("filled"))


@query("SELECT e.*  FROM (SELECT o_orderkey, md5(string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey)) AS seq FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) e SEMI JOIN (SELECT md5(string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey)) AS seq FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY l_orderkey) q USING (seq)")
def sequence_lookup(spark, d):
    """Rows whose whole sequence is one of a given list."""
    line = table(spark, d, "lineitem")
    seqs = lambda x: x.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c")).select("o_orderkey", F.md5(F.array_join(F.transform("c", lambda y: y["l_partkey"].cast("string")), " ")).alias("seq"))
    return seqs(line).join(seqs(line.filter("l_orderkey % 100 = 0")).select("seq"), "seq", "left_semi").select("o_orderkey", "seq")


@query("SELECT source, lang, n_chars, doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS pos FROM documents")
def global_row_numbers(spark, d):
    """Row numbers of a whole table by a number and an id, in buckets of the number."""
    x = table(spark, d, "documents").select("source", "lang", "n_chars", "doc_id")
    return positions(x, [(F.floor(F.col("n_chars") / 500), True)], [F.col("n_chars"), F.col("doc_id")])
