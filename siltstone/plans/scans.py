"""Queries on scans, sinks and text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import ordered, relational as R
from .registry import query, table as t

HASH = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"


@query(f"""WITH a AS (SELECT doc_id, source, n_chars, lang || '_' || source AS cluster FROM documents WHERE n_chars BETWEEN 200 AND 20000),
b AS (SELECT *, dense_rank() OVER (ORDER BY cluster) - 1 AS cluster_id, CASE WHEN source IN ('src0', 'src1') THEN 'capped5' WHEN source IN ('src2', 'src3') THEN 'capped2' ELSE 'all' END AS family FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY family, cluster_id ORDER BY {HASH.format('doc_id')}, doc_id) AS pick FROM b)
SELECT doc_id, source, cluster_id, n_chars AS seq_length, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS row_index FROM c
WHERE family = 'all' OR (family = 'capped5' AND pick <= 5) OR (family = 'capped2' AND pick <= 2)""")
def training_manifest(spark, d):
    """Length filter, cluster ids, cap by source family, length order, index."""
    docs = t(spark, d, "documents").filter(F.col("n_chars").between(200, 20000)).select("doc_id", "source", "lang", F.col("n_chars").alias("seq_length"))
    ids = R.dense_ids(docs.withColumn("cluster", F.concat_ws("_", "lang", "source")), ["cluster"], "cluster_id")
    family = F.when(F.col("source").isin("src0", "src1"), "capped5").when(F.col("source").isin("src2", "src3"), "capped2").otherwise("all")
    capped = ordered.cap_by_family(ids, family, {"capped5": 5, "capped2": 2}, "cluster_id", [X.hash_int(F.col("doc_id")), F.col("doc_id")])
    return R.dense_number(capped, [F.desc("seq_length"), F.col("doc_id")], "row_index").select("doc_id", "source", "cluster_id", "seq_length", "row_index")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_project(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'NULL', 'nan') THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority IN ('5-LOW', 'NULL') THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def null_tokens(spark, d):
    return R.null_tokens(R.null_tokens(t(spark, d, "orders"), ["o_orderstatus"], ["P", "NULL", "nan"]), ["o_orderpriority"], ["5-LOW", "NULL"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS record FROM documents)
SELECT doc_id, record, length(line) AS n, substr(line, 1, 20) AS head FROM r WHERE line <> ''""")
def record_split(spark, d):
    """Records of a multi-record text; blank ones are skipped."""
    r = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("record", "line")).filter("line <> ''")
    return r.select("doc_id", F.col("record").cast("long").alias("record"), F.length("line").cast("long").alias("n"), F.substring("line", 1, 20).alias("head"))


@query("SELECT doc_id, md5(regexp_replace(text, '[a-z]', '', 'g')) AS aligned, length(regexp_replace(text, '[a-z]', '', 'g')) AS n FROM documents")
def strip_lowercase(spark, d):
    s = X.strip_lowercase(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.md5(s).alias("aligned"), F.length(s).cast("long").alias("n"))


@query("""SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[a-z]*[^a-z]'), lambda x: length(x) - 1) AS deletions FROM conversations""")
def deletion_counts(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.transform(X.deletion_counts(F.col("text")), lambda x: x.cast("long")).alias("deletions"))


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS level, lower(substr(o_orderpriority, 3, 6)) AS word FROM orders WHERE length(o_orderpriority) >= 5")
def fixed_width(spark, d):
    p = F.col("o_orderpriority")
    return t(spark, d, "orders").filter(F.length(p) >= 5).select("o_orderkey", F.substring(p, 1, 1).alias("level"), F.lower(F.substring(p, 3, 6)).alias("word"))


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '' AND NOT starts_with(x, 'th')) AS m FROM benchmark), e AS (SELECT item_id, m, unnest(m) AS member, generate_subscripts(m, 1) - 1 AS pos FROM w)
SELECT item_id, pos, member, 'cluster_' || m[1] AS cluster, len(m) AS size FROM e""")
def line_explode(spark, d):
    """Cluster lines to (member, cluster, size)."""
    m = F.filter(F.split("text", r"\s+"), lambda x: (x != "") & ~x.startswith("th"))
    e = t(spark, d, "benchmark").select("item_id", m.alias("m")).select("item_id", F.size("m").cast("long").alias("size"), F.concat(F.lit("cluster_"), F.try_element_at("m", F.lit(1))).alias("cluster"), F.posexplode("m").alias("pos", "member"))
    return e.select("item_id", F.col("pos").cast("long").alias("pos"), "member", "cluster", "size")


@query("""WITH f AS (SELECT c_custkey, c_nationkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer) SELECT c_custkey, c_nationkey, dense_rank() OVER (ORDER BY first) - 1 AS cluster FROM f""")
def first_seen_id(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    return c.join(R.dense_number(first, [F.col("first")], "cluster"), "c_nationkey").select("c_custkey", "c_nationkey", "cluster")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN round(x::DOUBLE, 6) END) AS dense, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings""")
def sparse_dense_roundtrip(spark, d):
    """Values where the mask holds, stored sparsely, then restored with nulls."""
    e = t(spark, d, "embeddings").withColumn("mask", F.transform("embedding", lambda x: x > 0))
    sparse = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] > 0)
    m = F.map_from_entries("sparse")
    dense = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.round(F.try_element_at(m, i).cast("double"), 6))
    return e.withColumn("sparse", sparse).select("vec_id", dense.alias("dense"), F.size("sparse").cast("long").alias("n"))


@query("SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k, round(value, 6) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND value IS NOT NULL")
def history_filter(spark, d):
    """JSON history records; those that do not parse are skipped."""
    p = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return t(spark, d, "events").withColumn("k", p["k"]).filter("k IS NOT NULL AND value IS NOT NULL").select("event_id", "event_type", "k", F.round("value", 6).alias("value"))


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 200 AS batch FROM supplier")
def batch_ids(spark, d):
    n = R.dense_number(t(spark, d, "supplier").select("s_suppkey"), [F.col("s_suppkey")], "rn")
    return n.select("s_suppkey", F.floor(F.col("rn") / 200).alias("batch"))


@query("SELECT n_nationkey, l AS length, s AS sample FROM nation, range(50, 201, 25) a(l), range(0, 4) b(s)")
def length_grid(spark, d):
    n = t(spark, d, "nation").select("n_nationkey")
    return n.withColumn("length", F.explode(F.sequence(F.lit(50), F.lit(200), F.lit(25)).cast("array<bigint>"))).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))


@query("""WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY 1), e AS (SELECT conv_id, unnest(texts) AS text, unnest(turns) AS turn, generate_subscripts(turns, 1) - 1 AS sample FROM a)
SELECT conv_id, sample, 'turn=' || turn || ', share=' || printf('%.4f', length(text) / 1000.0) AS header FROM e""")
def explode_samples(spark, d):
    """Parallel arrays of a record to one row a sample, with a text header."""
    a = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    e = a.select("conv_id", F.posexplode(F.arrays_zip(F.col("s.turn").alias("turn"), F.col("s.text").alias("text"))).alias("sample", "z"))
    return e.select("conv_id", F.col("sample").cast("long").alias("sample"), F.concat(F.lit("turn="), F.col("z.turn"), F.lit(", share="), F.format_string("%.4f", F.length("z.text") / F.lit(1000.0))).alias("header"))


@query("""SELECT vec_id, printf('ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f', vec_id % 100000, chr(65 + label), vec_id % 10000, embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10, embedding[3]::DOUBLE * 10, 1.0, 0.0) AS line FROM embeddings""")
def pdb_line_format(spark, d):
    """Atoms as fixed-width text records."""
    e = F.col("embedding")
    xyz = [F.get(e, i).cast("double") * 10 for i in range(3)]
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.col("vec_id") % 100000, F.chr(F.lit(65) + F.col("label")), F.col("vec_id") % 10000, *xyz, F.lit(1.0), F.lit(0.0))
    return t(spark, d, "embeddings").select("vec_id", line.alias("line"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","seeds":[' || n_nationkey || ',' || n_regionkey || '],"version":1}' AS job FROM nation""")
def to_json_job(spark, d):
    s = F.struct(F.col("n_name").alias("name"), F.array("n_nationkey", "n_regionkey").alias("seeds"), F.lit(1).alias("version"))
    return t(spark, d, "nation").select("n_nationkey", F.to_json(s).alias("job"))


@query("SELECT doc_id, regexp_extract(source, '^([a-z]+)([0-9]+)$', 1) AS stem, coalesce(try_cast(nullif(regexp_extract(source, '^([a-z]+)([0-9]+)$', 2), '') AS BIGINT), 1) AS number FROM documents")
def regex_extract(spark, d):
    g = lambda k: F.regexp_extract("source", "^([a-z]+)([0-9]+)$", k)
    return t(spark, d, "documents").select("doc_id", g(1).alias("stem"), F.coalesce(F.nullif(g(2), F.lit("")).try_cast("bigint"), F.lit(1)).alias("number"))


@query("SELECT doc_id, regexp_replace(source, '[0-9]+', '', 'g') AS name, length(regexp_replace(text, '[0-9]+', '', 'g')) AS n FROM documents")
def strip_digits(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_replace("source", r"[0-9]+", "").alias("name"), F.length(F.regexp_replace("text", r"[0-9]+", "")).cast("long").alias("n"))


@query("""SELECT p_partkey, CASE WHEN n > 702 THEN chr((65 + ((n - 703) // 676) % 26)::INTEGER) ELSE '' END || CASE WHEN n > 26 THEN chr((65 + ((n - 27) // 26) % 26)::INTEGER) ELSE '' END || chr((65 + (n - 1) % 26)::INTEGER) AS letters
FROM (SELECT p_partkey, 1 + p_partkey % 18278 AS n FROM part)""")
def base26(spark, d):
    return t(spark, d, "part").select("p_partkey", X.base26(F.col("p_partkey") % 18278 + 1).alias("letters"))


@query("SELECT p_partkey, regexp_replace(replace(lower(p_name), ' ', '_'), '[^a-z0-9_.-]', '', 'g') AS name FROM part")
def sanitise(spark, d):
    return t(spark, d, "part").select("p_partkey", F.regexp_replace(F.translate(F.lower("p_name"), " ", "_"), "[^a-z0-9_.-]", "").alias("name"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS token FROM orders")
def first_token(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("token"))


LETTERS = {"A": "1", "C": "2", "G": "3", "T": "4"}


@query("SELECT n_nationkey, translate(regexp_replace(n_name, '[^ACGT]', 'X', 'g'), 'ACGT', '1234') AS code FROM nation")
def char_map(spark, d):
    return t(spark, d, "nation").select("n_nationkey", X.char_map(F.col("n_name"), LETTERS, "X").alias("code"))


@query("""SELECT event_id, split_part(kv, ':', 1) AS key, try_cast(split_part(kv, ':', 2) AS DOUBLE) AS number FROM (SELECT event_id, event_type || ':' || round(value, 2)::DECIMAL(18, 2) AS kv FROM events)""")
def kv_parse(spark, d):
    kv = F.concat(F.col("event_type"), F.lit(":"), F.round("value", 2).cast("decimal(18,2)").cast("string"))
    return t(spark, d, "events").select("event_id", F.split_part(kv, F.lit(":"), F.lit(1)).alias("key"), F.split_part(kv, F.lit(":"), F.lit(2)).try_cast("double").alias("number"))


@query("""SELECT d.doc_id, min(CASE WHEN contains(d.text, b.head) THEN 1 WHEN contains(lower(d.text), lower(b.head)) THEN 2 ELSE 3 END) AS priority, count(*) FILTER (WHERE contains(lower(d.text), lower(b.head))) AS hits FROM documents d,
(SELECT n_name AS head FROM nation UNION SELECT 'the ' UNION SELECT 'password') b GROUP BY 1""")
def fuzzy_find(spark, d):
    """Best way a document holds any of a fixed list of strings: exact, then
    case-folded; a list of names is small and fixed, so it goes to all rows."""
    heads = t(spark, d, "nation").select(F.col("n_name").alias("head")).union(spark.createDataFrame([("the ",), ("password",)], "head string")).distinct()
    listed = heads.agg(F.array_sort(F.collect_list("head")).alias("heads"))
    docs = t(spark, d, "documents").select("doc_id", "text").join(F.broadcast(listed))
    exact = F.exists("heads", lambda h: F.contains("text", h))
    folded = F.size(F.filter("heads", lambda h: F.contains(F.lower("text"), F.lower(h)))).cast("long")
    return docs.groupBy("doc_id").agg(F.min(F.when(exact, 1).when(folded > 0, 2).otherwise(3)).alias("priority"), F.sum(folded).alias("hits"))


@query("""WITH a AS (SELECT doc_id, list_transform(range(12), lambda i: CASE WHEN (doc_id + i) % 5 = 0 THEN -1 ELSE i + doc_id % 3 END) AS q, list_transform(range(12), lambda i: CASE WHEN (doc_id + i) % 7 = 0 THEN -1 ELSE 2 * i END) AS h FROM documents),
m AS (SELECT doc_id, q, h, list_min(list_filter(q, lambda x: x >= 0)) AS lq, list_min(list_filter(h, lambda x: x >= 0)) AS lh FROM a)
SELECT doc_id, list_transform(list_filter(list_zip(q, h), lambda z: z[1] >= 0 AND z[2] >= 0), lambda z: (z[1] - lq)::VARCHAR || '>' || (z[2] - lh)) AS mapping FROM m""")
def index_map(spark, d):
    """Two index lists shifted to start at zero and zipped; gaps are dropped."""
    i = F.sequence(F.lit(0), F.lit(11))
    a = t(spark, d, "documents").select("doc_id", F.transform(i, lambda k: F.when((F.col("doc_id") + k) % 5 == 0, F.lit(-1).cast("long")).otherwise(k + F.col("doc_id") % 3)).alias("q"), F.transform(i, lambda k: F.when((F.col("doc_id") + k) % 7 == 0, F.lit(-1)).otherwise(k * 2)).alias("h"))
    low = lambda c: F.array_min(F.filter(c, lambda x: x >= 0))
    z = F.filter(F.arrays_zip("q", "h"), lambda s: (s["q"] >= 0) & (s["h"] >= 0))
    return a.select("doc_id", F.transform(z, lambda s: F.concat((s["q"] - low("q")).cast("string"), F.lit(">"), (s["h"] - low("h")).cast("string"))).alias("mapping"))


@query("""WITH c AS (SELECT conv_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
z AS (SELECT conv_id, turn, list_zip(string_split(text, ''), string_split(q, '')) AS z FROM c)
SELECT conv_id, turn, md5(list_aggregate(list_transform(list_filter(z, lambda p: p[1] IS NOT NULL), lambda p: CASE WHEN p[1] = ' ' AND coalesce(p[2], ' ') = ' ' THEN '' WHEN coalesce(p[2], ' ') <> ' ' THEN translate(p[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE translate(p[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END), 'string_agg', '')) AS a3m FROM z""")
def sto_to_a3m(spark, d):
    """Columns that the query row has become upper case, others lower case, and
    gaps (blanks here) outside the query's columns go."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    c = t(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    z = F.zip_with(chars("text"), chars("q"), lambda p, q: F.when(p.isNull(), None).when((p == " ") & (F.coalesce(q, F.lit(" ")) == " "), "").when(F.coalesce(q, F.lit(" ")) != " ", F.translate(p, low, up)).otherwise(F.translate(p, up, low)))
    return c.join(first, "conv_id").select("conv_id", "turn", F.md5(F.array_join(z, "")).alias("a3m"))


@query("SELECT n_nationkey, list_transform(range(1, 5), lambda i: ascii(substr(rpad(n_name, 4, ' '), i::INTEGER, 1)) - 32) AS codes FROM nation")
def ascii_encode(spark, d):
    padded = F.rpad("n_name", 4, " ")
    return t(spark, d, "nation").select("n_nationkey", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.ascii(F.substr(padded, i, F.lit(1))) - 32).alias("codes"))


@query("SELECT o_orderkey, least(DATE '1996-12-31', (o_orderdate::DATE - 60)) AS cutoff, o_orderdate::DATE > DATE '1996-12-31' AS excluded FROM orders")
def date_cutoff(spark, d):
    day = F.to_date("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", F.least(F.lit("1996-12-31").cast("date"), F.date_sub(day, 60)).alias("cutoff"), (day > F.lit("1996-12-31").cast("date")).alias("excluded"))


@query("""SELECT o_orderkey, coalesce(try_cast(raw AS DATE), DATE '9999-12-31') AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)""")
def date_parse(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_to_date(raw, "yyyy-MM-dd"), F.lit("9999-12-31").cast("date")).alias("day"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def collect_results(spark, d):
    return R.lookup(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), ["doc_id"], {"quality": -1})


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // ceil((SELECT count(*) FROM supplier) / 7.0)::BIGINT AS chunk FROM supplier")
def chunk_jobs(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey")
    size = -(-s.count() // 7)
    return R.dense_number(s, [F.col("s_suppkey")], "rn").select("s_suppkey", F.floor(F.col("rn") / size).alias("chunk"))


@query("SELECT event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 6) AS minutes FROM events GROUP BY 1")
def elapsed(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type").agg(F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(60000000.0), 6).alias("minutes"))


@query("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber >= 5)")
def incremental_anti(spark, d):
    """Inputs that the manifest of finished work lacks."""
    done = t(spark, d, "lineitem").filter("l_linenumber >= 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")
