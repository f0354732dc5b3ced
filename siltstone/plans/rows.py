"""Queries on projections, filters, joins, sets and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import ordered as O
from ..operators import relational as R
from ..operators import sampling as S
from .registry import query, table as t

HASH = "('0x' || substr(md5({}::VARCHAR), 1, 8))::BIGINT"


@query("SELECT 'docs/' || doc_id AS blob_path, source, '' AS chain_idx, n_chars AS seq_length, 'monomer' AS complex_type, NULL::DOUBLE AS resolution, 1 AS num_chains FROM documents")
def schema_map(spark, d):
    return t(spark, d, "documents").select(F.concat(F.lit("docs/"), "doc_id").alias("blob_path"), "source", F.lit("").alias("chain_idx"), F.col("n_chars").alias("seq_length"), F.lit("monomer").alias("complex_type"), F.lit(None).cast("double").alias("resolution"), F.lit(1).alias("num_chains"))


@query("SELECT l_orderkey, '[' || string_agg('''' || l_linenumber || '''', ', ' ORDER BY l_linenumber) || ']' AS literal, count(*)::INTEGER AS size FROM lineitem GROUP BY 1")
def list_literal_size(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    lit = g.select("l_orderkey", F.concat(F.lit("['"), F.array_join(F.col("l").cast("array<string>"), "', '"), F.lit("']")).alias("literal"))
    return lit.withColumn("size", F.size(X.list_literal(F.col("literal"), "array<string>")))


@query("SELECT vec_id, list_transform(embedding[1:3], lambda x: round(x::DOUBLE, 4)) AS numbers, [vec_id, label::BIGINT] AS ints FROM embeddings")
def parse_arrays(spark, d):
    text = F.concat(F.lit("["), F.array_join(F.transform(F.slice("embedding", 1, 3), lambda x: X.rounded(x.cast("double"), 4).cast("string")), " "), F.lit("]"))
    ints = F.concat(F.lit("["), F.col("vec_id").cast("string"), F.lit(", "), F.col("label").cast("string"), F.lit("]"))
    return t(spark, d, "embeddings").select("vec_id", X.spaced_numbers(text).alias("numbers"), X.list_literal(ints, "array<bigint>").alias("ints"))


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS row_index FROM documents")
def dense_index(spark, d):
    return R.dense_number(t(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], "row_index")


@query("""SELECT o_orderkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'protein_nucleic_acid' WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 0 THEN 'protein_ligand' WHEN count(*) > 1 THEN 'protein_protein' ELSE 'monomer' END AS kind
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def case_type(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count(F.lit(1)).alias("n"))
    kind = X.case_ladder((F.col("r") > 0, "protein_nucleic_acid"), (F.col("a") > 0, "protein_ligand"), (F.col("n") > 1, "protein_protein"), default="monomer")
    return t(spark, d, "orders").join(n, "o_orderkey").select("o_orderkey", kind.alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag < l_linestatus THEN l_returnflag || ':' || l_linestatus ELSE l_linestatus || ':' || l_returnflag END AS pair,
least(l_partkey, l_suppkey)::VARCHAR || '_' || greatest(l_partkey, l_suppkey)::VARCHAR AS ids FROM lineitem""")
def pair_key(spark, d):
    ids = F.array_join(F.array_sort(F.array("l_partkey", "l_suppkey")).cast("array<string>"), "_")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.pair_key(F.col("l_returnflag"), F.col("l_linestatus"), ":").alias("pair"), ids.alias("ids"))


@query("SELECT a.n_regionkey, a.n_nationkey AS entity_1_id, a.n_name AS entity_1_name, b.n_nationkey AS entity_2_id, b.n_name AS entity_2_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def pair_columns(spark, d):
    n = t(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    side = lambda k: n.withColumnsRenamed({"id": f"entity_{k}_id", "name": f"entity_{k}_name"})
    return side(1).join(side(2), "n_regionkey").filter("entity_1_id < entity_2_id")


@query("""SELECT d.doc_id, CASE WHEN length(text) < 10 THEN text ELSE coalesce('q' || l.quality, CASE WHEN lang = 'en' THEN 'poly_' || source ELSE 'NotInClusterTxt' END) END AS cluster FROM documents d LEFT JOIN labels l USING (doc_id)""")
def fallback_key(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    known = F.concat(F.lit("q"), F.col("quality").cast("string"))
    other = F.when(F.col("lang") == "en", F.concat(F.lit("poly_"), "source")).otherwise("NotInClusterTxt")
    return j.select("doc_id", F.when(F.length("text") < 10, F.col("text")).otherwise(F.coalesce(known, other)).alias("cluster"))


@query("""SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'N') THEN 'all_n' WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 'mixed' WHEN bool_or(l_returnflag IN ('R', 'A')) THEN 'some' ELSE 'none' END AS kind FROM lineitem GROUP BY 1""")
def any_all_case(spark, d):
    flag = lambda *v: F.bool_or(F.col("l_returnflag").isin(*v))
    kind = X.case_ladder((F.bool_and(F.col("l_returnflag") == "N"), "all_n"), (flag("R") & flag("A"), "mixed"), (flag("R", "A"), "some"), default="none")
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(kind.alias("kind"))


@query("SELECT o_orderkey, CASE WHEN list_last(string_split(o_orderpriority, '-')) IN ('LOW', 'NOT SPECIFIED') THEN 'rna' WHEN contains(o_orderpriority, '/') THEN 'hybrid' ELSE list_last(string_split(o_orderpriority, '-')) END AS kind FROM orders")
def suffix_case(spark, d):
    last = F.element_at(F.split("o_orderpriority", "-"), -1)
    return t(spark, d, "orders").select("o_orderkey", F.when(last.isin("LOW", "NOT SPECIFIED"), "rna").when(F.contains("o_orderpriority", F.lit("/")), "hybrid").otherwise(last).alias("kind"))


@query("""SELECT c_custkey, coalesce(CASE WHEN try_cast(c_name AS DOUBLE) > 0 THEN try_cast(c_name AS DOUBLE) END, CASE WHEN c_acctbal > 0 THEN c_acctbal END, CASE WHEN c_nationkey > 0 THEN c_nationkey::DOUBLE END) AS number FROM customer""")
def coalesce_numeric(spark, d):
    return t(spark, d, "customer").select("c_custkey", X.first_number(F.col("c_name"), F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string")).alias("number"))


@query("SELECT p_partkey, upper(trim(coalesce(nullif(p_type, ''), p_brand, ''))) AS method FROM part")
def normalise_text(spark, d):
    return t(spark, d, "part").select("p_partkey", F.upper(F.trim(F.coalesce(F.nullif(F.col("p_type"), F.lit("")), F.col("p_brand"), F.lit("")))).alias("method"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS event_type, CASE WHEN event_type = 'view' THEN -value ELSE value END AS value FROM events")
def conditional_rewrite(spark, d):
    view = F.col("event_type") == "view"
    return t(spark, d, "events").select("event_id", F.when(view, "click").otherwise(F.col("event_type")).alias("event_type"), F.when(view, -F.col("value")).otherwise(F.col("value")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS number FROM lineitem")
def renumber(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")).cast("long").alias("number"))


@query("""WITH r AS (SELECT user_id, event_id, (event_id // 2) AS id FROM events), p AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM r)
SELECT user_id, event_id, id + sum(CASE WHEN id = prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS renumbered FROM p""")
def dup_renumber(spark, d):
    """Repeats of the id before push all later ids up by one."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    r = t(spark, d, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 2).alias("id"))
    repeat = r.withColumn("again", F.when(F.col("id") == F.lag("id").over(w), 1).otherwise(0))
    return repeat.select("user_id", "event_id", (F.col("id") + F.sum("again").over(w)).alias("renumbered"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN k > 0 THEN '.' || k ELSE '' END AS chain, k AS sym_id FROM r""")
def occurrence_suffix(spark, d):
    r = S.within_index(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_returnflag"], [F.col("l_linenumber")], "sym_id")
    return r.select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.when(F.col("sym_id") > 0, F.concat(F.lit("."), F.col("sym_id").cast("string"))).otherwise("")).alias("chain"), "sym_id")


@query("""SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 's' || l_suppkey ELSE 'a' || l_linenumber END AS token, list_sort(list(l_linenumber)) AS members FROM lineitem GROUP BY 1, 2""")
def conditional_group(spark, d):
    """Standard groups stay one token; others give one token a row."""
    token = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("a"), F.col("l_linenumber").cast("string")))
    return t(spark, d, "lineitem").groupBy("l_orderkey", token.alias("token")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("members"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber = 1)::INTEGER AS centre, (l_returnflag = 'N' AND l_linenumber = 2 OR l_returnflag <> 'N' AND l_linenumber = 1)::INTEGER AS representative FROM lineitem")
def mask_flags(spark, d):
    n, first = F.col("l_returnflag") == "N", F.col("l_linenumber")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (first == 1).cast("int").alias("centre"), ((n & (first == 2)) | (~n & (first == 1))).cast("int").alias("representative"))


@query("SELECT c_custkey, coalesce(n_name, 'UNK') AS nation, coalesce(r_name, 'UNK') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_lookup(spark, d):
    dim = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return R.lookup(t(spark, d, "customer").select("c_custkey", "c_nationkey"), dim, ["c_nationkey"], {"nation": "UNK", "region": "UNK"}).drop("c_nationkey")


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_suppkey, l_partkey) - 1 AS uid FROM lineitem")
def dense_pair_id(spark, d):
    return R.dense_ids(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"], "uid").select("l_orderkey", "l_linenumber", "uid")


@query("SELECT l_orderkey, l_linenumber, l_linestatus || row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber) AS name FROM lineitem")
def running_name(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_linestatus", n.cast("string")).alias("name"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'STEEL') AND NOT contains(p_type, 'POLISHED') THEN 'protein' WHEN contains(p_type, 'TIN') THEN 'dna' WHEN contains(p_type, 'BRASS') THEN 'rna' ELSE 'ligand' END AS kind FROM part")
def contains_case(spark, d):
    has = lambda w: F.contains("p_type", F.lit(w))
    return t(spark, d, "part").select("p_partkey", X.case_ladder((has("STEEL") & ~has("POLISHED"), "protein"), (has("TIN"), "dna"), (has("BRASS"), "rna"), default="ligand").alias("kind"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 5000")
def length_filter(spark, d):
    return t(spark, d, "documents").filter(F.col("n_chars").between(500, 5000)).select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def source_filter(spark, d):
    return t(spark, d, "documents").filter(F.col("source") == "src3").select("doc_id", "lang")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size < 3 THEN 'no_chain' WHEN p_type <> '' AND contains(p_type, 'PLATED') THEN 'method' WHEN p_retailprice IS NOT NULL AND p_retailprice >= 1800 THEN 'resolution' WHEN p_size > 45 THEN 'chains' END AS reason FROM part) GROUP BY 1""")
def reject_ladder(spark, d):
    reason = X.case_ladder((F.col("p_size") < 3, "no_chain"), ((F.col("p_type") != "") & F.contains("p_type", F.lit("PLATED")), "method"), (F.col("p_retailprice") >= 1800, "resolution"), (F.col("p_size") > 45, "chains"))
    return R.rejects(t(spark, d, "part"), reason)


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS resolution FROM customer)
SELECT c_custkey, resolution, CASE WHEN resolution IS NOT NULL AND resolution > 5000 THEN 'above' ELSE 'kept' END AS reason FROM r""")
def null_keep_filter(spark, d):
    """Kept rows and, with their reason, the removed ones."""
    r = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("resolution"))
    kept = R.keep_unknown_or_below(r, "resolution", 5000.0).withColumn("reason", F.lit("kept"))
    return R.union_all(kept, r.filter("resolution > 5000").withColumn("reason", F.lit("above")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_list(spark, d):
    ids = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return R.semi_list(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ids)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE (l_returnflag, l_linestatus) NOT IN (('N', 'O'), ('A', 'F'))")
def anti_tuple(spark, d):
    out = spark.createDataFrame([("N", "O"), ("A", "F")], "l_returnflag string, l_linestatus string")
    return R.anti_tuple(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), out)


@query("SELECT p_partkey FROM part WHERE try_cast(p_size::VARCHAR AS INTEGER) <= 20")
def cast_filter(spark, d):
    return t(spark, d, "part").filter(F.col("p_size").cast("string").try_cast("int") <= 20).select("p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_n(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT n_nationkey, n_name, round(list_max(list_transform(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ_0123456789', ''), lambda c: length(n_name) - length(replace(n_name, c, '')))) / length(n_name)::DOUBLE, 6) AS share FROM nation""")
def dominant_letter(spark, d):
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ_0123456789"])
    top = F.array_max(F.transform(letters, lambda c: F.length("n_name") - F.length(F.replace("n_name", c, F.lit("")))))
    return t(spark, d, "nation").select("n_nationkey", "n_name", F.round(top / F.length("n_name"), 6).alias("share")).filter("share <= 1")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_shipdate > TIMESTAMP '1997-06-01' THEN 'date' WHEN l_partkey = l_suppkey THEN 'same' WHEN l_quantity / 50 <= 0.1 THEN 'align_ratio' WHEN position(l_suppkey::VARCHAR IN l_partkey::VARCHAR) > 0 AND length(l_suppkey::VARCHAR) / length(l_partkey::VARCHAR)::DOUBLE > 0.95 THEN 'subsequence' WHEN l_quantity < 10 THEN 'short' ELSE 'ok' END AS reason FROM lineitem) GROUP BY 1""")
def template_ladder(spark, d):
    s, p = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    reason = X.case_ladder(
        (F.col("l_shipdate") > F.lit("1997-06-01").cast(t(spark, d, "lineitem").schema["l_shipdate"].dataType), "date"), (F.col("l_partkey") == F.col("l_suppkey"), "same"), (F.col("l_quantity") / 50 <= 0.1, "align_ratio"),
        (F.contains(p, s) & (F.length(s) / F.length(p) > 0.95), "subsequence"), (F.col("l_quantity") < 10, "short"), default="ok",
    )
    return R.rejects(t(spark, d, "lineitem"), reason)


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def isin_filter(spark, d):
    return t(spark, d, "events").filter(~F.col("event_type").isin("view", "click")).select("event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND l_linestatus NOT IN ('H', 'D')")
def blacklist_anti(spark, d):
    black = t(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t(spark, d, "lineitem").filter(~F.col("l_linestatus").isin("H", "D")).select("l_orderkey", "l_linenumber", "l_suppkey").join(black, "l_suppkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 1")
def and_select(spark, d):
    want = {"l_returnflag": "N", "l_linestatus": "O", "l_linenumber": 1}
    df = t(spark, d, "lineitem")
    for k, v in want.items():
        df = df.filter(F.col(k) == v)
    return df.select("l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS occupancy FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY occupancy DESC, l_returnflag) AS k FROM a)
SELECT l_orderkey, l_returnflag, round(occupancy, 6) AS occupancy FROM r WHERE k = 1""")
def best_alternative(spark, d):
    a = t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_quantity").alias("occupancy"))
    return R.top_n(a, ["l_orderkey"], [F.desc("occupancy"), F.col("l_returnflag")], 1).withColumn("occupancy", F.round("occupancy", 6))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS confident FROM embeddings")
def any_above(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: x > 0.3).alias("confident"))


@query("SELECT user_id, CASE WHEN avg(value) < 50 THEN '#' ELSE user_id::VARCHAR END AS token FROM events GROUP BY user_id")
def mask_low(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.when(F.avg("value") < 50, "#").otherwise(F.first("user_id").cast("string")).alias("token"))


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def left_lookup(spark, d):
    dim = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return R.lookup(t(spark, d, "orders").select("o_orderkey", "o_custkey"), dim, ["o_custkey"], {"segment": "unknown"}).drop("o_custkey")


@query("SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN (SELECT n_nationkey, lower(n_name) AS n_name FROM nation) b ON lower(a.n_name) = lower(b.n_name)")
def casefold_join(spark, d):
    a = t(spark, d, "nation").select(F.col("n_nationkey").alias("left_key"), F.lower("n_name").alias("k"))
    b = t(spark, d, "nation").select(F.col("n_nationkey").alias("right_key"), F.lower(F.lower("n_name")).alias("k"))
    return a.join(b, "k").drop("k")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def gather(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("""SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def pair_cross(spark, d):
    """All unordered pairs within a record; records hold a few rows."""
    a = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"))
    return a.join(t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("j")), "l_orderkey").filter("i < j")


@query("""WITH e AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, a.l_suppkey AS si, b.l_suppkey AS sj FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) SELECT l_orderkey, i, j FROM e WHERE si <> sj""")
def edge_filter(spark, d):
    """Edges whose ends lie in different groups."""
    n = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    edges = n.select("l_orderkey", F.col("l_linenumber").alias("i"), (F.col("l_linenumber") + 1).alias("j"), F.col("l_suppkey").alias("si"))
    ends = n.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_suppkey").alias("sj"))
    return edges.join(ends, ["l_orderkey", "j"]).filter("si <> sj").select("l_orderkey", "i", "j")


@query("""SELECT a.l_suppkey % 10 AS ti, b.l_suppkey % 10 AS tj, count(*) AS bonds FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2""")
def edge_rollup(spark, d):
    n = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("g"))
    ends = n.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("g").alias("tj"))
    return n.withColumnRenamed("g", "ti").join(ends, ["l_orderkey", "l_linenumber"]).groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("bonds"))


@query("""SELECT v.vec_id, o.op, round(o.sx * v.embedding[1]::DOUBLE + o.dx, 6) AS x, round(o.sx * v.embedding[2]::DOUBLE - o.dx, 6) AS y FROM embeddings v, (VALUES ('1', 1, 0.0), ('2', -1, 0.5), ('3', 1, 2.0)) o(op, sx, dx) WHERE contains('0,1,2,3,4', v.label::VARCHAR)""")
def op_expand(spark, d):
    """Listed groups times each operation, then the affine transform."""
    ops = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(s).alias("sx"), F.lit(x).alias("dx")) for o, s, x in (("1", 1, 0.0), ("2", -1, 0.5), ("3", 1, 2.0))])
    wanted = F.array_contains(F.split(F.lit("0,1,2,3,4"), ","), F.col("label").cast("string"))
    e = t(spark, d, "embeddings").filter(wanted).select("vec_id", "embedding", F.explode(ops).alias("o"))
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select("vec_id", "o.op", F.round(F.col("o.sx") * at(0) + F.col("o.dx"), 6).alias("x"), F.round(F.col("o.sx") * at(1) - F.col("o.dx"), 6).alias("y"))


@query("""WITH s AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS rn, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations),
p AS (SELECT conv_id, rn, max(CASE WHEN role = 'user' THEN turn END) AS user_turn, max(CASE WHEN role = 'assistant' THEN turn END) AS assistant_turn FROM s GROUP BY 1, 2)
SELECT conv_id, rn::INTEGER AS rank, user_turn, assistant_turn, abs((user_turn + 1) * (assistant_turn + 1)) AS product FROM p WHERE user_turn IS NOT NULL AND assistant_turn IS NOT NULL""")
def pair_by_species(spark, d):
    """Each side of a species ranked by similarity, zipped by rank to the
    shorter side."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc(F.length("text")), "turn"))
    s = t(spark, d, "conversations").select("conv_id", "role", "turn", "text").withColumn("rank", rank)
    p = s.groupBy("conv_id", "rank").pivot("role", ["user", "assistant"]).agg(F.max("turn"))
    both = p.filter("user IS NOT NULL AND assistant IS NOT NULL")
    return both.select("conv_id", "rank", F.col("user").alias("user_turn"), F.col("assistant").alias("assistant_turn"), F.abs((F.col("user") + 1) * (F.col("assistant") + 1)).alias("product"))


@query("SELECT arg_min(epoch, (abs(epoch - 777.5), epoch)) AS epoch, arg_min(round(value, 6), (abs(epoch - 777.5), epoch)) AS value FROM (SELECT event_id AS epoch, value FROM events)")
def nearest_epoch(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("epoch"), F.round("value", 6).alias("value"))
    return R.nearest_key(e, "epoch", "value", 777.5)


@query("SELECT 'order' AS kind, o_orderkey AS id, o_custkey AS customer, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM customer")
def union_all(spark, d):
    a = t(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return R.union_all(a, t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def distinct_ids(spark, d):
    return t(spark, d, "events").select("user_id").dropna().distinct()


@query("SELECT l_suppkey AS id FROM lineitem INTERSECT SELECT l_partkey FROM lineitem")
def intersect_ids(spark, d):
    l = t(spark, d, "lineitem")  # noqa: E741
    return l.select(F.col("l_suppkey").alias("id")).intersect(l.select("l_partkey"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_first(spark, d):
    """First row of each text; texts meet by their digest, not themselves."""
    s = t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return R.first_seen(s, ["digest"], [F.col("doc_id")]).drop("digest")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_dedup(spark, d):
    o = t(spark, d, "orders")
    return o.join(o.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "left_anti").select("o_orderkey")


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('split' || doc_id), 1, 8))::BIGINT, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k < (n * 14 // 16) THEN 'train' WHEN k < (n * 14 // 16) + (n // 16) THEN 'val' ELSE 'test' END AS split FROM r""")
def split_rows(spark, d):
    return S.split_rows(t(spark, d, "documents").select("doc_id"), "doc_id", {"train": 14 / 16, "val": 1 / 16, "test": 1 / 16}, "split")


@query("""WITH c AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY ('0x' || substr(md5('cl' || o_custkey), 1, 8))::BIGINT, o_custkey) - 1 AS k, count(*) OVER () AS n FROM c)
SELECT o_orderkey, o_custkey, CASE WHEN k < floor(n * 0.9) THEN 'train' WHEN k < floor(n * 0.9) + floor(n * 0.05) THEN 'val' ELSE 'test' END AS split FROM orders JOIN r USING (o_custkey)""")
def split_clusters(spark, d):
    return S.split_clusters(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"train": 0.9, "val": 0.05, "test": 0.05}, "cl")


@query("SELECT c_custkey, c_mktsegment, (SELECT max(n_nationkey) FROM nation) + dense_rank() OVER (ORDER BY c_mktsegment) AS new_id FROM customer")
def offset_ids(spark, d):
    return S.offset_ids(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", t(spark, d, "nation"), "n_nationkey")


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN -1 ELSE p_size END AS cluster FROM part), m AS (SELECT max(cluster) AS top FROM c)
SELECT p_partkey, CASE WHEN cluster = -1 THEN top + row_number() OVER (PARTITION BY cluster = -1 ORDER BY p_partkey) ELSE cluster END::BIGINT AS cluster FROM c, m""")
def fill_ids(spark, d):
    """Rows without a cluster get the next free numbers."""
    c = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, -1).otherwise(F.col("p_size")).alias("cluster"))
    top = c.agg(F.max("cluster")).first()[0] or 0
    filled = R.dense_number(c.filter("cluster = -1"), [F.col("p_partkey")], "n", 1).select("p_partkey", (F.col("n") + top).alias("cluster"))
    return c.filter("cluster <> -1").select("p_partkey", F.col("cluster").cast("long").alias("cluster")).unionByName(filled)


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS cluster, l_suppkey AS entity, CASE WHEN l_returnflag = 'N' THEN 'chain' ELSE 'interface' END AS kind, (l_returnflag = 'N')::INTEGER AS prot, (l_returnflag = 'A')::INTEGER AS nuc, (l_returnflag = 'R')::INTEGER AS ligand FROM lineitem),
s AS (SELECT cluster, count(DISTINCT entity) AS size FROM e GROUP BY 1), c AS (SELECT l_orderkey, entity, count(*) AS copies FROM e GROUP BY 1, 2)
SELECT e.l_orderkey, l_linenumber, round(CASE kind WHEN 'chain' THEN 0.5 ELSE 1 END * (3 * prot + 3 * nuc + 1 * ligand) / (size + 1e-9) / copies, 6) AS weight FROM e JOIN s USING (cluster) JOIN c ON c.l_orderkey = e.l_orderkey AND c.entity = e.entity""")
def sampling_weights(spark, d):
    flag = lambda v: (F.col("l_returnflag") == v).cast("int")
    e = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("cluster"), F.col("l_suppkey").alias("entity"), F.when(F.col("l_returnflag") == "N", "chain").otherwise("interface").alias("kind"), flag("N").alias("prot"), flag("A").alias("nuc"), flag("R").alias("ligand"))
    sizes = e.groupBy("cluster").agg(F.count_distinct("entity").alias("size"))
    copies = e.groupBy("l_orderkey", "entity").agg(F.count(F.lit(1)).alias("copies"))
    w = S.sampling_weight(F.col("kind"), {k: F.col(k) for k in ("prot", "nuc", "ligand")}, {"prot": 3.0, "nuc": 3.0, "ligand": 1.0}, {"chain": 0.5, "interface": 1.0}, F.col("size"), F.col("copies"))
    return e.join(sizes, "cluster").join(copies, ["l_orderkey", "entity"]).select("l_orderkey", "l_linenumber", F.round(w, 6).alias("weight"))


@query("""SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.3 WHEN 'P' THEN 0.2 ELSE 0 END / sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 9) AS mixed FROM orders""")
def mixture_weights(spark, d):
    m = S.mixture_weights(t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", {"F": 0.5, "O": 0.3, "P": 0.2})
    return m.select("o_orderkey", F.round("mixed", 9).alias("mixed"))


@query("""SELECT doc_id, round(-ln((('0x' || substr(md5('draw' || doc_id), 1, 8))::BIGINT + 1) / 4294967297.0) / n_chars, 9) AS draw FROM documents WHERE n_chars > 0 ORDER BY -ln((('0x' || substr(md5('draw' || doc_id), 1, 8))::BIGINT + 1) / 4294967297.0) / n_chars, doc_id LIMIT 100""")
def weighted_topn(spark, d):
    return S.weighted_topn(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 100, "draw").select("doc_id", F.round("draw", 9).alias("draw"))


@query("""WITH c AS (SELECT source, count(*) AS size FROM documents GROUP BY 1) SELECT doc_id, round(least(greatest(n_chars, 256), 512) / 512.0 / size, 6) AS p, ('0x' || substr(md5('keep' || doc_id), 1, 8))::BIGINT / 4294967296.0 < least(greatest(n_chars, 256), 512) / 512.0 / size AS kept FROM documents JOIN c USING (source)""")
def keep_prob(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    p = S.keep_probability(F.col("n_chars"), F.col("size"))
    return docs.join(docs.groupBy("source").agg(F.count(F.lit(1)).alias("size")), "source").select("doc_id", F.round(p, 6).alias("p"), (X.hash_uniform(F.col("doc_id"), "keep") < p).alias("kept"))


@query("""SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn > 0, ('0x' || substr(md5('msa' || conv_id || '_' || turn), 1, 8))::BIGINT, turn) <= 4 THEN 'main' ELSE 'extra' END AS part FROM conversations""")
def sample_keep_first(spark, d):
    """The first row of each group always stays; the rest by hash order."""
    h = X.hash_int(F.concat_ws("_", "conv_id", "turn"), "msa")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn") > 0, h, "turn"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.when(rank <= 4, "main").otherwise("extra").alias("part"))


@query("""SELECT vec_id, list_transform(embedding[1 + s:1 + s + 15], lambda x: round(x::DOUBLE, 6)) AS crop, s AS start FROM (SELECT vec_id, embedding, (('0x' || substr(md5('crop' || vec_id), 1, 8))::BIGINT % (len(embedding) - 15)) AS s FROM embeddings)""")
def crop_slice(spark, d):
    start = X.hash_int(F.col("vec_id"), "crop") % (F.size("embedding") - 15)
    return t(spark, d, "embeddings").withColumn("start", start).select("vec_id", F.transform(F.slice("embedding", F.col("start").cast("int") + 1, F.lit(16)), lambda x: X.rounded(x.cast("double"), 6)).alias("crop"), "start")


@query("""SELECT doc_id, CASE WHEN u < 0.2 THEN 'contiguous' WHEN u < 0.6 THEN 'spatial' ELSE 'interface' END AS method FROM (SELECT doc_id, ('0x' || substr(md5('method' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)""")
def choose_weighted(spark, d):
    return t(spark, d, "documents").select("doc_id", S.choose(F.col("doc_id"), {"contiguous": 0.2, "spatial": 0.4, "interface": 0.4}, "method").alias("method"))


@query("""WITH k AS (SELECT * FROM lineitem WHERE l_quantity > 20) SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS token FROM k""")
def reindex_crop(spark, d):
    return S.within_index(t(spark, d, "lineitem").filter("l_quantity > 20").select("l_orderkey", "l_linenumber"), ["l_orderkey"], [F.col("l_linenumber")], "token")


@query("""WITH f AS (SELECT doc_id, n_chars FROM documents d WHERE n_chars > 8000), g AS (SELECT doc_id, n_chars FROM documents WHERE n_chars <= 8000 OR n_chars IS NULL),
c AS (SELECT f.doc_id AS failed, arg_min(g.doc_id, (abs(f.n_chars - g.n_chars), g.doc_id)) AS replacement FROM f JOIN g ON abs(f.n_chars - g.n_chars) <= 200 GROUP BY 1)
SELECT f.doc_id AS failed, f.n_chars AS failed_size, c.replacement FROM f LEFT JOIN c ON c.failed = f.doc_id""")
def similar_replacement(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    return S.similar_replacement(docs.filter("n_chars > 8000"), docs.filter("n_chars <= 8000"), "doc_id", "n_chars", 200)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) = 1 ORDER BY o_totalprice DESC LIMIT 1000000000")
def sort_cast(spark, d):
    level = F.substring("o_orderpriority", 1, 1).try_cast("int")
    return t(spark, d, "orders").filter(level == 1).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem WHERE l_discount > 0.02) WHERE k <= 3")
def top_hits(spark, d):
    ok = t(spark, d, "lineitem").filter("l_discount > 0.02")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return ok.withColumn("rank", rank).filter("rank <= 3").select("l_orderkey", "l_linenumber", "rank")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, abs(s_acctbal - 1000) + s_suppkey * 1e-3 AS dist FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY dist, s_suppkey) AS n FROM r)
SELECT s_suppkey, s_nationkey FROM k WHERE n <= 32 AND s_nationkey NOT IN (SELECT s_nationkey FROM k WHERE n > 32)""")
def spatial_crop(spark, d):
    """The 32 nearest with an index-dependent nudge; partly taken groups go."""
    r = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.abs(F.col("s_acctbal") - 1000) + F.col("s_suppkey") * 1e-3).alias("dist"))
    near = r.orderBy("dist", "s_suppkey").limit(32)
    rest = r.join(near.select("s_suppkey"), "s_suppkey", "left_anti").select("s_nationkey").distinct()
    return near.join(rest, "s_nationkey", "left_anti").select("s_suppkey", "s_nationkey")


@query("""WITH g AS (SELECT l_suppkey, count(*) AS copies, sum(l_quantity) AS len FROM lineitem GROUP BY 1) SELECT l_suppkey, copies, len FROM g ORDER BY copies, len DESC, ('0x' || substr(md5('a' || l_suppkey), 1, 8))::BIGINT LIMIT 1""")
def anchor_pick(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("copies"), F.sum("l_quantity").alias("len"))
    return g.orderBy("copies", F.desc("len"), X.hash_int(F.col("l_suppkey"), "a")).limit(1)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations")
def within_index(spark, d):
    return S.within_index(t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], [F.col("turn")], "idx")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 4 = 1")
def strided_split(spark, d):
    return R.dense_number(t(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], "k").filter("k % 4 = 1").select("o_orderkey")


@query("""WITH f AS (SELECT doc_id, source, CASE WHEN source IN ('src0', 'src1') THEN 'a' WHEN source = 'src2' THEN 'b' ELSE 'c' END AS family, lang || source AS cl FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY family, cl ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT, doc_id) AS k FROM f)
SELECT doc_id, source FROM r WHERE family = 'c' OR (family = 'a' AND k <= 3) OR (family = 'b' AND k <= 1)""")
def cluster_cap(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", F.concat("lang", "source").alias("cl"))
    family = F.when(F.col("source").isin("src0", "src1"), "a").when(F.col("source") == "src2", "b").otherwise("c")
    return O.cap_by_family(docs, family, {"a": 3, "b": 1}, "cl", [X.hash_int(F.col("doc_id")), F.col("doc_id")]).select("doc_id", "source")
