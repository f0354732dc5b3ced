"""Queries that write driver tables as files and read them back, and queries on
what such files hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import nested as N
from ..operators import pairing
from ..operators import relational as R
from ..operators.shared import shared_path
from ..sources import tabular, texts
from .registry import query, table as t


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_typed(spark, d):
    """A table written as CSV and read with its schema."""
    rows, path = t(spark, d, "customer"), shared_path(spark, "csv")
    rows.write.option("header", True).csv(path)
    return tabular.typed_csv(spark, path, rows.schema)


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN NULL WHEN o_orderkey % 5 = 3 THEN 'NA' ELSE o_orderpriority END AS chain, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus || ',"' END AS note FROM orders""")
def csv_text_nulls(spark, d):
    """All columns text; the listed tokens are null, NA is not among them."""
    path, k = shared_path(spark, "csv"), F.col("o_orderkey")
    chain = F.when(k % 5 == 0, "NULL").when(k % 5 == 1, "n/a").when(k % 5 == 2, "-1.#IND").when(k % 5 == 3, "NA").otherwise(F.col("o_orderpriority"))
    note = F.when(k % 7 == 0, "").otherwise(F.concat("o_orderstatus", F.lit(',"')))
    t(spark, d, "orders").select("o_orderkey", chain.alias("chain"), note.alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return tabular.text_csv(spark, path)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus AS split FROM orders")
def csv_split_sink(spark, d):
    """CSV by split, read back with the split from the folders' names."""
    path = shared_path(spark, "csv")
    tabular.split_csv(t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("split")), "split", path)
    return tabular.typed_csv(spark, path, "o_orderkey long, o_totalprice double, split string")


@query("SELECT count(DISTINCT o_orderstatus) AS folders, true AS sized FROM orders")
def folder_listing(spark, d):
    """Files found below a folder by a pattern of their names."""
    path = shared_path(spark, "csv")
    tabular.split_csv(t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), "split", path)
    found = tabular.listing(spark, path, "part-*.csv").withColumn("folder", F.regexp_extract("file", "split=([^/]*)/", 1))
    return found.agg(F.count_distinct("folder").alias("folders"), (F.min("size") > 0).alias("sized"))


@query("SELECT 'doc ' || doc_id || ' ' || lang AS description, md5(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents")
def fasta_records(spark, d):
    """Texts written as wrapped FASTA records, with blank lines, and read back."""
    path = shared_path(spark, "fasta")
    wrapped = F.regexp_replace(F.regexp_replace("text", "[^A-Za-z]", ""), "(.{60})", "$1\n")
    record = F.concat(F.lit(">doc "), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit("\n"), wrapped, F.lit("\n"))
    t(spark, d, "documents").select(record.alias("value")).write.text(path)
    return texts.fasta_records(spark, path).select("description", F.md5("sequence").alias("sequence"))


# Fixed value: the form of a data base's sequence names.
UNIPROT = r"^(?:tr|sp)\|[A-Za-z0-9]{6,10}(?:_\d)?\|[A-Za-z0-9]+_([A-Za-z0-9]{1,5})(?:_\d+)?$"
HITS = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'tr|A' || lpad(c_custkey::VARCHAR, 7, '0') || '|A0_' || upper(substr(c_mktsegment, 1, 5)) || '/1-50 x' WHEN 1 THEN '  sp|P' || lpad(c_custkey::VARCHAR, 6, '0') || '_1|A3X1_LOX' || c_nationkey || '_7 y'
WHEN 2 THEN 'UniRef100_A' || c_custkey || '_' || (9000 + c_nationkey) || '/1-99' WHEN 3 THEN 'UniRef100_A' || c_custkey || '/1-99' WHEN 4 THEN 'tr|A1|B_C' ELSE '' END AS description FROM customer"""


def hits(spark, d):
    k = F.col("c_custkey").cast("string")
    n = F.col("c_custkey") % 6
    return t(spark, d, "customer").select(
        "c_custkey",
        F.when(n == 0, F.concat(F.lit("tr|A"), F.lpad(k, 7, "0"), F.lit("|A0_"), F.upper(F.substring("c_mktsegment", 1, 5)), F.lit("/1-50 x")))
        .when(n == 1, F.concat(F.lit("  sp|P"), F.lpad(k, 6, "0"), F.lit("_1|A3X1_LOX"), F.col("c_nationkey").cast("string"), F.lit("_7 y")))
        .when(n == 2, F.concat(F.lit("UniRef100_A"), k, F.lit("_"), (F.col("c_nationkey") + 9000).cast("string"), F.lit("/1-99")))
        .when(n == 3, F.concat(F.lit("UniRef100_A"), k, F.lit("/1-99"))).when(n == 4, "tr|A1|B_C").otherwise("").alias("description"),
    )


@query(f"""SELECT c_custkey, regexp_extract(split_part(regexp_extract(description, '\\S+'), '/', 1), '{UNIPROT}', 1) AS uniprot,
CASE WHEN starts_with(description, 'UniRef100') AND contains(description, '/') AND len(string_split(split_part(description, '/', 1), '_')) = 3 THEN string_split(split_part(description, '/', 1), '_')[3] ELSE '' END AS uniref FROM ({HITS})""")
def species_ids(spark, d):
    """Species of sequence descriptions, by each data base's rule."""
    return hits(spark, d).select("c_custkey", X.species_of("uniprot_all")(F.col("description")).alias("uniprot"), X.species_of("uniref100")(F.col("description")).alias("uniref"))


@query("SELECT o_orderkey, lower(substr(n, 1, 4)) AS entry, substr(n, 6) AS chain FROM (SELECT o_orderkey, regexp_extract(hit, '^[a-zA-Z0-9]{4}_[a-zA-Z0-9.]+') AS n FROM (SELECT o_orderkey, '1' || chr((65 + o_orderkey % 26)::INTEGER) || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '_' || o_orderstatus || '.' || o_orderkey % 7 || ' mol:protein' AS hit FROM orders))")
def entry_and_chain(spark, d):
    k = F.col("o_orderkey")
    hit = F.concat(F.lit("1"), F.chr(k % 26 + 65), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("_"), "o_orderstatus", F.lit("."), (k % 7).cast("string"), F.lit(" mol:protein"))
    return t(spark, d, "orders").select("o_orderkey", X.entry_and_chain(hit).alias("n")).select("o_orderkey", "n.*")


@query("SELECT user_id, type, round(value, 6) AS value FROM (SELECT user_id, event_type AS type, arg_max(round(value, 3), event_id) AS value FROM events GROUP BY 1, 2)")
def bias_spec(spark, d):
    """Lists of name:value parsed; the last of a name counts."""
    item = F.concat(F.lit(" "), F.col("event_type"), F.lit(" : "), F.format_string("%.3f", F.round("value", 3)))
    listed = t(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return listed.select("user_id", F.explode(X.bias_of(F.col("items"))).alias("type", "value"))


@query("""SELECT n_nationkey, 0 AS segment, 'A' AS chain, n_nationkey + 1 AS low, n_nationkey + 10 AS high, n_nationkey + 18 AS least, n_nationkey + 21 AS most FROM nation
UNION ALL SELECT n_nationkey, 0, NULL, 5, 8, n_nationkey + 18, n_nationkey + 21 FROM nation UNION ALL SELECT n_nationkey, 1, 'B', 7, 7, n_nationkey + 18, n_nationkey + 21 FROM nation
UNION ALL SELECT n_nationkey, 1, NULL, n_nationkey + 2, n_nationkey + 2, n_nationkey + 18, n_nationkey + 21 FROM nation UNION ALL SELECT n_nationkey, 1, NULL, 0, 0, n_nationkey + 18, n_nationkey + 21 FROM nation""")
def contig_spec(spark, d):
    """Contigs such as ``A1-10,5-8 B7,12,0`` in parts, with the length they allow."""
    k = lambda n: (F.col("n_nationkey") + n).cast("string")
    text = F.concat(F.lit("A"), k(1), F.lit("-"), k(10), F.lit(",5-8 B7,"), k(2), F.lit(",0"))
    parts = t(spark, d, "nation").withColumn("parts", X.contig_parts(text)).withColumn("length", X.contig_length(F.col("parts")))
    return parts.select("n_nationkey", F.explode("parts").alias("p"), F.col("length.low").alias("least"), F.col("length.high").alias("most")).select("n_nationkey", "p.*", "least", "most")


@query('SELECT n_nationkey AS "key", n_name AS "name", r_regionkey AS "region:key", r_name AS "region:about:name" FROM nation JOIN region ON n_regionkey = r_regionkey')
def config_flatten(spark, d):
    joined = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = joined.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("r_regionkey").alias("key"), F.struct(F.col("r_name").alias("name")).alias("about")).alias("region"))
    return N.flatten_columns(nested)


@query("""WITH e AS (SELECT user_id, event_id, 'k' AS key, json_extract(props, '$.k')::BIGINT AS v FROM events WHERE json_extract(props, '$.k') IS NOT NULL UNION ALL SELECT user_id, event_id, event_type, round(value)::BIGINT FROM events)
SELECT user_id, key, list(v ORDER BY event_id) AS values FROM e GROUP BY 1, 2""")
def merge_maps(spark, d):
    """Each event's map of metrics merged by user into lists."""
    e = t(spark, d, "events").select("user_id", "event_id", F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map("event_type", F.round("value").cast("long"))).alias("m"))
    return N.merge_maps(e, ["user_id"], "m", ["event_id"])


PAIRED = """WITH r AS (SELECT user_id % 20 AS complex, event_id % 3 AS chain, event_type AS species, event_id AS row, value FROM events WHERE NOT (user_id % 20 = 3 AND event_id % 3 = 1)),
s AS (SELECT *, row_number() OVER (PARTITION BY complex, chain, species ORDER BY value DESC, row) AS rank, count(*) OVER (PARTITION BY complex, chain, species) AS n FROM r),
f AS (SELECT complex, species, count(DISTINCT chain)::INTEGER AS n_chains, min(n) AS take, max(n) AS most FROM s GROUP BY 1, 2),
p AS (SELECT s.complex, s.species, s.rank::INTEGER AS rank, any_value(n_chains) AS n_chains, list_transform([0, 1, 2], lambda c: coalesce(map_from_entries(list((s.chain, s.row)))[c], -1)) AS rows
  FROM s JOIN f ON f.complex = s.complex AND f.species = s.species WHERE n_chains > 1 AND most <= 600 AND rank <= take GROUP BY 1, 2, 3),
u AS (SELECT * FROM p UNION ALL SELECT DISTINCT complex, '', 0, 3, [0, 0, 0]::BIGINT[] FROM r)
SELECT complex, species, rank, n_chains, rows, row_number() OVER (PARTITION BY complex ORDER BY n_chains DESC, abs(rows[1]::DOUBLE * rows[2] * rows[3]), species, rank) - 1 AS place FROM u"""


@query(PAIRED)
def pair_species_rows(spark, d):
    """Rows of three chains paired by species, in the order of the alignment."""
    e = t(spark, d, "events").select((F.col("user_id") % 20).alias("complex"), (F.col("event_id") % 3).alias("chain"), F.col("event_type").alias("species"), F.col("event_id").alias("row"), "value")
    rows = e.filter("NOT (complex = 3 AND chain = 1)")
    return pairing.order_pairs(pairing.pair_rows(rows, "complex", "chain", "species", "row", [F.desc("value"), F.col("row")], [0, 1, 2]), "complex", "species")


@query("SELECT variant::INTEGER AS variant, count(*) AS n FROM orders, range(3) v(variant) WHERE o_orderkey % 4 > variant GROUP BY 1")
def ensemble_map(spark, d):
    """A curried step over a few variants, as one plan."""
    above = lambda df, least: df.filter(F.col("o_orderkey") % 4 > least)
    steps = lambda df, k: R.pipeline(R.bound(above, k))(df)
    return R.each_variant(t(spark, d, "orders").select("o_orderkey"), steps, 3).groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
