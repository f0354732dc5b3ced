"""Queries of the operators over the driver tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic_ann, embedding_dedup, keyed_upsert, kneser_ney, mixing, secret_scan, sentencepiece_bpe, sharding, simhash, toxicity, url_filter, vector_code, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A vocabulary file by its name; each worker looks up where it is.
MODEL = "piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability and decision of every document."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


#: Labels of rows with this remainder are never learnt.
HELD_OUT = "pmod(crc32(cast({} as string)), 4) = 2"


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), usable=~F.expr(HELD_OUT.format("id")))
    held = F.coalesce(F.expr(HELD_OUT.format("doc_id")), F.lit(False))
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


# The rules (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
# Parts of the urls of the list to block.
SPAM_NAMES, SPAM_PREFIXES, SPAM_TLDS, SPAM_LANGS = ["cheap-pills", "casino-win", "free-bets", "adult-x", "spam-farm"], ["", "www.", "m.", "blog."], ["com", "net", "org"], ["en", "de", "fr", "es"]
#: Article numbers of a host's sections are below it, and every so many of them is listed, from the host's own number on.
SPAM_PAGES, SPAM_STEP = 10_000, 3


def blocklist(spark: SparkSession) -> DataFrame:
    """The list of urls to block: by a rule of its own, from no table. Some of
    its urls are of pages, most are not, and some spam pages are not on it."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    hosts = len(SPAM_NAMES) * len(SPAM_PREFIXES) * len(SPAM_TLDS)
    each = SPAM_PAGES // SPAM_STEP
    n = F.col("id")
    host, lang = F.floor(n / (each * 4)), F.floor(n / each)
    name, prefix, tld = pick(SPAM_NAMES, host), pick(SPAM_PREFIXES, F.floor(host / len(SPAM_NAMES))), pick(SPAM_TLDS, F.floor(host / (len(SPAM_NAMES) * len(SPAM_PREFIXES))))
    number = n % each * SPAM_STEP + host % SPAM_STEP
    return spark.range(hosts * 4 * each).select(F.concat(F.lit("http://"), prefix, name, F.lit(".example."), tld, F.lit("/"), pick(SPAM_LANGS, lang), F.lit("/"), number.cast("string")).alias("url"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_read(spark, sf_dir, "pages"), blocklist(spark), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_read(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(_read(spark, sf_dir, "documents"), MODEL, keep_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: What a change of ``client_changes`` sets, and what orders a client's changes.
CLIENT_VALUES, CLIENT_ORDER = ["source", "segment", "city", "balance"], ["seq", "change_id"]


def _crc(c: Column) -> Column:
    return F.crc32(c.cast("string"))


def client_decision(first: Column, change: Column) -> Column:
    """What a change does in the home whose first client is ``first``."""
    h = F.coalesce(_crc(first), F.lit(0)) % 10
    gone = F.coalesce(change["op"] == "D", F.lit(False)) | F.coalesce(_crc(change["change_id"]) % 8 < h, F.lit(False))
    return F.when(h > 7, "ignore").when(gone, "delete").otherwise("set")


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = _read(spark, sf_dir, "clients"), _read(spark, sf_dir, "client_changes")
    most = 1 + clients.count() // 1500
    folder = keyed_upsert.new_folder(spark, "clients")
    keyed_upsert.write_sorted(clients.filter(_crc(F.col("client_id")) % 7 > 3), "client_id", most, folder)
    winners = keyed_upsert.latest(changes, "client_id", CLIENT_ORDER, ["op", *CLIENT_VALUES])
    files = keyed_upsert.upsert(spark, folder, clients.schema, "client_id", winners, CLIENT_VALUES, most, client_decision)
    text = F.concat_ws("|", *[F.coalesce(F.col(f"row.{c}"), F.lit("")) for c in ("source", "segment", "city")])
    cents = F.coalesce(F.floor(100 * F.col("row.balance") + 0.5), F.lit(0)).cast("long")
    rows = keyed_upsert.rows_of(spark, clients.schema, folder).select("path", "at", F.col("row.client_id").alias("id"), cents.alias("cents"), F.crc32(text).alias("crc"))
    columns = ",".join(spark.read.parquet(folder).columns) if not files.isEmpty() else ""
    found = keyed_upsert.summaries(rows).join(files, "path")
    return found.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(columns).alias("columns"), "path", "rewritten")


def op12_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code.compress(_read(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_mixing, op2_embedding_dedup, op3_quality, op4_toxicity, op5_url_filter, op6_ann, op7_secrets, op8_warc, op9_sentencepiece, op10_simhash, op11_keyed_upsert, op12_vector_code, op13_sharding, pipeline]
    return {f.__name__: f for f in named}
