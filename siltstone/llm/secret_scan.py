"""Secret scans with corpus-wide ownership frequency.

Native: only DataFrame and SQL functions. A narrow pass finds candidate spans
in whole texts: for a pattern, the pieces between its matches and the matches
themselves give every span by running sums of lengths, in code points, taken
block by block so that the cost is linear in the matches of a text. The
candidates' value hashes, a few bytes a document, are then counted by owner
and repository over the whole corpus, first within owner and repository so
that a widely copied value is pre-aggregated before it meets in one place.
Values of many owners or repositories are examples; the rest look live. The
few values that make up a thousandth of all spans or more meet their spans by a
broadcast of a thousand rows at most, the others by a shuffle.

Kinds ``assign``, ``access`` and ``hex`` are the base and always stay;
``mixed`` (long tokens of upper, lower case and digits outside base spans) is
added only where it looks live.

Defined results: a null text counts as empty and has no spans; a null owner or
repository counts as one of its own; without columns ``source`` and ``lang``
and without an owner given, all rows have one owner and repository; repeated
rows give repeated results, and count once by owner and repository; very long
texts are taken whole, in memory of a few times their spans; of spans that
start together the kinds go in the order above; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The patterns of the base kinds and the least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
KINDS = ("assign", "access", "hex", "mixed")
MOST_OWNERS = 2
MOST_REPOSITORIES = 5
PLACEHOLDER = "<SECRET>"

SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"
#: Items of an array that are folded together; a fold copies what it has so far.
BLOCK = 256
#: A value of so large a share of all spans is joined by broadcast.
HEAVY_SHARE = 1 / 1000


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def block_of(items: Column, number: Column) -> Column:
    return F.slice(items, number * BLOCK + 1, F.lit(BLOCK))


def blocks(items: Column) -> Column:
    """Numbers of the blocks of ``items``, none for an empty array."""
    count = F.ceil(F.size(items) / F.lit(float(BLOCK))).cast("int")
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def prefixes(items: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each item what ``add`` makes, from 0 on, of the items before it:
    within blocks, from what the blocks before amount to, so that a fold copies
    a block's results at most, or one result a block."""
    whole = lambda some: F.aggregate(some, F.lit(0), add)

    def running(some: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(some, first, step, lambda s: s["out"])

    def by_block(every: Column) -> Column:
        begins = running(F.transform(blocks(every), lambda b: whole(block_of(every, b))), F.lit(0))
        return bind(begins, lambda at: F.flatten(F.transform(blocks(every), lambda b: running(block_of(every, b), F.get(at, b)))))

    return bind(items, by_block)


def spans_of(text: Column, pattern: str, number: int, group: int, least: int) -> Column:
    """Spans of all matches, leftmost first and without overlaps, whose
    ``group`` has at least ``least`` characters."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    between = F.slice(F.split(text, pattern, -1), 1, F.size(match))
    each = F.arrays_zip(between.alias("gap"), match.alias("match"), value.alias("value"))
    sized = F.transform(each, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), x["value"].alias("value")))

    def placed(items: Column) -> Column:
        before = prefixes(F.transform(items, lambda x: x["gap"] + x["size"]), lambda at, x: at + x)
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(number).alias("kind_no"), (at + x["gap"] + x["size"]).alias("end"), F.lit(KINDS[number]).alias("kind"), x["value"].alias("value"))
        return F.filter(F.zip_with(items, before, span), lambda x: F.char_length(x["value"]) >= least)

    return F.when(text.rlike(pattern), bind(sized, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.concat(spans_of(text, ASSIGN, 0, 2, 8), spans_of(text, ACCESS, 1, 0, 16), spans_of(text, HEX, 2, 0, 32))


def mixed_spans(text: Column, base: Column) -> Column:
    """Mixed tokens apart from all base spans. Tokens are held against the base
    spans by blocks: only those that reach into a block's stretch of text."""
    looks = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    found = F.filter(spans_of(text, MIXED, 3, 0, 24), looks)

    def apart(some: Column) -> Column:
        near = F.filter(base, lambda b: (b["end"] > F.get(some, F.lit(0))["start"]) & (b["start"] < F.element_at(some, -1)["end"]))
        return bind(near, lambda n: F.filter(some, lambda s: ~F.exists(n, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    return bind(found, lambda items: F.flatten(F.transform(blocks(items), lambda b: bind(block_of(items, b), apart))))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(row, id, owner, repository, base, mixed): the one pass over texts,
    stored. Values are kept as their hashes only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"))
    found = source.withColumn("base", base_spans(F.col("text"))).withColumn("mixed", mixed_spans(F.col("text"), F.col("base")))
    hashed = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"], F.sha2(s["value"], 256).alias("value")))
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", hashed(F.col("base")).alias("base"), hashed(F.col("mixed")).alias("mixed")), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n_spans) over the whole corpus."""
    values = found.select("owner", "repository", F.explode(F.transform(F.concat("base", "mixed"), lambda s: s["value"])).alias("value"))
    by_repository = values.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("spans"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum("spans").alias("spans"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"), F.sum("spans").alias("n_spans"))


def with_owners(spans: DataFrame, owned: DataFrame) -> DataFrame:
    """``spans`` joined with :func:`ownership`'s stored result. At most
    1 / HEAVY_SHARE values can have that share of all spans; they are broadcast
    and their spans stay where they are."""
    whole = owned.agg(F.sum("n_spans")).first()[0] or 0
    heavy = F.broadcast(owned.filter(F.col("n_spans") > whole * HEAVY_SHARE).select(F.col("value").alias("of"), F.struct("n_owners", "n_repositories").alias("heavy")))
    met = spans.join(heavy, F.col("value") == F.col("of"), "left").drop("of")
    here = met.filter("heavy IS NOT NULL").select(*spans.columns, "heavy.*")
    rest = met.filter("heavy IS NULL").drop("heavy").join(owned.filter(F.col("n_spans") <= whole * HEAVY_SHARE).drop("n_spans"), "value")
    return here.unionByName(rest)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """Columns: ``id_col``, base (array of spans), found (base and added spans,
    each with its hash, owners, repositories and whether it looks live)."""
    known = [F.col(c).cast("string") for c in ("source", "lang") if c in docs.columns and c not in (id_col, text_col)]
    if owner is None:
        owner = known[0] if known else F.lit("")
    repository = F.concat_ws("/", *known) if repository is None else repository
    rows = candidates(docs, id_col, text_col, owner, repository)
    owned = stored(ownership(rows), "owned")
    spans = rows.filter(F.size("base") + F.size("mixed") > 0).select("row", F.explode(F.concat("base", "mixed")).alias("s")).select("row", "s.*")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    judged = with_owners(spans, owned).withColumn("live", live).filter((F.col("kind_no") < 3) | F.col("live"))
    gathered = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind", "value", "n_owners", "n_repositories", "live"))).alias("found"))
    empty = F.array().cast(gathered.schema["found"].dataType)
    return rows.join(gathered, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("found", empty).alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`scan`'s result."""
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        id_col,
        of_kind("assign").alias("n_assign"),
        of_kind("access").alias("n_access"),
        of_kind("hex").alias("n_hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redacted(text: Column, spans: Column, placeholder: str = PLACEHOLDER) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced; block by
    block, each from its own stretch of the text."""

    def written(piece: Column, offset: Column, some: Column) -> Column:
        fresh = lambda s: F.concat(F.substring(piece, s["cover"] - offset + 1, s["start"] - s["cover"]), F.lit(placeholder))
        return F.array_join(F.transform(some, lambda s: F.when(s["start"] >= s["cover"], fresh(s)).otherwise("")), "")

    def block(some: Column) -> Column:
        offset = F.get(some, F.lit(0))["cover"]
        upto = F.array_max(F.transform(some, lambda s: F.greatest(s["end"], s["cover"])))
        return bind(F.substring(text, offset + 1, upto - offset), lambda piece: written(piece, offset, some))

    def whole(items: Column) -> Column:
        # cover: up to where the spans before reach
        cover = prefixes(F.transform(items, lambda s: s["end"]), lambda at, x: F.greatest(at, x))
        covered = F.zip_with(items, cover, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), c.alias("cover")))
        pieces = bind(covered, lambda every: F.transform(blocks(every), lambda b: bind(block_of(every, b), block)))
        last = F.coalesce(F.array_max(F.transform(items, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.greatest(F.char_length(text) - last, F.lit(0))))

    return bind(F.array_sort(spans), whole)


def redact_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **how) -> DataFrame:
    """``docs`` with live-looking secrets replaced in their texts and
    ``size_col`` renewed for the texts that change; same rows and columns.

    Rows without a candidate pass through untouched; the others are stored once
    and meet the corpus-wide counts, so texts in general are not shuffled. A row
    travels as one struct, so its columns may have any names."""
    columns = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    suspicious = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(MIXED)
    clean = docs.filter(~suspicious)
    names = [c for c in ("source", "lang") if c in columns and c not in (id_col, text_col)]
    row, key = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.struct(F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("sha")).alias("key")
    rows = stored(docs.filter(suspicious).select(row, key), "suspicious")
    scanned = scan(rows.select("key", F.col(f"row.`{text_col}`").alias("text"), *[F.col(f"row.{c}").alias(c) for c in names]), "key", "text", **how)
    live = scanned.select(F.col("key").alias("of"), F.filter("found", lambda s: s["live"]).alias("live")).filter(F.size("live") > 0).groupBy("of").agg(F.first("live").alias("live"))
    joined = rows.join(live, F.col("key").eqNullSafe(F.col("of")), "left").withColumn("text", F.when(F.col("live").isNotNull(), redacted(F.col(f"row.`{text_col}`"), F.col("live"))))
    own = lambda c: F.col(f"row.`{c}`")
    new = {text_col: F.coalesce("text", own(text_col))}
    if size_col in columns:
        new[size_col] = F.when(F.col("live").isNotNull(), F.char_length("text").cast("long")).otherwise(own(size_col))
    return clean.unionByName(joined.select(*[new.get(c, own(c)).alias(c) for c in columns]))
