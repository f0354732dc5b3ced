"""Text formats: fixed-width atoms, molecules, alignments and search hits.

All are native: a line or a whole file is one value, taken apart by string and
array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of every line; large files are split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row a file, carriage returns removed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit("\r"), F.lit("")).alias("text"))


def pdb_serial(serial: Column) -> Column:
    """A serial in the five columns that a PDB line has for it: decimal to
    99,999, then hybrid-36, A0000 to zzzzz, that is to 87,440,031. The query
    fails for others."""
    over, half = serial - 100_000, 26 * 36**4
    digits = lambda x: F.conv((x + 10 * 36**4).cast("string"), 10, 36)
    wrong = F.raise_error(F.concat(F.lit("no PDB serial: "), serial.cast("string"))).cast("string")
    text = F.when(over < 0, F.lpad(serial.cast("string"), 5, " ")).when(over < half, digits(over)).otherwise(F.lower(digits(over - half)))
    return F.when((serial <= -10_000) | (over >= 2 * half), wrong).otherwise(text)


def serial_of(text: Column) -> Column:
    """The number that :func:`pdb_serial` wrote; null where there is none."""
    code = F.conv(text, 36, 10).cast("long") - 10 * 36**4 + 100_000
    return F.when(text.rlike("^[A-Z][0-9A-Z]{4}$"), code).when(text.rlike("^[a-z][0-9a-z]{4}$"), code + 26 * 36**4).otherwise(text.try_cast("int")).cast("int")


def pdb_atoms(rows: DataFrame) -> DataFrame:
    """Atoms of fixed-width ATOM and HETATM lines ``value``."""
    cut = lambda start, size: F.trim(F.substring("value", start, size))
    group = cut(1, 6)
    return rows.filter(group.isin("ATOM", "HETATM")).select(
        "file", group.alias("group"), serial_of(cut(7, 5)).alias("serial"), cut(13, 4).alias("atom"), cut(18, 3).alias("residue"), F.substring("value", 22, 1).alias("chain"),
        cut(23, 4).try_cast("int").alias("seq_id"), cut(27, 1).alias("insertion"), *[cut(31 + 8 * k, 8).try_cast("double").alias(a) for k, a in enumerate("xyz")], cut(77, 2).alias("element"),
    )


def pdb_chains(rows: DataFrame) -> DataFrame:
    """(file, chains): sorted distinct chains of ATOM lines."""
    return pdb_atoms(rows).filter("group = 'ATOM'").groupBy("file").agg(F.array_sort(F.collect_set("chain")).alias("chains"))


def sdf_molecules(files: DataFrame) -> DataFrame:
    """(file, atoms): heavy atoms of the first molecule of V2000 ``text``; null
    where it is malformed or flat (no conformer)."""
    rows = F.split(F.split("text", r"\n?\$\$\$\$")[0], "\n")
    count = F.substring(F.get(rows, F.lit(3)), 1, 3).try_cast("int")
    cut = lambda x, start, size: F.trim(F.substring(x, start, size))
    atom = lambda x: F.struct(*[cut(x, 1 + 10 * k, 10).try_cast("double").alias(a) for k, a in enumerate("xyz")], cut(x, 32, 3).alias("symbol"))
    every = F.transform(F.slice(rows, 5, F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))), atom)
    sound = (F.size(every) == count) & F.forall(every, lambda a: a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull()) & F.exists(every, lambda a: a["z"] != 0)
    return files.select("file", F.when(sound, F.filter(every, lambda a: a["symbol"] != "H")).alias("atoms"))


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def stockholm(files: DataFrame) -> DataFrame:
    """(file, position, name, aligned, deletions) of Stockholm ``text``.

    Blocks are joined by name, names keep the order first seen, and the first is
    the query: columns where it has a gap are removed, and residues that others
    have there are counted before the next kept column."""
    line = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "value")).filter(~F.col("value").rlike(r"^\s*($|#|//)"))
    part = F.split(F.trim("value"), r"\s+")
    named = line.select("file", "line", part[0].alias("name"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("piece"))
    # one name of one file at a time
    rows = named.groupBy("file", "name").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda x: x["piece"]), "").alias("row"))
    query = rows.groupBy("file").agg(F.min_by("row", "line").alias("query"), F.array_sort(F.collect_list("line")).alias("order"))
    pairs = F.arrays_zip(letters(F.col("query")).alias("q"), letters(F.col("row")).alias("r"))
    kept = F.array_join(F.transform(F.filter("pairs", lambda p: p["q"] != "-"), lambda p: F.coalesce(p["r"], F.lit("-"))), "")
    marks = F.array_join(F.transform("pairs", lambda p: F.when(p["q"] != "-", "|").when(p["r"] != "-", "x").otherwise("")), "")
    runs = F.split(marks, r"\|", -1)
    return (
        rows.join(query, "file")
        .withColumn("pairs", pairs)
        .select("file", (F.array_position("order", F.col("line")) - 1).cast("int").alias("position"), "name", kept.alias("aligned"), F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), lambda x: F.length(x)).alias("deletions"))
    )


def residue_indices(sequence: Column, start: Column) -> Column:
    """Zero-based residue number of each letter, -1 for gaps."""
    chars = letters(sequence)
    seen = lambda c, i: F.length(F.replace(F.substring(sequence, F.lit(1), i + 1), F.lit("-"), F.lit("")))
    return F.transform(chars, lambda c, i: F.when(c == "-", F.lit(-1)).otherwise(start + seen(c, i) - 1))


def hhr_hits(files: DataFrame) -> DataFrame:
    """Hits of HHR ``text``: number, name, probability, e-value, aligned
    columns, summed probabilities, both aligned rows and their residue indices."""
    hits = files.select("file", F.explode(F.slice(F.split("text", r"(?:^|\n)No "), 2, 1 << 30)).alias("hit"))
    value = lambda key: F.regexp_extract("hit", key + r"=\s*([^\s%]+)", 1).try_cast("double")
    not_annotation = r"(?m)^{}\s+(?!ss_dssp|ss_pred|ss_conf|Consensus)\S+\s+"
    row = lambda side: F.array_join(F.regexp_extract_all("hit", F.lit(not_annotation.format(side) + r"\d+\s+([A-Z-]+)"), 1), "")
    first = lambda side: F.regexp_extract("hit", not_annotation.format(side) + r"(\d+)\s+[A-Z-]+", 1).try_cast("int") - 1
    found = hits.select(
        "file", F.regexp_extract("hit", r"^(\d+)", 1).try_cast("int").alias("index"), F.regexp_extract("hit", r"\n>([^\n]*)", 1).alias("name"),
        value("Probab").alias("probability"), value("E-value").alias("e_value"), value("Aligned_cols").cast("int").alias("aligned_cols"), value("Sum_probs").alias("sum_probs"),
        row("Q").alias("query"), row("T").alias("hit_sequence"), first("Q").alias("q0"), first("T").alias("t0"),
    )
    return found.withColumn("indices_query", residue_indices(F.col("query"), F.col("q0"))).withColumn("indices_hit", residue_indices(F.col("hit_sequence"), F.col("t0"))).drop("q0", "t0")


def hmm_header(k: int) -> Column:
    """Part ``k`` of a hit's ``header``: id, chain, start, end, length, title."""
    form = r"^>?([A-Za-z0-9]+)_(\w+)/(\d+)-(\d+).*protein length:(\d+) *(.*)$"
    return F.nullif(F.regexp_extract("header", form, k), F.lit(""))


def hmm_columns(start: Column) -> list[Column]:
    return [hmm_header(1).alias("id"), hmm_header(2).alias("chain"), (start + 1).alias("start"), hmm_header(4).cast("int").alias("end"), hmm_header(5).cast("int").alias("length"), hmm_header(6).alias("title")]


def hmmsearch_hits(records: DataFrame) -> DataFrame:
    """Hits of (header, sequence) A3M records whose molecule is a protein.

    A gap is index -1, an inserted (lower-case) letter moves the count on
    without an entry. A header of another form gives a null id."""
    start = hmm_header(3).cast("int") - 1
    before = lambda i: F.length(F.replace(F.substring("sequence", F.lit(1), i + 1), F.lit("-"), F.lit("")))
    marked = F.transform(letters(F.col("sequence")), lambda c, i: F.struct(c.alias("c"), (start + before(i) - 1).alias("n")))
    kept = F.filter(marked, lambda m: ~m["c"].rlike("[a-z]"))
    return records.filter(F.contains("header", F.lit("mol:protein"))).select(
        *hmm_columns(start), F.length(F.regexp_replace("sequence", "[^A-Z]", "")).alias("aligned_cols"), F.transform(kept, lambda m: F.when(m["c"] == "-", F.lit(-1)).otherwise(m["n"])).alias("indices_hit"),
    )


def hmmsearch_stockholm_hits(files: DataFrame) -> DataFrame:
    """As :func:`hmmsearch_hits`, and ``file``, from Stockholm ``text``: the
    description of a row is that of its ``#=GS name DE`` line, and residues at
    the query's gaps are insertions."""
    line = files.select("file", F.explode(F.split("text", "\n")).alias("value"))
    form = r"^#=GS\s+(\S+)\s+DE\s+(.*)$"
    titles = line.filter(F.col("value").rlike(form)).select("file", F.regexp_extract("value", form, 1).alias("name"), F.regexp_extract("value", form, 2).alias("title"))
    rows = stockholm(files).join(titles, ["file", "name"], "left")
    records = rows.select("file", "position", F.concat_ws(" ", "name", "title").alias("header"), F.col("aligned").alias("sequence"), "deletions")
    start = hmm_header(3).cast("int") - 1
    skipped = lambda i: F.aggregate(F.slice("deletions", F.lit(1), i + 1), F.lit(0), lambda s, n: s + n)
    seen = lambda i: F.length(F.replace(F.substring("sequence", F.lit(1), i + 1), F.lit("-"), F.lit("")))
    index = F.transform(letters(F.col("sequence")), lambda c, i: F.when(c == "-", F.lit(-1)).otherwise(start + skipped(i) + seen(i) - 1))
    return records.filter(F.contains("header", F.lit("mol:protein"))).select("file", "position", *hmm_columns(start), F.length(F.regexp_replace("sequence", "[^A-Z]", "")).alias("aligned_cols"), index.alias("indices_hit"))


def tblout_e_values(rows: DataFrame) -> DataFrame:
    """(name, e_value) of tblout lines (line, value): the last line of a name
    counts; ``query`` has 0."""
    part = F.split(F.trim("value"), r"\s+")
    hits = rows.filter(~F.col("value").rlike(r"^\s*(#|$)")).select("line", part[0].alias("name"), F.get(part, F.lit(4)).try_cast("double").alias("e_value"))
    last = hits.groupBy("name").agg(F.max_by("e_value", "line").alias("e_value"))
    return last.filter("name <> 'query'").unionByName(rows.sparkSession.createDataFrame([("query", 0.0)], "name string, e_value double"))


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, description, sequence) of FASTA files. A record is what lies
    between two lines that begin with ``>``, so files of any size are split.
    Sequence lines are trimmed and joined, blank ones skipped, and so are
    records that are blank altogether. A file's first line that is not blank is
    a header, with or without its mark."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit("\r"), F.lit("")).alias("value"))
    # only the first record of a file still has its mark
    body = F.regexp_replace("value", r"^>", "")
    rows = rows.filter(F.trim(F.regexp_replace(body, r"\s", "")) != "")
    line = F.split(body, "\n")
    rest = F.transform(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda x: F.trim(x))
    return rows.select("file", F.trim(F.get(line, F.lit(0))).alias("description"), F.array_join(rest, "").alias("sequence"))


def proteinnet_residues(files: DataFrame) -> DataFrame:
    """(file, index, residue, known, n, ca, c) of ProteinNet ``text``: the
    backbone points of each residue in Angstrom (the text has picometres).
    Letters other than the twenty become X; without a mask every residue counts
    as known."""
    section = lambda tag: F.regexp_extract("text", rf"(?s)(?:^|\n)\[{tag}\]\n(.*?)(?:\n\[[A-Z]+\]|$)", 1)
    first_line = lambda s: F.trim(F.split(s, "\n")[0])
    axes = F.transform(F.slice(F.split(section("TERTIARY"), "\n"), 1, 3), lambda row: F.transform(F.filter(F.split(row, r"\s+"), lambda x: x != ""), lambda x: x.cast("double") / 100))
    rows = files.select("file", letters(first_line(section("PRIMARY"))).alias("residues"), letters(first_line(section("MASK"))).alias("mask"), axes.alias("axes"))
    each = rows.select("file", "mask", "axes", F.posexplode("residues").alias("index", "residue"))
    at = lambda k: F.transform("axes", lambda axis: F.get(axis, F.col("index") * 3 + k))
    known = F.coalesce(F.get("mask", F.col("index")) == "+", F.lit(True))
    return each.select("file", "index", F.when(F.col("residue").rlike("^[ARNDCQEGHILKMFPSTWYV]$"), F.col("residue")).otherwise("X").alias("residue"), known.alias("known"), at(0).alias("n"), at(1).alias("ca"), at(2).alias("c"))


def mol2_molecules(files: DataFrame) -> DataFrame:
    """(file, atoms): heavy atoms of the first molecule of MOL2 ``text``; null
    where it is malformed or flat. The element is the atom type's part before
    the dot."""
    block = F.regexp_extract("text", r"(?s)@<TRIPOS>ATOM\n(.*?)(?:\n?@<TRIPOS>|$)", 1)
    part = F.transform(F.filter(F.split(block, "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(F.trim(x), r"\s+"))
    number = lambda p, k: F.get(p, F.lit(k)).try_cast("double")
    atom = lambda p: F.struct(*[number(p, 2 + k).alias(a) for k, a in enumerate("xyz")], F.split(F.coalesce(F.get(p, F.lit(5)), F.lit("")), r"\.")[0].alias("symbol"))
    every = F.transform(part, atom)
    sound = (F.size(every) > 0) & F.forall(every, lambda a: a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull() & (a["symbol"] != "")) & F.exists(every, lambda a: a["z"] != 0)
    return files.select("file", F.when(sound, F.filter(every, lambda a: a["symbol"] != "H")).alias("atoms"))


def molecules(mol2: DataFrame, sdf: DataFrame, key: Column) -> DataFrame:
    """(molecule, atoms): from the MOL2 file, from the SDF file where that is
    absent or malformed. ``key`` names the molecule of a ``file``."""
    a = mol2_molecules(mol2).select(key.alias("molecule"), F.col("atoms").alias("first"))
    b = sdf_molecules(sdf).select(key.alias("molecule"), F.col("atoms").alias("second"))
    return a.join(b, "molecule", "full").select("molecule", F.coalesce("first", "second").alias("atoms"))
