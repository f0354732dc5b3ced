"""Queries on chains: clusters, draws, symmetries, templates, alignments, crops,
clashes, motions and errors. Vectors stand in for coordinates and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignments as A
from ..operators import clashes, cropping, deviation, motion, patterns, sampling, similarity, symmetry
from ..operators.sidechain import RESIDUE_ATOMS, bonds_of
from ..operators.structure import ATOM_SLOTS
from .registry import query, table as t

WIDTH = 64


def vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def number(k):
    """Component k of ``e``, from 0, round the vector's end."""
    return F.get("e", F.lit(k % WIDTH))


def point(k, scale=10.0):
    return F.array(*[number(3 * k + i) * F.lit(scale) for i in range(3)])


# 2.12.3, 2.10.7
@query()
def identity_clusters(spark, d):
    """Components as letters of twenty bins, by identity 0.5 and coverage 0.8,
    with seeds of six letters; held against a plain programme in the tests."""
    level = lambda x: F.least(F.greatest(F.floor((x + 0.5) * 20), F.lit(0)), F.lit(19)).cast("int") + 1
    seq = F.array_join(F.transform("e", lambda x: F.substring(F.lit(similarity.LETTERS), level(x), F.lit(1))), "")
    return similarity.cluster_by_identity(vectors(spark, d).select("vec_id", seq.alias("seq")), "vec_id", "seq", identity=0.5, patterns=("1110111", "11011011", "110101101"), shared=5)


@query()
def chain_dedup(spark, d):
    """Vectors as chains of 21 points; held against a plain score in the tests."""
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.transform(F.slice("e", 3 * k + 1, F.lit(3)), lambda x: x * 20))
    return similarity.longest_of_similar(vectors(spark, d).select("vec_id", points.alias("points")), "vec_id", "points", cuts=((4.6, 6.6), (4.6, 6.6)), shared=6)


# 2.11.7
@query("""WITH w AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS units FROM orders WHERE round(o_totalprice * 100) > 0), p AS (SELECT o_orderkey, (sum(units) OVER (ORDER BY o_orderkey) - units)::BIGINT AS at FROM w),
d AS (SELECT i AS draw, ('0x' || substr(md5('draw:7:3:' || i), 1, 15))::BIGINT % (SELECT sum(units)::BIGINT FROM w) AS at FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i))
SELECT draw, draw % 4 AS replica, draw // 4 AS step, o_orderkey FROM d ASOF JOIN p ON d.at >= p.at""")
def draw_with_replacement(spark, d):
    """As many draws as orders, by price, dealt to four replicas."""
    o = t(spark, d, "orders")
    return sampling.draw_with_replacement(o, "o_orderkey", F.col("o_totalprice"), o.count(), seed=7, epoch=3, replicas=4, scale=100.0)


# 2.12.6
def orders_sql():
    rows = [f"({i}, {n}, {order})" for i, orders in enumerate(symmetry.residue_symmetries().values()) for n, order in enumerate(orders)]
    return ", ".join(rows)


SLOTS14 = "list_transform(range(14), lambda k: list_transform([0, 1, 2], lambda i: embedding[(3 * k + i + {}) % 64 + 1]::DOUBLE))"


@query(f"""WITH o(residue, number, list) AS (VALUES {orders_sql()}), v AS (SELECT vec_id, vec_id % 20 AS residue, {SLOTS14.format(0)} AS p, {SLOTS14.format(5)} AS q FROM embeddings),
r AS (SELECT vec_id, number, list, sqrt(list_avg(list_transform(list, lambda k, i: (p[i][1] - q[k + 1][1]) ** 2 + (p[i][2] - q[k + 1][2]) ** 2 + (p[i][3] - q[k + 1][3]) ** 2))) AS rmsd FROM v JOIN o USING (residue))
SELECT vec_id, arg_min(number, (rmsd, number))::INTEGER AS number, round(min(rmsd), 6) AS rmsd, round(min(rmsd) FILTER (WHERE number = 0), 6) AS before FROM r GROUP BY 1""")
def residue_permutation(spark, d):
    """The order of a residue's symmetric atoms of least deviation."""
    names = F.array(*map(F.lit, RESIDUE_ATOMS))
    v = vectors(spark, d).select("vec_id", F.get(names, (F.col("vec_id") % 20).cast("int")).alias("residue"), F.array(*[point(k, 1.0) for k in range(14)]).alias("p"), F.array(*[F.array(*[number(3 * k + i + 5) for i in range(3)]) for k in range(14)]).alias("q"))
    best = symmetry.with_best_order(v, "residue", "p", "q", symmetry.symmetry_table(spark))
    return best.select("vec_id", "best.number", F.round("best.rmsd", 6).alias("rmsd"), F.round("best.before", 6).alias("before"))


# 2.13.10
SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query(f"""WITH c AS (SELECT conv_id AS entry, turn AS number, {SEQ} AS seq FROM conversations), s AS (SELECT entry, number AS template, (number + conv_id_shift) % 3 AS named, seq, 1 + (length(seq) * 3) // 7 AS spot FROM (SELECT *, entry % 2 AS conv_id_shift FROM c)),
p AS (SELECT entry, template, named, CASE template % 3 WHEN 0 THEN cut WHEN 1 THEN substr(cut, 1, 4) || 'X' || substr(cut, 6) ELSE 'QZ' || cut END AS pattern FROM (SELECT *, substr(seq, spot, 18) AS cut FROM s)),
m AS (SELECT p.*, c.number, c.seq, regexp_replace(replace(pattern, 'X', '.'), '([A-WYZ])', '(?:\\1|X)', 'g') AS loose FROM p JOIN c USING (entry) WHERE c.seq <> ''),
h AS (SELECT entry, template, number, CASE WHEN contains(seq, pattern) THEN position(pattern IN seq) - 1 ELSE length(regexp_extract(seq, '^(.*?)' || loose, 1)) END AS place,
  CASE WHEN contains(seq, pattern) AND number = named THEN 0 WHEN contains(seq, pattern) THEN 1 ELSE 2 END AS rank FROM m WHERE contains(seq, pattern) OR regexp_matches(seq, loose))
SELECT p.entry, p.template, b.b.number AS chain, b.b.place::INTEGER AS place, CASE b.b.rank WHEN 0 THEN 'exact' WHEN 1 THEN 'sequence' WHEN 2 THEN 'wildcard' END AS how FROM p LEFT JOIN (SELECT entry, template, min({{'rank': rank, 'number': number, 'place': place}}) AS b FROM h GROUP BY 1, 2) b USING (entry, template)""")
def template_search(spark, d):
    """Cuts of turns, some with a wildcard or spoilt, sought in the turns of
    their conversation; the named chain is often another."""
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("entry"), F.col("turn").alias("number"), F.col("turn").alias("chain"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
    at = F.expr("1 + (length(seq) * 3) div 7")
    cut = F.substring(F.col("seq"), at.cast("int"), F.lit(18))
    kind = F.col("number") % 3
    pattern = F.when(kind == 0, cut).when(kind == 1, F.concat(F.substring(cut, 1, 4), F.lit("X"), F.substring(cut, 6, 99))).otherwise(F.concat(F.lit("QZ"), cut))
    made = c.select("entry", F.col("number").alias("template"), ((F.col("number") + F.col("entry") % 2) % 3).alias("chain"), pattern.alias("pattern"))
    return patterns.find_templates(made, c)


# 2.10.6, 2.15.4
ROWS = "SELECT vec_id // 8 AS alignment, (vec_id % 8)::INTEGER AS row, 'n' || (vec_id % 5) AS name, array_to_string(list_transform(embedding[1:{0}], lambda x: CASE WHEN x > {1} THEN 'A' WHEN x < -{1} THEN 'C' ELSE '-' END), '') AS seq FROM embeddings"


def alignment_rows(spark, d, places, least):
    # components are single precision, and so is the bound: one stored as 0.15 is not above it
    letter = lambda x: F.when(x > F.lit(least).cast("float"), "A").when(x < F.lit(-least).cast("float"), "C").otherwise("-")
    return t(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("alignment"), (F.col("vec_id") % 8).cast("int").alias("row"), F.concat(F.lit("n"), (F.col("vec_id") % 5).cast("string")).alias("name"), F.array_join(F.transform(F.slice("embedding", 1, places), letter), "").alias("seq")
    )


@query(f"""WITH a AS ({ROWS.format(4, 0.08)}), q AS (SELECT alignment, arg_min(seq, row) AS query FROM a GROUP BY 1), k AS (SELECT a.*, array_to_string(list_transform(list_filter(range(1, 5), lambda i: query[i] <> '-'), lambda i: seq[i]), '') AS key FROM a JOIN q USING (alignment))
SELECT alignment, row, name, seq FROM k QUALIFY row_number() OVER (PARTITION BY alignment, key ORDER BY row) = 1""")
def alignment_copies(spark, d):
    return A.without_copies(alignment_rows(spark, d, 4, 0.08))


@query(f"""WITH a AS ({ROWS.format(64, 0.15)}), e AS (SELECT alignment, i FROM a, range(1, 65) r(i) GROUP BY 1, 2 HAVING bool_or(seq[i] <> '-'))
SELECT alignment, row, name, coalesce(string_agg(seq[i], '' ORDER BY i) FILTER (WHERE i IS NOT NULL), '') AS seq FROM a LEFT JOIN e USING (alignment) GROUP BY 1, 2, 3""")
def alignment_columns(spark, d):
    return A.without_empty_columns(alignment_rows(spark, d, 64, 0.15))


@query(f"""WITH a AS ({ROWS.format(4, 0.08)}), f AS (SELECT alignment, name, row_number() OVER (PARTITION BY alignment ORDER BY min(row), name) AS rank FROM a GROUP BY 1, 2)
SELECT a.* FROM a JOIN f USING (alignment, name) WHERE rank <= 3""")
def alignment_first(spark, d):
    return A.first_rows(alignment_rows(spark, d, 4, 0.08), 3)


CHAINS = """SELECT vec_id // 16 AS complex, (vec_id // 4) % 4 AS number, CASE WHEN (vec_id // 4) % 4 < 2 THEN 'prot' ELSE 'rna' END AS kind, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) - 1 AS row,
list_transform(embedding[1:4 + 3 * ((vec_id // 4) % 4)], lambda x: CASE WHEN x > 0 THEN 'A' ELSE 'C' END) AS s FROM embeddings WHERE embedding[5] > 0"""
HEIGHTS = {"dense_max": "most", "dense_min": "fewest", "sparse": "total"}


def merge_sql(how):
    at = "g.at - c.below" if how == "sparse" else "g.at"
    return f"""WITH r AS ({CHAINS}), c AS (SELECT *, max(n) OVER w AS most, min(n) OVER w AS fewest, (sum(n) OVER w)::BIGINT AS total, coalesce(sum(n) OVER (PARTITION BY complex ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below
FROM (SELECT complex, number, kind, count(*) AS n, max(len(s)) AS width FROM r GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY complex)),
g AS (SELECT complex, number, unnest(range({HEIGHTS[how]})) AS at FROM c)
SELECT g.complex, g.at AS row, string_agg(coalesce(array_to_string(r.s, ''), repeat(CASE c.kind WHEN 'prot' THEN '-' ELSE '.' END, c.width)), '' ORDER BY g.number) AS seq,
flatten(list(coalesce(list_transform(r.s, lambda x: 1), list_transform(range(c.width), lambda i: 0)) ORDER BY g.number)) AS mask
FROM g JOIN c USING (complex, number) LEFT JOIN r ON r.complex = g.complex AND r.number = g.number AND r.row = {at} GROUP BY 1, 2"""


def merged_chains(spark, d, how):
    from pyspark.sql import Window

    v = vectors(spark, d).filter(number(4) > 0)
    chain = F.floor(F.col("vec_id") / 4)
    own = chain % 4
    rows = v.select(F.floor(F.col("vec_id") / 16).alias("complex"), own.alias("number"), F.when(own < 2, "prot").otherwise("rna").alias("kind"), (F.row_number().over(Window.partitionBy(chain).orderBy("vec_id")) - 1).cast("long").alias("row"), F.transform(F.slice("e", F.lit(1), (4 + 3 * own).cast("int")), lambda x: F.when(x > 0, "A").otherwise("C")).alias("s"))
    rows = rows.select("complex", "number", "kind", "row", F.array_join("s", "").alias("seq"), F.transform("s", lambda x: F.lit(1)).alias("mask"))
    return A.merged(rows, how, {"prot": "-", "rna": "."}, {"mask": "0"})


@query(merge_sql("dense_max"))
def merge_padded(spark, d):
    return merged_chains(spark, d, "dense_max")


@query(merge_sql("dense_min"))
def merge_cut(spark, d):
    return merged_chains(spark, d, "dense_min")


@query(merge_sql("sparse"))
def merge_sparse(spark, d):
    return merged_chains(spark, d, "sparse")


# 2.9.4, 2.5.6
TOKENS = """SELECT vec_id // {0} AS structure, (vec_id % {0})::INTEGER AS token, (vec_id % {0}) // {1} AS {2}, (vec_id % {0}) // 3 AS residue, (vec_id % {0}) < 8 AS core,
CASE WHEN embedding[9] < 0.15 THEN embedding[1]::DOUBLE * 10 END AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings"""
AWAY = "sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2)"
PICK = "('0x' || substr(md5('{0}' || structure || ':' || token), 1, 8))::BIGINT"


def token_rows(spark, d, size, each, name):
    inside = (F.col("vec_id") % size).cast("int")
    return vectors(spark, d).select(
        F.floor(F.col("vec_id") / size).alias("structure"), inside.alias("token"), F.floor(inside / each).alias(name), F.floor(inside / 3).alias("residue"), (inside < 8).alias("core"),
        F.when(number(8) < F.lit(0.15).cast("float").cast("double"), number(0) * 10).alias("x"), (number(1) * 10).alias("y"), (number(2) * 10).alias("z"),
    )


def interface_sql(name, radius):
    return f"i AS (SELECT DISTINCT a.* FROM t a JOIN t b ON a.structure = b.structure AND a.{name} <> b.{name} AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < {radius})"


@query(f"""WITH t AS ({TOKENS.format(64, 16, 'chain')}), {interface_sql('chain', 0.6)},
o AS (SELECT structure, token, x, y, z, 0 AS kind FROM i UNION ALL SELECT structure, token, x, y, z, 1 FROM t WHERE x IS NOT NULL),
c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY structure ORDER BY kind, {PICK.format('crop')}, token) = 1),
r AS (SELECT p.*, c.token AS centre, row_number() OVER (PARTITION BY p.structure ORDER BY coalesce({AWAY}, 'inf'::DOUBLE) + p.token * 1e-3, p.token) AS rank FROM t p JOIN c ON p.structure = c.structure),
n AS (SELECT structure, residue, count(*) FILTER (WHERE rank <= 24) AS have, count(*) AS n FROM r GROUP BY 1, 2)
SELECT r.structure, r.token, r.chain, r.residue, centre FROM r JOIN n USING (structure, residue) WHERE rank <= 24 AND NOT (chain >= 2 AND have < n)""")
def crop_around_interface(spark, d):
    """24 tokens about an interface; residues of two chains only whole."""
    crop = cropping.spatial_crop(token_rows(spark, d, 64, 16, "chain"), 24, "crop", radius=0.6, whole=F.col("chain") >= 2)
    return crop.select("structure", "token", "chain", "residue", "centre")


@query(f"""WITH t AS ({TOKENS.format(128, 4, 'molecule')}), {interface_sql('molecule', 1.0)}, m AS (SELECT structure, molecule, count(*) AS n, bool_or(core) AS core FROM t GROUP BY 1, 2),
l AS (SELECT structure FROM m GROUP BY 1 HAVING count(*) > 20), c AS (SELECT * FROM i WHERE core QUALIFY row_number() OVER (PARTITION BY structure ORDER BY {PICK.format('near')}, token) = 1),
w AS (SELECT p.structure, p.molecule, min({AWAY}) AS away FROM t p JOIN c ON p.structure = c.structure WHERE p.x IS NOT NULL GROUP BY 1, 2),
r AS (SELECT structure, molecule, away, row_number() OVER o AS rank, (sum(n) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM m SEMI JOIN l USING (structure) LEFT JOIN w USING (structure, molecule) WINDOW o AS (PARTITION BY structure ORDER BY core DESC, away NULLS LAST, molecule))
SELECT structure, molecule, rank::INTEGER AS rank, running, away IS NOT NULL AND (rank <= 20 OR running <= 96) AS kept FROM r""")
def nearest_chains(spark, d):
    """Of 32 molecules a structure the core, the nearest 20, and more up to 96 tokens."""
    return cropping.nearest_chains(token_rows(spark, d, 128, 4, "molecule"), "near", most_tokens=96, radius=1.0, core="core")


# 2.14.14
ELEMENTS = ["C", "N", "O", "S"]


@query(f"""WITH a AS (SELECT vec_id // 50 AS structure, (vec_id % 50) // 10 AS chain, CASE WHEN (vec_id % 50) // 10 = 4 THEN 'lig' ELSE 'prot' END AS kind, CASE WHEN (vec_id % 50) // 10 IN (0, 4) THEN 0 ELSE 1 + (vec_id % 50) // 10 END AS molecule,
[{', '.join(str(clashes.RADII[e]) for e in ELEMENTS)}][1 + vec_id % 4]::DOUBLE AS radius, embedding[1]::DOUBLE * 9 AS x, embedding[2]::DOUBLE * 9 AS y, embedding[3]::DOUBLE * 9 AS z FROM embeddings),
p AS (SELECT a.structure, a.chain AS i, b.chain AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist, a.radius + b.radius AS sum, (a.kind = 'lig')::INTEGER + (b.kind = 'lig')::INTEGER AS ligands, a.molecule = b.molecule AS bonded
  FROM a JOIN a b ON a.structure = b.structure AND a.chain < b.chain),
h AS (SELECT structure, i, j, dist / sum < 0.75 AND NOT (ligands = 1 AND bonded) AS vdw, dist < 1.1 AND ligands = 0 AS close, dist / sum AS ratio FROM p),
n AS (SELECT structure, chain, count(*) AS n FROM a GROUP BY 1, 2),
g AS (SELECT structure, i, j, count(*) FILTER (WHERE vdw) AS vdw_pairs, round(min(ratio) FILTER (WHERE vdw), 6) AS nearest, count(*) FILTER (WHERE close) AS close_pairs FROM h WHERE vdw OR close GROUP BY 1, 2, 3)
SELECT g.*, vdw_pairs > 0 AS vdw_clash, round(close_pairs / least(m.n, o.n), 6) AS close_share, close_pairs > 100 OR close_pairs / least(m.n, o.n) > 0.5 AS close_clash
FROM g JOIN n m ON m.structure = g.structure AND m.chain = g.i JOIN n o ON o.structure = g.structure AND o.chain = g.j""")
def radius_clashes(spark, d):
    """Clashing chains by radii and by distance, with a ligand bonded to one."""
    inside = F.col("vec_id") % 50
    chain = F.floor(inside / 10)
    atoms = vectors(spark, d).select(
        F.floor(F.col("vec_id") / 50).alias("structure"), chain.alias("chain"), F.when(chain == 4, "lig").otherwise("prot").alias("kind"), F.when(chain.isin(0, 4), F.lit(0)).otherwise(chain + 1).alias("molecule"),
        F.get(F.array(*map(F.lit, ELEMENTS)), (F.col("vec_id") % 4).cast("int")).alias("element"), *[(number(k) * 9).alias(a) for k, a in enumerate("xyz")],
    )
    return clashes.chain_clashes(atoms).withColumns({c: F.round(c, 6) for c in ("nearest", "close_share")})


# 2.14.7, 2.14.4
def uniform_sql(seed):
    return f"(('0x' || substr(md5('{seed}' || vec_id), 1, 8))::BIGINT / 4294967296.0)"


def normal_sql(seed):
    return f"(sqrt(-2 * ln(greatest({uniform_sql(seed + 'a:')}, 1e-12))) * cos(2 * pi() * {uniform_sql(seed + 'b:')}))"


@query(f"""WITH q AS (SELECT vec_id, embedding, [{', '.join(normal_sql(f'm{k}') for k in range(4))}] AS q, [{', '.join(normal_sql(f'ms{k}') + ' * 2.0' for k in range(3))}] AS shift FROM embeddings),
u AS (SELECT *, list_transform(q, lambda v: v / sqrt(list_dot_product(q, q))) AS n FROM q), c AS (SELECT *, list_transform([1, 2, 3], lambda i: (embedding[i]::DOUBLE + embedding[i + 3]::DOUBLE) / 2) AS mid FROM u),
m AS (SELECT *, [1 - 2 * (n[3] ** 2 + n[4] ** 2), 2 * (n[2] * n[3] - n[1] * n[4]), 2 * (n[2] * n[4] + n[1] * n[3]), 2 * (n[2] * n[3] + n[1] * n[4]), 1 - 2 * (n[2] ** 2 + n[4] ** 2), 2 * (n[3] * n[4] - n[1] * n[2]), 2 * (n[2] * n[4] - n[1] * n[3]), 2 * (n[3] * n[4] + n[1] * n[2]), 1 - 2 * (n[2] ** 2 + n[3] ** 2)] AS r FROM c)
SELECT vec_id, list_transform(range(6), lambda k: round(shift[k % 3 + 1] + list_dot_product(r[3 * (k % 3) + 1:3 * (k % 3) + 3], list_transform([1, 2, 3], lambda i: embedding[3 * (k // 3) + i]::DOUBLE - mid[i])), 6)) AS points FROM m""")
def rigid_motion(spark, d):
    """Two points turned about their middle and shifted, by hashes of the id."""
    v = vectors(spark, d).select("vec_id", F.array(point(0, 1.0), point(1, 1.0)).alias("points"))
    return motion.random_motion(v, "vec_id", "points", "m", 2.0).select("vec_id", F.transform(F.flatten("points"), lambda x: F.round(x, 6)).alias("points"))


def minus_sql(a, b):
    return "[" + ", ".join(f"embedding[{3 * a + i}]::DOUBLE - embedding[{3 * b + i}]::DOUBLE" for i in (1, 2, 3)) + "]"


@query(f"""WITH a AS (SELECT vec_id, {minus_sql(0, 1)} AS u, {minus_sql(2, 1)} AS v, {minus_sql(3, 1)} AS y FROM embeddings), b AS (SELECT *, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS e FROM a),
c AS (SELECT *, list_transform([1, 2, 3], lambda i: v[i] - e[i] * list_dot_product(e, v)) AS w FROM b), f AS (SELECT *, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS g FROM c),
l AS (SELECT vec_id, [list_dot_product(e, y), list_dot_product(g, y), list_dot_product([e[2] * g[3] - e[3] * g[2], e[3] * g[1] - e[1] * g[3], e[1] * g[2] - e[2] * g[1]], y)] AS p FROM f),
s AS (SELECT *, sqrt(p[1] ** 2 + p[2] ** 2 + 1e-8) AS flat, sqrt(list_dot_product(p, p)) + 1e-8 AS size FROM l)
SELECT vec_id, list_transform([p[1] / flat, p[2] / flat, flat / size, p[3] / size], lambda x: round(x, 6)) AS angles FROM s""")
def frame_angles(spark, d):
    """Azimuth and elevation of a fourth point in the frame of three."""
    four = motion.local_angles(point(0, 1.0), point(1, 1.0), point(2, 1.0), point(3, 1.0))
    return vectors(spark, d).select("vec_id", F.transform(four, lambda x: F.round(x, 6)).alias("angles"))


# 2.17.4
def slots_of(shift):
    return F.array(*[F.array(*[number(3 * k + i + shift) * 10 for i in range(3)]) for k in range(len(ATOM_SLOTS))])


def residues(spark, d):
    names = F.array(*map(F.lit, RESIDUE_ATOMS))
    return vectors(spark, d).select("vec_id", "label", F.get(names, (F.col("vec_id") % 20).cast("int")).alias("residue"), slots_of(0).alias("p"), slots_of(5).alias("q"))


def bonds_sql():
    rows = []
    for n, (residue, names) in enumerate(RESIDUE_ATOMS.items()):
        atoms = names.split()
        pairs = [*symmetry.BACKBONE, *[(a, b) for a, b, _ in bonds_of(residue)], *([("CD", "N")] if residue == "PRO" else [])]
        rows += [f"({n}, {ATOM_SLOTS.index(a)}, {ATOM_SLOTS.index(b)})" for a, b in pairs if a in atoms and b in atoms]
    return ", ".join(rows)


def swaps_sql():
    """(residue, slot, slot that takes its place)."""
    rows = []
    for n, residue in enumerate(RESIDUE_ATOMS):
        for pair in deviation.SWAPS.get(residue, "").split():
            a, b = (ATOM_SLOTS.index(x) for x in pair.split("-"))
            rows += [f"({n}, {a}, {b})", f"({n}, {b}, {a})"]
    return ", ".join(rows)


AT = "embedding[(3 * {0} + i + {1}) % 64 + 1]::DOUBLE * 10"
SQUARE = "list_sum(list_transform([0, 1, 2], lambda i: ({} - {}) ** 2))"


@query(f"""WITH b(residue, a, b) AS (VALUES {bonds_sql()}), w(residue, slot, other) AS (VALUES {swaps_sql()}), v AS (SELECT vec_id, vec_id % 20 AS residue, embedding FROM embeddings),
m AS (SELECT vec_id, avg((sqrt({SQUARE.format(AT.format('a', 0), AT.format('b', 0))}) - sqrt({SQUARE.format(AT.format('a', 5), AT.format('b', 5))})) ** 2) AS bond_mse FROM v JOIN b USING (residue) GROUP BY 1),
s AS (SELECT vec_id, residue, embedding, unnest(range(37)) AS k FROM v),
r AS (SELECT vec_id, sqrt(avg({SQUARE.format(AT.format('k', 0), AT.format('k', 5))})) AS plain, sqrt(avg({SQUARE.format(AT.format('coalesce(other, k)', 0), AT.format('k', 5))})) AS other FROM s LEFT JOIN w ON w.residue = s.residue AND w.slot = k GROUP BY 1)
SELECT vec_id, round(bond_mse, 6) AS bond_mse, round(least(plain, other), 6) AS rmsd FROM m JOIN r USING (vec_id)""")
def residue_errors(spark, d):
    """Bonds and deviation of residues with 37 slots, symmetric atoms swapped."""
    scored = deviation.residue_errors(residues(spark, d), "residue", "p", "q")
    return scored.select("vec_id", F.round("bond_mse", 6).alias("bond_mse"), F.round("rmsd", 6).alias("rmsd"))


@query()
def chi_errors(spark, d):
    """Mean errors a structure, side-chain angles included; plain in the tests."""
    return deviation.mean_errors(deviation.residue_errors(residues(spark, d), "residue", "p", "q"), ["label"])
