"""Column builders shared by operators and queries; all JVM-side."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(key: Column, seed: str = "") -> Column:
    """First 32 bits of md5(seed || key) as a bigint: a draw that any engine,
    and any partitioning, repeats."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed: str = "") -> Column:
    return hash_int(key, seed) / F.lit(4294967296.0)


def pair_key(a: Column, b: Column, sep: str = "_", missing: str = "") -> Column:
    """Unordered key of two values; nulls are spelled ``missing``."""
    return F.array_join(F.array_sort(F.array(F.coalesce(a.cast("string"), F.lit(missing)), F.coalesce(b.cast("string"), F.lit(missing)))), sep)


def case_ladder(*steps: tuple[Column, str], default: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = reduce(lambda c, s: c.when(s[0], s[1]), steps[1:], F.when(*steps[0]))
    return out if default is None else out.otherwise(default)


def first_number(*texts: Column, positive: bool = True) -> Column:
    """First text that reads as a number, above zero if ``positive``."""
    read = [t.try_cast("double") for t in texts]
    return F.coalesce(*[F.when(x > 0, x) if positive else F.when(x != 0, x) for x in read])


def strip_lowercase(s: Column) -> Column:
    """An A3M row without its insertions."""
    return F.regexp_replace(s, "[a-z]", "")


def deletion_counts(s: Column) -> Column:
    """Lower-case letters before each aligned column of an A3M row."""
    return F.transform(F.filter(F.split(s, "(?<=[^a-z])"), lambda x: x.rlike("[^a-z]$")), lambda x: F.length(x) - 1)


def base26(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA: bijective base 26, for n up to 18,278."""
    letter = lambda x: F.chr(x + 65)
    one = letter((n - 1) % 26)
    two = F.when(n > 26, letter(F.floor((n - 27) / 26) % 26)).otherwise("")
    three = F.when(n > 702, letter(F.floor((n - 703) / 676) % 26)).otherwise("")
    return F.concat(three, two, one)


def char_map(s: Column, table: dict[str, str], default: str) -> Column:
    """Each character by ``table``, else ``default``."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(default))), "")


def squared_distance(a: Column, b: Column) -> Column:
    zipped = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rbf(d: Column, low: float = 2.0, high: float = 22.0, bins: int = 16) -> Column:
    """Gaussians at evenly spaced centres, as wide as their spacing by bins."""
    sigma = (high - low) / bins
    step = (high - low) / (bins - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.exp(-F.pow((d - (F.lit(low) + i * F.lit(step))) / F.lit(sigma), F.lit(2.0))))


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many places, halves away from zero. What rounds to zero keeps
    its sign, as in IEEE 754; Spark's own rounding goes by decimals and loses it."""
    return F.round(F.abs(x), places) * F.signum(x)


def angle_error(a: Column, b: Column) -> Column:
    """Distance of two angles in radians, at most pi."""
    d = F.abs(a - b)
    return F.least(d, F.abs(d - F.lit(2 * math.pi)))


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == i).cast("int"))


def softmax_expect(logits: Column, low: float, high: float) -> Column:
    """Mean bin centre under the softmax of ``logits``."""
    x = F.transform(logits, lambda v: v.cast("double"))
    n = F.size(x)
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    width = (F.lit(high) - F.lit(low)) / n
    top = F.aggregate(F.transform(e, lambda v, i: v * (F.lit(low) + (i + 0.5) * width)), F.lit(0.0), lambda s, v: s + v)
    return top / F.aggregate(e, F.lit(0.0), lambda s, v: s + v)


def bins_below(x: Column, low: float, high: float, count: int) -> Column:
    """Boundaries strictly below ``x``: its bin."""
    step = (high - low) / (count - 1)
    edges = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(low) + i * F.lit(step))
    return F.size(F.filter(edges, lambda b: x > b))


def pad_to(a: Column, size: Column, fill: Column) -> Column:
    return F.concat(a, F.array_repeat(fill, F.greatest(size - F.size(a), F.lit(0))))


def is_permutation(p: Column) -> Column:
    return F.coalesce((F.size(p) > 0) & (F.array_sort(p) == F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)))), F.lit(False))


def list_literal(s: Column, kind: str = "array<int>") -> Column:
    """An array from a printed Python list; never evaluated."""
    return F.from_json(F.regexp_replace(s, "'", '"'), kind)


def spaced_numbers(s: Column) -> Column:
    """An array from a printed array of blank-separated numbers."""
    return F.transform(F.filter(F.split(F.regexp_replace(s, r"[\[\]]", ""), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def species_of_uniprot(description: Column) -> Column:
    """Species of a UniProtKB entry name, empty if there is none: the first
    word up to ``/`` as ``db|accession|name_SPECIES``."""
    word = F.substring_index(F.get(F.filter(F.split(description, r"\s+"), lambda x: x != ""), F.lit(0)), "/", 1)
    # Fixed value: the form of a data base's sequence names.
    form = r"^(?:tr|sp)\|[A-Za-z0-9]{6,10}(?:_\d)?\|[A-Za-z0-9]+_([A-Za-z0-9]{1,5})(?:_\d+)?$"
    return F.coalesce(F.regexp_extract(word, form, 1), F.lit(""))


def species_of_uniref(description: Column) -> Column:
    """The part after the second and last ``_`` before ``/`` of a UniRef100
    description, else empty."""
    head = F.substring_index(description, "/", 1)
    fits = description.startswith("UniRef100") & F.contains(description, F.lit("/")) & (F.size(F.split(head, "_")) == 3)
    return F.coalesce(F.when(fits, F.substring_index(head, "_", -1)), F.lit(""))


#: Species by the data base that pairs are searched in.
SPECIES = {"uniprot": species_of_uniprot, "uniref100": species_of_uniref}


def species_of(data_base: str) -> Callable[[Column], Column]:
    for prefix, found in SPECIES.items():
        if data_base.startswith(prefix):
            return found
    raise NotImplementedError(f"no species rule for {data_base}")


def entry_and_chain(hit: Column) -> Column:
    """Struct (entry, chain) of a hit's name ``1abc_A``, which it begins with;
    the query fails for any other."""
    name = F.regexp_extract(hit, r"^([a-zA-Z\d]{4}_[a-zA-Z0-9.]+)", 1)
    sound = F.when(name == "", F.raise_error(F.concat(F.lit("no entry and chain in "), hit)).cast("string")).otherwise(name)
    return F.struct(F.lower(F.substring(sound, 1, 4)).alias("entry"), F.substring(sound, 6, 1 << 30).alias("chain"))


def bias_of(items: Column) -> Column:
    """Map of ``name:value`` items; the query fails for an item without a colon
    or a number. Of repeated names the last counts."""
    wrong = lambda x: F.raise_error(F.concat(F.lit("not name:value: "), x))
    name = lambda x: F.when(F.contains(x, F.lit(":")), F.trim(F.substring_index(x, ":", 1))).otherwise(wrong(x).cast("string"))
    value = lambda x: F.coalesce(F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).try_cast("double"), wrong(x).cast("double"))
    last = F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: F.trim(F.substring_index(y, ":", 1)) == F.trim(F.substring_index(x, ":", 1))))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(name(x), value(x))))


def contig_parts(contig: Column) -> Column:
    """Parts of a contig such as ``A1-10,5-8 B3,0``: array of structs (segment,
    chain, low, high). A part that begins with a letter names residues of that
    chain; others are free lengths, chain null; ``0`` ends a segment."""
    part = lambda n, p: F.struct(
        n.alias("segment"), F.when(p.rlike("^[A-Za-z]"), F.substring(p, 1, 1)).alias("chain"),
        F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("low"), F.coalesce(F.nullif(F.regexp_extract(p, r"-(\d+)$", 1), F.lit("")), F.regexp_extract(p, r"(\d+)", 1)).cast("int").alias("high"),
    )
    return F.flatten(F.transform(F.split(F.trim(contig), r"\s+"), lambda s, n: F.transform(F.split(s, ","), lambda p: part(n, p))))


def contig_length(parts: Column) -> Column:
    """Struct (low, high): residues that a contig's parts make at least and at most."""
    size = lambda p, free: F.when(p["chain"].isNotNull(), p["high"] - p["low"] + 1).otherwise(free)
    add = lambda free: F.aggregate(parts, F.lit(0), lambda s, p: s + size(p, p[free]))
    return F.struct(add("low").alias("low"), add("high").alias("high"))


def virtual_cb(n: Column, ca: Column, c: Column) -> Column:
    """The virtual CB of a residue's three backbone points, arrays of three."""
    # Weights of b x c, b and c, for b = CA - N and c = C - CA.
    weights = (-0.58273431, 0.56802827, -0.54067466)
    g = lambda a, i: F.get(a, F.lit(i)).cast("double")
    b, e = [g(ca, i) - g(n, i) for i in range(3)], [g(c, i) - g(ca, i) for i in range(3)]
    cross = [b[j] * e[k] - b[k] * e[j] for j, k in ((1, 2), (2, 0), (0, 1))]
    return F.array(*[F.lit(weights[0]) * cross[i] + F.lit(weights[1]) * b[i] + F.lit(weights[2]) * e[i] + g(ca, i) for i in range(3)])


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bin_centres_weight(probabilities: Column, low: float, high: float, tokens: Column) -> Column:
    """Sum of probability / (1 + (bin centre / norm)^2), norm by ``tokens``."""
    norm = F.lit(1.24) * F.cbrt(F.greatest(tokens, F.lit(19)) - 15) - F.lit(1.8)
    scale = F.struct((F.lit(low) / norm).alias("low"), (F.lit(high - low) / F.size(probabilities) / norm).alias("width"))

    def total(s: Column) -> Column:
        ratio = lambda i: s["low"] + (i + 0.5) * s["width"]
        return F.aggregate(F.transform(probabilities, lambda p, i: p / (1 + ratio(i) * ratio(i))), F.lit(0.0), lambda x, y: x + y)

    return bind(scale, total)


def softmax(logits: Column) -> Column:
    powers = lambda top: F.transform(logits, lambda v: F.exp(v.cast("double") - top))
    shares = lambda e: bind(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda whole: F.transform(e, lambda v: v / whole))
    return bind(bind(F.array_max(logits).cast("double"), powers), shares)
