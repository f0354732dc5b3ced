"""Sequences sought in chains, with X as a wildcard on either side."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def first_matches(patterns: list[str], chain: str) -> list[int]:
    """For each pattern the first place where it fits ``chain``, or -1; X fits
    any letter on either side. All patterns go at once: each has a bit for each
    of its letters in one whole number, set where the letters so far fit."""
    starts = ends = at = 0
    whole: dict[str, int] = {}
    always, last = 0, {}
    found = [-1] * len(patterns)
    for n, pattern in enumerate(patterns):
        if not pattern:
            found[n] = 0
            continue
        starts |= 1 << at
        for c in pattern:
            if c == "X":
                always |= 1 << at
            else:
                whole[c] = whole.get(c, 0) | 1 << at
            at += 1
        ends |= 1 << at - 1
        last[at - 1] = n
    any_letter = (1 << at) - 1
    state = 0
    for place, c in enumerate(chain):
        state = (state << 1 | starts) & (any_letter if c == "X" else whole.get(c, 0) | always)
        hit = state & ends
        while hit:
            bit = hit.bit_length() - 1
            hit ^= 1 << bit
            n = last[bit]
            found[n] = place - len(patterns[n]) + 1
            ends ^= 1 << bit  # only the first place counts
    return found


def find_templates(templates: DataFrame, chains: DataFrame) -> DataFrame:
    """(entry, template, chain, place, how) of ``templates`` (entry, template,
    chain, pattern) in the ``chains`` (entry, number, chain, seq) of their entry.

    In order: ``exact`` in the chain that is named, ``sequence`` exact in any
    chain, ``wildcard`` in any; the first chain by number, and in it the first
    place, from 0. Templates that fit nowhere have nulls. Templates meet chains
    by an equi-join; only those without an exact match go to the wildcards,
    which a batch tries together for each of its chains."""
    t = templates.select("entry", "template", F.col("chain").alias("named"), F.coalesce("pattern", F.lit("")).alias("pattern"))
    met = t.join(chains.select("entry", "number", F.col("chain").alias("in_chain"), "seq").filter("seq <> ''"), "entry")
    hit = lambda rank, place: F.struct(F.lit(rank).alias("rank"), "number", F.col("in_chain").alias("chain"), place.alias("place"))
    at = F.expr("locate(pattern, seq)") - 1
    exact = met.filter(at >= 0).groupBy("entry", "template").agg(F.min(F.when(F.col("named") == F.col("in_chain"), hit(0, at)).otherwise(hit(1, at))).alias("hit"))
    exact = stored(exact, "exact")
    rest = met.join(exact.select("entry", "template"), ["entry", "template"], "left_anti").filter(F.length("pattern") <= F.length("seq"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            together: dict[str, list[int]] = {}
            patterns = batch.column(5).to_pylist()
            for row, chain in enumerate(batch.column(4).to_pylist()):
                together.setdefault(chain, []).append(row)
            places = [-1] * batch.num_rows
            for chain, rows in together.items():
                for row, place in zip(rows, first_matches([patterns[r] for r in rows], chain)):
                    places[row] = place
            keep = pa.array([n for n, p in enumerate(places) if p >= 0], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(keep) for k in range(4)], pa.array([p for p in places if p >= 0], pa.int32())], names=["entry", "template", "number", "in_chain", "place"])

    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("entry", "template", "number", "in_chain"))
    loose = rest.select("entry", "template", "number", "in_chain", "seq", "pattern").mapInArrow(work, f"{kinds}, place int")
    wild = loose.groupBy("entry", "template").agg(F.min(hit(2, F.col("place"))).alias("hit"))
    found = exact.unionByName(wild)
    how = F.element_at(F.array(F.lit("exact"), F.lit("sequence"), F.lit("wildcard")), F.col("hit.rank") + 1)
    return t.select("entry", "template").join(found, ["entry", "template"], "left").select("entry", "template", F.col("hit.chain").alias("chain"), F.col("hit.place").cast("int").alias("place"), F.when(F.col("hit").isNotNull(), how).alias("how"))
