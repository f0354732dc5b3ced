"""Confidence scores of predicted structures, as grouped sums over pair tables.

``pairs`` has (keys, i, j, prob): the error distribution of token j seen from
token i, an array over equal bins. ``tokens`` has (keys, token, chain,
has_frame, ligand). A score of a selection of tokens is normed by how many the
selection has; without a framed token it is 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bin_centres_weight

EPS = 1e-8
#: Tokens of a structure that meet as many others in one group, and rows of them
#: that are multiplied at once.
BLOCK, TOGETHER = 2048, 256
#: A sum of powers below this is made anew from the pair's own largest logit.
TINY = 1e-200


def pair_terms(pairs: DataFrame, tokens: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """(keys, i, chain_i, frame_i, chain_j, n, n_i, n_j, whole, local) summed
    over j: ``whole`` normed by all tokens, ``local`` by the tokens of the two
    chains (of the one, within a chain). One shuffle by (keys, i, chain of j),
    with partial sums."""
    sizes = tokens.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("n_of"))
    known = tokens.join(sizes, [*keys, "chain"]).join(tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    a = known.select(*keys, F.col("token").alias("i"), F.col("chain").alias("chain_i"), F.col("has_frame").alias("frame_i"), F.col("n_of").alias("n_i"), "n")
    b = known.select(*keys, F.col("token").alias("j"), F.col("chain").alias("chain_j"), F.col("n_of").alias("n_j"))
    met = pairs.join(a, [*keys, "i"]).join(b, [*keys, "j"])
    some = F.when(F.col("chain_i") == F.col("chain_j"), F.col("n_i")).otherwise(F.col("n_i") + F.col("n_j"))
    scored = met.select(*keys, "i", "chain_i", "frame_i", "chain_j", "n", "n_i", "n_j", bin_centres_weight(F.col("prob"), low, high, F.col("n")).alias("whole"), bin_centres_weight(F.col("prob"), low, high, some).alias("local"))
    return scored.groupBy(*keys, "i", "chain_i", "frame_i", "chain_j", "n", "n_i", "n_j").agg(F.sum("whole").alias("whole"), F.sum("local").alias("local"))


def summed_logit_terms(tokens: DataFrame, keys: list[str], low: float, high: float, logits: str = "logits", block: int = BLOCK) -> DataFrame:
    """:func:`pair_terms` of all two tokens of a structure whose pair's error
    distribution is the softmax of the sum of their own ``logits``, a column of
    ``tokens``. No pair is a row: the powers of a sum are products, so a block
    of tokens by a block of tokens is a few matrix products. Each two blocks are
    a group, so work is dealt evenly whatever a structure's size. Tokens without
    logits, or with null ones, count, but their pairs have no distribution."""
    sizes = tokens.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("n_of"))
    known = tokens.join(sizes, [*keys, "chain"]).join(tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    cut = known.select(*keys, F.col("token").alias("i"), "chain", F.col("has_frame").alias("frame_i"), "n", F.col("n_of"), F.col(logits).cast("array<double>").alias("logits"), F.pmod(F.xxhash64("token", F.lit(7)), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("met"))
    left = cut.withColumnsRenamed({"own": "__a", "met": "__b"})
    right = cut.select(*[F.col(c).alias(c) for c in (*keys, "chain", "n_of", "logits")], F.col("own").alias("__b"), F.col("met").alias("__a"))
    kind = lambda c: cut.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"`{k}` {kind(k)}" for k in keys], f"i {kind('i')}", f"chain_i {kind('chain')}", "frame_i boolean", f"chain_j {kind('chain')}", "n bigint, n_i bigint, n_j bigint, whole double, local double"])
    scored = left.groupBy(*keys, "__a", "__b").cogroup(right.groupBy(*keys, "__a", "__b")).applyInArrow(_block_terms(keys, low, high), schema)
    return scored.groupBy(*keys, "i", "chain_i", "frame_i", "chain_j", "n", "n_i", "n_j").agg(F.sum("whole").alias("whole"), F.sum("local").alias("local"))


def _block_terms(keys: list[str], low: float, high: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def parts(rows: pa.Table) -> list[tuple]:
        """(places, chain, tokens of it, logits or None) by chain and number of
        logits; those that have none, or null ones, by themselves."""
        found: dict[tuple, list[int]] = {}
        lists, chains = rows.column("logits").to_pylist(), rows.column("chain").to_pylist()
        for at, (chain, x) in enumerate(zip(chains, lists)):
            found.setdefault((chain, 0 if x is None or None in x else len(x)), []).append(at)
        of = rows.column("n_of").to_pylist()
        return [(np.array(at), chain, of[at[0]], np.array([lists[k] for k in at], float) if width else None) for (chain, width), at in found.items()]

    def weights(width: int, tokens: int) -> np.ndarray:
        norm = 1.24 * np.cbrt(max(tokens, 19) - 15) - 1.8
        return 1 / (1 + ((low + (np.arange(width) + 0.5) * (high - low) / width) / norm) ** 2)

    def shares(x: np.ndarray, y: np.ndarray, over: list[np.ndarray]) -> list[np.ndarray]:
        """For each weight of the bins the sums over ``y`` of the weighted
        distributions, a number for each of ``x``."""
        a, b = (np.exp(v - v.max(1, keepdims=True)) for v in (x, y))
        total = a @ b.T
        out = [((a * w) @ b.T) / np.where(total < TINY, 1.0, total) for w in over]
        for i, j in np.argwhere(total < TINY):
            power = x[i] + y[j]
            power = np.exp(power - power.max())
            for w, o in zip(over, out):
                o[i, j] = (power * w).sum() / power.sum()
        return [o.sum(1) for o in out]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, "i", "chain_i", "frame_i", "chain_j", "n", "n_i", "n_j", "whole", "local"]
        out = []
        theirs = parts(right) if left.num_rows else []
        for places, chain, n_i, x in parts(left) if right.num_rows else []:
            rows = left.take(pa.array(places))
            for _, other, n_j, y in theirs:
                whole = local = pa.nulls(len(places), pa.float64())
                if x is not None and y is not None and x.shape[1] == y.shape[1]:
                    n = rows.column("n")[0].as_py()
                    over = [weights(x.shape[1], n), weights(x.shape[1], n_i if chain == other else n_i + n_j)]
                    sums = [shares(x[k : k + TOGETHER], y, over) for k in range(0, len(x), TOGETHER)]
                    whole, local = (pa.array(np.concatenate([s[k] for s in sums]), from_pandas=False) for k in (0, 1))
                same = lambda v, kind: pa.array([v] * len(places), kind)
                out.append(pa.table([*[rows.column(k) for k in keys], rows.column("i"), rows.column("chain"), rows.column("frame_i"), same(other, left.schema.field("chain").type), rows.column("n"), rows.column("n_of"), same(n_j, pa.int64()), whole, local], names=names))
        if out:
            return pa.concat_tables(out)
        types = {**{k: left.schema.field(k).type for k in keys}, "i": left.schema.field("i").type, "chain_i": left.schema.field("chain").type, "frame_i": pa.bool_(), "chain_j": left.schema.field("chain").type}
        return pa.schema([(c, types.get(c, pa.int64() if c[0] == "n" else pa.float64())) for c in names]).empty_table()

    return work


def _best(value: Column) -> Column:
    return F.coalesce(F.max(F.when(F.col("frame_i"), value)), F.lit(0.0))


def predicted_tm(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ptm, iptm) of :func:`pair_terms`."""
    other = F.col("chain_i") != F.col("chain_j")
    rows = terms.groupBy(*keys, "i", "frame_i", "n", "n_i").agg(F.sum("whole").alias("every"), F.sum(F.when(other, F.col("whole")).otherwise(0.0)).alias("across"))
    return rows.groupBy(*keys).agg(_best(F.col("every") / F.col("n")).alias("ptm"), _best(F.col("across") / (F.lit(EPS) + F.col("n") - F.col("n_i"))).alias("iptm"))


def chain_pair_iptm(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, iptm) of each two chains, both ways round."""
    across = terms.filter("chain_i <> chain_j").withColumn("mean", F.col("local") / (F.lit(EPS) + F.col("n_j")))
    one = across.groupBy(*keys, F.least("chain_i", "chain_j").alias("a"), F.greatest("chain_i", "chain_j").alias("b")).agg(_best(F.col("mean")).alias("iptm"))
    return one.unionByName(one.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "iptm"))


def chain_scores(terms: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chain, ligand, ptm, iptm): ``iptm`` the mean over the pairs with
    this chain whose first chain has a framed token; ``ligand`` where at least
    half (rounded down) of the chain's tokens are."""
    own = terms.filter("chain_i = chain_j").groupBy(*keys, F.col("chain_i").alias("chain")).agg(_best(F.col("local") / F.col("n_i")).alias("ptm"))
    of = tokens.groupBy(*keys, "chain").agg(F.bool_or("has_frame").alias("framed"), (F.count_if("ligand") >= F.floor(F.count(F.lit(1)) / 2)).alias("ligand"))
    pairs = chain_pair_iptm(terms, keys).join(of.select(*keys, F.col("chain").alias("a"), "framed"), [*keys, "a"]).filter("framed")
    both = pairs.select(*keys, F.explode(F.array("a", "b")).alias("chain"), "iptm")
    mean = both.groupBy(*keys, "chain").agg(F.avg("iptm").alias("iptm"))
    return of.drop("framed").join(own, [*keys, "chain"], "left").join(mean, [*keys, "chain"], "left").select(*keys, "chain", "ligand", F.coalesce("ptm", F.lit(0.0)).alias("ptm"), F.coalesce("iptm", F.lit(0.0)).alias("iptm"))


def chain_pair_global(pairs: DataFrame, chains: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (:func:`chain_pair_iptm`) with ``iptm_global``: the first
    chain's score if that is a ligand, else the second's if that is, else the
    mean of both."""
    side = lambda c: chains.select(*keys, F.col("chain").alias(c), F.col("iptm").alias(f"of_{c}"), F.col("ligand").alias(f"ligand_{c}"))
    met = pairs.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    score = F.when(F.col("ligand_a"), F.col("of_a")).when(F.col("ligand_b"), F.col("of_b")).otherwise((F.col("of_a") + F.col("of_b")) * 0.5)
    return met.select(*keys, "a", "b", "iptm", score.alias("iptm_global"))


def chain_plddt(atoms: DataFrame, keys: list[str], score: str = "plddt") -> DataFrame:
    """(keys, a, b, plddt): means over the atoms of one chain (a = b) and of
    each two, from each chain's sum and count. ``atoms`` has (keys, chain, score)."""
    sums = atoms.groupBy(*keys, "chain").agg(F.sum(score).alias("sum"), F.count(score).alias("n"))
    side = lambda c: sums.select(*keys, F.col("chain").alias(c), F.col("sum").alias(f"sum_{c}"), F.col("n").alias(f"n_{c}"))
    both = side("a").join(side("b"), keys)  # a row for each two chains of a structure
    alone = F.col("a") == F.col("b")
    return both.select(*keys, "a", "b", F.when(alone, F.col("sum_a") / F.col("n_a")).otherwise((F.col("sum_a") + F.col("sum_b")) / (F.col("n_a") + F.col("n_b"))).alias("plddt"))


def weighted_error(pairs: DataFrame, keys: list[str], error: Column, contact: Column) -> DataFrame:
    """(keys, gpde): mean pair error by contact probability."""
    return pairs.groupBy(*keys).agg((F.sum(error * contact) / F.sum(contact)).alias("gpde"))


def ranking(ptm: Column, iptm: Column, disorder: Column, clash: Column) -> Column:
    return 0.8 * iptm + 0.2 * ptm + 0.5 * disorder - 100 * clash.cast("int")
