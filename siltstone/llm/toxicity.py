"""Toxicity by noisy-channel deobfuscation.

A token that holds a letter and a digit, a sign that resembles a letter, a sign
between letters or a doubled letter opens a lattice, as do letters set apart by
blanks or signs: each observed character may stand for itself, for a letter that
it resembles, for nothing (a separator), for a repetition of the letter before
or, if it is a blank, for the border of two words. An exact Viterbi search under an
interpolated character trigram model picks the likeliest reading: a first pass
over the ``BEAM`` cheapest states bounds the cost, and where it has left states
out, a second one leaves out only states that cannot lead below that bound. The
restored text is scored by a sparse logistic model over its words and their
first three to eight letters.

The character model and the logistic model are fitted on all labelled rows:
their grams, words and features are counted in tasks, and the weights are those
of Spark's logistic regression. Every row is scored over its whole text, one
pass; texts of labelled rows are shuffled once, others not.

Defined results: a null text counts as empty, and a text without known words
has the prior's score. Without labels of both classes the score is the share of
label 1 among the labels, 0 if there are none. Rows of the label table that
share an id count once, with their largest label; null ids and labels are
ignored. Of document rows that share an id one, of the least text, is learnt
from. Repeated document rows get equal scores;
readings of equal cost go to the one found first; very long texts are scored
whole, very long tokens in overlapping windows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Tokens whose weight a worker keeps before it forgets them all.
MEMO_TOKENS = 400_000
#: Tokens or features that a task counts before it passes its counts on.
COUNTED = 150_000
#: Characters of the texts whose tokens it counts before it does so.
COUNTED_CHARS = 1 << 25
#: Characters whose grams are counted at once, some 100 bytes each.
GRAM_CHARS = 1 << 17
#: Words of rows, or bytes of texts, that are worked on at once, one row at least.
AT_ONCE = 1 << 17
#: States of the first pass over a lattice, whose cost bounds the exact one.
BEAM = 4

# Characters and the letters that they stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "¡": "i",
    "#": "h", "\ue000": "m", "\ue001": "w", "\ue002": "n", "\ue003": "a", "\ue004": "v",
}
#: Letters drawn with several signs, the longest first, each read as one character.
DRAWN = {"/\\/\\": "\ue000", "\\/\\/": "\ue001", "|\\|": "\ue002", "/\\": "\ue003", "\\/": "\ue004"}
SEPARATORS = " .-_*~^'`·,/\\"

BLANKS = " \t\n\r\x0b\x0c\xa0"
#: Price of reading a blank as a border, beside the word's end.
BORDER = 0.3
#: Price of reading a sign that resembles a letter as nothing.
MARK_GONE = 9.0
#: Price of reading a letter as a repetition of the one before.
REPEATED = 1.2

EDGE = re.compile(r"^\W+|[\W_]+$")
#: Tokens that the character model never learns from.
ODD = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|^[\d$@!|+€][^\W\d_]{2}|[^\W\d_]{2}[\d$@€]$|([^\W\d_])\1\1")
#: Tokens with a letter that open the lattice.
OPEN = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|[\d@$!|+€£¢(¡#]|/\\|\\/|([^\W\d_])\1")
SPACED = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+€£¢(¡#])(?:[\s.\-_*~^'`·,/\\]+(?:[^\W_]|[@$!|+€£¢(¡#])){2,}(?![^\s.,;:!?])")
LETTER = re.compile(r"[^\W\d_]")
LETTERS = re.compile(r"[^\W\d_]{3,}")
REPEATS = re.compile(r"([^\W\d_])\1+")
MOST = 48
#: A word's first letters that are features beside the word itself.
PREFIXES = (3, 4, 5, 6, 7, 8)


class Costs(dict):
    """Costs of grams, each made by ``make`` when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, gram: str) -> float:
        if len(self) > 500_000:
            self.clear()
        found = self[gram] = self.make(gram)
        return found


class CharModel:
    """Interpolated character trigrams; log probabilities by dictionary."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.two, self.one, self.after_two, self.after_one = Counter(), Counter(), Counter(), Counter()
        for gram, n in counts.items():
            self.after_two[gram[:2]] += n
            self.two[gram[1:]] += n
            self.after_one[gram[1]] += n
            self.one[gram[2]] += n
        self.total = sum(self.one.values()) or 1
        self.cost = Costs(self._cost).__getitem__
        self.least, self.least_after = Costs(self._least).__getitem__, Costs(self._least_after).__getitem__
        self.floor: dict[str, float] = {}

    def _cost(self, gram: str) -> float:
        p = 0.9 * self.one.get(gram[2], 0) / self.total + 0.1 / 256
        n = self.after_one.get(gram[1], 0)
        p = (self.two.get(gram[1:], 0) + 4 * p) / (n + 4)
        n = self.after_two.get(gram[:2], 0)
        p = (self.three.get(gram, 0) + 4 * p) / (n + 4)
        return -math.log(p)

    def _floors(self) -> dict[str, float]:
        """Least costs by last letter and by last two, of grams that were seen
        and of shorter contexts."""
        if not self.floor:
            best: dict[str, float] = {}
            for gram in self.three:
                for context in (gram[:2], "\0" + gram[1], "\0\0"):
                    found = self.cost(context + gram[2])
                    for end in (gram[2], gram[1:]) if context[1] != "\0" else (gram[2],):
                        if found < best.get(end, math.inf):
                            best[end] = found
            self.floor = best
        return self.floor

    def _least(self, letter: str) -> float:
        """No gram that ends with ``letter`` costs less."""
        return min(self._floors().get(letter, math.inf), self.cost("\0\0" + letter))

    def _least_after(self, two: str) -> float:
        """No gram that ends with these two letters costs less."""
        return min(self._floors().get(two, math.inf), self.cost("\0" + two))

    def restore(self, observed: str) -> str:
        """Likeliest reading of one obfuscated token or run of letters; a blank
        in it is a border of words or nothing."""
        observed = observed.lower()
        if observed.isalpha():
            return self.undoubled(observed)
        letter_gone = 12.0
        for drawn, c in DRAWN.items():
            observed = observed.replace(drawn, c)
        # a reading that drops no letter bounds the cost of those that may
        bound = self.search(observed, math.inf, math.inf)[0]
        return self.search(observed, letter_gone, bound)[1]

    def undoubled(self, letters: str) -> str:
        """The search for a token of letters only, which hides repetitions and
        nothing else. A run of one letter leaves the same two letters behind it
        and its next neighbour however much of it is written, so each run is
        decided alone, by the grams that it changes; of equal cost the fewer."""
        cost, out, at = self.cost, [], 0
        for run in REPEATS.finditer(letters):
            a, size = run.group(1), run.end() - run.start()
            x = letters[run.start() - 1] if run.start() else " "
            after = letters[run.end()] if run.end() < len(letters) else " "
            twice = cost(x + a + a) + cost(a + a + after)
            prices = [REPEATED * (size - 1) + cost(x + a + after)]
            prices += [REPEATED * (size - n) + twice + (n - 2) * (cost(a + a + a) if n > 2 else 0.0) for n in range(2, size + 1)]
            out.append(letters[at : run.start()] + a * (1 + prices.index(min(prices))))
            at = run.end()
        return "".join(out) + letters[at:]

    def rests(self, steps: list[tuple]) -> list[float]:
        """What the characters from each place on, and the end, cost at least.

        A character costs its cheapest reading after a letter that may stand
        before it. What lies between must be read as nothing then, and what this
        costs more than its own least counts to the character: no other shares
        it. Behind a place that excess may be paid already; then the first
        character that is read is taken at its least after any letter."""
        n = len(steps)
        least, after = self.least, self.least_after
        own, lower, excess, letters = [], [], [], []
        for k in range(n + 1):
            read, gone, border = steps[k] if k < n else ((), math.inf, True)
            enter = BORDER if k < n else 0.0
            low = min([gone, *[min(REPEATED, price + least(x)) for x, price in read]])
            best, paid, j = gone, 0.0, k - 1
            while paid < best:
                for y in letters[j] if j >= 0 else " ":
                    for x, price in read:
                        found = paid + price + after(y + x)
                        if found < best:
                            best = found
                        if x == y and paid + REPEATED < best:
                            best = paid + REPEATED
                    if border and (y != " " or k == n):
                        best = min(best, paid + enter + (after(y + " ") if y != " " else 0.0))
                if j < 0:
                    break
                paid += excess[j]
                j -= 1
            own.append(best)
            lower.append(min(low, enter) if border else low)
            excess.append(gone - best)
            letters.append([x for x, _ in read] + [" "] * border)
        out, slack, total = [0.0] * (n + 1), 0.0, 0.0
        for k in range(n, -1, -1):
            slack = max(own[k] - lower[k], slack - excess[k] if k < n else 0.0)
            total += own[k]
            out[k] = total - slack
        return out

    def search(self, observed: str, letter_gone: float, bound: float) -> tuple[float, str, bool]:
        """(cost, reading, whether no state was left out that could be better).

        Without a bound the ``BEAM`` cheapest states of each step go on; with
        one, all states from which the rest can cost so little."""
        cost = self.cost
        steps = [options(c, letter_gone) for c in observed]
        rest = self.rests(steps) if bound < math.inf else []
        states: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
        exact = True
        for k, (readings, gone, border) in enumerate(steps, 1):
            most = bound - rest[k] + 1e-9 if rest else math.inf
            after: dict[str, tuple[float, str]] = {}
            for state, (spent, text) in states.items():
                last = state[1]
                for x, price in readings:
                    if x == last:  # a repetition: nothing more is written
                        total = spent + REPEATED
                        if total <= most and (state not in after or total < after[state][0]):
                            after[state] = (total, text)
                    total = spent + price + cost(state + x)
                    if total <= most:
                        to = last + x
                        if to not in after or total < after[to][0]:
                            after[to] = (total, text + x)
                if border and last != " ":
                    total = spent + BORDER + cost(state + " ")
                    if total <= most and ("  " not in after or total < after["  "][0]):
                        after["  "] = (total, text + " ")
                total = spent + gone
                if total <= most and total < math.inf and (state not in after or total < after[state][0]):
                    after[state] = (total, text)
            if not rest and len(after) > BEAM:
                states, exact = dict(sorted(after.items(), key=lambda e: e[1][0])[:BEAM]), False
            else:
                states = after
        ends = ((spent + (cost(state + " ") if state[1] != " " else 0.0), text) for state, (spent, text) in states.items())
        total, text = min(ends, key=lambda e: e[0])
        return total, text, exact


def options(c: str, letter_gone: float) -> tuple[tuple[tuple[str, float], ...], float, bool]:
    """(readings and their prices, price of reading nothing, may be a border)."""
    if c in BLANKS:
        return (), 0.3, True
    if c in SEPARATORS:
        return (((c, 6.0),) if c == "'" else ()), 0.3, False
    if c in LOOKS_LIKE:
        return ((c, 5.0), *((x, 1.0) for x in LOOKS_LIKE[c])), MARK_GONE, False
    return ((c, 0.0),), letter_gone, False


def grams(words: Iterator[str]) -> Counter:
    counts: Counter = Counter()
    for word in words:
        padded = f"  {word} "
        counts.update([padded[k : k + 3] for k in range(len(padded) - 2)])
    return counts


def gram_batch(tokens: dict[str, int]) -> pa.RecordBatch:
    """(gram, n) of the plain words among tokens and their numbers, as
    :func:`grams` has them; characters as whole numbers of 21 bits, three a gram."""
    found, pieces, times, chars = [], [], [], 0
    for token, n in tokens.items():
        word = token if token.isalpha() else plain(token)
        if word.isalpha() and not ODD.search(token):
            word = f"  {word} "
            for k in range(0, len(word) - 2, GRAM_CHARS):  # pieces of a long word share two characters
                pieces.append(word[k : k + GRAM_CHARS + 2])
                times.append(n)
                chars += len(pieces[-1])
                if chars >= GRAM_CHARS:
                    found.append(piece_grams(pieces, times))
                    pieces, times, chars = [], [], 0
                if len(found) > 64:
                    found = [summed_grams(*map(np.concatenate, zip(*found)))]
    found.append(piece_grams(pieces, times))
    keys, n = summed_grams(*map(np.concatenate, zip(*found)))
    names = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    return pa.RecordBatch.from_arrays([pa.array([names[k : k + 3] for k in range(0, len(names), 3)], pa.string()), pa.array(n)], names=["gram", "n"])


def piece_grams(pieces: list[str], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, n) of the grams within pieces that count so many times."""
    size = np.array(list(map(len, pieces)), np.int64)
    c = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = np.ones(max(len(c) - 2, 0), bool)
    ends = np.cumsum(size)[:-1]  # a gram of two pieces begins at the last two characters of one
    inside[ends - 1] = inside[ends - 2] = False
    return summed_grams(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], np.repeat(np.array(times, np.int64), size)[:-2][inside])


def summed_grams(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, where = np.unique(keys, return_inverse=True)
    total = np.zeros(len(each), np.int64)
    np.add.at(total, where, n)
    return each, total


def gram_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (gram, n) of rows (text): a text has a token once."""
    seen, chars = Counter(), 0
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            seen.update(set(text.lower().split()))
            chars += len(text)
            if len(seen) > COUNTED or chars > COUNTED_CHARS:
                yield gram_batch(seen)
                seen, chars = Counter(), 0
    yield gram_batch(seen)


def plain(token: str) -> str:
    """A token in lower case without signs at its edges."""
    return EDGE.sub("", token)


def readings(token: str, model: CharModel) -> list[str]:
    """Words that one lower-case token stands for: itself without edge signs,
    and its restored form if it looks obfuscated. Tokens longer than MOST
    characters are read in overlapping windows, so none is passed over."""
    if token.isalpha() and not REPEATS.search(token):
        return [token]
    bare = token.rstrip(".,;:!?\"')").lstrip("\"'(")
    if bare.isalpha() and not REPEATS.search(bare):
        return [bare]
    word = bare if bare.isalpha() else plain(token)
    if not LETTER.search(bare) or not OPEN.search(bare):
        return [word] if word else []
    out = [word] if word else []
    for start in range(0, max(1, len(bare) - MOST // 2), MOST // 2):
        restored = model.restore(bare[start : start + MOST])
        out += LETTERS.findall(restored)
    return list(dict.fromkeys(out))


def spaced(text: str, model: CharModel) -> list[str]:
    """Words spelled with their letters set apart."""
    return [r for m in SPACED.finditer(text) for r in readings_of_spaced(m.group(), model)]


def readings_of_spaced(run: str, model: CharModel) -> list[str]:
    out = []
    for start in range(0, max(1, len(run) - MOST), MOST):
        part = run[start : start + 2 * MOST]
        # a first letter may be a word of its own, which trigrams tell poorly
        for read in (part, part[1:].lstrip(BLANKS + SEPARATORS)):
            out += LETTERS.findall(model.restore(read))
    return list(dict.fromkeys(out))


def word_features(word: str) -> list[str]:
    return [f"w:{word}", *(f"{k}:{word[:k]}" for k in PREFIXES if len(word) > k)]


def restored_words(text: str, model: CharModel, memo: dict[str, list[str]]) -> set[str]:
    lower = text.lower()
    out = set(spaced(lower, model))
    for token in set(lower.split()):
        found = memo.get(token)
        if found is None:
            if len(memo) >= MEMO_TOKENS:
                memo.clear()
            found = readings(token, model)
            if len(token) <= 64:
                memo[token] = found
        out.update(found)
    return out


def cut(batch: pa.RecordBatch, sizes: pa.Array, most: int = 0) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of rows whose ``sizes`` add up to ``most`` at most, by
    default ``AT_ONCE``, or of one row. A slice needs memory by its size, and a
    batch has as many rows as Spark likes, of any size."""
    ends, start = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + (most or AT_ONCE), "right")))
        yield batch.slice(start, stop - start)
        start = stop


def coded_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code of the word) of each word of (words, y), and the words by code."""
    lists = batch.column(0)
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    return row, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def counted_features(batch: pa.RecordBatch) -> pa.Table:
    """(feature, positive, negative) of rows (words, y), as :func:`word_features`
    names them. A row has a word once, of words of one beginning it may have more."""
    row, code, words = coded_words(batch)
    toxic = batch.column(1).to_numpy() == 1
    found = [("w:", words, row, code)]
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for k in PREFIXES:
        begun = pc.utf8_slice_codeunits(words, 0, k).dictionary_encode()
        long = size[code] > k
        n = max(len(begun.dictionary), 1)
        pair = np.unique(row[long] * n + begun.indices.to_numpy()[code[long]])
        found.append((f"{k}:", begun.dictionary, pair // n, pair % n))
    tables = []
    for name, values, rows, codes in found:
        every, positive = (np.bincount(c, minlength=len(values)) for c in (codes, codes[toxic[rows]]))
        some = np.flatnonzero(every)
        feature = pc.binary_join_element_wise(pa.scalar(name), values.take(pa.array(some)), "")
        tables.append(pa.table({"feature": feature, "positive": positive[some], "negative": (every - positive)[some]}))
    return pa.concat_tables(tables)


def summed(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by("feature").aggregate([("positive", "sum"), ("negative", "sum")])
    return total.select(["feature", "positive_sum", "negative_sum"]).rename_columns(["feature", "positive", "negative"])


def feature_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (feature, positive, negative) of rows (words, y)."""
    parts: list[pa.Table] = []
    for batch in batches:
        for part in cut(batch, pc.list_value_length(batch.column(0))):
            parts.append(counted_features(part))
            if sum(p.num_rows for p in parts) > 2 * COUNTED:
                # what was seen once is passed on first: its like may not come again
                total = summed(parts)
                once = pc.equal(pc.add(total["positive"], total["negative"]), 1)
                yield from total.filter(once).to_batches(max_chunksize=COUNTED)
                parts = [total.filter(pc.invert(once))]
                if parts[0].num_rows > COUNTED:
                    yield from parts.pop().to_batches(max_chunksize=COUNTED)
                pa.default_memory_pool().release_unused()
    if parts:
        yield from summed(parts).to_batches(max_chunksize=COUNTED)
    parts.clear()
    pa.default_memory_pool().release_unused()


def feature_counts(words: DataFrame) -> DataFrame:
    """(feature, positive, negative) of rows (words, y): texts of either label
    that have a feature. Tasks pass on partial counts."""
    partial = words.select("words", "y").mapInArrow(feature_parts, "feature string, positive bigint, negative bigint")
    return partial.groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def fit_logistic(words: DataFrame, l1: float = 0.4, l2: float = 0.02, rounds: int = 200) -> tuple[float, dict[str, float]] | None:
    """Sparse logistic regression of all rows (words, y), by Spark's own in as
    many tasks as it likes; features of a text are how many of its words have
    them, four at most. Candidates are features seen in two texts of label 1 and
    clearly more often there. None without texts of both labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    n = {r.y: r["count"] for r in words.groupBy("y").count().collect()}
    if len(n) < 2:
        return None
    often = (F.col("positive") >= 2) & (F.col("positive") / F.lit(float(n[1])) > 3 * F.col("negative") / F.lit(float(n[0])))
    names = [r.feature for r in feature_counts(words).filter(often).select("feature").orderBy("feature").collect()]  # the model's words
    if not names:
        return math.log(n[1] / n[0]), {}
    spark = words.sparkSession
    number = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = number.value
        begins = pa.array(sorted({f[2:5] for f in of}), pa.string())
        for batch in (part for whole in batches for part in cut(whole, pc.list_value_length(whole.column(0)))):
            row, code, words = coded_words(batch)
            # features of the words whose beginning a feature has; most have none
            some = np.flatnonzero(pc.is_in(pc.utf8_slice_codeunits(words, 0, 3), begins).to_numpy(zero_copy_only=False))
            ids = [[of[f] for f in word_features(w) if f in of] for w in words.take(pa.array(some)).to_pylist()]
            place = np.full(len(words), -1)
            place[some] = np.arange(len(some))
            lengths = np.array([len(x) for x in ids] or [0])
            flat, starts = np.array([f for x in ids for f in x], np.int64), np.cumsum(lengths) - lengths
            row, at = row[place[code] >= 0], place[code][place[code] >= 0]
            each = lengths[at] if len(at) else np.zeros(0, np.int64)
            inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            pair, count = np.unique(np.repeat(row, each) * len(of) + flat[np.repeat(starts[at], each) + inside], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(of)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % len(of), np.minimum(count, 4))]
            yield pa.RecordBatch.from_arrays([*lists, batch.column(1)], names=["at", "value", "y"])

    # equal rows, such as the many without a candidate, count as one of their weight
    coded = stored(words.select("words", "y").mapInArrow(rows, "at array<int>, value array<int>, y int").groupBy("at", "value", "y").agg(F.count(F.lit(1)).cast("double").alias("weight")), "toxicity-rows")
    size = len(names)
    vector = F.udf(lambda at, value: Vectors.sparse(size, at, value), VectorUDT())
    total = float(sum(n.values()))
    learner = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=(l1 + l2) / total, elasticNetParam=l1 / (l1 + l2), standardization=False, maxIter=rounds, tol=1e-7)
    model = learner.fit(coded.select(vector("at", "value").alias("x"), F.col("y").cast("double").alias("label"), "weight"))
    number.destroy()
    w = model.coefficients.toArray()
    return float(model.intercept), {names[k]: float(w[k]) for k in np.flatnonzero(w)}


def in_order(texts: set[str]):
    """Matches where a text's characters, or signs that resemble them, stand in
    order with anything between: else no reading has it, as a reading writes
    none that is not there. Letters drawn with several signs are not seen."""

    def step(x: str) -> str:
        signs = "".join(map(re.escape, sorted({x, *(c for c, like in LOOKS_LIKE.items() if x in like)})))
        return f"[^{signs}]*[{signs}]"

    # a text that begins with another has nothing to add
    least = [t for t in sorted(texts) if not any(t[:k] in texts for k in range(1, len(t)))]
    return re.compile("|".join("".join(map(step, t)) for t in least) or r"(?!)").match


class ToxicityModel:
    def __init__(self, gram_counts: dict[str, int], bias: float, weights: dict[str, float]):
        self.gram_counts, self.bias, self.weights = gram_counts, bias, weights

    def scorer(self):
        chars, weights = CharModel(self.gram_counts), self.weights
        memo: dict[str, tuple[tuple[str, float], ...]] = {}
        by_word = {f[2:]: x for f, x in weights.items() if f[0] == "w"}
        by_prefix = [(k, known) for k in PREFIXES if (known := {f[2:]: x for f, x in weights.items() if f[0] == str(k)})]

        begins = {f[2:][:3] for f in weights}  # a word of another begin has no feature
        # readings of letters alone differ in repetitions only
        first, single = {b[:1] for b in begins}, {REPEATS.sub(r"\1", b) for b in begins}
        hidden = in_order({f[2:] for f in weights})

        def weightless(raw: str) -> bool:
            """Whether no reading of a token can have a feature."""
            bare = raw.rstrip(".,;:!?\"')").lstrip("\"'(")
            if not bare.isalpha() or len(bare) > MOST:
                return "\\" not in raw and not hidden(raw)
            if bare[0] not in first:
                return True
            once = REPEATS.sub(r"\1", bare)
            return once[:3] not in single and once[:2] not in single and once[:1] not in single

        def weigh(word: str) -> float:
            if word[:3] not in begins:
                return 0.0
            total = by_word.get(word, 0.0)
            for k, known in by_prefix:
                if len(word) > k:
                    total += known.get(word[:k], 0.0)
            return total

        def token(raw: str) -> tuple[tuple[str, float], ...]:
            if len(memo) >= MEMO_TOKENS:
                memo.clear()
            found = () if weightless(raw) else tuple((w, x) for w in readings(raw, chars) if (x := weigh(w)))
            if len(raw) <= 64:
                memo[raw] = found
            return found

        def score(text: str) -> float:
            lower = text.lower()
            found = {w: weigh(w) for w in spaced(lower, chars)}
            get = memo.get
            for raw in set(lower.split()):
                words = get(raw)
                if words is None:
                    words = token(raw)
                if words:
                    found.update(words)
            z = self.bias + sum(found.values())
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column | None) -> tuple[DataFrame, int, int]:
    """(id, text, y) of every usable labelled row, one an id, and the numbers of
    labels 1 and 0, also of ids without a text."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull())
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    if usable is not None:
        y = y.filter(usable)
    n = {bool(r[0]): r[1] for r in y.groupBy(F.col("y") == 1).count().collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = texts.join(y, "id").groupBy("id").agg(F.min("text").alias("text"), F.max((F.col("y") == 1).cast("int")).alias("y"))
    return stored(each, "toxicity-labelled"), n.get(True, 0), n.get(False, 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> ToxicityModel:
    """``usable``: a condition on column ``id`` that labelled rows must meet."""
    labelled, positive, negative = training_sample(docs, labels, id_col, text_col, label_col, usable)
    share = positive / (positive + negative) if positive + negative else 0.0
    prior = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    if not positive or not negative:
        return ToxicityModel({}, prior, {})

    counted = labelled.select("text").mapInArrow(gram_parts, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    gram_counts = {r.gram: r.n for r in counted.collect()}  # the character model
    known = labelled.sparkSession.sparkContext.broadcast(gram_counts)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = CharModel(known.value)
        memo: dict[str, list[str]] = {}
        for batch in batches:
            for part in cut(batch, pc.binary_length(batch.column(0)), 8 * AT_ONCE):
                found = [sorted(restored_words(t.as_py(), chars, memo)) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), part.column(1)], names=["words", "y"])

    restored = stored(labelled.select("text", "y").mapInArrow(words, "words array<string>, y int"), "toxicity-words")
    known.destroy()
    bias, weights = fit_logistic(restored) or (prior, {})
    return ToxicityModel(gram_counts, bias, weights)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row; narrow."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = [score(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    scored = source.mapInArrow(work, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores below ``limit``."""
    columns = docs.columns
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text_col).alias("text"))
    names = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            keep = pa.array([score(t.as_py() or "") < limit for t in batch.column(1)], pa.bool_())
            rows = batch.column(0).filter(keep)
            yield pa.RecordBatch.from_arrays(rows.flatten(), names=columns)

    return source.mapInArrow(work, names)
