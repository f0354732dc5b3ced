"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Each run of text that no vocabulary piece can cross is encoded on its own with
a score-ordered agenda of adjacent symbol pairs: the best-scored pair, leftmost
on ties, is merged until no adjacent pair is a piece. Runs repeat a lot, so
each worker keeps its encoder from task to task, with a bounded memo of runs in
two generations, so that runs in use outlive the others. Every document of each
Arrow batch is encoded by the sentencepiece library as well, and a difference
raises.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to an empty text; characters outside the vocabulary become byte pieces;
pairs of equal score go to the leftmost; texts of any length are taken whole.
Rows are independent: repeated rows, and rows without an id, give results of
their own; an empty table gives an empty result; extra columns are ignored. A
model given by a bare file name is looked up among the public tokenizers by
each worker; a path must be one that every worker has.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Runs kept in a worker's memo, half of them at least of late; bounds its memory.
MEMO_RUNS = 400_000
#: Runs of up to so many characters are encoded in lockstep.
SHORT = 32
NONE = np.int32(2**31 - 1)
#: Symbols from here on are code points that no piece has.
OUTSIDE = 1 << 24
#: Odd multiplier of the pair table's hash: 2^64 divided by the golden ratio.
HASH = 0x9E3779B97F4A7C15


def model_flags(path: str) -> dict[str, int]:
    """Fields of the model file that the encoder relies on, read from the
    protobuf wire format: model_type, add_dummy_prefix, remove_extra_whitespaces
    and escape_whitespaces, with the format's defaults, and the size of the
    normalizer's character map."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            shift = value = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                if byte < 128:
                    return value
                shift += 7

        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                size = {1: 8, 5: 4}.get(kind) or varint()
                yield tag >> 3, data[at : at + size]
                at += size

    flags = {"model_type": 1, "add_dummy_prefix": 1, "remove_extra_whitespaces": 1, "escape_whitespaces": 1, "charsmap": 0}
    with open(path, "rb") as file:
        model = file.read()
    for number, value in fields(model):
        if number == 2:
            flags.update({"model_type": v for n, v in fields(value) if n == 3})
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    flags["charsmap"] = len(v)
                elif n in (3, 4, 5):
                    flags[("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces")[n - 3]] = v
    return flags


def located(model: str) -> str:
    """The path of a model; that of a public tokenizer for a bare file name."""
    if os.path.basename(model) != model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


class MergeEncoder:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, path: str, memo_runs: int = MEMO_RUNS):
        import sentencepiece

        path = located(path)
        flags = model_flags(path)
        if flags["model_type"] != 2 or flags["remove_extra_whitespaces"] or flags["charsmap"] or not flags["escape_whitespaces"]:
            raise ValueError(f"not a merge-type vocabulary with identity normalisation: {flags}")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.prefix = SPACE if flags["add_dummy_prefix"] else ""
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        by_score = sorted(self.ids, key=lambda p: -lib.get_score(self.ids[p]))
        self.order = {}
        last, place = None, -1
        for piece in by_score:  # pieces of equal score share a place: the leftmost pair goes first
            score = lib.get_score(self.ids[piece])
            place += score != last
            last = score
            self.order[piece] = place
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(lib.get_piece_size()) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo_runs = memo_runs
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(lib.get_piece_size()))
        self.texts = [str(i) for i in range(lib.get_piece_size())]
        single = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        #: By code point: the id of a one-character piece, else OUTSIDE + code point.
        self.alphabet = np.arange(max(single) + 1, dtype=np.int32) + OUTSIDE
        self.alphabet[list(single)] = list(single.values())
        self._pair_table()

    def _pair_table(self) -> None:
        """Open-addressing table from (left id, right id) to the place and the
        id of the piece that they merge into."""
        keys, places, merged = [], [], []
        for piece, number in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    places.append(self.order[piece])
                    merged.append(number)
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.places = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        for key, place, number in zip(keys, places, merged):
            slot = (key * HASH & (1 << 64) - 1) >> (64 - bits)
            while self.keys[slot] != -1:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.places[slot], self.merged[slot] = key, place, number

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; a free slot, whose place is NONE, if no piece."""
        key = left.astype(np.int64) << 32 | right
        slot = ((key.astype(np.uint64) * np.uint64(HASH)) >> self.shift).astype(np.int64)
        wrong = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            here = self.keys[slot[wrong]]
            wrong = wrong[(here != key[wrong]) & (here != -1)]
        return slot

    def lockstep(self, runs: list[str]) -> None:
        """Encode new short runs together: each step takes the head of every
        run's agenda, merges it and renews the two pairs beside it."""
        runs.sort(key=len)
        for start in range(0, len(runs), 8192):
            part = runs[start : start + 8192]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            width = int(sizes[-1])
            points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.int64)
            columns = np.arange(width)[None, :]
            symbols = np.full((len(part), width), -1, np.int32)
            symbols[columns < sizes[:, None]] = np.where(points < len(self.alphabet), self.alphabet[np.minimum(points, len(self.alphabet) - 1)], points + OUTSIDE)
            whole = symbols.copy()
            rows = np.arange(len(part))
            agenda = np.full((len(part), width), NONE, np.int32)
            agenda[:, : width - 1] = self.places[self.look(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())].reshape(len(part), width - 1)
            while len(rows):
                at = agenda.argmin(1)
                each = np.arange(len(rows))
                live = agenda[each, at] != NONE
                if not live.all():
                    whole[rows[~live]] = -1
                    whole[rows[~live], : symbols.shape[1]] = symbols[~live]
                    rows, at, symbols, agenda = rows[live], at[live], symbols[live], agenda[live]
                    each = np.arange(len(rows))
                    if not len(rows):
                        break
                slot = self.look(symbols[each, at], symbols[each, at + 1])
                beyond = columns[:, : symbols.shape[1]] > at[:, None]
                np.copyto(symbols[:, :-1], symbols[:, 1:].copy(), where=beyond[:, :-1])
                np.copyto(agenda[:, :-1], agenda[:, 1:].copy(), where=beyond[:, :-1])
                symbols, agenda = symbols[:, :-1], agenda[:, :-1].copy()
                symbols[each, at] = self.merged[slot]
                last = symbols.shape[1] - 1
                agenda[each, at] = np.where(at < last, self.places[self.look(symbols[each, at], symbols[each, np.minimum(at + 1, last)])], NONE)
                has = np.flatnonzero(at > 0)
                agenda[has, at[has] - 1] = self.places[self.look(symbols[has, at[has] - 1], symbols[has, at[has]])]
            full = whole != -1
            ends = np.cumsum(full.sum(1)).tolist()
            ids = whole[full].tolist()
            odd = set(np.flatnonzero((whole >= OUTSIDE).any(1)).tolist())
            memo, numbers, begin = self.memo, self.numbers, 0  # shared numbers keep the memo small
            for n, (run, end) in enumerate(zip(part, ends)):
                if n in odd:
                    memo[run] = tuple(j for i in ids[begin:end] for j in ([i] if i < OUTSIDE else self.outside(chr(i - OUTSIDE))))
                else:
                    memo[run] = tuple([numbers[i] for i in ids[begin:end]])
                begin = end

    def outside(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def learn(self, runs: set[str]) -> None:
        """Put the runs that the memo lacks into it; long ones are left to
        :meth:`merge`, as they seldom come back."""
        new = runs.difference(self.memo)
        if len(self.memo) + len(new) > self.memo_runs // 2:
            self.older, self.memo, new = self.memo, {}, runs
        known = new & self.older.keys()
        self.memo.update(zip(known, map(self.older.__getitem__, known)))
        self.lockstep([r for r in new - known if len(r) <= SHORT])

    def merge(self, run: str) -> tuple[int, ...]:
        """The agenda of one run of any length: a heap, stale entries skipped."""
        order = self.order
        symbols = list(run)
        after = list(range(1, len(run) + 1))
        before = list(range(-1, len(run) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols):
                place = order.get(symbols[i] + symbols[j])
                if place is not None:
                    heapq.heappush(heap, (place, i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i] = left + right
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.ids.get(symbol)
                ids += self.outside(symbol) if known is None else [known]
        return tuple(ids)

    def split(self, text: str) -> list[str]:
        """Runs that no piece crosses: space marks and what follows them."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " " or not self.prefix:
            return self.runs.findall(self.prefix + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        split = [self.split(t) for t in texts]
        everything: set[str] = set()
        for runs in split:
            everything.update(runs)
        self.learn(everything)
        get, merge = self.memo.get, self.merge
        out = []
        for runs in split:
            found = list(map(get, runs))
            if None in found:  # long runs
                found = [merge(r) if ids is None else ids for r, ids in zip(runs, found)]
            out.append(list(chain.from_iterable(found)))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""

    def decode_batch(self, ids: list[list[int]]) -> list[str]:
        """The library's texts; no ids give an empty one."""
        decoded = iter(self.library.decode([i for i in ids if i], num_threads=1) if any(ids) else [])
        return [next(decoded) if i else "" for i in ids]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> MergeEncoder:
    """The encoder that this worker keeps for its tasks."""
    return MergeEncoder(path)


def encode_documents(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row for each document: id, n_tokens, ids (or only their digests).

    Columns: ``id_col``, n_tokens long, ids_sha256, decoded_sha256, and with
    ``keep_ids`` also ids array<int> and decoded string. Narrow: no shuffle.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                all_ids, by_library = encoder.encode_batch(texts), encoder.library.encode(texts, num_threads=1)
                if all_ids != by_library:
                    n = next(n for n, ids in enumerate(all_ids) if ids != by_library[n])
                    raise AssertionError(f"ids differ from the library's for a text of {len(texts[n])} characters")
                all_texts = encoder.decode_batch(all_ids)
                digits = encoder.texts
                counts = list(map(len, all_ids))
                digests = [hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest() for ids in all_ids]
                decoded_digests = [hashlib.sha256(t.encode()).hexdigest() for t in all_texts]
                arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(work, out).withColumnRenamed("id", id_col)


def decode_documents(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, array of ids); null or empty ids give an empty text."""
    source = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = source.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        for batch in batches:
            texts = encoder.decode_batch([ids or [] for ids in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return source.mapInArrow(work, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": "text"})
