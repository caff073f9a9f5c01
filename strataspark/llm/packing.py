"""Best-fit packing of token sequences, certified by dual-feasible lower bounds.

Documents become token ids with the tokenizers library and end in one id 0; those longer than a
sequence are cut. Full pieces are sequences by themselves. All others are dealt out to partitions
at random, and each partition packs its own pieces by best-fit decreasing. A lower bound from
dual-feasible functions says how few sequences could hold a partition's pieces. Where a partition
uses more, it has a gap: such partitions exchange pieces - theirs are dealt out anew, among fewer
partitions, together with what lies in sequences that are not full - and pack again. Pieces are dealt by row, not by
content, so copies spread like any others. A gap that is still open in the last round is reported with its pieces.

Defined cases: null and empty texts are one piece of length 1 (the end id); ties go by doc_id and
piece; repeated rows are packed as rows of their own; an empty table gives no pieces; extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ragged, TwoGenerations, portions, read_table, stage, text_of, worker_cache

MAX_TOKENS = 2048
VOCABULARY = "word_bpe_49k.json"
#: Pieces that one task packs at once.
PER_PARTITION = 8192
ROUNDS = 6

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words whose pre-tokens are plain to see; all others go to the library whole.
_PLAIN = f"^[{_LETTERS}0-9!-&(-;=-~]+$"
_PARTS = f"([{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+)"
#: Taken for spaces by Arrow, but not by the tokenizer; and the mark that is used between pre-tokens.
_SEPARATORS = "[\x01\x1c-\x1f]"


class WordIds:
    """Token ids of texts, as little-endian uint32.

    The vocabulary has no tokens across white space, so a text's ids are its words' ids one after
    the other, and a plain word's ids those of its pre-tokens. Arrow splits a batch into words, finds
    the different ones and splits these into pre-tokens; different pre-tokens are looked up in a bounded
    cache before the library encodes what is new, and numpy puts the ids together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts = TwoGenerations(300_000)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _library_parts(self, parts: list[str]) -> list[bytes]:
        """The same for pre-tokens, many in one call: each ends with the one token of its that ends a word."""
        out: list[bytes] = []
        lots = [parts[k : k + 500] for k in range(0, len(parts), 500)]
        for some, x in zip(lots, self.library.encode_batch_fast([" ".join(p) for p in lots], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, dtype="<u4")
            at = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(at) == len(some) and at[-1] == len(ids):
                out += [ids[s:e].tobytes() for s, e in zip([0, *at], at, strict=False)]
            else:
                out += self._library(some)
        return out

    def _learn(self, new: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(new, pa.string()), _PLAIN).to_pylist()
        for kind, encode in ((True, self._library_parts), (False, self._library)):
            own = [p for p, is_plain in zip(new, plain, strict=True) if is_plain == kind]
            self.parts.now.update(zip(own, encode(own), strict=True))

    def _words(self, words: pa.Array) -> Ragged:
        """The ids of different words; plain ones are split, an empty word has none."""
        plain = pc.match_substring_regex(words, _PLAIN)
        marked = pc.replace_substring_regex(pc.utf8_lower(words), _PARTS, "\x01\\1")
        cut = pc.split_pattern(pc.if_else(plain, marked, pc.binary_join_element_wise("", words, "\x01")), "\x01", max_splits=None)
        # the first is the empty piece before a mark
        parts = cut.flatten().dictionary_encode()
        known = parts.dictionary.to_pylist()
        if ask := self.parts.absent(set(known) - {""}):
            self._learn(ask)
        get = self.parts.now.get
        ids = Ragged.of([get(p, b"") for p in known])
        self.parts.make_room()
        return ids.take(parts.indices.to_numpy()).joined(np.diff(cut.offsets.to_numpy()))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (no nulls)."""
        odd = pc.match_substring_regex(texts, _SEPARATORS)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        words = split.flatten().dictionary_encode()
        found = self._words(words.dictionary).take(words.indices.to_numpy()).joined(np.diff(split.offsets.to_numpy()))
        for k, strange in enumerate(odd.to_pylist()):
            yield np.frombuffer(self._library([texts[k].as_py()])[0], "<u4") if strange else found[k]


def encoder(path: str) -> WordIds:
    """One for each worker process, which later tasks use again."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(("packing", path), lambda: WordIds(path))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row for each piece of each document (PIECES)."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in portions(batches):
            rows: list[tuple] = []
            for i, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[at : at + max_tokens]
                    rows.append((i, k, at, len(part), zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that these pieces need at least.

    The largest of the plain sum and two families of dual-feasible functions: u(e), which counts
    pieces above capacity - e as whole ones and drops those below e, and f(k), which rounds
    x (k + 1) / capacity down to whole k-ths.
    """
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    size = np.bincount(x, minlength=capacity + 1)
    count, total = np.cumsum(size), np.cumsum(size * np.arange(capacity + 1))
    e = np.arange(1, capacity // 2 + 1)
    whole = count[-1] - count[capacity - e]
    between = total[capacity - e] - total[e - 1]
    best = max(best, int((whole + -(-between // capacity)).max()))
    for k in range(1, 21):
        scaled = x * (k + 1)
        exact = scaled % capacity == 0
        # whole k-ths, and x itself where that is exact: compared in units of 1 / (k capacity)
        value = np.where(exact, x * k, scaled // capacity * capacity).sum()
        best = max(best, -(-int(value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. Bins are kept by free space; a bit set of the spaces in use finds the least that fits."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, made = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = in_use >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                in_use ^= 1 << space
        else:
            space, b = capacity, made
            made += 1
        bins[i] = b
        left = space - size
        if left:
            by_space[left].append(b)
            in_use |= 1 << left
    return bins


PACKED = f"{PIECES}, group long, bin long, offset long, loose boolean, gap long"


def _pack(capacity: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        pdf = pdf.iloc[order].reset_index(drop=True)
        b, n = bins[order], lengths[order]
        before = np.cumsum(n) - n
        first = np.r_[True, b[1:] != b[:-1]]
        filled = np.bincount(b, weights=n).astype(np.int64)
        gap = len(filled) - lower_bound(lengths, capacity)
        # one sequence need not be full even in a best packing; with a gap, pieces in others that aren't full move too
        partial = np.flatnonzero(filled < capacity)
        give = partial if gap > 0 else partial[np.argsort(filled[partial], kind="stable")][:1]
        pdf["bin"], pdf["offset"] = b, before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["loose"], pdf["gap"] = np.isin(b, give) & (not last), gap if last else 0
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "group", "bin", "offset", "loose", "gap"]]

    return run


def dealt(pieces: DataFrame, groups: int, seed: int) -> DataFrame:
    """pieces, a table, with `group`: rows spread at random over groups, whatever they hold."""
    numbered = pieces.withColumn("row_", F.monotonically_increasing_id())
    return numbered.withColumn("group", F.pmod(F.xxhash64("row_", F.lit(seed)), F.lit(groups))).drop("row_")


def pack(cut: DataFrame, capacity: int = MAX_TOKENS, per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """PIECES with sequence_id, offset and gap; cut is read more than once, so it should be a table.

    gap: by how many sequences the piece's partition is above its lower bound at the end, 0 where it is certified; pieces
    that found a place in an earlier round lie in full sequences, or in the one that need not be full. Each round's result is held in the shared folder. Round by round the pieces that are still
    loose go to fewer partitions; once they fit into one, all places stand.
    """
    full = cut.where(F.col("length") >= capacity)
    # full pieces have sequences by themselves: a number for each row
    done = full.select("*", F.lit(-1).cast("long").alias("group"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))
    parts = [done.withColumn("round_", F.lit(0))]
    rest = cut.where(F.col("length") < capacity)
    n = rest.count()
    for k in range(1, rounds + 1):
        groups = max(1, -(-n // per_partition))
        last = k == rounds or groups == 1
        packed = stage(dealt(rest, groups, k).groupBy("group").applyInPandas(_pack(capacity, last), PACKED), f"pack{k}")
        parts.append(packed.where(~F.col("loose")).drop("loose").withColumn("round_", F.lit(k)))
        rest = packed.where("loose").select(*cut.columns)
        if last or not (n := rest.count()):
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # full pieces have their own number; others, below zero, round (3 bits), group (31) and bin (29)
    number = F.when(F.col("round_") == 0, F.col("bin")).otherwise(-(F.shiftleft(F.shiftleft(F.col("round_").cast("long"), 31).bitwiseOR(F.col("group")), 29).bitwiseOR(F.col("bin"))) - 1)
    return out.select(*cut.columns, number.alias("sequence_id"), "offset", "gap")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(stage(pieces(read_table(spark, sf_dir, "documents")), "pieces"))
