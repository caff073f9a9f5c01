"""SentencePiece encoding by a score-ordered agenda, and decoding.

A merge-type vocabulary is applied as its training did: all adjacent pairs of symbols that form a
piece wait in an agenda, the best score first and the leftmost first among equals, and the pair on
top is merged until none is left. Characters without a piece become byte pieces.

No piece has a space mark after another character, so a text falls apart, without change of its
result, before each run of spaces; the constructor refuses vocabularies that are not so. The different
words of a batch are encoded side by side: their agendas are columns of numpy arrays, and each step
merges the top of every agenda. Long words have an agenda of their own, a heap. Every different word of every
Arrow batch, and a whole text of each, is also encoded by the sentencepiece library, and the job stops on a
difference.

Defined cases: null and empty texts have no ids and decode to the empty text; very long words are
encoded in n log n steps; repeated rows are encoded alike; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ragged, portions, read_table, text_of, worker_cache

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words up to this length are merged side by side; NEVER ranks pairs that are no piece.
SHORT, NEVER = 48, 1 << 30


class Agenda:
    """Encoder for one vocabulary (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(sp.get_piece_size())]
        self.ids = {sp.id_to_piece(i): i for i, s in enumerate(special) if not s}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this vocabulary goes on after a space, so texts do not fall apart into words")
        if sp.normalize(" x  \u00a0\ufb01 ") != f"{SPACE * 2}x{SPACE * 2}\u00a0\ufb01{SPACE}":
            raise ValueError("this model's normaliser changes texts")
        scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}  # equal scores, equal rank
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decimal = pa.array([str(i) for i in range(sp.get_piece_size())])
        # all ways to put a piece together from two others, by both ids; and the ids of characters
        pairs = {(self.ids[p[:k]] << 32 | self.ids[p[k:]]): (self.rank[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank, self.pair_id = np.array([pairs[k] for k in self.pairs.tolist()], np.int64).reshape(-1, 2).T
        self.characters = np.full(max((ord(p) for p in self.ids if len(p) == 1), default=0) + 2, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.characters[ord(p)] = i

    def _merge_alone(self, text: str) -> list[int]:
        """Ids of one word, with a heap; entries: rank of the joined piece, then place."""
        symbols, n, rank = list(text), len(text), self.rank.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFF
            j = right[i]
            if j >= n or not symbols[i]:
                continue
            joined = symbols[i] + symbols[j]
            if rank(joined) != top >> 32:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = joined, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(joined + symbols[k])) is not None:
                    heapq.heappush(agenda, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := rank(symbols[h] + joined)) is not None:
                heapq.heappush(agenda, r << 32 | h)
        out: list[int] = []
        for s in filter(None, symbols):
            known = self.ids.get(s)
            out.extend([known] if known is not None else [self.byte[b] for b in s.encode()])
        return out

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair of ids forms; NEVER where it forms none."""
        if not len(self.pairs):
            return np.full(len(a), NEVER), a
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER), self.pair_id[at]

    def _merge_together(self, symbol: np.ndarray, lengths: np.ndarray) -> Ragged:
        """Ids of many words, given as character ids: a step merges the top of each word's agenda, all words at once."""
        out = np.empty_like(symbol)  # a word's ids stand where its characters stood
        home, sizes = np.cumsum(lengths) - lengths, lengths.copy()
        word = np.arange(len(lengths))[lengths > 0]
        n = lengths[word]
        while len(word):
            first = np.cumsum(n) - n
            inner = np.ones(len(symbol), bool)
            inner[first + n - 1] = False  # a word's last symbol has no right neighbour
            rank, joined = np.full(len(symbol), NEVER), np.zeros_like(symbol)
            at = np.flatnonzero(inner)
            rank[at], joined[at] = self._ranked(symbol[at], symbol[at + 1])
            live = len(word)
            while True:
                best = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), first)
                at = best[best < NEVER << 32] & 0xFFFFFFFF
                going = best < NEVER << 32
                if going.sum() * 2 <= live:
                    break
                symbol[at] = joined[at]
                keep = np.ones(len(symbol), bool)
                keep[at + 1] = False
                n = n - going
                symbol, rank, joined = symbol[keep], rank[keep], joined[keep]
                at = at - np.arange(len(at))
                first = np.cumsum(n) - n
                last = first + n - 1
                rank[last] = NEVER
                inner = np.ones(len(symbol), bool)
                inner[last] = False
                again = at[inner[at]]
                rank[again], joined[again] = self._ranked(symbol[again], symbol[again + 1])
                starts = np.zeros(len(symbol), bool)
                starts[first] = True
                again = at[~starts[at]] - 1
                rank[again], joined[again] = self._ranked(symbol[again], symbol[again + 1])
            # words whose agenda is empty leave; the others go on
            done = np.repeat(~going, n)
            ready = np.flatnonzero(~going)
            place = np.repeat(home[word[ready]] - (np.cumsum(n[ready]) - n[ready]), n[ready]) + np.arange(n[ready].sum())
            out[place] = symbol[done]
            sizes[word[ready]] = n[ready]
            symbol, word, n = symbol[~done], word[going], n[going]
        used = np.repeat(home - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Ragged(out[used], sizes)

    def _with_bytes(self, ids: Ragged) -> Ragged:
        """The same with byte pieces for characters that have no piece (given as code points beyond all ids)."""
        point = ids.values - len(self.decimal)
        if not (point >= 0).any():
            return ids
        width = 1 + sum((point >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))
        ends = np.cumsum(width)
        back = np.repeat(ends, width) - 1 - np.arange(ends[-1])  # bytes of the character that follow
        point, wide = np.repeat(point, width), np.repeat(width, width)
        first = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide] | point >> 6 * back
        byte = np.where(back == wide - 1, first, 0x80 | point >> 6 * back & 0x3F)
        values = np.where(point >= 0, np.array(self.byte)[np.where(point >= 0, byte, 0)], np.repeat(ids.values, width))
        return Ragged(values, np.diff(np.r_[0, np.r_[0, ends][ids.ends]]))

    def merge(self, words: list[str]) -> Ragged:
        """Ids of each word, whose spaces are SPACE."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbol = self.characters[np.minimum(points, len(self.characters) - 1)]
        symbol = np.where(symbol < 0, len(self.decimal) + points, symbol)
        alone = lengths > SHORT
        together = self._with_bytes(self._merge_together(symbol[np.repeat(~alone, lengths)], np.where(alone, 0, lengths)))
        if not alone.any():
            return together
        long = [self._merge_alone(words[k]) for k in np.flatnonzero(alone).tolist()]
        both = Ragged(np.concatenate([together.values, *map(np.array, long)]), np.r_[together.lengths, [len(x) for x in long]])
        order = np.arange(len(words))
        order[alone] = len(words) + np.arange(len(long))
        return both.take(order)

    def encode(self, texts: pa.Array) -> Ragged:
        """The ids of each text (no nulls)."""
        odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}")
        plain = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        strange = [_WORD.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts.filter(odd).to_pylist()]
        marked = pc.binary_join_element_wise(SPACE, plain.flatten(), "")
        words = pa.concat_arrays([marked, pa.array([w for x in strange for w in x], pa.string())]).dictionary_encode()
        counts, start = np.diff(plain.offsets.to_numpy()), plain.offsets.to_numpy()[:-1].astype(np.int64)
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        counts[at] = [len(x) for x in strange]
        start[at] = len(marked) + np.cumsum(counts[at]) - counts[at]
        known = words.dictionary.to_pylist()
        ids = self.merge(known)
        self.check(known, ids)
        ends = np.cumsum(counts)
        order = np.repeat(start - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        out = ids.take(words.indices.to_numpy()[order]).joined(counts)
        if len(texts) and out[0].tolist() != self.library.encode(texts[0].as_py()):
            raise ValueError(f"the words and the library differ on {texts[0].as_py()[:200]!r}")
        return out

    def check(self, words: list[str], ids: Ragged) -> None:
        """Stops on a difference to the library, which puts one SPACE before a text by itself."""
        flat, ends = ids.values.tolist(), ids.ends.tolist()
        theirs = self.library.encode([w[1:].replace(SPACE, " ") for w in words], num_threads=1)
        for w, own, s, e in zip(words, theirs, [0, *ends], ends, strict=False):
            if own != flat[s:e] and w != SPACE:  # an empty text has no ids
                raise ValueError(f"the agenda and the library differ on {w[:200]!r}")


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def agenda(path: str) -> Agenda:
    return worker_cache(("sentencepiece", path), lambda: Agenda(path))


CODED = "doc_id long, n_tokens long, ids string, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def code(docs: DataFrame, model: str | None = None, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document; with digests their SHA-256 in place of both."""
    path = model or model_path()
    hexed = (lambda x: hashlib.sha256(x.encode()).hexdigest()) if digests else (lambda x: x)
    schema = DIGESTS if digests else CODED
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(path)
        for batch in portions(batches, most=8 << 20):
            ids = own.encode(batch.column(1))
            offsets = np.r_[0, ids.ends]
            written = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own.decimal.take(pa.array(ids.values))), ",").to_pylist()
            flat, ends = ids.values.tolist(), offsets.tolist()
            decoded = [own.library.decode(flat[s:e]) if e > s else "" for s, e in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids.lengths), pa.array(map(hexed, written), pa.string()), pa.array(map(hexed, decoded), pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return code(read_table(spark, sf_dir, "documents"), digests=True)
