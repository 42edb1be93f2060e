"""SentencePiece merge-type encoding with seeded merge dropout, and its decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from logloom.llm.common import frugal, mix, slices, small_batches, text_buffer, without
from logloom.llm.packing import TOKENIZERS, read_bytes

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
#: Words of more signs go through the agenda one by one, shorter ones many at a time.
WIDE = 48
#: Words are merged together with those up to the next of these lengths.
WIDTHS = np.array([4, 8, 12, 16, 24, WIDE])
RESULT = ("pieces",)

_SPACE = 0x2581
_OUTSIDE = 1 << 21  # symbols of signs that the vocabulary lacks, plus the code point
_PAIR = 22  # bits of the right symbol in the key of a pair
_FILL = (1 << _PAIR) - 1  # behind the end of a word, part of no pair
_NONE = np.iinfo(np.int32).max
_ROWS = 1 << 15
_SLICE = 1 << 20


class PieceModel:
    """Pieces, their order of merging and the byte pieces of a model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = held.get_piece_size()
        self.pieces = [held.id_to_piece(i) for i in range(n)]
        plain = [
            not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i) or held.is_unused(i))
            for i in range(n)
        ]
        self._plain = plain
        scores = np.array([held.get_score(i) for i in range(n)])
        #: Merges with the higher score come first.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if held.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        raw = [
            bytes([int(p[3:5], 16)]) if held.is_byte(i) else p.replace("▁", " ").encode() if plain[i] else b""
            for i, p in enumerate(self.pieces)
        ]
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @cached_property
    def sign(self) -> np.ndarray:
        """Piece of each sign, or the symbol of one that the vocabulary lacks."""
        sign = np.arange(_OUTSIDE, _OUTSIDE + 0x110000, dtype=np.int32)
        for i, piece in enumerate(self.pieces):
            if self._plain[i] and len(piece) == 1:
                sign[ord(piece)] = i
        # A literal U+2581 would decode to a space, so it goes as bytes.
        if sign[_SPACE] < _OUTSIDE:
            sign[0x20], sign[_SPACE] = sign[_SPACE], _OUTSIDE + _SPACE
        return sign

    @cached_property
    def merge_of(self) -> dict[int, int]:
        """Piece that a pair of pieces makes."""
        ids = {p: i for i, p in enumerate(self.pieces) if self._plain[i]}
        merges: dict[int, int] = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left << _PAIR | right] = i
        return merges

    @cached_property
    def _slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """Keys of the pairs in order, their pieces and ranks, and where each slot's pair is.

        The last entry stands for no pair; a slot that several pairs share has -1.
        """
        keys = np.array(sorted(self.merge_of), np.int64)
        made = np.array([self.merge_of[k] for k in keys.tolist()], np.int32)
        bits = max(len(keys), 1).bit_length() + 3
        shift = np.uint64(64 - bits)
        slot = _hashed(keys, shift)
        at = np.full(1 << bits, len(keys), np.int32)
        at[slot] = np.arange(len(keys))
        at[np.flatnonzero(np.bincount(slot, minlength=1 << bits) > 1)] = -1
        rank = np.append(self.rank[made], np.int32(_NONE))
        return np.append(keys, -1), np.append(made, np.int32(-1)), rank, at, shift

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece that two symbols make together and its rank, -1 and the highest if none."""
        keys, made, rank, slots, shift = self._slots
        key = left.astype(np.int64) << _PAIR | right
        at = slots[_hashed(key, shift)]
        shared = np.nonzero(at < 0)
        if len(shared[0]):
            at[shared] = np.searchsorted(keys[:-1], key[shared])
        at[keys[at] != key] = len(keys) - 1
        return made[at], rank[at]


def _hashed(key: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)


@lru_cache(maxsize=1)
def piece_model(model: bytes) -> PieceModel:
    """The same model for all tasks of a worker."""
    return PieceModel(model)


def units(text: str) -> list[str]:
    """Words with the spaces before them, the first of which is left out.

    No piece has a space after another sign, so nothing is merged across words.
    """
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, gap = [], 0
    for part in parts:
        if part:
            out.append(" " * gap + part)
            gap = 0
        else:
            gap += 1
    if gap and text:
        out.append(" " * (gap - 1))
    return out


def ranges(size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Indices of all runs ``begin .. begin + size``, one after the other."""
    step = np.cumsum(size) - size
    return np.repeat(begin - step, size) + np.arange(int(size.sum()))


def _spot(start, middle, end) -> np.ndarray:
    """Number of a candidate merge within its word, never 0; ``start < middle < end``."""
    at = np.uint64(start) * np.uint64(0x9E3779B97F4A7C15)
    at = at + np.uint64(middle) * np.uint64(0xC2B2AE3D27D4EB4F)
    return at + np.uint64(end) * np.uint64(0x165667B19E3779F9)


def _skipped(key, spot, limit: int):
    """Whether the candidate merge of two symbols at this spot is left out."""
    return mix(spot ^ key) < np.uint64(limit)


def _limit(dropout: float) -> int:
    return min(int(dropout * 2**64), 2**64 - 1)


def _agenda(model: PieceModel, symbols: list[int], key: int, limit: int) -> list[int]:
    """Merges of one long word, best candidate first."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []
    rank, merges = model.rank, model.merge_of

    def offer(i: int) -> None:
        j = after[i]
        if j >= n or symbols[i] >= _OUTSIDE or symbols[j] >= _OUTSIDE:
            return
        made = merges.get(symbols[i] << _PAIR | symbols[j])
        if made is not None:
            heapq.heappush(heap, (int(rank[made]), i, end[j], made))

    for i in range(n):
        offer(i)
    word = np.array([key], np.uint64)
    while heap:
        _, i, stop, made = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        if merges.get(symbols[i] << _PAIR | symbols[j]) != made:
            continue
        if limit and _skipped(word, _spot(np.array([i]), np.array([j]), np.array([stop])), limit)[0]:
            continue
        symbols[i], end[i], alive[j] = made, stop, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [symbols[i] for i in range(n) if alive[i]]


def _together(
    model: PieceModel,
    symbols: np.ndarray,
    size: np.ndarray,
    keys: np.ndarray | None = None,
    limit: int = 0,
    barred: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many words at once, filled up to one length: in each round every word takes its best merge.

    Whether a candidate is skipped follows from its place in the word and the key
    alone, so the rounds take the same merges as the agenda. ``barred`` names one
    candidate of each row that is skipped besides. Returns the symbols, how many of
    each row are left, and the candidates that were merged, with 0 after the last.
    """
    n, width = symbols.shape
    left_over = np.zeros(n, np.int64)
    done = np.zeros((n, width), np.int32)
    rows = np.arange(n)
    s = symbols.astype(np.int32)
    taken = np.zeros((n, width), np.uint64)
    edge = np.broadcast_to(np.arange(width + 1, dtype=np.int16), (n, width + 1))

    def weigh(row: np.ndarray, left, right, start, middle, end) -> np.ndarray:
        rank = model.merged(left, right)[1]
        if limit or barred is not None:
            spot = _spot(start, middle, end)
            if limit:
                rank[_skipped(keys[row], spot, limit)] = _NONE
            if barred is not None:
                rank[spot == barred[row]] = _NONE
        return rank

    cost = weigh(rows[:, None], s[:, :-1], s[:, 1:], edge[:, :-2], edge[:, 1:-1], edge[:, 2:])
    while True:
        now = s.shape[1]
        if now > 1:
            best = cost.argmin(axis=1)
            go = cost[np.arange(len(rows)), best] < _NONE
        else:
            best, go = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        if not go.all():
            stay = ~go
            done[rows[stay], :now] = s[stay]
            left_over[rows[stay]] = size[rows[stay]] - (width - now)
            rows, s, edge, cost, best = rows[go], s[go], edge[go], cost[go], best[go]
        if not len(rows):
            return done, left_over, taken
        r = np.arange(len(rows))
        taken[rows, width - now] = _spot(edge[r, best], edge[r, best + 1], edge[r, best + 2])
        s[r, best] = model.merged(s[r, best], s[r, best + 1])[0]
        # The symbol behind the best place goes, with the edge and the candidate between them.
        before = np.arange(now)[None, :] <= best[:, None]
        s = np.where(before[:, :-1], s[:, :-1], s[:, 1:])
        edge = np.where(before, edge[:, :-1], edge[:, 1:])
        cost = np.where(before[:, 1:-1], cost[:, :-1], cost[:, 1:])
        for side in (-1, 0):
            at = best + side
            ok = np.flatnonzero((at >= 0) & (at < now - 2))
            i = at[ok]
            cost[ok, i] = weigh(rows[ok], s[ok, i], s[ok, i + 1], edge[ok, i], edge[ok, i + 1], edge[ok, i + 2])


def _symbols(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words, each with a space before it, and how many each has."""
    text = "".join([" " + w for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return model.sign[points], np.array([len(w) + 1 for w in words], np.int64)


def _first_skipped(taken: np.ndarray, row: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
    """First of the merges in each ``row`` of ``taken`` that ``keys`` skip, -1 if none."""
    first = np.full(len(row), -1)
    for a in range(0, len(row), _ROWS):
        spot = taken[row[a : a + _ROWS]]
        gone = _skipped(keys[a : a + _ROWS, None], spot, limit) & (spot != 0)
        some = np.flatnonzero(gone.any(axis=1))
        first[a + some] = gone[some].argmax(axis=1)
    return first


class _Forms:
    """Pieces of occurrences, handed in by and by and put in order at the end."""

    def __init__(self, n: int):
        self.size = np.zeros(n, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, own: np.ndarray, row: np.ndarray, pieces: np.ndarray, left: np.ndarray) -> None:
        """Occurrences ``own`` have the pieces of these rows."""
        flat = pieces[np.arange(pieces.shape[1])[None, :] < left[:, None]].astype(np.int32)
        self.size[own] = left[row]
        self.held.append((own, row, flat, left))

    def joined(self) -> np.ndarray:
        begin = np.cumsum(self.size) - self.size
        ids = np.zeros(int(self.size.sum()), np.int64)
        for own, row, flat, left in self.held:
            ids[ranges(left[row], begin[own])] = flat[ranges(left[row], (np.cumsum(left) - left)[row])]
        return ids


def encode_units(
    model: PieceModel, words: list[str], keys: np.ndarray, dropout: float, word: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words one after the other, and how many each has.

    With ``word``, those of the occurrences ``words[word]``, each with a key of its
    own. Work is saved exactly: the merges of a word without dropout hold for every
    occurrence whose key skips none of them. So do those with one candidate skipped
    for every occurrence whose key skips that one first and none after it. All
    others are merged on their own.
    """
    limit = _limit(dropout)
    symbols, size = _symbols(model, words)
    begin = np.cumsum(size) - size
    if word is None:
        word = np.arange(len(words))
    forms = _Forms(len(word))
    width_of = size[word]
    wide = np.flatnonzero(width_of > WIDE)
    kinds, kind = np.unique(word[wide], return_inverse=True)
    each = [(wide[i : i + 1], k) for i, k in enumerate(kind.tolist())]
    for some, k in each if limit else [(wide[kind == k], k) for k in range(len(kinds))]:
        x = symbols[begin[kinds[k]] :][: size[kinds[k]]].tolist()
        out = np.array([_agenda(model, x, int(keys[some[0]]), limit)])
        forms.add(some, np.zeros(len(some), np.int64), out, np.array([out.shape[1]]))
    group = np.where(width_of > WIDE, -1, np.searchsorted(WIDTHS, width_of))
    for g, width in enumerate(WIDTHS.tolist()):
        own = np.flatnonzero(group == g)
        if not len(own):
            continue
        kinds, kind = np.unique(word[own], return_inverse=True)
        own_size, cols = size[kinds], np.arange(width)
        start = symbols[np.minimum(begin[kinds][:, None] + cols, len(symbols) - 1)]
        start[cols >= own_size[:, None]] = _FILL
        got, left, taken = _together(model, start, own_size)
        if limit:
            first = _first_skipped(taken, kind, keys[own], limit)
            calm = first < 0
            forms.add(own[calm], kind[calm], got, left)
            own, kind, first = own[~calm], kind[~calm], first[~calm]
            pairs, pair = np.unique(kind * width + first, return_inverse=True)
            of = pairs // width
            got, left, taken = _together(model, start[of], own_size[of], barred=taken[of, pairs % width])
            calm = _first_skipped(taken, pair, keys[own], limit) < 0
            forms.add(own[calm], pair[calm], got, left)
            own, kind = own[~calm], kind[~calm]
            for a in range(0, len(own), _ROWS):
                part, of = own[a : a + _ROWS], kind[a : a + _ROWS]
                got, left, _ = _together(model, start[of], own_size[of], keys[part], limit)
                forms.add(part, np.arange(len(part)), got, left)
        else:
            forms.add(own, kind, got, left)
    ids, size = forms.joined(), forms.size
    strange = np.flatnonzero(ids >= _OUTSIDE)
    if len(strange):  # signs outside the vocabulary become their bytes
        of = np.repeat(np.arange(len(word)), size)
        raw = [chr(x).encode("utf-8", "surrogatepass") for x in (ids[strange] - _OUTSIDE).tolist()]
        times = np.ones(len(ids), np.int64)
        times[strange] = [len(x) for x in raw]
        at = np.cumsum(times) - times
        ids, of = np.repeat(ids, times), np.repeat(of, times)
        places = ranges(times[strange], at[strange])
        ids[places] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        size = np.bincount(of, minlength=len(word))
    return ids, size


def _words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different units of all texts, which of them each unit is, and how many each text has."""
    odd = np.array([not t or t[0] == " " or t[-1] == " " or "  " in t for t in texts], bool)
    plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string()), " ")
    loose = [units(t) if t else [] for t, o in zip(texts, odd) if o]
    count = np.zeros(len(texts), np.int64)
    count[~odd] = pc.list_value_length(plain).to_numpy(zero_copy_only=False)
    count[odd] = [len(found) for found in loose]
    rest = pa.array([unit for found in loose for unit in found], pa.large_string())
    coded = pa.concat_arrays([plain.flatten(), rest]).dictionary_encode()
    order = np.argsort(odd, kind="stable")
    begin = np.zeros(len(texts), np.int64)
    begin[order] = np.cumsum(count[order]) - count[order]
    word = coded.indices.to_numpy()[ranges(count, begin)].astype(np.int64)
    return coded.dictionary.to_pylist(), word, count


def encode_texts(model: PieceModel, texts: list[str], seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and how many each has."""
    known, word, count = _words(texts)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    keys = np.zeros(len(word), np.uint64)
    if dropout > 0:
        nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        own = np.array([xxhash.xxh3_64_intdigest(t, seed) for t in texts], np.uint64)
        keys = mix(np.repeat(own, count) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ids, size = encode_units(model, known, keys, dropout, word)
    ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(count)]
    return ids, np.diff(ends, prepend=0)


def encode_pieces(
    docs: DataFrame,
    text_col: str = "text",
    seed: int = 0,
    dropout: float = DROPOUT,
    model: str = f"{TOKENIZERS}/{MODEL}",
) -> DataFrame:
    """``docs`` with ``pieces``, the piece ids of the whole text.

    Adjacent symbols are merged in the order of the pieces' scores. Each candidate
    merge is skipped with probability ``dropout``; a hash keyed by ``seed``, the
    whole text, the word's place in it and the candidate's place in the word decides,
    so every occurrence is drawn by itself and a repeated task gives the same pieces.
    Without dropout the pieces are those of the model itself. Signs outside the
    vocabulary, and a literal U+2581, become byte pieces, so that decoding is
    lossless.

    Null and empty texts have no pieces. Repeated rows get the same pieces, empty
    tables give empty results, and an input column ``pieces`` is replaced.
    """
    docs = small_batches(without(docs, RESULT))
    held = docs.sparkSession.sparkContext.broadcast(read_bytes(model))
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("pieces", ArrayType(IntegerType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(held.value)
        for batch in batches:
            _, starts = text_buffer(batch.column(at))
            for a, z in slices(starts, _SLICE):
                part = batch.slice(a, z - a)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids, size = encode_texts(own, texts, seed, dropout)
                cuts = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "pieces"])

    return docs.mapInArrow(frugal(task), schema)


def decode_pieces(
    frame: DataFrame,
    pieces_col: str = "pieces",
    to: str = "decoded",
    model: str = f"{TOKENIZERS}/{MODEL}",
) -> DataFrame:
    """``frame`` with the text of its pieces in ``to``.

    Null and empty lists decode to an empty text; ids that the model lacks are an
    error. An input column named like ``to`` is replaced.
    """
    frame = small_batches(without(frame, [to]))
    held = frame.sparkSession.sparkContext.broadcast(read_bytes(model))
    at = frame.columns.index(pieces_col)
    schema = StructType([*frame.schema.fields, StructField(to, StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(held.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(at)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                raw = own.raw[ranges(own.raw_size[ids], own.raw_at[ids])]
                length = np.concatenate(([0], np.cumsum(own.raw_size[ids])))
                stop = length[np.cumsum(size)]
                start = np.concatenate(([0], stop[:-1]))
                # The first space is the one that encoding put there.
                begin = np.where(size > 0, start + 1, start)
                texts = [raw[i:j].tobytes().decode() for i, j in zip(begin.tolist(), stop.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, to]
                )

    return frame.mapInArrow(frugal(task), schema)
