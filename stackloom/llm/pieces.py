"""SentencePiece encoding and decoding in batched numpy.

Texts are cut before every run of spaces; the distinct words of a block are encoded once, those of equal length
together. Rolling hashes of all substrings up to the longest piece probe the sorted piece keys, which gives a table of
the piece, if any, that starts at each place with each length. On this table two segmentations advance all words of a
length at once:

* `viterbi` for unigram models: best-scoring path, vectorised maxima store the backpointers;
* `merges` for BPE models, whose ids are defined by merge order and not by a best path: vectorised maxima pick each
  word's best adjacent pair until no pair is a piece.

Characters without a piece become byte pieces. Decoding is the inverse and exact, but for U+2581, which the format
itself reads as a space.

Defined cases: null and empty texts have no pieces and decode to the empty text; very long words are merged
with a heap; repeated rows are encoded one by one; an empty table gives no rows; extra columns are not read, and one that
is kept under the name of a result column is returned as <name>_kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import U64, Texts, mix64, powers, slices
from .schema import carried, column, named, with_fields

SPACE = 0x2581
LONG_WORD = 256
BLOCK = 1 << 20
_BITS = 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """A vocabulary: hash keys of normal pieces in order, scores by id, bytes of each id."""

    keys: np.ndarray
    key_ids: np.ndarray
    scores: np.ndarray
    known: np.ndarray
    longest: int
    byte_ids: np.ndarray
    text: np.ndarray  # all ids' bytes, spaces for U+2581
    text_at: np.ndarray
    unigram: bool
    unknown: int

    @staticmethod
    def load(path: str) -> Pieces:
        """Reads a model on the driver; any place that its library can open."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        pieces = [model.id_to_piece(i) for i in ids]
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = np.full(256, -1, np.int32)
        raw = []
        for i in ids:
            if model.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
                raw.append(bytes([int(pieces[i][3:5], 16)]))
            else:
                raw.append(b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else pieces[i].replace(chr(SPACE), " ").encode())
        scores = np.array([model.get_score(i) for i in ids], np.float32)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        unigram = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.UNIGRAM
        return Pieces.of([pieces[i] for i in normal], normal, scores, byte_ids, raw, unigram, model.unk_id())

    @staticmethod
    def of(pieces: list[str], ids: list[int], scores: np.ndarray, byte_ids: np.ndarray, raw: list[bytes], unigram: bool, unknown: int = 0) -> Pieces:
        keys = np.array([_piece_key(p) for p in pieces], U64)
        order = np.argsort(keys)
        known = np.zeros(1 << _BITS, bool)
        known[(keys >> U64(64 - _BITS)).astype(np.int64)] = True
        at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        return Pieces(keys[order], np.array(ids, np.int32)[order], scores.astype(np.float32), known, max(map(len, pieces), default=1), byte_ids, np.frombuffer(b"".join(raw), np.uint8), at, unigram, unknown)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Ids of substring keys, -1 for none."""
        out = np.full(len(key), -1, np.int32)
        maybe = np.flatnonzero(self.known[(key >> U64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        same = self.keys[at] == key[maybe]
        out[maybe[same]] = self.key_ids[at[same]]
        return out


def _piece_key(piece: str) -> int:
    h = np.zeros(1, U64)
    for c in piece:
        h = h * U64(0x9E3779B97F4A7C15) + U64(ord(c) + 1)
    return int(mix64(h)[0])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def substring_table(vocabulary: Pieces, chars: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Piece id by place and length (0 unused), -1 for none; room: characters left in the word."""
    table = np.full((len(chars), vocabulary.longest + 1), -1, np.int32)
    live, h = np.arange(len(chars)), np.zeros(len(chars), U64)
    for size in range(1, vocabulary.longest + 1):
        fits = room[live] >= size
        live, h = live[fits], h[fits]
        if not len(live):
            break
        h = h * U64(0x9E3779B97F4A7C15) + (chars[live + size - 1].astype(U64) + U64(1))
        table[live, size] = vocabulary.find(mix64(h))
    return table


def viterbi(table: np.ndarray, scores: np.ndarray, start: np.ndarray, size: int, unknown: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Best paths of words of one size: (row of word, cuts) blocks. A character without a piece scores `unknown`."""
    n, most = len(start), table.shape[1] - 1
    best = np.full((n, size + 1), -np.inf, np.float64)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int32)
    for end in range(1, size + 1):
        length = np.arange(1, min(most, end) + 1)
        ids = table[start[:, None] + (end - length), length]
        value = np.where(ids >= 0, scores[ids], np.where(length == 1, unknown, -np.inf)) + best[:, end - length]
        pick = value.argmax(1)
        best[:, end], back[:, end] = value[np.arange(n), pick], length[pick]
    inner = np.zeros((n, size + 1), bool)
    inner[:, size] = True
    at = np.full(n, size)
    while (at > 0).any():
        at = at - np.where(at > 0, back[np.arange(n), at], 0)
        inner[np.arange(n), at] = True
    count = inner.sum(1)
    out = []
    for k in np.unique(count):
        rows = np.flatnonzero(count == k)
        out.append((rows, np.nonzero(inner[rows])[1].reshape(len(rows), k)))
    return out


def merges(table: np.ndarray, scores: np.ndarray, start: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """BPE of words of one size: in each round every word that can joins its best pair, the left one among equals."""
    rows, most = np.arange(len(start)), table.shape[1] - 1
    cuts = np.tile(np.arange(size + 1), (len(start), 1))
    out = []
    while len(rows):
        if cuts.shape[1] < 3:
            out.append((rows, cuts))
            break
        length = cuts[:, 2:] - cuts[:, :-2]
        ids = table[start[rows][:, None] + cuts[:, :-2], np.minimum(length, most)]
        value = np.where((ids >= 0) & (length <= most), scores[ids], -np.inf)
        pick = value.argmax(1)
        able = value[np.arange(len(rows)), pick] > -np.inf
        if not able.all():
            out.append((rows[~able], cuts[~able]))
            rows, cuts, pick = rows[able], cuts[able], pick[able]
        cuts = np.where(np.arange(cuts.shape[1] - 1) <= pick[:, None], cuts[:, :-1], cuts[:, 1:])
    return out


def merge_long(table: np.ndarray, scores: np.ndarray, start: int, size: int) -> np.ndarray:
    """Cuts of one long word by BPE with a heap of pairs."""
    most = table.shape[1] - 1
    end, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < size and end[b] - a <= most and (i := table[start + a, end[b] - a]) >= 0:
            heapq.heappush(heap, (-float(scores[i]), a, end[b]))

    for a in range(size - 1):
        offer(a)
    while heap:
        _, a, b = heapq.heappop(heap)
        middle = end[a]
        if not alive[a] or middle >= size or not alive[middle] or end[middle] != b:
            continue
        alive[middle], end[a] = False, b
        if b < size:
            before[b] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return np.array([*[a for a in range(size) if alive[a]], size])


def encode_words(vocabulary: Pieces, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each word's ids start) of words given as code points."""
    sizes = np.diff(at)
    room = np.repeat(at[1:], sizes) - np.arange(len(chars))
    table = substring_table(vocabulary, chars, room)
    unknown = float(vocabulary.scores[vocabulary.key_ids].min(initial=0)) - 10
    cut_words, cut_places = [], []
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.unique(sizes))
    for group in np.split(order, bounds[1:]) if len(order) else []:
        size = int(sizes[group[0]])
        if size > LONG_WORD and not vocabulary.unigram:
            done = [(np.array([i]), merge_long(table, vocabulary.scores, int(at[w]), size)[None]) for i, w in enumerate(group)]
        elif vocabulary.unigram:
            done = viterbi(table, vocabulary.scores, at[group], size, unknown)
        else:
            done = merges(table, vocabulary.scores, at[group], size)
        for rows, cuts in done:
            cut_words.append(np.repeat(group[rows], cuts.shape[1] - 1))
            cut_places.append(np.stack((cuts[:, :-1].ravel(), np.diff(cuts, axis=1).ravel())))
    if not cut_words:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    word, (place, length) = np.concatenate(cut_words), np.concatenate(cut_places, 1)
    order = np.lexsort((place, word))
    word, place, length = word[order], place[order] + at[word[order]], length[order]
    ids = table[place, length]
    # A character without a piece becomes the pieces of its UTF-8 bytes.
    c = np.where(ids < 0, chars[place], 0)
    width = np.where(ids < 0, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), 1)
    c, w, first = np.repeat(c, width), np.repeat(width, width), np.repeat(np.cumsum(width) - width, width)
    k = np.arange(len(c)) - first
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w]
    byte = np.where(k == 0, np.where(w == 1, c, lead | (c >> (6 * (w - 1)))), 0x80 | ((c >> (6 * (w - 1 - k))) & 0x3F))
    fallback = vocabulary.byte_ids[byte & 0xFF]
    out = np.where(np.repeat(ids, width) >= 0, np.repeat(ids, width), np.where(fallback >= 0, fallback, vocabulary.unknown)).astype(np.int32)
    return out, np.searchsorted(np.repeat(word, width), np.arange(len(at)))


def encode(vocabulary: Pieces, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids start)."""
    n, chars_of = len(texts), texts.n_chars()
    filled = np.flatnonzero(chars_of)
    code = np.frombuffer(texts.bytes.tobytes().decode().encode("utf-32-le"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    at = np.concatenate(([0], np.cumsum(chars_of)))
    chars = np.insert(code, at[:-1][filled], 0x20)
    chars[chars == 0x20] = SPACE
    heads = (at[:-1] + np.cumsum(chars_of > 0) - (chars_of > 0))[filled]
    space = chars == SPACE
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[heads] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(chars))
    up, down = powers(len(chars), 0)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(chars.astype(U64) + U64(1)) * up[: len(chars)], dtype=U64)))
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
    sizes = (ends - starts)[one]
    ids, word_at = encode_words(vocabulary, chars[_ragged(starts[one], sizes)], np.concatenate(([0], np.cumsum(sizes))))
    each = np.diff(word_at)[inverse]
    out = ids[_ragged(word_at[:-1][inverse], each)]
    words_before = np.searchsorted(starts, np.append(heads, len(chars)))
    total = np.concatenate(([0], np.cumsum(each)))[words_before]
    text_at = np.zeros(n + 1, np.int64)
    text_at[1:][filled] = np.diff(total)
    return out, np.cumsum(text_at)


def decode(vocabulary: Pieces, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text's bytes start)."""
    sizes = np.diff(vocabulary.text_at)[ids]
    data = vocabulary.text[_ragged(vocabulary.text_at[:-1][ids], sizes)]
    ends = np.concatenate(([0], np.cumsum(sizes)))[at]
    filled = ends[1:] > ends[:-1]
    led = np.zeros(len(filled), bool)
    led[filled] = data[ends[:-1][filled]] == 0x20  # the space put before each text
    keep = np.ones(len(data), bool)
    keep[ends[:-1][led]] = False
    return data[keep], ends - np.concatenate(([0], np.cumsum(led)))


def encode_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str | None = None, best_path: bool = False) -> DataFrame:
    """The columns `keep`, ids, n_tokens, and round_trip: whether decoding the ids gives the text back.

    best_path: Viterbi also for a model of merges, over its pieces and their scores; its ids are then not the library's.
    """
    vocabulary = Pieces.load(model or default_model())
    sent = docs.sparkSession.sparkContext.broadcast(replace(vocabulary, unigram=True) if best_path else vocabulary)
    source = carried(docs, keep)
    fields = source.schema.fields[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=BLOCK):
            texts = Texts(part.column("text"))
            ids, at = encode(sent.value, texts)
            data, ends = decode(sent.value, ids, at)
            blob = data.tobytes()
            if blob == texts.bytes.tobytes() and np.array_equal(ends, texts.offsets):
                same = np.ones(len(texts), bool)
            else:
                same = np.array([blob[ends[i] : ends[i + 1]] == texts.raw(i).replace(chr(SPACE).encode(), b" ") for i in range(len(texts))], bool)
            kept = [c for c in part.schema.names if c != "text"]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, pa.array(np.diff(at)), pa.array(same)], names=[*kept, "ids", "n_tokens", "round_trip"])

    return named(source.mapInArrow(run, with_fields(fields, "ids array<int>, n_tokens long, round_trip boolean")), keep)


def decode_ids(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: str | None = None) -> DataFrame:
    """The columns `keep` and the text of `ids`; bytes that are no UTF-8 become replacement characters."""
    sent = rows.sparkSession.sparkContext.broadcast(Pieces.load(model or default_model()))
    source = rows.select(*[column(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col("ids").cast("array<int>").alias("ids"))
    fields = source.schema.fields[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = [[i for i in x or [] if i is not None and 0 <= i < len(sent.value.scores)] for x in part.column("ids").to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            data, ends = decode(sent.value, np.array([i for x in lists for i in x], np.int32), at)
            out = [data[ends[i] : ends[i + 1]].tobytes().decode(errors="replace") for i in range(len(lists))]
            kept = [c for c in part.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(out, pa.string())], names=[*kept, "text"])

    return named(source.mapInArrow(run, with_fields(fields, "text string")), keep)
