"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams of words (word ends marked), learned from labelled texts. A
text is a mixture of languages: its words' trigram likelihoods enter expectation-maximisation, which estimates the
share of each language. Sets are then compared by likelihood less a penalty of `PENALTY` * ln(words) for each further
language: of the single languages the likeliest, and the sets of the 2, 3, ... largest shares up to all languages. No
set can be likelier than all languages together, so a text is done once that likelihood, less the next penalty, falls
behind its best set; there is no largest set. The prediction is the largest share of the chosen set.

Learned on a bounded sample: about `SAMPLE` labelled texts of each language, chosen by a hash of doc_id (all texts of
a language that has fewer). Counting is spread over the executors; the driver gets one count for each language and
trigram bucket at most, and at most `most` languages (an error beyond, as the model is sent to all executors).

Defined cases: `und` with score 0 for null texts, texts without a letter, and if no language was learned; very long
texts are read whole; repeated rows are judged one by one; an empty table gives no rows; extra columns are not read, and
one that is kept under the name of a result column is returned as <name>_kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpointed
from .columnar import LOWER, Texts, Words, slices
from .schema import carried, named, with_fields
from .toxicity import held_out

SAMPLE, BITS, SMOOTHING, PENALTY, ROUNDS, LANGUAGES = 3000, 15, 0.5, 2.0, 6, 512
UNKNOWN = "und"
#: ASCII letters and all non-ASCII bytes.
WORD_BY_LETTER = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])


def trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte's trigram, where each word's trigrams start)."""
    data = LOWER[words.texts.bytes].astype(np.uint32)
    sizes = words.ends - words.starts
    at = np.concatenate(([0], np.cumsum(sizes)))
    where = np.repeat(words.starts - at[:-1], sizes) + np.arange(at[-1])
    first, last = np.zeros(at[-1], bool), np.zeros(at[-1], bool)
    first[at[:-1]], last[at[1:] - 1] = True, True
    before = np.where(first, 0, data[np.maximum(where - 1, 0)])
    after = np.where(last, 0, data[np.minimum(where + 1, max(len(data) - 1, 0))])
    code = (before << 16 | data[where] << 8 | after).astype(np.uint32)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32), at


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # bucket, language


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for part in slices(batches):
        words = Words(Texts(part.column("text")), WORD_BY_LETTER)
        if not len(words):
            continue
        grams, at = trigrams(words)
        size = at[words.at[1:]] - at[words.at[:-1]]
        langs = np.array(part.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            own = np.repeat(langs == lang, size)
            total[lang] = total.get(lang, 0) + np.bincount(grams[own], minlength=1 << BITS)
    for lang, n in total.items():
        bucket = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(n[bucket].astype(np.int64))], names=["lang", "bucket", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> Languages:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    size = checkpointed(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))
    if (n := size.count()) > most:
        raise ValueError(f"{n} languages are labelled; at most {most} make a model")
    # A join by shuffle would send all texts of a language to one task; the sizes are few, as just counted.
    spread = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_003)) / 1_000_003.0
    some = known.join(F.broadcast(size), "lang").where(spread * F.col("size") < sample).select("lang", F.col("text").cast("string").alias("text"))
    counted = some.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    names = sorted(rows["lang"].unique())
    table = np.full((1 << BITS, len(names)), SMOOTHING)
    np.add.at(table, (rows["bucket"].to_numpy(int), np.searchsorted(names, rows["lang"].to_numpy(str)) if names else []), rows["n"].to_numpy(float))
    return Languages(names, np.log(table / table.sum(0)).astype(np.float32) if names else table.astype(np.float32))


def _em(share: np.ndarray, likely: np.ndarray, doc: np.ndarray, heads: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds, and the log-likelihood that the last ones give (without the words' common factors)."""
    for _ in range(rounds):
        r = share[doc] * likely
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, heads, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((share[doc] * likely).sum(1)), heads)


def mixtures(model: Languages, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(texts with words, their language shares; 0 outside the chosen set)."""
    texts = np.flatnonzero(words.counts)
    if not len(texts) or not model.names:
        return texts[:0], np.zeros((0, len(model.names)))
    grams, at = trigrams(words)
    score = np.add.reduceat(model.log_p[grams], at[:-1], axis=0)
    likely = np.maximum(np.exp(score - score.max(1, keepdims=True)), 1e-9)
    n = words.counts[texts]
    doc, heads = np.repeat(np.arange(len(texts)), n), words.at[:-1][texts]
    k = len(model.names)
    share, full = _em(np.full((len(texts), k), 1 / k, np.float32), likely, doc, heads, n, ROUNDS)
    rank = np.argsort(np.argsort(-share, 1, kind="stable"), 1)
    single = np.add.reduceat(np.log(likely), heads, axis=0)
    first = single.argmax(1)
    best = single[np.arange(len(texts)), first]
    chosen = np.eye(k, dtype=share.dtype)[first]
    live = np.arange(len(texts))
    for size in range(2, k + 1):
        fine = PENALTY * (size - 1) * np.log(n + 1)
        live = live[full[live] - fine[live] > best[live]]
        if not len(live):
            break
        each = n[live]
        at = np.concatenate(([0], np.cumsum(each)))
        some = np.repeat(heads[live] - at[:-1], each) + np.arange(at[-1])
        start = np.where(rank[live] < size, share[live] + 1e-3, 0).astype(np.float32)
        own, likelihood = _em(start / start.sum(1, keepdims=True), likely[some], np.repeat(np.arange(len(live)), each), at[:-1], each, ROUNDS)
        value = likelihood - fine[live]
        better = value > best[live]
        best[live[better]], chosen[live[better]] = value[better], own[better]
    return texts, chosen


def identify(docs: DataFrame, model: Languages, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score, and the chosen languages with their shares."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = carried(docs, keep)
    fields = source.schema.fields[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value.names
        for part in slices(batches):
            texts = Texts(part.column("text"))
            words = Words(texts, WORD_BY_LETTER)
            own, share = mixtures(sent.value, words)
            has_letter = np.zeros(len(texts), bool)
            ascii_letters = np.concatenate(([0], np.cumsum(WORD_BY_LETTER[texts.bytes] & (texts.bytes < 0x80))))
            has_letter[:] = ascii_letters[texts.offsets[1:]] > ascii_letters[texts.offsets[:-1]]
            for i in np.flatnonzero(~has_letter & (words.counts > 0)):
                has_letter[i] = any(c.isalpha() for c in texts.raw(i).decode())
            lang, score, mix = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
            for i, row in zip(own.tolist(), share, strict=True):
                if has_letter[i]:
                    order = np.argsort(-row, kind="stable")
                    lang[i], score[i] = names[order[0]], min(1.0, float(row[order[0]]))
                    mix[i] = [{"lang": names[j], "share": float(row[j])} for j in order if row[j] > 0]
            kept = [c for c in part.schema.names if c != "text"]
            mixed = pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(lang, pa.string()), pa.array(score), mixed], names=[*kept, "lang_pred", "score", "mixture"])

    return named(source.mapInArrow(run, with_fields(fields, "lang_pred string, score double, mixture array<struct<lang:string,share:double>>")), keep)
