"""Language of texts and of their parts: scripts narrow the candidates, word scores are smoothed by a Viterbi path.

A word's score for a language is the sum of the log chances of its letter trigrams and of the word itself, all hashed into a
table of fixed size. A language is a candidate for words of the scripts it was seen in. The best path through the words of
a text pays ``penalty`` for each change of language; its stretches label the spans of mixed text.
"""

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import parts_of, small_batches

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
CHARS_AT_ONCE = 8_000_000
SCRIPT_SHARE = 0.01

# First code points of ranges of one script (Unicode blocks); 0 is Latin, letters elsewhere are "other".
SCRIPT_STARTS = [
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 19), (0x0900, 6), (0x0980, 7), (0x0A00, 8), (0x0A80, 9),
    (0x0B00, 19), (0x0B80, 10), (0x0C00, 11), (0x0C80, 19), (0x0E00, 12), (0x0E80, 19), (0x10A0, 13), (0x1100, 14), (0x1200, 15), (0x1380, 19),
    (0x1E00, 0), (0x1F00, 1), (0x2000, 19), (0x2C60, 0), (0x2C80, 19), (0x3040, 16), (0x30A0, 17), (0x3100, 19), (0x3400, 18), (0xA000, 19),
    (0xAC00, 14), (0xD7B0, 19), (0xF900, 18), (0xFB00, 0), (0xFB50, 5), (0xFE00, 19), (0xFF21, 0), (0xFF66, 17), (0xFFA0, 14), (0xFFE0, 19), (0x20000, 18), (0x30000, 19),
]
SCRIPTS = 20
STARTS = np.array([s for s, _ in SCRIPT_STARTS])
SCRIPT_OF = np.array([k for _, k in SCRIPT_STARTS])


def script_of(points):
    return SCRIPT_OF[np.searchsorted(STARTS, points, "right") - 1]


def features_of(words):
    """Buckets of all features of distinct words (a row of them for each word one after the other), their number by word, and each word's script."""
    points = np.frombuffer(("_" + "__".join(words) + "_").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    with np.errstate(over="ignore"):
        grams = ((points[:-2] * MIX) ^ points[1:-1]) * MIX ^ points[2:]
        grams *= MIX
        whole = pd.util.hash_array(np.array(words, object), categorize=False) * MIX
    inside = np.ones(len(points) - 2, bool)
    inside[ends[:-1] - 2] = inside[ends[:-1] - 1] = False  # trigrams that reach into the next word
    counts = sizes - 2
    out = np.empty(int(counts.sum()) + len(words), np.int64)
    first = np.cumsum(counts + 1) - counts - 1
    place = np.ones(len(out), bool)
    place[first] = False
    out[first] = (whole >> np.uint64(48)).astype(np.int64) % BUCKETS
    out[place] = (grams[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS
    return out, counts + 1, script_of(points[starts + 1].astype(np.int64))


def words_by_text(texts):
    """Distinct words, the number of each word of all texts, and how many words each text has."""
    lists = [WORD.findall(t.lower()) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    codes, words = pd.factorize(np.array([w for x in lists for w in x], object))
    return words.tolist(), codes, counts


class Model:
    """languages: sorted names; weights: log chances by bucket and language; scripts: whether a language uses a script."""

    def __init__(self, languages, counts, scripts):
        self.languages = languages
        total = counts.sum(0, keepdims=True)
        self.weights = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)
        used = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0, keepdims=True))
        self.allowed = used | ~used.any(1, keepdims=True)  # a script of no language leaves all as candidates

    def scores(self, words):
        buckets, counts, script = features_of(words)
        sums = np.add.reduceat(self.weights[buckets], np.cumsum(counts) - counts)
        return np.where(self.allowed[script], sums, sums - 50.0).astype(np.float32)


def portions(texts):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHARS_AT_ONCE or k + 1 == len(texts):
            yield at, k + 1
            at, size = k + 1, 0


def quota(counts, most):
    """The number of rows of each language at which the languages together give about ``most``: all rows of those that have fewer."""
    left = most
    for k, n in enumerate(ranked := sorted(counts)):
        if n * (len(ranked) - k) > left:
            return max(1.0, left / (len(ranked) - k))
        left -= n
    return float(ranked[-1])


def learn(docs, train_docs=20_000, id_col="doc_id", text_col="text", lang_col="lang"):
    """A Model from about ``train_docs`` of the rows with text and language (all if there are fewer), picked by a hash of the id.

    Each language gives the same number of rows, or all of its rows if it has fewer, so that no language is left out for its small share.
    Counts meet by partial sums; the table that reaches the driver has at most BUCKETS cells for each language.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(found)
    if not languages:
        return None
    own = quota(found.values(), train_docs)
    below = F.create_map(*[F.lit(x) for name in languages for x in (name, math.ceil(min(1.0, own / found[name]) * (1 << 40)))])
    rows = rows.where(F.pmod(F.xxhash64(F.coalesce("key", "text")), F.lit(1 << 40)) < below[F.col("lang")].cast("long"))
    number = {name: k for k, name in enumerate(languages)}

    def run(batches):
        for batch in parts_of(batches):
            texts, langs = batch.column("text").to_pylist(), np.array([number[x] for x in batch.column("lang").to_pylist()])
            for a, b in portions(texts):
                words, codes, counts = words_by_text(texts[a:b])
                if not words:
                    continue
                pairs, times = np.unique(codes * len(languages) + np.repeat(langs[a:b], counts), return_counts=True)
                buckets, sizes, script = features_of(words)
                starts = np.cumsum(sizes) - sizes
                word, lang = np.divmod(pairs, len(languages))
                at = np.repeat(starts[word] - (np.cumsum(sizes[word]) - sizes[word]), sizes[word]) + np.arange(sizes[word].sum())
                total = np.bincount(buckets[at] * len(languages) + np.repeat(lang, sizes[word]), np.repeat(times, sizes[word]), BUCKETS * len(languages))
                scripts = np.bincount(script[word] * len(languages) + lang, times, SCRIPTS * len(languages))
                total = np.r_[total, scripts]
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells].astype(np.int64))], ["cell", "n"])

    sums = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros((BUCKETS + SCRIPTS) * len(languages))
    flat[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    flat = flat.reshape(-1, len(languages))
    return Model(languages, flat[:BUCKETS], flat[BUCKETS:])


def viterbi(scores, counts, penalty):
    """The language number of each word on the best path of each text; texts go side by side, longest first."""
    order = np.argsort(-counts, kind="stable")
    ranked = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    steps = int(ranked[0]) if len(ranked) else 0
    live = np.searchsorted(-ranked, -np.arange(1, steps + 1), "right")  # texts that have a word at each step
    n_lang = scores.shape[1]
    best = np.zeros((len(counts), n_lang), np.float32)
    came = []  # the language before the word if it changes, else the same
    stay = np.arange(n_lang)
    for step in range(steps):
        n = live[step]
        now = best[:n]
        if step:
            top = now.argmax(1)
            change = now[np.arange(n), top][:, None] - penalty
            moved = change > now
            came.append(np.where(moved, top[:, None], stay).astype(np.uint8 if n_lang < 256 else np.int32))
            now = np.maximum(now, change)
        now = now + scores[starts[:n] + step]
        best[:n] = now - now.max(1, keepdims=True)
    path = np.zeros(len(scores), np.int32)
    state = best.argmax(1)
    for step in range(steps - 1, -1, -1):
        n = live[step]
        path[starts[:n] + step] = state[:n]
        if step:
            state[:n] = came[step - 1][np.arange(n), state[:n]]
    return path


def labelled(texts, model, penalty):
    """For each text: language number or -1, share of its letters in that language, letters, and the stretches (language number, words)."""
    pred, share, letters, spans = [], [], [], []
    for a, b in portions(texts):
        words, codes, counts = words_by_text(texts[a:b])
        n_lang = len(model.languages)
        if not words:
            pred += [-1] * (b - a)
            share += [0.0] * (b - a)
            letters += [0] * (b - a)
            spans += [[] for _ in range(b - a)]
            continue
        path = viterbi(model.scores(words)[codes], counts, penalty)
        size = np.fromiter(map(len, words), np.int64, len(words))[codes]
        text = np.repeat(np.arange(b - a), counts)
        by_lang = np.bincount(text * n_lang + path, size, (b - a) * n_lang).reshape(b - a, n_lang)
        total = by_lang.sum(1)
        top = by_lang.argmax(1)
        pred += np.where(total > 0, top, -1).tolist()
        share += (by_lang.max(1) / np.maximum(1, total)).tolist()
        letters += total.astype(np.int64).tolist()
        new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])]) if len(path) else np.empty(0, np.int64)
        runs = np.diff(np.r_[new, len(path)])
        own = [[] for _ in range(b - a)]
        for t, lang, n in zip(text[new].tolist(), path[new].tolist(), runs.tolist()):
            own[t].append((lang, n))
        spans += own
    return pred, share, letters, spans


def detect(docs, model, penalty=12.0, id_col="doc_id", text_col="text", extra=()):
    """(doc_id, lang_pred, score, n_letters, spans) for every row, and the ``extra`` columns.

    lang_pred: the language of most letters, und for null texts and texts without letters, or if nothing was learned. score: the
    share of the letters on its stretches, 0 for und. spans: (lang, words) one after the other. Ties go to the first language
    by name. Repeated rows are judged alike; other columns stay out. Empty table: no rows.
    """

    def run(batches):
        for batch in parts_of(batches):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            own = [c for c in batch.schema.names if c != "__text"]
            pred, share, letters, spans = labelled(texts, model, penalty) if model else ([-1] * len(texts), [0.0] * len(texts), [sum(map(len, WORD.findall(t))) for t in texts], [[] for _ in texts])
            names = model.languages if model else []
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, own), pa.array([names[k] if k >= 0 else "und" for k in pred], pa.string()), pa.array(share, pa.float64()), pa.array(letters, pa.int64()), pa.array([[{"lang": names[k], "words": n} for k, n in x] for x in spans], kind)],
                [*own, "lang_pred", "score", "n_letters", "spans"])

    own = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).cast("string").alias("__text"))
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{fields}, lang_pred string, score double, n_letters long, spans array<struct<lang:string,words:int>>")


def held_out(docs, parts, part, id_col="doc_id"):
    """Whether the row belongs to the part that nothing is learned from; rows without id do not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def keep_known(docs, model, least_share=0.5, least_words=10, penalty=12.0, text_col="text"):
    """``docs`` without the texts that have no letters, or neither a language for ``least_share`` of them nor that share of their words in
    stretches of ``least_words`` and more, as texts in several languages have. Nothing is dropped for its language if none was learned."""
    own = docs.columns

    def run(batches):
        for batch in parts_of(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            _, share, letters, spans = labelled(texts, model, penalty)
            long = [sum(n for _, n in own if n >= least_words) >= least_share * sum(n for _, n in own) for own in spans]
            yield batch.filter(pa.array([n > 0 and (s >= least_share or x) for n, s, x in zip(letters, share, long)]))

    small_batches(docs.sparkSession)
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields).select(*(F.col(f"`{c}`") for c in own))


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held_out(docs, 4, 2)
    found = detect(docs, learn(docs.where(~out)), extra=[out.alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_letters", F.size("spans").cast("long").alias("n_spans"))
