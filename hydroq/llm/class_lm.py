"""Text scores from a Brown class model: exchange clustering of words, class transitions, word emissions.

Counts cover every training document. The ``class_words`` most frequent words are the seeds: the exchange method clusters them (each word
in turn moves to the class that raises the likelihood of the class pairs most). Every other word of ``least`` occurrences or more then
makes the same move against the seeds' class table: its neighbours are counted by class with partial sums, and it takes the class with
the largest gain, so the number of clustered words grows with the corpus. Words below ``least`` and unknown ones fall into classes by
their spelling (their last character and their first one beyond ASCII). Then

    P(word | word before) = P(class | class before) P(word | class),

both smoothed by added counts. Texts are cut into blocks of a few MB and read once: a block lists its different words, and its texts become
their numbers in that list, which all later passes work on. A block asks the table of words (a join) for those of its own words
that are not among the ``head_words`` most frequent, which every task has. So a vocabulary of any size fits, and each text becomes a string
of classes from which the transitions are counted and the texts scored.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import LOWER, parts_of, stage
from hydroq.llm.language import held_out

END = b"\n"  # the end of a text, counted as a token; no word can hold it
LAST_KINDS = 5
FIRST_KINDS = 9
SHAPES = LAST_KINDS * FIRST_KINDS
LAST_KIND = np.array([0 if bytes([c]).isalpha() or c >= 0x80 else 1 if bytes([c]).isdigit() else 2 if c == ord(".") else 3 if c == ord(",") else 4 for c in range(256)])
SMALL = 64  # gains of fewer neighbours are looked up
MARKS = 1 << 26  # bits of the map of attested words


def shape_of(word):
    """The spelling class of a word (bytes)."""
    kind = int(LAST_KIND[word[-1]])
    if word.isascii():
        return kind
    first = next(c for c in word.decode("utf-8", "replace") if c > "\x7f")
    return kind + LAST_KINDS * (1 + ord(first) % (FIRST_KINDS - 1))


def tokens_of(text):
    """The tokens of one text (bytes), as ``coded`` finds them in many."""
    return [*text.translate(LOWER).split(), END]


def shapes_of(words):
    """``shape_of`` all words of an Arrow array without nulls or empty words."""
    if not len(words):
        return np.zeros(0, np.int64)
    at, data = _bytes_of(words)
    out = LAST_KIND[data[at[1:] - 1]]
    wide = np.flatnonzero(data >= 0x80)
    first = np.searchsorted(wide, at)
    beyond = np.flatnonzero(first[1:] > first[:-1])
    place = wide[first[beyond]]
    lead, then = data[place].astype(np.int64), data[np.minimum(place + 1, len(data) - 1)]
    two = (lead >= 0xC2) & (lead < 0xE0) & (then & 0xC0 == 0x80) & (place + 1 < at[beyond + 1])  # a character of two bytes
    out[beyond[two]] += LAST_KINDS * (1 + ((lead[two] & 0x1F) << 6 | then[two] & 0x3F) % (FIRST_KINDS - 1))
    rest = beyond[~two]
    out[rest] = [shape_of(w) for w in words.take(pa.array(rest)).to_pylist()]
    return out


def _bytes_of(words):
    """(offsets, bytes) of an Arrow array of bytes; the offsets count from its own first byte."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], data


def places_in(words, listed):
    """Place of each word in ``listed`` (Arrow array), -1 for none."""
    return pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy()


def packed(numbers):
    """Non-negative numbers as compressed bytes: all lowest bytes first, then the next ones as far as needed."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes(), 1)


def unpacked(data, count):
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, count)
    out = planes[0].astype(np.int64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


def coded(texts):
    """(number of each token, different words, tokens of each text) of an Arrow array of texts; the end is word 0, the others follow by frequency."""
    texts = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)  # all of it works by byte
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # outer white space leaves empty words
    words, of = words.filter(full).dictionary_encode(), of[full.to_numpy(zero_copy_only=False)]
    found = words.indices.to_numpy()
    order = np.argsort(-np.bincount(found, minlength=len(words.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    size = np.bincount(of, minlength=len(texts)) + 1
    inner = np.ones(int(size.sum()), bool)
    inner[np.cumsum(size) - 1] = False
    codes = np.zeros(len(inner), np.int64)
    codes[inner] = rank[found]
    return codes, pa.concat_arrays([pa.array([END], pa.binary()), words.dictionary.take(pa.array(order)).cast(pa.binary())]), size


BLOCK_SCHEMA = "block long, doc_id array<long>, held_out array<boolean>, size array<int>, codes binary, words binary"


def coded_blocks(rows, size=10_000_000, most=2000):
    """BLOCK_SCHEMA rows: the different words of each block and its texts as their numbers; written, so that a text is read once.

    rows: (doc_id, held_out, text); a block has at most ``most`` rows and some ``size`` bytes, and is also cut where a column ``block`` changes.
    """
    kept = [c for c in ("block", "doc_id", "held_out", "text") if c in rows.columns]

    def run(batches):
        for k, texts in enumerate(_blocks_in(batches, size, most)):
            texts = texts.combine_chunks()
            codes, words, sizes = coded(texts["text"].chunk(0))
            # words hold no line end; the first one, the end of a text, is known
            listed = zstandard.compress(pc.binary_join(pa.ListArray.from_arrays(pa.array([1, len(words)], pa.int32()), words), b"\n")[0].as_py(), 1)
            columns = [[(TaskContext.get().partitionId() << 40) + k], [texts["doc_id"].to_pylist()], [texts["held_out"].to_pylist()], [sizes.tolist()], [packed(codes)], [listed]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "doc_id", "held_out", "size", "codes", "words"])

    return stage(rows.select(kept).mapInArrow(run, BLOCK_SCHEMA), "coded")


def _blocks_in(batches, size, most):
    """Tables of the rows of one block each."""
    open_, held, count, last = [], 0, 0, None
    for batch in parts_of(batches):
        own = batch.column("block").to_pylist() if "block" in batch.schema.names else [None] * batch.num_rows
        start = 0
        for k, (length, block) in enumerate(zip(pc.binary_length(batch.column("text")).to_pylist(), own)):
            if count and (held + length > size or count == most or block != last):
                yield pa.Table.from_batches([*open_, batch.slice(start, k - start)])
                open_, start, held, count = [], k, 0, 0
            held, count, last = held + length, count + 1, block
        open_.append(batch.slice(start))
    if count:
        yield pa.Table.from_batches(open_)


def in_text_blocks(rows, size=10_000_000, most=2000):
    """``rows`` (doc_id, held_out, text) with ``block``, for callers that choose the blocks; written, so that the numbers stay."""

    def run(batches):
        for k, texts in enumerate(_blocks_in(batches, size, most)):
            texts = texts.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), (TaskContext.get().partitionId() << 40) + k)), *texts.columns], ["block", *texts.schema.names])

    return stage(rows.mapInArrow(run, "block long, doc_id long, held_out boolean, text binary"), "blocks")


class Block:
    """A row of BLOCK_SCHEMA, opened; ``codes`` are the tokens of its texts, or of those to learn from only."""

    def __init__(self, row, learned=False):
        self.number, self.size = row["block"][0].as_py(), row["size"][0].values.to_numpy()
        listed = zstandard.decompress(row["words"][0].as_py())
        rest = pc.split_pattern(pa.array([listed], pa.binary()), "\n").flatten() if listed else pa.array([], pa.binary())
        self.words = pa.concat_arrays([pa.array([END], pa.binary()), rest])
        self.codes = unpacked(row["codes"][0].as_py(), int(self.size.sum()))
        self.learned = np.repeat(~row["held_out"][0].values.to_numpy(zero_copy_only=False), self.size)
        if learned:
            self.codes = self.codes[self.learned]

    def counts(self):
        """How often each word occurs in the texts to learn from."""
        return np.bincount(self.codes[self.learned], minlength=len(self.words))


def opened(batches, learned=False):
    for row in parts_of(batches, 1):
        yield Block(row, learned)


def word_counts(blocks):
    """(word, n) of all words in the texts to learn from; written."""

    def run(batches):
        for block in opened(batches):
            n = block.counts()
            own = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([block.words.take(own), pa.array(n).take(own)], ["word", "n"])

    found = blocks.select("block", "held_out", "size", "codes", "words").mapInArrow(run, "word binary, n long")
    return stage(found.groupBy("word").agg(F.sum("n").alias("n")), "words")


def most_frequent(counts, most):
    """Words and counts of at most ``most`` words: all those above the smallest count that fits."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect()  # at most one row a word
    least, total = None, 0
    for r in sizes:
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    if least is None:
        return {}
    head = counts.where(F.col("n") >= least).toArrow()
    return dict(zip(head["word"].to_pylist(), head["n"].to_pylist()))


def symbol_pairs(blocks, symbols):
    """Counts of neighbours (array: symbol before, symbol): listed words have their own symbol, others one by spelling."""
    n = len(symbols) + SHAPES
    listed = pa.array(list(symbols), pa.binary())

    def run(batches):
        sums = np.zeros(n * n, np.int64)
        for block in opened(batches, learned=True):
            if not len(block.codes):
                continue
            place = places_in(block.words, listed)
            own = np.where(place >= 0, place, len(symbols) + shapes_of(block.words))[block.codes]
            before = np.r_[own[-1:], own[:-1]]  # every text ends with the same token
            sums += np.bincount(before * n + own, minlength=n * n)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], ["cell", "n"])

    sums = blocks.select("block", "held_out", "size", "codes", "words").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most n * n rows
    flat = np.zeros(n * n)
    flat[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return flat.reshape(n, n)


def _f(x):
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs, movable, classes, sweeps=6):
    """Class of each symbol: the first ``movable`` are clustered into ``classes``, the others keep a class of their own each.

    Starts from the rank modulo ``classes``; every step takes a symbol out and puts it where the likelihood of the class pairs is highest.
    """
    n = len(pairs)
    own = np.r_[np.arange(movable) % classes, classes + np.arange(n - movable)]
    k = classes + n - movable
    grid = np.zeros((k, k))
    np.add.at(grid, (own[:, None], own[None, :]), pairs)
    left, right = pairs.sum(1), pairs.sum(0)
    class_left, class_right = grid.sum(1), grid.sum(0)
    open_to = np.arange(classes)
    for _ in range(sweeps):
        moves = 0
        for w in range(movable):
            a, self_pairs = own[w], pairs[w, w]
            after = np.bincount(own, pairs[w], k)
            ahead = np.bincount(own, pairs[:, w], k)
            after[a] -= self_pairs
            ahead[a] -= self_pairs
            grid[a] -= after
            grid[:, a] -= ahead
            grid[a, a] -= self_pairs
            class_left[a] -= left[w]
            class_right[a] -= right[w]
            rows, columns = grid[:classes], grid[:, :classes].T
            gain = (_f(rows + after) - _f(rows)).sum(1) + (_f(columns + ahead) - _f(columns)).sum(1)
            middle = grid[open_to, open_to]
            gain += _f(middle + after[:classes] + ahead[:classes] + self_pairs) - _f(middle + after[:classes]) - _f(middle + ahead[:classes]) + _f(middle)
            gain -= _f(class_left[:classes] + left[w]) - _f(class_left[:classes]) + _f(class_right[:classes] + right[w]) - _f(class_right[:classes])
            b = int(gain.argmax())
            if gain[a] >= gain[b] - 1e-9:
                b = a
            moves += b != a
            own[w] = b
            grid[b] += after
            grid[:, b] += ahead
            grid[b, b] += self_pairs
            class_left[b] += left[w]
            class_right[b] += right[w]
        if not moves:
            break
    return own


class Model:
    """class_of: classes of clustered words, the rest by spelling; log chances of transitions, and what a class divides its words' chances by."""

    def __init__(self, head, class_of, classes, transitions, tokens, words, class_tokens, class_words, added, added_pairs):
        self.head, self.class_of, self.classes = head, class_of, classes
        self.tokens, self.words, self.added = tokens, words, added
        total = classes + SHAPES
        self.transition = np.log10((transitions + added_pairs) / (transitions.sum(1, keepdims=True) + added_pairs * total))
        self.share = np.log10(class_tokens + added * (class_words + 1))  # of a class: what its words' chances are divided by

    def class_number(self, word):
        found = self.class_of.get(word)
        return found if found is not None else self.classes + shape_of(word)


def marks_of(words):
    """A map of ``MARKS`` bits (bytes) with the places of all ``words``; a word whose place is empty is none of them."""
    place = F.crc32("word") % MARKS
    cells = words.select(place.alias("p")).groupBy(F.expr("p div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toArrow()  # at most MARKS / 64 rows
    flat = np.zeros(MARKS // 64, "<i8")
    flat[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return flat.tobytes()


def marked(marks, word):
    place = zlib.crc32(word) % MARKS
    return marks[place >> 3] >> (place & 7) & 1


def all_marked(marks, words):
    """``marked`` for every word of an Arrow array."""
    if not len(words):
        return np.zeros(0, bool)
    at, data = _bytes_of(words)
    at, data = at.tolist(), data.tobytes()
    place = np.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]) % MARKS
    return (np.frombuffer(marks, np.uint8)[place >> 3] >> (place & 7) & 1).astype(bool)


def neighbours(blocks, class_of, classes, head, least, marks):
    """(word, near) for every word that is not in ``class_of``, one row a block.

    near: the class after each occurrence in the texts to learn from (cell) and the one before it (cell - classes - SHAPES), a byte
    each (two from 129 classes on). Words known to occur less than
    ``least`` times are left out: those of ``head`` by their count, the rest if their place in ``marks`` is empty (a few rarer
    words share a place with others and stay). If all words of that many are in ``head``, all others are left out.
    """
    total = classes + SHAPES
    beyond = min(head.values(), default=math.inf) > least
    known = pa.array(list(head), pa.binary()), np.array([*head.values(), 0])
    seeds = pa.array(list(class_of), pa.binary()), np.array([*class_of.values(), 0])
    shared = blocks.sparkSession.sparkContext.broadcast((known, seeds, marks))  # at most head_words words and MARKS bits

    def run(batches):
        (known, known_n), (seeds, seed_class), marks = shared.value
        for block in opened(batches, learned=True):
            if not len(block.codes):
                continue
            seed, place = places_in(block.words, seeds), places_in(block.words, known)
            open_ = (seed < 0) & (place >= 0) & (known_n[place] >= least)
            if beyond:
                rare = np.flatnonzero((seed < 0) & (place < 0))
                open_[rare] = all_marked(marks, block.words.take(pa.array(rare)))
            number = np.where(seed >= 0, seed_class[seed], classes + shapes_of(block.words))[block.codes]
            at = np.flatnonzero(open_[block.codes])
            # a text follows the end of another one: the last end of the block is followed by its first word
            after, before = np.r_[number[1:], number[:1]], np.r_[number[-1:], number[:-1]]
            keys = block.codes[at] * (2 * total)
            word, cell = np.divmod(np.sort(np.r_[keys + after[at], keys + total + before[at]]), 2 * total)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
            cell = cell.astype(_cells(total))
            ends = (np.r_[starts, len(word)] * cell.itemsize).astype(np.int32)
            near = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(cell.tobytes())])
            yield pa.RecordBatch.from_arrays([block.words.take(pa.array(word[starts])), near], ["word", "near"])

    return blocks.select("block", "held_out", "size", "codes", "words").mapInArrow(run, "word binary, near binary")


def _cells(total):
    return np.dtype(np.uint8 if 2 * total <= 256 else "<u2")


def near_sums(batches, total):
    """(words, counts by word and cell) from (word, near) rows sorted by word; a word's rows are added up one by one."""
    last, held = None, None
    for batch in parts_of(batches):
        words, near = batch.column("word"), batch.column("near")
        if not len(words):
            continue
        starts = np.r_[0, 1 + np.flatnonzero(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False))]
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(words)]))
        cells = np.frombuffer(_bytes_of(near)[1].tobytes(), _cells(total))
        size = pc.binary_length(near).to_numpy() // cells.itemsize
        sums = np.bincount(np.repeat(group, size) * (2 * total) + cells, minlength=len(starts) * 2 * total).reshape(-1, 2 * total)
        words = words.take(pa.array(starts))
        if last is not None and words[0] == last[0]:
            sums[0] += held[0]
        elif last is not None:
            yield last, held
        yield words.slice(0, len(words) - 1), sums[:-1]
        last, held = words.slice(len(words) - 1), sums[-1:]
    if last is not None:
        yield last, held


class Gains:
    """What a word's neighbours add to the likelihood in each class: ``n`` of a cell (class after, or class before + total)."""

    def __init__(self, grid, classes):
        self.total, self.classes = len(grid), classes
        self.around = np.concatenate([grid[:classes], grid[:, :classes].T], axis=1).T  # by cell and class
        self.now = _f(self.around)
        self.small = np.array([_f(self.around + n) - self.now for n in range(SMALL)])
        self.left, self.right = grid.sum(1)[:classes], grid.sum(0)[:classes]

    def best(self, sums):
        """The class with the largest gain for each row of ``sums`` (by word and cell; no row is empty)."""
        word, cells = np.nonzero(sums)
        n = sums[word, cells]
        gain = self.small[np.minimum(n, SMALL - 1), cells]
        many = np.flatnonzero(n >= SMALL)
        gain[many] = _f(self.around[cells[many]] + n[many, None]) - self.now[cells[many]]
        gain = np.add.reduceat(gain, np.searchsorted(word, np.arange(len(sums))), axis=0)
        after, before = sums[:, :self.total].sum(1)[:, None], sums[:, self.total:].sum(1)[:, None]
        gain -= _f(self.left + after) - _f(self.left) + _f(self.right + before) - _f(self.right)
        return (gain - 1e-9 * np.arange(self.classes)).argmax(1)


def word_classes(blocks, counts, seeds, grid, classes, head, least):
    """(word, n, class) for every word of ``counts``: seeds as given, words of ``least`` occurrences by their neighbours, others by spelling."""
    attested, total = counts.where(F.col("n") >= least), classes + SHAPES
    listed, seed_class = pa.array(list(seeds), pa.binary()), np.array([*seeds.values(), 0])
    near = neighbours(blocks, seeds, classes, head, least, marks_of(attested.select("word")))

    def choose(batches):
        gains = Gains(grid, classes)
        for words, sums in near_sums(batches, total):
            own = np.flatnonzero(sums[:, :total].sum(1) >= least)  # an occurrence has one word after it
            for at in range(0, len(own), 200):
                part = own[at:at + 200]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(part)), pa.array(gains.best(sums[part]).astype(np.int32))], ["word", "best"])

    chosen = stage(near.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word binary, best int"), "chosen")

    def number(batches):
        for batch in parts_of(batches, 100_000):
            words = batch.column("word")
            place, best = places_in(words, listed), pc.fill_null(batch.column("best"), -1).to_numpy()
            own = np.where(place >= 0, seed_class[place], np.where(best >= 0, best, classes + shapes_of(words)))
            yield pa.RecordBatch.from_arrays([words, batch.column("n"), pa.array(own.astype(np.int32))], ["word", "n", "class"])

    rare = counts.where(F.col("n") < least).select("word", "n", F.lit(None).cast("int").alias("best"))
    return stage(attested.join(chosen, "word", "left").unionAll(rare).mapInArrow(number, "word binary, n long, class int"), "classes")


def class_strings(blocks, words, head, classes, added, least):
    """(doc_id, held_out, n_tokens, n_known, base, own, classes: one byte a token) for every text of ``blocks``.

    base and own: sums of log10(n + 1) and log10(n + added) over the tokens. A word below ``least`` has the class of its spelling, so
    a block that holds all its occurrences knows its facts; only the others are sent to the block.
    """
    smallest = min(head.values(), default=1 << 62)
    known = words.where(F.col("n") >= smallest).toArrow().combine_chunks()  # at most head_words words
    columns = [known[k].combine_chunks() for k in ("word", "n", "class")]
    shared = blocks.sparkSession.sparkContext.broadcast((columns[0], np.r_[columns[1].to_numpy(), 0], np.r_[columns[2].to_numpy(), 0]))

    def ask(batches):
        for block in opened(batches):
            rare = np.flatnonzero(places_in(block.words, shared.value[0]) < 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), block.number)), pa.array(rare.astype(np.int32)), block.words.take(pa.array(rare)), pa.array(block.counts()[rare])], ["block", "code", "word", "own"])

    def prepare(batches):
        listed, frequent, own = shared.value
        for row in parts_of(batches, 1):
            block = Block(row)
            place = places_in(block.words, listed)
            n = np.where(place >= 0, frequent[place], block.counts())
            number = np.where(place >= 0, own[place], classes + shapes_of(block.words))
            yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([packed(n)], pa.binary()), pa.array([packed(number)], pa.binary()), pa.array([len(n)], pa.int32())], [*row.schema.names[:5], "n", "class", "words"])

    def code(texts, found):
        out = []
        for row in texts.to_batches(max_chunksize=1):
            different = row["words"][0].as_py()
            n, number = (unpacked(row[k][0].as_py(), different) for k in ("n", "class"))
            asked = found["code"].to_numpy()
            n[asked], number[asked] = found["n"].to_numpy(), found["class"].to_numpy()
            size = row["size"][0].values.to_numpy()
            codes, text = unpacked(row["codes"][0].as_py(), int(size.sum())), np.repeat(np.arange(len(size)), size)
            with np.errstate(divide="ignore"):
                sums = [np.bincount(text, x[codes], len(size)) for x in (n > 0, np.log10(n + 1.0), np.log10(n + added))]
            flow, ends = number.astype(np.uint8)[codes].tobytes(), np.cumsum(size)
            strings = pa.array([flow[e - k:e] for e, k in zip(ends.tolist(), size.tolist())], pa.binary())
            out.append(pa.table([row["doc_id"][0].values, row["held_out"][0].values, pa.array(size.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), strings],
                                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "classes"]))
        return pa.concat_tables(out)

    asked = blocks.select("block", "held_out", "size", "codes", "words").mapInArrow(ask, "block long, code int, word binary, own long")
    found = asked.join(words.where(F.col("n") < smallest), "word").where((F.col("n") != F.col("own")) | (F.col("n") >= least)).select("block", "code", "n", "class")
    texts = blocks.mapInArrow(prepare, "block long, doc_id array<long>, held_out array<boolean>, size array<int>, codes binary, n binary, class binary, words int")
    out = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(code, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, classes binary")
    return stage(out, "strings")


def flows(part):
    """(classes of all tokens, classes before them, text number of each) of a batch of class strings; each text follows an end."""
    strings = part.column("classes").to_pylist()
    flow = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    return flow, np.r_[flow[-1:], flow[:-1]], np.repeat(np.arange(len(size)), size)


def class_pairs(strings, total):
    """Counts of neighbouring classes (array: class before, class)."""

    def run(batches):
        for part in parts_of(batches):
            flow, before, _ = flows(part)
            counts = np.bincount(before * total + flow, minlength=total * total)
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    sums = strings.select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most total * total rows
    flat = np.zeros(total * total)
    flat[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return flat.reshape(total, total)


def fit(rows, class_words=1500, classes=60, head_words=100_000, added=1.0, added_pairs=0.1, least=5):
    """(Model, strings, words): the model of the rows that are not held out, the class strings of all rows, and the table (word, n, class).

    rows: (doc_id, held_out, text), and perhaps block. classes + 45 classes by spelling fit a byte.
    """
    blocks = coded_blocks(rows)
    counts = word_counts(blocks)
    head = most_frequent(counts, head_words)
    ranked = sorted(head, key=lambda w: (-head[w], w))[:class_words]
    symbols = {w: k for k, w in enumerate(ranked)}
    pairs = symbol_pairs(blocks, symbols)
    own = exchange(pairs, len(symbols), classes)
    total = classes + SHAPES
    grid = np.zeros((total, total))
    np.add.at(grid, (own[:, None], own[None, :]), pairs)
    seeds = {w: int(own[k]) for w, k in symbols.items()}
    words = word_classes(blocks, counts, seeds, grid, classes, head, least)
    strings = class_strings(blocks, words, head, classes, added, least)
    transitions = class_pairs(strings.where("not held_out"), total)
    sizes = words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()  # one row a class
    class_tokens, class_sizes = np.zeros(total), np.zeros(total)
    for r in sizes:
        class_tokens[r["class"]], class_sizes[r["class"]] = r["n"], r["words"]
    return Model(head, seeds, classes, transitions, int(class_tokens.sum()), int(class_sizes.sum()), class_tokens, class_sizes, added, added_pairs), strings, words


def score(strings, model):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every class string."""
    transition, share = model.transition, model.share

    def run(batches):
        for part in parts_of(batches):
            flow, before, text = flows(part)
            rest = np.bincount(text, transition[before, flow] - share[flow], part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(part.column("own").to_numpy() + rest)], [*part.schema.names[:5], "score"])

    out = strings.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.words + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def score_texts(docs, parts=7, part=2, id_col="doc_id", text_col="text", **settings):
    """Scores of all rows by a model of those whose crc32(id as text) modulo ``parts`` is not ``part``.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): null text counts as empty and has the end token only;
    rows without id are learned from. Repeated rows count as often as they occur and get equal scores. Other columns stay
    out. Empty table: no rows. With nothing to learn from, all chances are those of the added counts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(docs, parts, part, id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    model, strings, _ = fit(rows, **settings)
    return score(strings, model)


@query("op10_class_lm")
def op10(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
