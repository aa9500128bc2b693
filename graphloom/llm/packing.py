"""Packing token pieces into fixed windows by best-fit decreasing, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cut, groups, held, quiet_tokenizers, ready, spread, table, texts_of

CONTEXT = 2048
END_ID = 1


def vocabulary() -> str:
    """The default tokenizer file, on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of one token, put between words that are encoded together.
MARK = "~"


def latin(text: str) -> bool:
    """Whether it is of Latin-1 alone, whose small letters are one character each and are composed."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def small(text: str) -> bool:
    return latin(text) and text == text.lower()


class Words(dict):
    """Numbers words as they come; `new` lists those that came since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Tokens:
    """The ids of numbered words, one after another."""

    def __init__(self):
        self.words, self.flat, self.size = Words(), np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.start) < len(self.words):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.size : self.size + len(ids)] = ids
        self.start[at], self.length[at] = self.size + np.cumsum(lengths) - lengths, lengths
        self.size += len(ids)

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class Encoder:
    """Ids of texts. The tokenizer drops white space and no token spans it, so words between spaces are encoded once and remembered; when `limit` are known, those of the last period stay at hand for another."""

    def __init__(self, path: str, limit: int = 700_000):
        quiet_tokenizers()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        # for small letters of Latin-1 alone the same model needs no normaliser, and words are split at spaces
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Found as they stand before anything else is done; small letters must not bring one about.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary_ = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary_.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary_.items() if t.endswith("</w>")]] = True
        self.now, self.before = Tokens(), Tokens()

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids and their numbers; one call for all, with marks between, unless a word has the mark."""
        joined = f" {MARK} ".join(words)
        if len(self.mark) == 1 and joined.count(MARK) == len(words) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(words) - 1:
                return np.delete(ids, marks), np.diff(np.r_[-1, marks, len(ids)]) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters: each is one piece to the tokenizer, and ends with a token that ends words."""
        joined = " ".join(words)
        if not small(joined):
            return self._encode(words)
        ids = np.array(self.letters.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        last = np.flatnonzero(self.ends[ids])
        return (ids, np.diff(np.r_[-1, last])) if len(last) == len(words) and last[-1] == len(ids) - 1 else self._encode(words)

    def _learn(self, first: int, new: list[str]) -> None:
        """new: the words from number `first` on."""
        old = np.fromiter((self.before.words.get(w, -1) for w in new), np.int64, len(new)) if self.before.words else np.full(len(new), -1)
        known = np.flatnonzero(old >= 0)
        self.now.put(first + known, *self.before.get(old[known]))
        alpha = np.fromiter(map(str.isalpha, new), bool, len(new))
        for other, encode in ((np.flatnonzero((old < 0) & alpha), self._encode_letters), (np.flatnonzero((old < 0) & ~alpha), self._encode)):
            for i in range(0, len(other), 512):
                at = other[i : i + 512]
                self.now.put(first + at, *encode([new[j] for j in at.tolist()]))

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and each text's number of ids."""
        if len(self.now.words) > self.limit:
            self.now, self.before = Tokens(), self.now
        words, counts = [], []
        for t in texts:
            if latin(t):  # the tokenizer takes small letters anyway
                low = t.lower()
                if not any(x in low for x in self.added):
                    t = low
            own = t.replace("\n", " ").split(" ")
            counts.append(len(own))
            words += own
        first, self.now.words.new = len(self.now.words), []
        at = np.fromiter(map(self.now.words.__getitem__, words), np.int64, len(words))
        self._learn(first, self.now.words.new)
        ids, lengths = self.now.get(at)
        return ids, np.add.reduceat(lengths, np.r_[0, np.cumsum(counts)[:-1]])


def pieces(docs: DataFrame, path: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens): full windows from the text's start, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path or vocabulary()
        encoder = held(f"encoder {key}", lambda: Encoder(key))
        for b in batches:
            docs_of, texts = b.column(0).to_pylist(), texts_of(b)
            rows, parts_of, ready_to = [], {}, 0

            def finish(i: int, ids: list[np.ndarray]) -> None:
                ids = np.concatenate([*ids, [end_id]]).astype("<u4")
                for at in range(0, len(ids), context):
                    part = ids[at : at + context]
                    rows.append((docs_of[i], at, len(part), zlib.crc32(part.tobytes()), len(ids)))

            for owners, parts in groups(texts):
                ids, counts = encoder.parts(parts)
                cuts = np.cumsum(counts)[:-1]
                for i, own in zip(owners, np.split(ids, cuts), strict=True):
                    parts_of.setdefault(i, []).append(own)
                while ready_to < owners[-1]:
                    finish(ready_to, parts_of.pop(ready_to))
                    ready_to += 1
            while ready_to < len(texts):
                finish(ready_to, parts_of.pop(ready_to))
                ready_to += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ready(docs.sparkSession)
    return spread(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Tightest:
    """A segment tree over remaining capacities: how many windows are open at or above each, and the tightest that holds a piece."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += n
            at //= 2

    def find(self, length: int) -> int:
        """The smallest capacity of at least `length` with an open window, or -1."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return -1


def plan(counts: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """counts[l]: pieces of length l -> rows (length, first rank, past rank, first window, offset): the pieces of a length with ranks from first to past go to as many windows in turn.

    Best-fit decreasing. Windows of equal rest are alike, so runs of them are moved at once: the work depends on the context's length, not on the number of pieces.
    """
    tree, runs, rows, windows = Tightest(context), [[] for _ in range(context + 1)], [], 0

    def put_back(rest: int, first: int, n: int) -> None:
        if n and rest:
            runs[rest].append((first, n))
            tree.add(rest, n)

    for length in range(context, 0, -1):
        rank, left = 0, int(counts[length])
        while left:
            rest = tree.find(length)
            if rest < 0:
                rest = context
                first, n = windows, -(-left // (rest // length))
                windows += n
            else:
                first, n = runs[rest].pop()
                tree.add(rest, -n)
            # a window that has taken a piece and holds another is then the tightest, so each is filled before the next
            each = rest // length
            full = min(n, left // each)
            more = left - full * each if full < n else 0
            for windows_from, many, times in ((first, full, each), (first + full, 1, more)):
                for k in range(times if many else 0):
                    rows.append((length, rank, rank + many, windows_from, context - rest + k * length))
                    rank += many
            left -= full * each + more
            put_back(rest - each * length, first, full)
            put_back(rest - more * length, first + full, int(more > 0))
            put_back(rest, first + full + (more > 0), n - full - (more > 0))
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with `end_id`; a null or empty text is that id alone. Documents longer than the context are cut into full windows and a rest. Best-fit decreasing runs over all pieces of the table: its plan needs the histogram of lengths only (at most `context` numbers), and pieces find their windows by their rank among those of their length. Ranks are counted in buckets of an id's hash, so no length is one group. Repeated rows are packed each; equal lengths rank by bucket, doc_id and start. An empty table gives no rows.
    """
    own = cut(pieces(docs, path, context, end_id))
    counts = {r[0]: r[1] for r in own.groupBy("length").count().collect()}
    total = sum(counts.values())
    steps = plan(np.array([counts.get(i, 0) for i in range(context + 1)]), context)
    buckets = max(1, int(total**0.5) // 16)
    salted = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = salted.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before.drop("count"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, int(steps[:, 2].max(initial=0)))
        order = np.lexsort((steps[:, 1], steps[:, 0]))
        table_ = steps[order]
        key = table_[:, 0] * width + table_[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (2, 5))
            at = np.searchsorted(key, length * width + rank, "right") - 1
            yield pa.record_batch([*b.columns[:5], pa.array(table_[at, 3] + rank - table_[at, 1]), pa.array(table_[at, 4])], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, F.col("rank").cast("long")).mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
