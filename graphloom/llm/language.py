"""Language identification by cross-parsing: each language's labelled text becomes a suffix automaton, and a text belongs where it falls into the fewest phrases."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fold, groups, held, ready, spread, table, texts_of

#: What a text is parsed without: runs of it count as one space.
OTHER = re.compile(r"[\W\d_]+")
#: Labelled rows that are looked at for a language, and about how many characters of whole texts its automaton takes.
SAMPLE_ROWS, AUTOMATON_CHARS = 150, 100_000
#: Letters that have a column of their own in the automata's table; others are unknown.
ALPHABET = 127
#: A text is parsed in lanes of so many characters, and a phrase ends with its lane.
LANE = 512


def plain(text: str | None) -> str:
    """The running text in lower case: words with one space between, before and after; empty without letters."""
    own = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {own} " if own else ""


class Automaton:
    """The suffix automaton of a text: every path from the start spells a substring."""

    def __init__(self, text: str):
        step, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new, p = len(step), last
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] != length[p] + 1:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[new] = q
            last = new
        self.step = step

    def phrases(self, word: str) -> int:
        """The number of phrases of a greedy parse: each the longest match from where it starts, or one unknown character."""
        step, n, at = self.step, 0, 0
        while at < len(word):
            state, begun = step[0], at
            while at < len(word) and (to := state.get(word[at])) is not None:
                state = step[to]
                at += 1
            at += at == begun
            n += 1
        return n


class Parser:
    """The automata of all languages as one table of steps, and parses of many texts at once.

    State 0 of each automaton is its start. symbols: a text's characters as columns of the table, the last for unknown ones.
    """

    def __init__(self, learned: dict[str, str]):
        seen: dict[str, int] = {}
        for text in learned.values():
            for c in text:
                seen[c] = seen.get(c, 0) + 1
        letters = sorted(seen, key=lambda c: (-seen[c], c))[:ALPHABET]
        self.width = len(letters) + 1
        self.column = np.full(0x110000, len(letters), np.uint8)
        self.column[[ord(c) for c in letters]] = np.arange(len(letters))
        tables, self.roots, at = [], [], 0
        for lang in sorted(learned):
            step = Automaton(learned[lang]).step
            rows = np.full((len(step), self.width), -1, np.int32)
            for i, to in enumerate(step):
                for c, state in to.items():
                    if self.column[ord(c)] < len(letters):
                        rows[i, self.column[ord(c)]] = state + at
            tables.append(rows)
            self.roots.append(at)
            at += len(step)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def symbols(self, texts: list[str]) -> np.ndarray:
        return self.column[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """The number of phrases of each text by each language: each phrase the longest match from where it starts, or one unknown character; it ends with its lane."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        lanes = -(-sizes // LANE)
        if not lanes.sum():
            return out
        symbols = np.r_[self.symbols(texts), np.zeros(LANE, np.uint8)].astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * LANE
        size = np.minimum(LANE, sizes[owner] - nth * LANE)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        live = np.searchsorted(-size, -np.arange(LANE), "left")  # lanes longer than each place
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        for place in range(int(size[0])):
            n = live[place]
            c, now = symbols[begin[:n] + place], state[:, :n]
            to = self.table[now * self.width + c]
            failed = to < 0
            start = self.table[roots * self.width + c]
            count[:, :n] += failed & (now != roots)
            to = np.where(failed, start, to)
            unknown = to < 0
            count[:, :n] += unknown
            state[:, :n] = np.where(unknown, roots, to)
        count += state != roots
        for k in range(len(self.roots)):
            out[:, k] = np.bincount(owner, count[k], len(texts))
        return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = AUTOMATON_CHARS) -> dict[str, str]:
    """docs (doc_id, text, lang) -> the running text to learn each language from: whole texts of a bounded sample of rows.

    Rows without lang or letters are left out. The sample is about `rows` rows of each language with the smallest hashes of doc_id, of no more than `chars` characters each, taken in that order until they come to `chars`; a language all of whose sampled texts are longer takes the shortest. Texts that are parsed are whole. Repeated rows count once; an empty table gives no language.
    """
    named = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    if not counts:
        return {}
    h = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40))
    share = F.coalesce(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int((1 << 40) * min(1.0, 1.3 * rows / n)) + 1)])[F.col("lang")], F.lit(0))
    some = named.where(h < share).withColumn("long", F.length("text") > chars)
    got = some.where("not long").select("lang", h.alias("h"), "doc_id", "text").collect()
    learned = {}
    for lang in sorted(counts):
        own = sorted({(r.h, r.doc_id is None, r.doc_id or 0, plain(r.text)) for r in got if r.lang == lang})[:rows]
        size, taken = 0, []
        for r in own:
            if size < chars:
                taken.append(r[-1].strip())
                size += len(r[-1])
        if not any(taken):
            shortest = some.where(F.col("long") & (F.col("lang") == lang)).orderBy(F.length("text"), "doc_id").select("text").first()
            taken = [plain(shortest.text).strip()] if shortest else []
        learned[lang] = f" {' '.join(t for t in taken if t)} "
    return {k: v for k, v in learned.items() if v.strip()}


def predict(docs: DataFrame, learned: dict[str, str], keep: list[Column]) -> DataFrame:
    """docs (doc_id, text) and columns to keep -> those columns, lang_pred string, score double; a row for each row.

    A text's running words, in lower case and with one space between, are parsed by each language's automaton, across words. A phrase counts log2 of the automaton's text, per character. lang_pred: the language with the fewest normalised phrases, ties to the first by name; `und` with score 0 where the text is null or without letters or nothing was learned. score: the winner's share when phrases are exponents. A text of millions of characters is parsed a million at a time.
    """
    langs = sorted(learned)
    price = np.array([math.log2(len(learned[x]) + 2) for x in langs])
    columns = docs.select(*keep, "text")
    kept = columns.columns[:-1]
    name = f"language {hash(tuple(learned.items()))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(name, lambda: Parser(learned))
        for b in batches:
            texts = texts_of(b)
            total, size = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
            for owners, parts in groups(texts):
                running = [plain(t) for t in parts]
                np.add.at(total, owners, parser.phrases(running))
                np.add.at(size, owners, [len(t) for t in running])
            cost = total * price / np.maximum(size, 1)[:, None]
            score, named = np.zeros(len(texts)), ["und"] * len(texts)
            if langs and len(texts):
                best = cost.argmin(axis=1)
                weight = np.exp(-4 * (cost - cost.min(axis=1, keepdims=True)))
                score = np.where(size > 0, weight[np.arange(len(texts)), best] / weight.sum(axis=1), 0.0)
                named = [langs[i] if n else "und" for i, n in zip(best.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch([*b.columns[: len(kept)], pa.array(named, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    ready(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema[: len(kept)])
    return columns.mapInArrow(run, f"{schema}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    held = fold(4) == 2
    learned = fit(docs.where(~held))
    return predict(docs, learned, [F.col("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out")])
