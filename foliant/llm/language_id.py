"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by a forward algorithm; a text's is the product over its words. Piece probabilities are
learned from all labelled texts: words are counted for each language, one expectation step over all segmentations of
each word (from pieces of equal probability) gives expected piece counts, and these are normalised and smoothed.
Words are runs of letters (categories L), lower-cased. Distinct words of one length go through the lattice together:
a trie of the pieces is walked for all of them at once, start by start. Values are rescaled at each start, so words of
any length count. Shuffled are distinct words and piece counts; the model (vocabulary x languages) is what is broadcast.
Scoring is map-side, with word probabilities kept in a bounded worker cache.
Null texts, and texts without a letter, are `und` with score 0. Rows with a null label teach nothing. With no labelled
text at all, all are `und`. Repeated rows each count and each give a row; other columns are left out.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import slices, worker_cache

VOCABULARY = "piece_bpe_32k.model"
#: Weight of the pooled distribution in each language's, in pieces; a letter in no piece.
SMOOTHING, UNKNOWN = 200.0, 1e-7
#: Words a worker keeps; distinct words a task gathers before it hands them on; cells of a lattice worked on at once.
KEEP_WORDS, FLUSH, CELLS = 200_000, 200_000, 1 << 20
#: Most languages a model may have: with the vocabulary, the bound of what is broadcast.
MOST_LANGUAGES = 500
WORDS = re.compile(r"[^\W\d_]+").findall
START = "▁"


def letter_runs(word: str) -> list[str]:
    """The runs of letters of a word that may hold other numerals than digits."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


@functools.cache
def vocabulary(name: str) -> dict[str, int]:
    """Pieces of letters, lower case; START may begin a piece."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found: dict[str, int] = {}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k).lower()
        if piece.removeprefix(START).isalpha() or piece == START:
            found.setdefault(piece, len(found))
    return found


class Lattice:
    """All places of pieces in words, by a trie whose edges are one sorted array of (node, letter)."""

    def __init__(self, pieces: dict[str, int]):
        nodes: dict[tuple[int, int], int] = {}
        own = [-1]
        for piece, k in pieces.items():
            at = 0
            for c in piece:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
                if at == len(own):
                    own.append(-1)
            own[at] = k
        edges = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = np.argsort(edges)
        self.edges, self.to, self.piece = np.append(edges[order], np.iinfo(np.int64).max), np.append(np.array(list(nodes.values()), np.int64)[order], 0), np.array(own)
        self.longest = max(map(len, pieces), default=1)

    def places(self, letters: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, piece) of what begins at start in the rows of letters; piece -1: a letter that is no piece."""
        rows, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        for size in range(1, min(self.longest, letters.shape[1] - start) + 1):
            key = node << 21 | letters[rows, start + size - 1]
            at = np.searchsorted(self.edges, key)
            on = self.edges[at] == key
            if size == 1:
                piece = np.where(on, self.piece[self.to[at]], -1)
                yield 1, rows, piece
                rows, node = rows[on], self.to[at[on]]
            else:
                rows, node = rows[on], self.to[at[on]]
                ends = self.piece[node] >= 0
                if ends.any():
                    yield size, rows[ends], self.piece[node[ends]]
            if not len(rows):
                return


def by_length(words: list[str], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, letters with START before them) of words of one length, about CELLS / cells letters at once."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(words) else []:
        n = int(sizes[own[0]]) + 1
        step = max(1, CELLS // (cells * n))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            text = "".join(START + words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64).reshape(-1, n)


def expected_counts(words: list[str], times: np.ndarray, group: np.ndarray, n_groups: int, lattice: Lattice, n_pieces: int) -> np.ndarray:
    """(groups x pieces) expected uses of each piece over all segmentations of the words, all pieces being equally likely."""
    total = np.zeros(n_groups * n_pieces)
    p = 1.0 / n_pieces
    for part, letters in by_length(words, 2 * lattice.longest):
        rows, n = letters.shape
        # forward[:, i] are kept relative to the sum at the last start, which is c[:, i] of what it was before
        forward, c = np.zeros((rows, n + 1)), np.ones((rows, n + 1))
        forward[:, 0] = 1.0
        steps = []
        for start in range(n):
            c[:, start] = forward[:, start]
            forward[:, start : start + lattice.longest + 1] /= c[:, start : start + 1]
            for size, at, piece in lattice.places(letters, start):
                steps.append((start, size, at, piece))
                forward[at, start + size] += p
        c[:, n] = forward[:, n]
        # share[:, i]: how likely a border at i is
        share = np.zeros((rows, n + 1))
        share[:, n] = 1.0
        weight, key = times[part].astype(float), group[part] * n_pieces
        for start, size, at, piece in reversed(steps):
            x = p * share[at, start + size]
            for k in range(start + 1, start + size + 1):
                x /= c[at, k]
            share[at, start] += x
            known = piece >= 0
            np.add.at(total, key[at[known]] + piece[known], x[known] * weight[at[known]])
    return total.reshape(n_groups, n_pieces)


def word_log_probabilities(words: list[str], lattice: Lattice, probabilities: np.ndarray) -> np.ndarray:
    """(words x languages) log P(word); probabilities: pieces x languages, and a last row for a letter in no piece."""
    n_langs = probabilities.shape[1]
    out = np.zeros((len(words), n_langs))
    for part, letters in by_length(words, n_langs):
        rows, n = letters.shape
        forward, logs = np.zeros((n + 1, rows, n_langs)), np.zeros((rows, n_langs))
        forward[0] = 1.0
        for start in range(n):
            if start % 8 == 0:
                c = forward[start].copy()
                forward[start : start + lattice.longest + 1] /= c
                logs += np.log(c)
            for size, at, piece in lattice.places(letters, start):
                forward[start + size, at] += forward[start, at] * probabilities[piece]
        out[part] = logs + np.log(forward[n])
    return out


def learn(docs: DataFrame, text: Column, lang: Column, vocab: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """The languages in order, and piece probabilities (pieces x languages)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            words, langs, ns = [], [], []
            for own, c in counts.items():
                for w in [w for w in c if not w.isalpha()]:
                    k = c.pop(w)
                    for x in letter_runs(w):
                        c[x] += k
                words += c.keys()
                ns += c.values()
                langs += [own] * len(c)
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "lang": pa.array(langs, pa.string()), "n": pa.array(ns, pa.int64())})

        for batch in batches:
            for own, t in zip(batch.column("lang").to_pylist(), chain.from_iterable(slices(batch.column("text")))):
                counts.setdefault(own, Counter()).update(WORDS(t.lower()))
                if sum(map(len, counts.values())) > FLUSH:
                    yield flush()
        yield flush()

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(vocab)
        lattice = Lattice(pieces)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, group = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            sums = expected_counts(batch.column("word").to_pylist(), batch.column("n").to_numpy(), group, len(langs), lattice, len(pieces))
            for own, x in zip(langs, sums):
                total[own] = total[own] + x if own in total else x
        for own, sums in total.items():
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([own] * len(k), pa.string()), "piece": pa.array(k, pa.int64()), "x": pa.array(sums[k])})

    def pack(group: pa.Table) -> pa.Table:
        sums = np.zeros(len(vocabulary(vocab)))
        sums[group.column("piece").to_numpy()] = group.column("x").to_numpy()
        return pa.table({"lang": group.column("lang").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    texts = docs.select(text.alias("text"), lang.cast("string").alias("lang")).where("text is not null and lang is not null")
    words = texts.mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(expect, "lang string, piece long, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
    rows = counts.groupBy("lang").applyInArrow(pack, "lang string, sums binary").limit(MOST_LANGUAGES + 1).collect()  # a row for each language
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"a model holds at most {MOST_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    langs = [r["lang"] for r in rows]
    table = np.stack([np.frombuffer(r["sums"]) for r in rows], 1) if rows else np.zeros((len(vocabulary(vocab)), 0))
    pooled = (table.sum(1, keepdims=True) + 1e-3) / (table.sum() + 1e-3 * len(table)) if langs else table
    return langs, (table + SMOOTHING * pooled) / (table.sum(0, keepdims=True) + SMOOTHING) if langs else table


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[Column], text: Column, vocab: str = VOCABULARY) -> DataFrame:
    """The kept columns, then lang_pred and score: the posterior of the most likely language, all being equally likely before."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, langs, table))

    @F.arrow_udf("lang_pred string, score double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        name, langs, table = shared.value
        n = len(langs)
        own = worker_cache(f"language {name}")
        if not own:
            own |= {"lattice": Lattice(vocabulary(vocab)), "known": {}, "blank": set(), "values": np.zeros((1 << 12, n))}
        lattice, known, blank = own["lattice"], own["known"], own["blank"]
        probabilities = np.concatenate([table, np.full((1, n), UNKNOWN)])
        for batch in texts:
            best, sure = [], []
            for raws in slices(batch):
                split = [WORDS(t.lower()) if t and n else [] for t in raws]
                if len(known) > KEEP_WORDS:
                    known.clear(), blank.clear()
                fresh = list(set().union(*split).difference(known))
                runs = [letter_runs(w) for w in fresh]
                found = word_log_probabilities([x for r in runs for x in r], lattice, probabilities)
                upto = np.cumsum([0, *map(len, runs)])
                sums = np.concatenate([np.zeros((1, n)), np.cumsum(found, 0)]) if len(found) > len(fresh) or not all(runs) else None
                values = own["values"]
                while len(known) + len(fresh) > len(values):
                    own["values"] = values = np.concatenate([values, np.zeros_like(values)])
                values[len(known) : len(known) + len(fresh)] = found if sums is None else sums[upto[1:]] - sums[upto[:-1]]
                blank.update(w for w, r in zip(fresh, runs) if not r)
                known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                for words in split:
                    if all(w in blank for w in words):
                        best.append("und")
                        sure.append(0.0)
                        continue
                    total = values[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                    k = int(total.argmax())
                    best.append(langs[k])
                    sure.append(float(1.0 / np.exp(total - total[k]).sum()))
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    return docs.select(*keep, score.asNondeterministic()(text).alias("__p")).select("*", "__p.*").drop("__p")


def held_out(id_col: str, modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id's text leaves the remainder; null ids count as the text of nothing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    out = held_out(id_col, 4)
    model = learn(docs.where(~out), F.col(text_col), F.col(lang_col))
    return predict(docs, model, [F.col(id_col).alias("doc_id"), out.alias("held_out")], F.col(text_col))


def accepted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that get a language with a posterior of at least `least`."""
    model = learn(docs, F.col(text_col), F.col(lang_col))
    row = F.struct(*docs.columns)
    p = predict(docs, model, [row.alias("row")], F.col(text_col))
    return p.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
