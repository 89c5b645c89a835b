"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A document is parsed against each: the longest prefix of what is left that
occurs in the language's text is one phrase, and so on. A text parses into few long phrases in its own language; the
one that needs the fewest phrases for each character wins.

Texts are normalised to lower-case letters with single spaces between words. Characters outside a language's text end a phrase and are one of their own.
Whole texts are parsed. Their pieces run in step through the automaton's transition table, each from the start; then a piece is run again from the state in which
the one before it ended, until it meets the states of its first run, and so on until no state changes: the parse is that of the uncut text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_hash, text_key

#: Characters of labelled text for each language, and of a document that are taken for it: the bound of what is learned.
MODEL_CHARS, DOC_CHARS = 40_000, 1_000
#: Every language is learned. Beyond 64 of them they share this number of characters alike.
TOTAL_CHARS = 64 * MODEL_CHARS
#: Characters of a piece; pieces parsed in step.
PIECE, STEP_ROWS = 512, 8_192
#: Places that are tried at once for a state's transitions.
WINDOW = 64
SPREAD = np.arange(WINDOW)[:, None]
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def normalise(text: str) -> str:
    return NOT_LETTERS.sub(" ", text).strip().lower()


class SuffixAutomaton:
    """Of a text; states have transitions by character, and state 0 is the start."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: str) -> int:
        """Phrases of the greedy longest-match parse, one character at a time."""
        n, state = 0, 0
        for c in text:
            if c in self.next[state]:
                n += state == 0
                state = self.next[state][c]
            else:
                n += 1
                state = self.next[0].get(c, 0)
        return n


class Table:
    """An automaton's transitions as rows laid over each other: that of `state` by the character of code c is at base[state] + c, if owner says so.

    States with several transitions go where theirs are free, those with most first; the rest have one each, which fits any free place. So the size follows the number of transitions
    (at most three for each character of the text), 8 bytes a place, and not that of states times different characters.
    """

    def __init__(self, automaton: SuffixAutomaton):
        self.chars = np.array(sorted(map(ord, automaton.next[0])), np.uint32)
        code = {chr(c): i + 1 for i, c in enumerate(self.chars)}
        width, n = len(self.chars) + 1, len(automaton.next)
        codes = [np.fromiter(map(code.__getitem__, go), np.int64, len(go)) for go in automaton.next]
        degree = np.array([len(x) for x in codes])
        self.base = np.zeros(n, np.int32)
        taken, start = np.zeros(2 * width + 2 * int(degree.sum()) + WINDOW, bool), 0
        several = np.nonzero(degree > 1)[0]
        for s in several[np.argsort(-degree[several], kind="stable")].tolist():
            while True:
                if start + WINDOW + width > len(taken):
                    taken = np.concatenate([taken, np.zeros(len(taken), bool)])
                free = np.nonzero(~taken[start + SPREAD + codes[s]].any(axis=1))[0]
                if len(free):
                    break
                start += WINDOW
            self.base[s] = start + free[0]
            taken[self.base[s] + codes[s]] = True
        single = np.nonzero(degree == 1)[0]
        while (~taken[width:]).sum() < len(single):
            taken = np.concatenate([taken, np.zeros(len(taken), bool)])
        self.base[single] = width + np.nonzero(~taken[width:])[0][: len(single)] - np.array([codes[s][0] for s in single], np.int64)
        size = int(self.base.max()) + width
        self.owner, self.target, self.root = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(width, np.int32)
        states = np.repeat(np.arange(n), degree)
        at = self.base[states] + np.concatenate([*codes, np.zeros(0, np.int64)])
        to = np.fromiter((t for go in automaton.next for t in go.values()), np.int32, len(at))
        self.owner[at], self.target[at] = states, to
        self.root[codes[0]] = to[: degree[0]]

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.chars, self.base, self.owner, self.target, self.root))

    def phrases(self, pieces: np.ndarray, sizes: np.ndarray, before: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin in each piece, states in which pieces end).

        pieces: characters, one row a piece, longest first; before: the row that each goes on from, or -1; start: the state before pieces with none.
        """
        every = np.arange(len(pieces))
        at = np.searchsorted(self.chars, pieces)
        at[at == len(self.chars)] = 0
        codes = np.where(self.chars[at] == pieces, at + 1, 0).astype(np.int32) if len(self.chars) else np.zeros(pieces.shape, np.int32)
        codes = np.ascontiguousarray(codes.T)
        states, begins = np.zeros(codes.shape, np.int32), np.zeros(codes.shape, bool)

        def step(j: int, rows: slice | np.ndarray, state: np.ndarray) -> np.ndarray:
            c = codes[j, rows]
            place = self.base[state] + c
            to = np.where(self.owner[place] == state, self.target[place], 0)
            # A phrase begins where the automaton stands at its start, or where it has no way on.
            begins[j, rows] = (state == 0) | (to == 0)
            return np.where(to == 0, self.root[c], to)

        state = np.where(before < 0, start, 0).astype(np.int32)
        used = state.copy()
        live = np.searchsorted(-sizes, -np.arange(1, pieces.shape[1] + 1), side="right")  # pieces with a character at each step
        for j, m in enumerate(live.tolist()):
            if not m:
                break
            state = states[j, :m] = step(j, slice(0, m), state[:m])
        while True:
            entry = np.where(before < 0, start, states[sizes - 1, every][before])
            rows = np.nonzero(entry != used)[0]
            if not len(rows):
                return begins.sum(axis=0), states[sizes - 1, every]
            used[rows] = state = entry[rows].astype(np.int32)
            for j in range(len(codes)):
                state = step(j, rows, state)
                more = (state != states[j, rows]) & (sizes[rows] > j + 1)
                states[j, rows] = state
                rows, state = rows[more], state[more]
                if not len(rows):
                    break


def parse(texts: list[str], models: list[Table]) -> np.ndarray:
    """Phrases of each normalised text, a row, by each model, a column."""
    cut = [(i, x[k : k + PIECE]) for i, x in enumerate(texts) for k in range(0, len(x), PIECE)]
    out = np.zeros((len(texts), len(models)), np.int64)
    carried = np.zeros(len(models), np.int32)  # states at the end of the pieces before, for a text that goes on
    for k in range(0, len(cut), STEP_ROWS):
        own = cut[k : k + STEP_ROWS]
        who, sizes = np.array([i for i, _ in own]), np.array([len(x) for _, x in own])
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        follows = np.concatenate([[False], who[1:] == who[:-1]])
        before = np.where(follows, np.concatenate([[0], place[:-1]]), -1)[order]
        sizes = sizes[order]
        pieces = np.zeros((len(own), sizes[0]), np.uint32)
        pieces[np.arange(sizes[0]) < sizes[:, None]] = np.frombuffer("".join(own[i][1] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.zeros((len(models), len(own)), np.int32)
        if k and cut[k - 1][0] == who[0]:
            start[:, place[0]] = carried
        for j, model in enumerate(models):
            n, ends = model.phrases(pieces, sizes, before, start[j])
            np.add.at(out[:, j], who[order], n)
            carried[j] = ends[place[-1]]
    return out


def sample(docs: DataFrame) -> dict[str, str]:
    """Labelled text for every language, of at most MODEL_CHARS, less if there are very many: a spread of documents, in the order of a hash of their ids."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    order = F.xxhash64("doc_id", text_key(F.col("text")))
    counts = known.groupBy("lang").agg(F.count_distinct(order).alias("count"), F.min(order).alias("least")).collect()
    chars = max(1, min(MODEL_CHARS, TOTAL_CHARS // max(1, len(counts))))
    each = min(DOC_CHARS, 2 * chars)
    want = max(1, 2 * chars // each)
    out: dict[str, str] = {}
    parts = docs.sparkSession.createDataFrame([(x["lang"], max(1, x["count"] // want), x["least"]) for x in counts], "lang string, every long, least long")
    # About `want` documents a language, the one of the least hash always; rows equal in id and text count once, so what comes to the driver is bounded and copies crowd out nothing.
    picked = known.join(F.broadcast(parts), "lang").filter((F.pmod(order, F.col("every")) == 0) | (order == F.col("least"))).select("lang", order.alias("o"), F.substring("text", 1, each).alias("text")).dropDuplicates(["lang", "o"])
    for x in sorted(picked.collect(), key=lambda x: (x["lang"], x["o"], x["text"])):
        have = out.get(x["lang"], "")
        if len(have) < chars:
            out[x["lang"]] = (have + " " + normalise(x["text"]))[:chars]
    return out


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score for each row of `docs` (doc_id, text), after `labelled` (doc_id, text, lang).

    score: the winner's share of 1 / phrases over all languages. Null texts, texts without a letter, and all texts if nothing is labelled: `und`, 0.
    Ties go to the language that comes first in alphabetical order. Repeated rows are judged alike; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = sample(labelled)
    langs = sorted(texts)
    models = spark.sparkContext.broadcast([Table(SuffixAutomaton(texts[x])) for x in langs])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, some = batch.column("text").to_pylist(), batch.column("letters").to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if langs and (i := [k for k, x in enumerate(some) if x]):
                inverse = 1 / np.maximum(parse([normalise(texts[k]) for k in i], models.value), 1)
                best = inverse.argmax(axis=1)
                for k, b, s in zip(i, best, inverse.max(axis=1) / inverse.sum(axis=1), strict=True):
                    pred[k], score[k] = langs[b], float(s)
            yield pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(id_hash(F.col("doc_id")), F.lit(3)) == 1
    found = identify(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
