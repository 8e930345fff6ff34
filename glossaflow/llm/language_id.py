"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. For each language their
probabilities are fitted by expectation maximisation to words of a bounded,
documented sample of labelled rows; there, and only there, longer words count
as parts of RUN letters. A word's probability in a language is the sum over all
its segmentations into pieces, by the forward algorithm; long words are summed
by parts, each a linear map of the state, which compose to the same sum. A text
is scored by all of its words, and each worker keeps the words it has seen, up
to a bound.

Defined results: ``und`` with score 0 for a null text or one without letters;
empty labels table or no labelled row: everything is ``und``; ties go to the
language that comes first in order; a null id is held out; repeated rows are
each predicted; only the text is an input of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import POWERS, mix64, tidy
from .token_counts import slices

WORD = regex.compile(r"\p{L}+")
#: Letters of a part of a long word, and the probability of a letter that no piece holds.
RUN, FLOOR = 40, 1e-7
#: Each letter multiplies probabilities by this, which is taken off again at the end: without it long words would underflow.
SCALE = 24.0


def code_values(words: list[str], n: int) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)
    return mix64(codes.astype(np.uint64) + np.uint64(0x51ED270B))


def piece_hashes(words: list[str], n: int):
    """A function of (begin, end) that hashes that part of each word of n letters."""
    up, down = POWERS.to(n + 1)
    sums = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(code_values(words, n) * up[:n], axis=1, out=sums[:, 1:])
    return lambda a, b: mix64((sums[:, b] - sums[:, a]) * down[a] + np.uint64(b - a))


@cache
def vocabulary(path: str) -> tuple[np.ndarray, list[str]]:
    """The pieces that are letters, in lower case, sorted by hash; begins of words are marked by a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", " ").lower() for i in range(model.get_piece_size())}
    found = {x for x in found if re.fullmatch(r" ?[^\W\d_]+", x)}
    by_hash = {}
    for n in {len(x) for x in found}:
        words = sorted(x for x in found if len(x) == n)
        by_hash.update(zip(piece_hashes(words, n)(0, n).tolist(), words, strict=True))
    order = sorted(by_hash)
    return np.array(order, np.uint64), [by_hash[h] for h in order]


def runs(word: str) -> list[str]:
    """The parts of a word; the first has a space before it."""
    marked = " " + word
    return [marked[i : i + RUN] for i in range(0, len(marked), RUN)]


@dataclass
class Model:
    """log-free piece probabilities: pieces x languages, the last row for what is no piece."""

    languages: list[str]
    hashes: np.ndarray
    probabilities: np.ndarray
    #: Letters of the longest piece.
    longest: int

    def _ids(self, words: list[str], n: int) -> dict[tuple[int, int], np.ndarray]:
        part = piece_hashes(words, n)
        out = {}
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                h = part(begin, end)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                out[begin, end] = np.where(self.hashes[at] == h, at, len(self.hashes))
        return out

    def _weight(self, ids: np.ndarray, length: int) -> np.ndarray:
        p = self.probabilities[ids]
        if length == 1:  # a letter that is no piece
            p = np.maximum(p, FLOOR)
        return p * SCALE**length

    def forward(self, words: list[str], n: int, ids: dict | None = None) -> list[np.ndarray]:
        """alpha[i]: words x languages, the sum over all segmentations of the first i letters."""
        ids = ids or self._ids(words, n)
        alpha = [np.ones((len(words), len(self.languages)))]
        for end in range(1, n + 1):
            alpha.append(sum(alpha[b] * self._weight(ids[b, end], end - b) for b in range(max(0, end - self.longest), end)))
        return alpha

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            marked = " " + word
            if len(marked) > RUN:
                out[i] = self.long_score(marked)
            else:
                by_length.setdefault(len(marked), []).append((i, marked))
        for n, held in by_length.items():
            for a in range(0, len(held), 20_000):
                part = held[a : a + 20_000]
                at = np.array([i for i, _ in part])
                out[at] = np.log(self.forward([x for _, x in part], n)[n]) - n * np.log(SCALE)
        return out

    def long_score(self, marked: str) -> np.ndarray:
        """The same of one word of any length. The state at a letter is the forward sums of the longest places up to it; a part of the word maps the state before it to that after it, all parts are mapped at once, and the maps are applied in turn."""
        n, width, size = len(marked), self.longest, max(RUN, self.longest)
        state = np.zeros((width, len(self.languages)))  # state[k]: of k letters back
        state[0] = 1
        log = np.zeros(len(self.languages))
        whole = (n // size) * size
        for a in range(0, whole, 128 * size):
            starts = np.arange(a, min(a + 128 * size, whole), size)
            # each part with the letters before it that a piece may begin in
            parts = [marked[max(0, s - width) : s].rjust(width, "\0") + marked[s : s + size] for s in starts.tolist()]
            ids = self._ids(parts, width + size)
            sums = np.zeros((width + size + 1, len(parts), width, len(self.languages)))
            sums[width - np.arange(width), :, np.arange(width)] = 1
            for end in range(width + 1, width + size + 1):
                for begin in range(end - width, end):
                    sums[end] += sums[begin] * self._weight(ids[begin, end], end - begin)[:, None, :]
            for k in range(len(parts)):
                state = np.einsum("jbl,bl->jl", sums[width + size - np.arange(width), k], state)
                top = state.max(0)
                state, log = state / top, log + np.log(top)
        if n > whole:
            rest = marked[max(0, whole - width) : whole].rjust(width, "\0") + marked[whole:]
            ids, m = self._ids([rest], len(rest)), n - whole
            sums = [*state[::-1]]
            sums = [np.zeros_like(state[0]), *sums]  # sums[i]: at letter i of rest
            for end in range(width + 1, width + m + 1):
                sums.append(sum(sums[b] * self._weight(ids[b, end], end - b)[0] for b in range(end - width, end)))
            state = sums[-1][None]
        return np.log(state[0]) + log - n * np.log(SCALE)

    def expected(self, words: list[str], counts: np.ndarray, n: int, ids: dict) -> np.ndarray:
        """Expected uses of each piece in each language over all segmentations of the words; counts: words x languages."""
        alpha = self.forward(words, n, ids)
        beta = [np.ones_like(alpha[0])] * (n + 1)
        for begin in range(n - 1, -1, -1):
            beta[begin] = sum(self._weight(ids[begin, e], e - begin) * beta[e] for e in range(begin + 1, min(n, begin + self.longest) + 1))
        out, whole = np.zeros_like(self.probabilities), counts / alpha[n]
        for (b, e), which in ids.items():
            used = alpha[b] * self._weight(which, e - b) * beta[e] * whole
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(which, used[:, k], len(out))
        return out


def fit(words: dict[str, Counter], vocabulary_file: str, rounds: int = 4, smooth: float = 0.05) -> Model:
    """Expectation maximisation from probabilities that fall with a piece's length."""
    languages = sorted(words)
    hashes, pieces = vocabulary(vocabulary_file)
    start = np.array([30.0 ** -len(x) for x in pieces] + [0.0])
    model = Model(languages, hashes, np.repeat((start / start.sum())[:, None], len(languages), 1), max(map(len, pieces), default=1))
    counts: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        for word, n in words[lang].items():
            for x in runs(word):
                counts.setdefault(x, np.zeros(len(languages)))[k] += n
    by_length: dict[int, list[str]] = {}
    for x in counts:
        by_length.setdefault(len(x), []).append(x)
    groups = []
    for n, held in by_length.items():
        for a in range(0, len(held), 20_000):
            part = held[a : a + 20_000]
            groups.append((part, np.array([counts[x] for x in part]), n))
    for _ in range(rounds):
        total = sum(model.expected(part, c, n, model._ids(part, n)) for part, c, n in groups)
        total[-1] = 0
        total[:-1] += smooth
        model.probabilities = total / total.sum(0)
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_words(docs: DataFrame, chars: int, id_col: str, text_col: str, lang_col: str) -> dict[str, Counter]:
    """Words by language of labelled rows that are not held out: all rows of a language with at most chars code points, else a share of its rows, chosen by hash, with about so many, but at least the rows of the least hash."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("language sample")), 1).alias("h"))
    # rows without letters teach nothing; were one of them the least, its language would be lost
    rows = rows.where(F.col("t").rlike(r"\p{L}"))
    share = {}
    for lang, n, least in rows.groupBy("l").agg(F.sum(F.length("t")), F.min("h")).collect():  # as many as languages
        share[lang] = max(int(2**63 * min(1.0, chars / n)) - 1, least)
    if not share:
        return {}
    limits = F.create_map(*[x for lang, most in share.items() for x in (F.lit(lang), F.lit(most).cast("long"))])
    out: dict[str, Counter] = {lang: Counter() for lang in share}
    for lang, text in rows.where(F.col("h") <= F.element_at(limits, F.col("l"))).select("l", "t").toLocalIterator():
        out[lang].update(WORD.findall(text.lower()))
    return {lang: words for lang, words in out.items() if words}


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", most_words: int = 500_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches):
        import pyarrow as pa

        model = shared.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages) if model else 1))
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            for part in slices(texts) if model else ():
                found = [WORD.findall(t.lower()) for t in texts[part]]
                words = [w for x in found for w in x]
                fresh = list(set(words) - known.keys())
                if len(known) + len(fresh) > most_words:
                    known, table, fresh = {}, table[:0], list(set(words))
                if fresh:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    table = np.concatenate([table, model.scores(fresh)])
                sums = np.zeros((len(words) + 1, table.shape[1]))
                np.cumsum(table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))], axis=0, out=sums[1:])
                ends = np.cumsum([len(x) for x in found])
                for i, (n, end) in enumerate(zip(map(len, found), ends, strict=True), part.start):
                    if n:
                        x = sums[end] - sums[end - n]
                        k = int(x.argmax())
                        best[i], score[i] = model.languages[k], 1 / np.exp(x - x[k]).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(tidy(made), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_file: str, chars: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on a sample of at most about chars code points a language, and predicts every row."""
    words = training_words(docs, chars, id_col, text_col, lang_col)
    return predict(docs, fit(words, vocabulary_file) if words else None, id_col, text_col)
