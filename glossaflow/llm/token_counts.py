"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers count the tokens of byte-level BPE without making
them:

* ``Splitter`` cuts text into pretokens. Its states say which alternative of
  the splitting pattern is under way; a transition is annotated with the places
  where a pretoken begins. A batch is cut into chunks, each chunk is run from
  every state at once, which gives a map from entry to exit state, the maps
  compose by a parallel prefix scan, and then each chunk is run once from the
  state in which it really begins.
* ``PairTransducer`` reads the bytes of a pretoken. Its state is the last token
  of the encoding of each prefix after which a token can still be under way, and
  how many tokens these have fewer than the whole; a transition is annotated
  with the tokens that its byte adds. States and transitions are compiled when
  they are first met, and forgotten beyond a bound: a long run of one byte comes
  back to the same states, so it costs a look-up a byte. Results are kept for
  pretokens seen before, up to a bound.

Defined results: a null or empty text has no tokens; the special string of the
vocabulary counts as one token wherever it stands, as in the library;
very long texts and texts without any space take the same path; repeated rows
are counted each; other columns are ignored.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, SINGLE, R, V, L, E, END = range(12)
N_CLASSES = 12
# states: nothing begun; in letters, numbers, others; in white space that ends with a space or not; after ' and after 'r 'v 'l
NONE, LETTERS, NUMBERS, OTHERS, SPACES, WHITES, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(10)
N_STATES = 10
#: The ends of the contractions that the pattern takes as pretokens, and the white space of the pattern.
ONE_LETTER_ENDS, TWO_LETTER_ENDS = "stmd", {"r": "e", "v": "e", "l": "l"}
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Where a transition says a pretoken begins: at the character read, or at the one before it.
HERE, BEFORE = 1, 2


@cache
def code_classes() -> np.ndarray:
    """The class of every code point, from the Unicode categories."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[[ord(c) for c in WHITE_SPACE]] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    table[[ord(c) for c in ONE_LETTER_ENDS]] = SINGLE
    for c, kind in zip("rvle", (R, V, L, E), strict=True):
        table[ord(c)] = kind
    return table


@cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begins, both at state * N_CLASSES + class."""
    letters = {LETTER, SINGLE, R, V, L, E}

    def begin(c: int) -> int:
        """The state after a character that begins a pretoken."""
        return LETTERS if c in letters else {NUMBER: NUMBERS, SPACE: SPACES, WHITE: WHITES, OTHER: OTHERS, QUOTE: QUOTED, END: NONE}[c]

    def step(q: int, c: int) -> tuple[int, int]:
        if q in (QUOTED_R, QUOTED_V, QUOTED_L):
            if c == (L if q == QUOTED_L else E):
                return NONE, 0
            to, where = step(LETTERS, c)  # no contraction: the letter after the quote has begun letters
            return to, where | BEFORE
        if c == END:
            return NONE, 0
        if q in (SPACES, WHITES):
            if c in (SPACE, WHITE):
                return begin(c), 0
            if q == WHITES:  # the last white character stands alone
                return begin(c), BEFORE | HERE
            return OTHERS if c == QUOTE else begin(c), BEFORE
        if q == QUOTED:
            if c == SINGLE:
                return NONE, 0
            if c in (R, V, L):
                return {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
            if c in (OTHER, QUOTE):
                return OTHERS, 0
        if q == LETTERS and c in letters or q == NUMBERS and c == NUMBER or q == OTHERS and c in (OTHER, QUOTE):
            return q, 0
        return begin(c), HERE

    made = [step(q, c) for q in range(N_STATES) for c in range(N_CLASSES)]
    return np.array([x[0] for x in made], np.uint8), np.array([x[1] for x in made], np.uint8)


def scan(maps: np.ndarray) -> np.ndarray:
    """maps[i] composed after all maps before it, in log2(n) steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), 1)
        step *= 2
    return out


def pretoken_begins(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Where pretokens begin in a stream of classes. END separates texts and begins nothing."""
    to, where = transitions()
    n = -(-len(classes) // chunk) or 1
    padded = np.full(n * chunk, END, np.uint8)
    padded[: len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(n, chunk).T)
    # maps of all states; a chunk whose map has become constant goes on with one state only
    maps, single = np.tile(np.arange(N_STATES, dtype=np.uint8), (n, 1)), np.zeros(n, np.uint8)
    several, constant = np.arange(n), np.zeros(0, np.intp)
    for j in range(chunk):
        if len(several):
            maps[several] = to[maps[several].astype(np.intp) * N_CLASSES + columns[j][several][:, None]]
            if j % 16 == 15:
                same = (maps[several] == maps[several][:, :1]).all(1)
                fresh = several[same]
                single[fresh] = maps[fresh, 0]
                constant, several = np.concatenate([constant, fresh]), several[~same]
                single_j = columns[j + 1 :]
                if len(fresh):
                    state = single[fresh]
                    for row in single_j:
                        state = to[state.astype(np.intp) * N_CLASSES + row[fresh]]
                    maps[fresh] = state[:, None]
    entry = np.zeros(n, np.uint8)
    entry[1:] = scan(maps)[:-1, NONE]
    flags = np.zeros((chunk, n), np.uint8)
    state = entry
    for j in range(chunk):
        at = state.astype(np.intp) * N_CLASSES + columns[j]
        flags[j], state = where[at], to[at]
    flat = np.ascontiguousarray(flags.T).reshape(-1)
    begins = (flat & HERE) != 0
    begins[:-1] |= (flat[1:] & BEFORE) != 0
    return begins[: len(classes)]


class PairTransducer(dict):
    """Pretoken to its number of tokens; computed on first sight.

    states: the bytes at the end that begin some token, and for the prefix before each of them, and for the whole, its
    last token and how many tokens fewer than the whole it has.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 1_000_000, most_states: int = 50_000):
        super().__init__()
        self.ranks, self.most, self.most_states = ranks, most, most_states
        self.begun = {token[:i] for token in ranks for i in range(1, len(token))}
        self._forget()
        self.parts, self.pairs = self._splits(), {}
        self.joined = {v: k for k, v in self.parts.items()}

    def _splits(self) -> dict[int, tuple[int, int]]:
        """For each token the pair that merges to it: the cut at which both sides are tokens that encode to themselves, found by merging with lower ranks only."""
        out = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                left = [self.ranks[token[i : i + 1]] for i in range(len(token))]
                ends = list(range(1, len(token) + 1))
                starts = list(range(len(token)))
                while len(left) > 2:
                    best = min(((self.ranks.get(token[starts[i] : ends[i + 1]], rank), i) for i in range(len(left) - 1)), default=(rank, 0))
                    if best[0] >= rank:
                        break
                    i = best[1]
                    left[i : i + 2], ends[i : i + 2], starts[i : i + 2] = [best[0]], [ends[i + 1]], [starts[i]]
                if len(left) == 2:
                    out[rank] = (left[0], left[1])
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and then b is just a, b: no merge across their border would come before one inside them."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        joined, parts = self.joined, self.parts
        limit, ok = 1 << 60, True
        while True:
            merged = joined.get((a, b))
            if merged is not None and merged < limit:
                ok = False
                break
            # undo the later of the two merges that touch the border, as it was not there yet when earlier ones were made
            if a in parts and (a > b or b not in parts):
                limit, a = a, parts[a][1]
            elif b in parts:
                limit, b = b + 1, parts[b][0]
            else:
                break
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The state after one more byte and the tokens that it adds; found once, kept as a transition."""
        open_, last, less = self.states[state]
        read, ranks = open_ + bytes([byte]), self.ranks
        for i in range(len(read)):
            token = ranks.get(read[i:])
            if token is not None and (last[i] < 0 or self.compatible(last[i], token)):
                break
        more = 1 - less[i]
        while read and read not in self.begun:
            read = read[1:]
        kept = len(last) - len(read)
        made = read, (*last[kept:], token), (*[x + more for x in less[kept:]], 0)
        full = len(self.states) >= self.most_states
        if full:
            self._forget()
        to = self.numbers.setdefault(made, len(self.states))
        if to == len(self.states):
            self.states.append(made)
        if not full:
            self.moves[state << 8 | byte] = to, more
        return to, more

    def _forget(self) -> None:
        """No states but the first, in which nothing is read."""
        self.states, self.moves = [(b"", (-1,), (0,))], {}
        self.numbers = {self.states[0]: 0}

    def count(self, piece: bytes) -> int:
        if piece in self.ranks:
            return 1
        state = n = 0
        for byte in piece:
            state, more = self.moves.get(state << 8 | byte) or self.move(state, byte)
            n += more
        return n

    def __missing__(self, text: str) -> int:
        out = self.count(text.encode())
        if len(self) >= self.most:
            self.clear()
        if len(text) <= 64:
            self[text] = out
        return out


@cache
def compiled(vocabulary: str) -> tuple[PairTransducer, tuple[str, ...]]:
    """The transducer over a vocabulary file (tokenizers' JSON of a byte-level BPE), and its special strings."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    of_char = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    special = tuple(x["content"] for x in spec["added_tokens"])
    ranks = {bytes(of_char[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    order = {}
    for i, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        order[bytes(of_char[c] for c in a + b)] = 256 + i
    if order:  # ranks by order of merging, whatever the ids are
        ranks = {t: order.get(t, i) for i, t in enumerate(sorted(ranks, key=lambda t: (len(t) > 1, ranks[t])))}
    return PairTransducer(ranks), special


def count_tokens(texts: list[str], counter: PairTransducer, special: tuple[str, ...]) -> np.ndarray:
    """The number of tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        parts = [text]
        for s in special:
            if s in text:
                parts = [y for x in parts for y in x.split(s)]
        out[i] += len(parts) - 1
        for x in parts:
            if x:
                pieces.append(x)
                owner.append(i)
    if not pieces:
        return out
    joined = "\0".join(pieces)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in pieces]) - 1
    classes = code_classes()[codes]
    classes[ends[:-1]] = END
    classes = np.append(classes, np.uint8(END))
    begins = np.flatnonzero(pretoken_begins(classes))
    stops = np.minimum(np.append(begins[1:], len(codes)), ends[np.searchsorted(ends, begins)])
    counts = np.fromiter(map(counter.__getitem__, [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]), np.int64, len(begins))
    np.add.at(out, np.array(owner), np.add.reduceat(counts, np.searchsorted(begins, np.concatenate([[0], ends[:-1] + 1]))))
    return out


def slices(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts with about so many characters, so that memory follows the longest text and not the batch."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def with_token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def counted(batches):
        import pyarrow as pa

        counter, special = compiled(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = np.concatenate([count_tokens(texts[s], counter, special) for s in slices(texts)]) if texts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return held.mapInArrow(tidy(counted), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
