"""The pipeline's stages against brute-force versions, each over what the stage before it kept."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glossaflow.llm import mixing, queries, suffix_dedup

from . import edges
from .test_ngram_join import shingles
from .test_row_operators import brute_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), edges.documents(spark), [edges.documents(spark).collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, edges.SF).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        out.append(docs.collect())
    return out


def test_quality(stages):
    def passes(text):
        n, chars, symbols, again, _, base = brute_rules(text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        letters = sum(c.isalpha() for c in text)
        return not (base or len(lines) >= 4 and 100 * again > 60 * len(lines) or 100 * symbols > 20 * n or chars < 2 * n or chars > 25 * n or 100 * letters < 50 * chars or 100 * text.count("!") > 30 * n)

    assert Counter(stages[1]) == Counter(r for r in stages[0] if passes(r.text))


def test_near_duplicates(stages):
    sets = {r.doc_id: shingles(r.text, 5) for r in stages[1]}
    ids = sorted(sets)
    group = {i: i for i in ids}
    find = lambda i: i if group[i] == i else find(group[i])
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                group[q] = p
    assert {r.doc_id for r in stages[2]} == {i for i in ids if find(i) == i}
    assert set(stages[2]) <= set(stages[1])


def test_passages(stages):
    size, count = corpus_pipeline.PASSAGE.size, Counter()
    raw = {r.doc_id: r.text.encode() for r in stages[2]}
    for b in raw.values():
        count.update(b[s : s + size] for s in range(len(b) - size + 1))
    want = {}
    for i, b in raw.items():
        gone, out = [False] * len(b), b""
        for s in range(len(b) - size + 1):
            if count[b[s : s + size]] > 1:
                gone[s : s + size] = [True] * size
        runs, start = [], None
        for k, g in enumerate([*gone, False]):
            if g and start is None:
                start = k
            if not g and start is not None:
                runs.append(suffix_dedup.whole_characters(b, start, k))
                start = None
        at = 0
        for a, z in runs:
            out, at = out + b[at:a], z
        out = (out + b[at:]).decode()
        if out.strip(" "):
            want[i] = out
    assert {r.doc_id: r.text for r in stages[3]} == want
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_mixture(spark, stages):
    """Raked by plain loops, and drawn by the document's own number."""
    tokenizer = Tokenizer.from_file(queries.VOCABULARY.file)
    size = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in stages[3]}

    def topic(text):
        hits = [sum(w in words for w in re.split(r"[^\w]+|_", text.lower())) for words in queries.TOPICS.values()]
        return [*queries.TOPICS][hits.index(max(hits))] if max(hits) else "other"

    cell = {r.doc_id: (r.source, r.lang, topic(r.text)) for r in stages[3]}
    whole = sum(size.values())
    goals = []
    for k, margin in enumerate(queries.MARGINS):
        held = Counter()
        for i, c in cell.items():
            held[c[k]] += size[i]
        want = {v: (n / whole) ** margin.power for v, n in held.items()}
        goal, free, left = {}, dict(want), queries.KEEP * whole
        while over := [v for v, t in free.items() if t * left / sum(free.values()) >= held[v]]:
            scale = left / sum(free.values())
            for v in [v for v in over if free[v] * scale >= held[v]]:
                goal[v] = held[v]
                left -= held[v]
                del free[v]
        goals.append(goal | {v: t * left / sum(free.values()) for v, t in free.items()})
    tokens = Counter()
    for i, c in cell.items():
        tokens[c] += size[i]
    p = dict.fromkeys(tokens, queries.KEEP)
    for _ in range(200):
        for k, goal in enumerate(goals):
            for v, g in goal.items():
                mine = [c for c in p if c[k] == v]
                now, full = sum(tokens[c] * p[c] for c in mine), sum(tokens[c] for c in mine if p[c] >= 1)
                for c in mine:
                    if now >= g:
                        p[c] = min(1.0, p[c] * g / now) if now else 0.0
                    elif p[c] < 1 and now - full > 1e-12 * whole:
                        p[c] = min(1.0, p[c] * (g - full) / (now - full))
    draw = {r.doc_id: r.u for r in spark.createDataFrame(stages[3], stages_schema()).select("doc_id", mixing.uniform("doc_id", "text", 7).alias("u")).collect()}
    close = {i for i, c in cell.items() if abs(draw[i] - p[c]) < 1e-4}
    assert {r.doc_id for r in stages[4]} - close == {i for i, c in cell.items() if draw[i] < p[c]} - close
    assert set(stages[4]) <= set(stages[3]) and len(close) < 3


def stages_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_packed(stages):
    from .test_packing import gapless

    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}
    gapless(stages[5], corpus_pipeline.SEQUENCE)


def test_columns_and_run(spark, stages):
    for rows in stages[1:-1]:
        assert rows[0].__fields__ == COLUMNS
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, edges.SF).collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in stages[5]}


def test_stages_on_edges(spark, tmp_path):
    for name, df in [("edges", edges.frame(spark)), ("empty", edges.empty(spark))]:
        docs = df
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, edges.SF).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            if i < 4:
                assert docs.columns == df.columns
        assert name == "edges" or docs.count() == 0
