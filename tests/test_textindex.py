"""The text index against plain loops over all texts."""

import math
import random
import re

import pytest

from spanlight.operators import textindex as t


def _texts(seed, n=300):
    r = random.Random(seed)
    vocabulary = ["the", "then", "theory", "of", "red", "Redder", "éa", "x1", "a"]
    out = [(i * 37 - 2000, " ".join(r.choices(vocabulary, weights=[9, 3, 1, 5, 2, 1, 1, 1, 4], k=r.randrange(0, 40))) + r.choice(["", ".", ", the of"])) for i in range(n)]
    return [*out, (50_000, None), (50_001, ""), (50_002, "the " * 5000 + "red of"), (50_003, "rare")]


def _words(s):
    return re.findall(r"[^\W_]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    texts = _texts(1)
    ix = t.TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    ix.append(spark.createDataFrame([*texts[:150], (None, "the red")], "doc long, body string"), "doc", "body")
    ix.append(spark.createDataFrame(texts[150:], "doc long, body string"), "doc", "body")
    return texts, ix


def test_phrases_and_prefixes(spark, index):
    texts, ix = index
    queries = [(1, "the of", False), (2, "The red", True), (3, "the the the", False), (4, "a", True), (5, "nowhere the", False), (6, "", False), (7, None, True), (8, "of the re", True), (9, "th", True), (10, "red of", None)]
    got = {(r.query_id, r.doc): r.n for r in ix.phrase(spark.createDataFrame(queries, "query_id long, phrase string, prefix boolean")).collect()}
    want = {}
    for q, phrase, prefix in queries:
        p = _words(phrase)
        for doc, text in texts:
            w = _words(text)
            fits = lambda i: w[i : i + len(p) - 1] == p[:-1] and (w[i + len(p) - 1].startswith(p[-1]) if prefix else w[i + len(p) - 1] == p[-1])  # noqa: B023, E731
            if p and (n := sum(fits(i) for i in range(len(w) - len(p) + 1))):
                want[q, doc] = n
    assert got == want and len(got) > 300 and got[10, 50_002] == 1 and got[3, 50_002] == 4998


def test_ranks_are_those_of_scoring_every_text(spark, index):
    texts, ix = index
    queries = [(1, "red theory"), (2, "the"), (3, "rare the the"), (4, "unknown"), (5, None), (6, "x1 éa of")]
    bags = [(doc, _words(text)) for doc, text in texts]
    mean = sum(len(w) for _, w in bags) / len(bags)
    for k in (1, 7):
        rows = ix.ranked(spark.createDataFrame(queries, "query_id long, text string"), k).collect()
        got = {(r.query_id, r["rank"]): (r.doc, r.score) for r in rows}
        want = {}
        for q, text in queries:
            scores = []
            terms = set(_words(text))
            df = {x: sum(x in w for _, w in bags) for x in terms}
            for doc, w in bags:
                parts = [math.log(1 + (len(bags) - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in terms if x in w]
                if parts:
                    scores.append((-sum(round(p * t.UNIT) for p in parts), doc))
            want.update({(q, i + 1): (doc, -s / t.UNIT) for i, (s, doc) in enumerate(sorted(scores)[:k])})
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in want)


def test_ids_are_indexed_once(spark, index, tmp_path):
    texts, ix = index
    before = ix.commits()
    with pytest.raises(ValueError, match="indexed already"):
        ix.append(spark.createDataFrame([(99_999, "new"), texts[3]], "doc long, body string"), "doc", "body")
    assert ix.commits() == before
    with pytest.raises(Exception, match="there twice"):
        t.TextIndex(spark, str(tmp_path)).append(spark.createDataFrame([(1, "a"), (1, "b")], "doc long, body string"), "doc", "body")
    with pytest.raises(ValueError, match="no segment"):
        t.TextIndex(spark, str(tmp_path / "none")).rows()


def test_postings_go_to_their_block_once(spark, index, monkeypatch):
    """40 equal phrases are a row a block, beside the block's postings (round 4: each query shuffled the postings of its words)."""
    texts, ix = index
    rows, look = [], t.TextIndex._at_blocks
    monkeypatch.setattr(t.TextIndex, "_at_blocks", lambda self, columns, where, *a: rows.append(where.count()) or look(self, columns, where, *a))
    phrases = spark.createDataFrame([(i, "the of", i % 2 == 0) for i in range(80)], "query_id long, phrase string, prefix boolean")
    found = {r.query_id: r["count"] for r in ix.phrase(phrases).groupBy("query_id").count().collect()}
    blocks = ix.rows().where("term = 'the'").count()
    assert len(found) == 80 and len(set(found.values())) == 1 and rows == [2 * blocks]
    ranks = ix.ranked(spark.createDataFrame([(i, "the of the") for i in range(40)], "query_id long, text string"), 3)
    assert ranks.count() == 120 and max(rows[1:]) <= blocks + ix.rows().where("term = 'of'").count()


def test_an_index_is_written_by_one_shuffle_of_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b" if i % 3 else None) for i in range(3000)], "doc long, text string")
    plan = t.blocks(docs, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    ix = t.TextIndex(spark, str(tmp_path))
    ix.append(docs.where("doc % 3 = 0"), "doc", "text")
    assert ix.rows().where("term IS NULL").selectExpr("sum(n)").first()[0] == 1000 and ix.rows().where("term IS NOT NULL").count() == 0
    ix.append(docs.where("doc % 3 > 0"), "doc", "text")
    assert ix.phrase(spark.createDataFrame([(1, "a b", False)], "query_id long, phrase string, prefix boolean")).count() == 2000
