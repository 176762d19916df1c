import random
import re
import zlib
from collections import Counter

import pytest

from conftest import DATA
from spanlight.llm import spelling


def near(a, b):
    """Whether exactly one inserted, deleted or replaced code point tells a from b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        found = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, ()) if near(w, x)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 8))) for _ in range(40)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(stems[: rng.randint(1, 40)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdÉ×ÿ") + w[at + 1 :], w[:at] + rng.choice("abC") + w[at:]])
            words.append(w)
        rows.append((i, " ".join(words)))
    return [*rows, (3, rows[3][1]), (None, rows[4][1]), (98, None), (99, ""), (100, "x" * 70_000 + " " + "lengthy " * 9), (101, "zchains " * 60 + "zchain " * 25 + "zchan " * 9 + "zchin " * 3)]


@pytest.mark.parametrize("most, size", [(1 << 25, 1 << 18), (1, 7)])
def test_against_all_pairs(spark, most, size):
    """Also with many small shards and a block each."""
    rows = texts(size)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    want = brute(rows)
    assert result(spelling.variants(df, most, size)) == want
    assert any(r[2] != r[1] and r[1] for r in want)  # some root lies more than a form away


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert result(spelling.variants(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert spelling.variants(docs.limit(0)).count() == 0


def test_automaton_on_random_tries():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))).encode() for _ in range(rng.randint(1, 30))})
        trie = spelling.Trie.from_bytes(spelling.Trie(words, list(range(1, len(words) + 1))).to_bytes())
        for _ in range(10):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
            assert sorted(trie.near(w.encode())) == [(x, i + 1) for i, x in enumerate(words) if near(w.encode(), x)]
