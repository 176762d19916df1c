import hashlib
import random
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from conftest import DATA
from spanlight.llm import crosstok

PATHS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), crosstok.pair(*PATHS)


def brute(rows, libraries):
    """The contract in plain loops over the libraries' own tokens."""
    a_lib, b_lib, p = libraries
    all_ = []
    for _, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        own = (" " + (text or "")).encode()
        if b"".join(p.text_a[i] for i in a) != own or b"".join(p.text_b[i] for i in b) != own:
            a, b = [], []
        spans, ends = [], []
        for ids, texts in ((a, p.text_a), (b, p.text_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(texts[i]), i))
                at += len(texts[i])
            spans.append(out)
            ends.append({e for _, e, _ in out})
        shared, groups, here, i = ends[0] & ends[1], [], [[], []], [0, 0]
        for c in sorted(shared):
            here = [[], []]
            for side in range(2):
                while i[side] < len(spans[side]) and spans[side][i[side]][1] <= c:
                    here[side].append(str(spans[side][i[side]][2]))
                    i[side] += 1
            groups.append("|".join(",".join(x) for x in here))
        links, lo = [], 0
        for s, e, i in spans[0]:
            while lo < len(spans[1]) and spans[1][lo][1] <= s:
                lo += 1
            at = lo
            while at < len(spans[1]) and spans[1][at][0] < e:
                links.append((i, spans[1][at][2]))
                at += 1
        all_.append((len(a), len(b), groups, links))
    count = Counter(x for *_, links in all_ for x in set(links))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    return [(d, na, nb, len(g), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (d, _), (na, nb, g, links) in zip(rows, all_, strict=True)]


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = ["", None, " ", "  ", "a", "a ", " a  b", "a\n b\t c\r\n", "x  y", "<|endoftext|> <s> <unk>", "<0x0A>", "▁ ▁a", "\x00 \x1c \x1d a", "zażółć gęślą", "漢字 かな 😀👍🏽", "é ﬁ ①", "don't I'LL", "1 23  456", "﻿bom", "a​b", "ｆｕｌｌ"]


def test_against_plain_loops(spark, libraries):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(150):
        rows.append((100 + i, "".join(rng.choice("aeinrst  ,.'\n\téß1 2一\U0001f600") for _ in range(rng.randint(1, 80)))))
    rows += [(7, "again and again"), (7, "again and again"), (None, "nobody's text")]
    want = sorted(brute(rows, libraries), key=str)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, pairs string, row int")
    assert result(crosstok.align(df, *PATHS)) == want
    # Without and with few counts by broadcast, most links meet theirs by the join.
    assert result(crosstok.align(df, *PATHS, top=0)) == want and result(crosstok.align(df, *PATHS, top=20)) == want
    assert crosstok.align(df.limit(0), *PATHS).count() == 0


def test_documents_and_long_text(spark, libraries):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = [tuple(r) for r in docs.collect()]
    rows.append((-1, "lorem ipsum\ndolor " * 3_000 + "x" * 2_000))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(crosstok.align(df, *PATHS)) == sorted(brute(rows, libraries), key=str)


def test_groups_give_the_texts_back(spark, libraries):
    p = libraries[2]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for r in crosstok.token_groups(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect():
        assert sum(r.in_a) == len(r.a) and sum(r.in_b) == len(r.b) and len(r.in_a) == len(r.in_b)
        at = to = 0
        for x, y in zip(r.in_a, r.in_b, strict=True):
            assert b"".join(p.text_a[i] for i in r.a[at : at + x]) == b"".join(p.text_b[i] for i in r.b[to : to + y])
            at, to = at + x, to + y
        if r.a:
            assert b"".join(p.text_a[i] for i in r.a) == (" " + rows[r.doc_id][1]).encode()


def test_cut_texts_have_the_tokens_of_whole_ones(libraries):
    a_lib, b_lib, p = libraries
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "the", " ", " ", "  ", "\n", "\t", ".", "'s", "é", " ", "　", "\x85", "\x1f", "1", "漢", "▁"]) for _ in range(rng.randint(1, 30)))
        said = p.encode(text)
        if said:
            a, b = (list(memoryview(x).cast("I")) for x in said)
            assert a == a_lib.encode(" " + text, add_special_tokens=False).ids and b == b_lib.encode(text), repr(text)
