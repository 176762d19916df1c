import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import DATA
from spanlight.llm import arc, bpe, chat, htmltext, langid, mixing, nndescent, quality, secrets, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows, a clashing column."""
    long = "word " * 60_000
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "b", 0, "x"), (3, "one two", "en", "a", 7, None), (3, "one two", "en", "a", 7, None), (4, "One TWO", None, "a", 7, None), (None, "drei vier fünf sechs", "de", None, 20, ""), (5, long, "en", "b", len(long), ""), (6, " \t\n", "en", "b", 3, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_id_on_held_out_documents(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = langid.predict(big, langid.train(big)).where(langid.held_out(F.col("doc_id")))
    hit = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert hit[0] > 0.97 and 0 <= hit[1] <= hit[2] <= 1


def test_language_id_edges(spark, odd):
    said = langid.predict(odd, langid.train(odd)).collect()
    assert len(said) == 8 and all(r.lang_pred == "und" and r.score == 0 for r in said if r.text in (None, "", " \t\n"))
    assert langid.predict(odd, langid.train(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_model_against_plain_loops():
    import math

    rng = random.Random(4)
    rows = []
    for _ in range(40):
        at = sorted(rng.sample(range(30), 6))
        rows.append((rng.randrange(3), np.array(at), np.array([rng.random() for _ in at])))
    w, bias = langid.ftrl(rows, 3)
    z, n = {}, {}
    last = 1 << langid.BITS
    for _ in range(langid.EPOCHS):
        for y, at, x in rows:
            coords = [*zip(at.tolist(), x.tolist(), strict=True), (last, 1.0)]

            def weight(i, k):
                v = z.get((i, k), 0.0)
                return 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / ((langid.SMOOTH + math.sqrt(n.get((i, k), 0.0))) / langid.STEP + langid.L2)

            now = {(i, k): weight(i, k) for i, _ in coords for k in range(3)}
            s = [sum(v * now[i, k] for i, v in coords) for k in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for i, v in coords:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.STEP * now[i, k]
                    n[i, k] = old + g * g
    for (i, k) in z:
        v = z[i, k]
        want = 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / ((langid.SMOOTH + math.sqrt(n[i, k])) / langid.STEP + langid.L2)
        assert (bias[k] if i == last else w[i, k]) == pytest.approx(want, abs=1e-9)
    at, count = np.array([1, 5]), np.array([3, 1])
    idf = np.arange(10) / 10 + 1
    raw = [(1 + math.log(3)) * 1.1, 1.5]
    assert langid.features(at, count, idf).tolist() == pytest.approx([v / math.hypot(*raw) for v in raw])


def test_language_temperature_is_the_best_of_a_grid():
    import math

    rng = np.random.default_rng(3)
    logits, y = rng.standard_normal((200, 4)) * 5, rng.integers(0, 4, 200)
    y[:120] = logits[:120].argmax(axis=1)

    def loss(t):
        off = 1 / 202
        p = logits / t
        lse = np.log(np.exp(p - p.max(axis=1, keepdims=True)).sum(axis=1)) + p.max(axis=1)
        target = np.full((200, 4), off / 3)
        target[np.arange(200), y] = 1 - off
        return float((lse - (target * p).sum(axis=1)).mean())

    best = min((math.exp(x) for x in np.linspace(math.log(0.02), math.log(50), 4000)), key=loss)
    assert langid.temperature(logits, y) == pytest.approx(best, rel=0.01)


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    up = list(range(len(ids)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(root(i), []).append(x)
    return [min(x for x in groups[root(i)] if x is not None) if any(x is not None for x in groups[root(i)]) else None for i in range(len(ids))]


def test_simhash_is_exact(spark, docs, odd):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r.text) for r in rows]
        want = sorted(map(repr, zip([r.doc_id for r in rows], prints, brute_components([r.doc_id for r in rows], prints), strict=True)))
        got = sorted(repr((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in simhash.near_duplicates(table).collect())
        assert got == want


def test_simhash_trees_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    near = base[rng.integers(0, 300, 900)].copy()
    for _ in range(3):
        near ^= np.where(rng.random(900) < 0.7, np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64), np.uint64(0))
    dense = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    x = np.unique(np.concatenate([base, near, dense]))
    want = brute_components(list(range(len(x))), [int(v) for v in x])
    assert simhash.link(x).tolist() == want
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    parts = simhash.shards(frame, leaf=100)
    assert parts.select("leaf").distinct().count() > 20
    fps = {int(v): i for i, v in enumerate(x.view(np.int64))}
    up = list(range(len(x)))

    def root(i):
        return i if up[i] == i else root(up[i])

    groups = {}
    for r in parts.collect():
        groups.setdefault(r.leaf, []).append(fps[r.fp])
    for g in groups.values():
        for k, i in enumerate(simhash.link(x[sorted(g)]).tolist()):
            a, b = root(sorted(g)[k]), root(sorted(g)[i])
            up[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(x))] == want


def test_simhash_leaves_of_random_codes_stay_few(spark):
    x = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 40_000, dtype=np.int64)
    parts = simhash.shards(spark.createDataFrame([(int(v),) for v in x], "fp long"), leaf=1000)  # six levels
    assert parts.count() < 2 * 1.17**6 * len(x)
    assert parts.groupBy("leaf").count().agg(F.max("count")).first()[0] < 4000


def test_components_that_do_not_finish_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError):
        simhash.components(links, max_rounds=2)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_arc_versions_and_errors():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x\r\n\r\ny</p>"
    for version in (1, 2):
        data = arc.arc_file([("http://a.b/c d", "text/html", block), ("http://e", "text/html", b"raw")], version)
        got = list(arc.parse_arc(data))
        assert [r.block for r in got] == [block, b"raw"] and got[0].url == "http://a.b/c%20d"
        with pytest.raises(ValueError):
            list(arc.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(arc.parse_arc(b"http://x 0.0.0.0 20200101 text/html 3\nabc\n"))
    assert arc.iso("20200102") == "2020-01-02T00:00:00Z"
    ids = {arc.record_id(f, o, d) for f in ("a", "b") for o in (0, 7) for d in ("x", "y")}
    assert len(ids) == 8 and all(re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", i) for i in ids)


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    rows = [(3, "http://x", "same", 0), (1, "http://y", "same", 0), (2, None, None, 0), (9, "u", "", 0), (4, "u v\n", "WARC/1.0\r\n\r\nbody\r\n\r\n", 0), (None, "u", "same", 0), (1, "http://y", "same", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for name, limit in (("a", 1), ("b", 5000)):  # one record a file, and many
        monkeypatch.setattr(arc, "ARCHIVE_RECORDS", limit)
        legacy, path = str(tmp_path / f"arc{name}"), str(tmp_path / f"warc{name}")
        arc.write_arc(pages, legacy)
        records = arc.from_arc(spark, legacy)
        assert records.select("id").distinct().count() == 7
        arc.write_warc(arc.with_revisits(records), path)
        read = arc.read_warc(spark, path)
        assert read.select("id").distinct().count() == 7
        got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in arc.refers_to_keys(read).collect())
        d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
        same, none = d("same"), d("")
        assert got == sorted([(3, 4, same, "revisit", "1"), (1, 4, same, "response", "None"), (1, 4, same, "response", "None"), (0, 4, same, "revisit", "1"), (2, 0, none, "response", "None"), (9, 0, none, "revisit", "2"), (4, 20, d(rows[4][2]), "response", "None")])
    arc.write_arc(pages.limit(0), str(tmp_path / "none"))
    arc.write_warc(arc.with_revisits(arc.from_arc(spark, str(tmp_path / "none"))), str(tmp_path / "nothing"))


def test_warc_files_have_a_member_a_record(spark, tmp_path):
    import gzip
    import os

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    arc.write_arc(pages, str(tmp_path / "a"))
    arc.write_warc(arc.with_revisits(arc.from_arc(spark, str(tmp_path / "a"))), str(tmp_path / "w"))
    whole = b"".join((tmp_path / "w" / f).read_bytes() for f in os.listdir(tmp_path / "w") if f.startswith("part"))
    plain = gzip.decompress(whole)  # a reader of plain gzip understands it
    assert plain.count(b"WARC/1.0\r\n") == whole.count(b"\x1f\x8b\x08") and plain.count(b"WARC-Type: response") == 40
    assert gzip.decompress(arc._members(b"x" * (1 << 24))) == b"x" * (1 << 24) and arc._members(b"x" * (1 << 24))[-1] == 0
    # A foreign archive without source keys: every record has an id of its own.
    block = b"HTTP/1.1 200 OK\r\n\r\nsame"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.arc").write_bytes(arc.arc_file([("http://a", "text/html", block)] * 3))
    got = arc.with_revisits(arc.from_arc(spark, str(tmp_path / "f"))).collect()
    assert len({r.id for r in got}) == 3 and sum(r.refers_to is None for r in got) == 1 and all(r.key is None for r in got)


def test_chat_layouts_and_escapes(spark):
    rows = [
        (1, '{"prompt":"p","completion":"c"}'), (2, '{"instruction":"i","input":"n","output":"o"}'), (3, '{"messages":[{"role":"user","content":"<|im_end|> <\\\\|x"},{"role":"assistant","content":""}]}'),
        (4, '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}'), (5, '{"what":1}'), (6, None), (7, "no json"),
    ]
    said = {r.conv_id: r for r in chat.canonical_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert [said[i].layout for i in range(1, 8)] == ["prompt_completion", "instruction_input", "messages", "sharegpt", "unknown", "unknown", "unknown"]
    assert [(t.role, t.text) for t in said[4].turns] == [("user", "h"), ("assistant", "g")]
    texts = ["<|im_end|>", "<\\|im_start|>", "a\nb<|im_end|>\n", "", "<\\\\|", "<<|"]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us er<|\n", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(turns)
    back = out.select(chat.parse_formatted(F.col("formatted")).alias("t"), chat.loss_spans(F.col("formatted"), F.col("in_loss")).alias("s"), chat.masked_text(F.col("formatted"), F.col("in_loss")).alias("m"), "formatted").first()
    assert [t.text for t in back.t] == texts and back.t[0].role == "us er<|\n"
    assert [back.formatted[s.start : s.end] for s in back.s] == ["<\\\\|im_start|>", "", "<<\\|"]
    assert back.m == "".join(texts[1::2])


def test_chat_fingerprints_see_nesting(spark):
    record = '{"a":{"b":[{"c":1,"d":{"e":[1,2]}},{"c":2}],"f":null},"g":[],"h":[[{"i":"x"}]],"x y":{"`q`":true}}'
    paths = spark.range(1).select(chat.record_paths(F.lit(record))).first()[0]
    assert {"a.b[].c", "a.b[].d.e[]", "a.f", "g[]", "h[][].i"} <= set(paths) and len(paths) == 6
    rows = [
        (1, '{"prompt":{"completion":"b"}}'), (2, '{"messages":[{"role":"user","content":"q","name":"n"}],"id":7}'), (3, '{"prompt":"p","response":"r","input":"?"}'), (4, '{"meta":{"prompt":"no"},"prompt":"p","completion":"c"}'), (5, "[]"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r.conv_id: r.layout for r in chat.canonical_records(df).collect()}
    assert got == {1: "unknown", 2: "messages", 3: "unknown", 4: "prompt_completion", 5: "unknown"}
    out = {r.conv_id: r for r in chat.format_turns(chat.turn_rows(df)).collect()}
    assert {k: r.unknown for k, r in out.items()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1} and out[1].formatted == ""
    nested = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r.role, r.text) for r in chat.turn_rows(nested).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]


def test_chat_nulls_clashes_and_long_texts(spark):
    long = "x<|im_end|>" * 50_000
    rows = [(None, 0, "user", "q", "s"), (None, 1, "assistant", None, None), (1, 0, None, long, "s"), (1, 0, None, long, "s"), (2, None, "assistant", "", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(chat.turn_rows(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 1: 2, 2: 1} and got[1].loss_chars == 0
    said = "".join(f"\n{t}\n" for t in (long, long))
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digest(chat.format_turns(chat.turn_rows(df.limit(0)))).count() == 0


def test_quality_against_brute_force(spark, odd):
    pieces = ["a", "Bc", "#", "\x0b", "\x1c", "\xa0", "é", "Ⅰ", "ÀÀ", "…", "...", "- ", "* x", "\n", "\n", " ", " ", "\x85", "\x01", "word", "the", "$%"]
    rng = random.Random(8)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 120))) for _ in range(400)] + ["same line here\n" * 30, "- a\n- b\n- c d e f g h i j k", None, "A plain sentence of words that differ from each other, and not too few"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = quality.order_rules(df)
    assert sorted(order) == sorted(quality.RULES)
    ruled = {r.doc_id: r for r in quality.cascade(df, order).collect()}
    for r in quality.judge(df, order).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert r[1:6] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        hit = {name for name, rejects in quality.RULES.items() if rejects(quality.Doc(t))}
        assert r.kept == ruled[r.doc_id].kept == (not r.base_failed and not hit)
        assert ruled[r.doc_id].rejected_by in ({"base"} if r.base_failed else hit or {None})
    assert {r.rejected_by for r in ruled.values()} >= {"base", None}
    assert quality.judge(odd, quality.order_rules(odd)).count() == 8
    none = odd.limit(0)
    assert quality.judge(none, quality.order_rules(none)).count() == 0


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert quality.repeated_words(words) == len(covered)
    many = [str(i).encode() for i in range(9000)] * 2
    assert quality.repeated_words(many) == 18000


def test_bpe_equals_the_library(spark, docs, odd):
    path = bpe.tokenizer_path()
    theirs, enc = Tokenizer.from_file(path), bpe.encoder(path)
    rng = random.Random(1)
    letters = [*"aabcth eE'sd \n\t 12.,!éß　\xa0\x85\x1c\x00你😀", "<|endoftext|>", "  ", "the"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)] + [r.text or "" for r in docs.union(docs).select("text").limit(100).collect()] + ["ab" * 9000, "a" * 12000, "你😀" * 5000, " " * 5000, "word " * 40_000]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9000)), "".join(rng.choices("tehriaons", k=20_000))]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        blocks = list(enc.packed(t))
        assert np.frombuffer(b"".join(blocks), "<u4").tolist() == ids
        state = bpe.Decoder()
        said = "".join(x for b in blocks for x in bpe.decode(b, enc.v, state)) + state.end()
        assert said == theirs.decode(ids, skip_special_tokens=False)
    assert bpe.digest(odd, path).count() == 8 and bpe.encode(odd, path).count() == 8
    assert bpe.digest(odd.limit(0), path).count() == 0
    state = bpe.Decoder()
    assert "".join(state.push(bytes([b])) for b in "aé你😀".encode() + b"\xff") + state.end() == "aé你😀�"


def test_bpe_transducer_keeps_constant_state():
    enc = bpe.encoder(bpe.tokenizer_path())
    v, run = enc.v, bpe.Transducer(enc.v)
    rng = random.Random(3)
    stream = "".join(rng.choices("tehriaons", k=60_000)).encode()
    most = 0
    stable = run._stable

    def seen(last, size, at):
        nonlocal most
        keep, out = stable(last, size, at)
        most = max(most, at - keep)
        return keep, out

    run._stable = seen
    out = [i for ids in run.run(stream[i : i + 512] for i in range(0, len(stream), 512)) for i in ids]
    assert b"".join(v.text[i] for i in out) == stream
    assert 0 < most <= v.lookahead  # undecided bytes after each look


def test_mixing_reaches_its_targets(spark, odd):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 0 and sum(got.values()) == pytest.approx(1510) and got["b"] == pytest.approx(1480 * 2 / 7)
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == 8 and all(r.reps <= 3 for r in mixed)
    assert mixing.mix(odd.limit(0)).count() == 0
    big = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.sum(F.col("size") * F.col("reps")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"))
    assert big.where(F.abs(F.col("taken") - F.col("target")) > F.col("most")).count() == 0


def test_html_layout():
    page = "<title>t</title><style>x</style><h1>A &amp; B</h1><p>one<p hidden>no</p><p>two<br>three  four<ul><li>x<li>y<ol><li>z</ol></ul><div style='display:none'>no</div><table><tr><th>k<th>value<tr><td>long key<td>1</table><pre>a\n  b</pre>tail<"
    assert htmltext.text_of(page) == "A & B\n\none\n\ntwo\nthree four\n\n- x\n- y\n  1. z\n\nk         value\nlong key  1\n\na\n  b\n\ntail<"
    for bad in ("", None, "<", "<p", "<table><td>x", "</div>y", "<a href='x>z", "<div>" * 5000 + "deep", "<li>x</ul>", "<!-- x"):
        assert isinstance(htmltext.text_of(bad), str)
    assert htmltext.text_of("<div>" * 5000 + "deep") == "deep"


def test_html_spans_and_style_rules():
    table = "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell<td>d<tr><td rowspan=0>x<td>y<td>z<tr><td>w</table>"
    assert htmltext.text_of(table) == "a          b\n           c\nwide cell     d\nx          y  z\n           w"
    assert htmltext.text_of("<table><tr>" + "<td colspan=3>x<td>y" * 60 + "</table>").split() == ["x", "y"] * 60
    css = "<style>/* .a{} */ .no, p.gone{display:none} #id{visibility:hidden} @media print{.print{display:none}} .no.yes{display:block} div .deep{display:none}</style>"
    assert htmltext.text_of(css + "<p class='x no'>1<p class=gone>2<div class=gone>3</div><i id=id>4</i><b class=print>5</b><b class='no yes'>6</b><div><b class=deep>7</b></div><b class=no style='display:inline'>8") == "3\n56\n7\n8"


def test_html_keeps_all_visible_words():
    """Random trees whose visible words are known as they are made."""
    rng = random.Random(12)
    count = iter(range(10**9))

    def make(depth, shown, inside):
        html, words = [], []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "block", "inline", "hidden", "list", "table", "comment", "class", "entity"]) if depth else "text"
            if kind in ("text", "entity"):
                w = f"w{next(count)}" + ("&amp;x" if kind == "entity" else "")
                html.append(f" {w} ")
                words += [w.replace("&amp;", "&")] if shown else []
            elif kind == "comment":
                html.append(f"<!-- c{next(count)} > -->")
            elif kind == "list":
                items = [make(depth - 1, shown, "li") for _ in range(rng.randint(1, 3))]
                html.append("<ul>" + "".join(f"<li>{h}" + rng.choice(["", "</li>"]) for h, _ in items) + "</ul>")
                words += [w for _, ws in items for w in (["-", *ws] if ws else [])]
            elif kind == "table" and inside != "li":
                cells = [f"c{next(count)}" for _ in range(4)]
                html.append("<table><tr><td>{}<td>{}<tr><th colspan=2>{}</th><td>{}</table>".format(*cells))
                words += cells if shown else []
            elif kind in ("block", "inline", "hidden", "class", "table"):
                tag = rng.choice(["div", "section", "blockquote"]) if kind == "block" else "span" if kind == "inline" else "div"
                off = {"hidden": rng.choice([" hidden", " style='display: none'"]), "class": " class='a off'"}.get(kind, "")
                h, ws = make(depth - 1, shown and not off, inside)
                html.append(f"<{tag}{off}>{h}</{tag}>")
                words += ws
        return "".join(html), words

    for _ in range(300):
        html, words = make(4, True, "")
        assert htmltext.text_of("<style>.off{display:none}</style>" + html).split() == words


def test_html_extraction_in_spark(spark):
    rows = [(1, "<p>a<p>b", "t", 0), (1, "<p>a<p>b", "t", 0), (None, None, None, 1), (2, "", "x", 2), (3, "<p>" + "word " * 200_000, "y", 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_lines int")
    got = sorted(((r.page_id or 0, r.text[:8], r.n_lines) for r in htmltext.extract(df).collect()))
    assert got == [(0, "", 0), (1, "a\n\nb", 3), (1, "a\n\nb", 3), (2, "", 0), (3, "word wor", 1)]
    assert htmltext.extract(df.limit(0)).count() == 0


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 12 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_base_and_grammar(spark, odd):
    rng = random.Random(2)
    pieces = ["token", "=", "secret:", " ", "API_KEY", "apikey = '", "password", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef", "x", '"', "é", "\n", "Passwd : "]
    for _ in range(4000):
        t = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        assert secrets.base_spans(t) == brute_secrets(t)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    kinds = {"hex": secrets.infer([key(40) for _ in range(200)]), "access": secrets.infer(["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(200)])}
    plain = secrets.infer(["".join(rng.choices(["tion", "er", "the", "ing", "an"], k=6)) for _ in range(300)])
    model = secrets.Model(kinds, plain)
    assert secrets.spans_of("see " + key(20).upper() + "9F and theingantiontheer", model)[0][2] == "grammar"
    assert secrets.spans_of("theingantiontheer" + "tion" * 4, model) == []
    assert secrets.scan(odd, secrets.learn(odd)).count() == 8
    assert {r.doc_id: r.text for r in secrets.redact(odd, model).collect()}[3] == "one two"


def test_secret_automata_against_counts():
    import math

    rng = random.Random(5)
    words = ["".join(rng.choices("abc", [5, 3, 1], k=rng.randint(1, 9))) for _ in range(400)]
    one = secrets.infer(words, alpha=1e-300)  # everything is compatible: one state, plain frequencies
    n = {c: sum(w.count(c) for w in words) for c in "abc"} | {"": len(words)}
    total = sum(n.values()) + 0.5 * 5
    p = lambda c: math.log2((n[c] + 0.5) / total)
    assert len(one.states) == 1 and one.bits("abca") == pytest.approx(p("a") * 2 + p("b") + p("c") + p(""))
    # Letters and digits in turn, an end after a digit only: the start, after a letter, after a digit.
    often = lambda: 1 + next(n for n in range(99) if rng.random() < 0.3)
    pairs = ["".join(rng.choice("xyz") + rng.choice("12") for _ in range(often())) for _ in range(2000)]
    two = secrets.infer(pairs, alpha=1e-5)
    assert len(two.states) == 3
    assert two.bits("x1y2") > two.bits("xy12") + 10 and two.bits("x1") > two.bits("x") + 5


def test_secret_sample_is_the_least_of_all(spark):
    import xxhash

    words = [f"{i:x}".rjust(20, "a") for i in range(3000)]
    df = spark.createDataFrame([(i, f"{w} and {w} Zz{w}") for i, w in enumerate(words)], "doc_id long, text string").repartition(7)
    got = secrets.samples(df, {"assign": 5, "access": 5, "hex": 40, "": 9})
    h = lambda w: (xxhash.xxh64_intdigest(w.encode(), secrets.SEED) >> 1, w)
    assert got["hex"] == sorted(set(words), key=h)[:40] and got["assign"] == [] and len(got[""]) == 0


def test_secret_scan_on_held_out_values(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = secrets.samples(docs, {"assign": 400, "access": 0, "hex": 400, "": 2000})
    half = lambda k: (got[k][::2], [w for w in got[k][1::2] if len(w) >= 16])
    model = secrets.Model({k: secrets.infer(half(k)[0]) for k in ("assign", "hex")}, secrets.infer(half("")[0]))
    caught = lambda ws: sum(model.score(w) >= secrets.MIN_BITS for w in ws) / len(ws)
    assert caught(half("hex")[1]) > 0.95 and caught(half("assign")[1]) > 0.9 and caught(half("")[1]) < 0.01


def test_secret_scan_of_an_empty_table(spark, odd):
    none = odd.limit(0)
    assert secrets.scan(none, secrets.learn(none)).count() == 0


def test_nn_descent_edges(spark):
    v = lambda *x: [float(c) for c in x]
    bad = [(-50, None), (-100, v(0, 0)), (-150, v("nan", 1)), (-200, [None, 1.0]), (-250, v("inf", 1)), (-300, v(1, 2, 3)), (None, v(1, 1))]
    good = [(0, v(1, 0)), (3, v(2, 0)), (1, v(1, 0)), (2, v(0, 1)), (50, v(1, 1)), (50, v(1, 1))]
    cols = "id long, vector array<double>"
    got = nndescent.nearest(spark.createDataFrame(good + bad, cols), F.col("id") % 50 == 0).collect()
    by = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert len(got) == 8 and by[0] == [(1, 1.0), (3, 1.0), (50, 0.707107), (2, 0.0)]
    assert by[50] == [(0, 0.707107), (1, 0.707107), (2, 0.707107), (3, 0.707107)]
    assert nndescent.nearest(spark.createDataFrame([], cols), F.lit(True)).count() == 0
    assert nndescent.nearest(spark.createDataFrame([(0, v(1, 2))], cols), F.lit(True)).count() == 0


def test_nn_descent_recall(spark):
    """More than ten times as many vectors as a beam holds, in noisy clusters; copies of one vector take a fifth."""
    rng = np.random.default_rng(7)
    n = 11 * nndescent.BEAM
    x = rng.standard_normal((10, 48))[rng.integers(0, 10, n)] + rng.standard_normal((n, 48))
    x[: n // 5] = x[0]
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)
    got = nndescent.nearest(df, F.col("id") % 250 == 0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, n, 250):
        s = unit @ unit[q]
        s[q] = -9
        own = {r["rank"]: r for r in got if r.query_id == q}
        assert sorted(own) == [1, 2, 3, 4, 5]
        worst = np.sort(s)[-5]
        hit += sum(r.score >= worst - 1e-9 for r in own.values())
        total += 5
        if q < n // 5:
            assert [own[k].vec_id for k in range(1, 6)] == [i for i in range(6) if i != q][:5]
    assert hit / total >= 0.9


def test_pipeline_keeps_its_contract(spark, odd):
    import corpus_pipeline as p

    docs = odd.drop("fp").unionByName(spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100))
    for name, stage in p.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        if name != "BPE":
            assert docs.columns == before.columns
        if name == "SimHash near-dedup":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids))
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 50


def test_stages_leave_columns_of_any_name_alone(spark):
    import corpus_pipeline as p

    names = ["kept_id", "taken_id", "reps", "score", "lang_pred", "row_a", "node", "copy_", "user_0", "a.b"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and after.count() > 20
        for n in names:
            assert after.where(F.col(f"`{n}`") != F.concat(F.lit(f"{n}-"), "doc_id")).count() == 0
        docs = after
    assert p.tokenize(spark, docs, DATA).count() == docs.count()


def test_stage_finds_near_copies_of_similarity_08(spark):
    import corpus_pipeline as p
    from spanlight.llm import neardup

    rng = random.Random(7)
    rows, pairs = [], []
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        copy = list(words)
        for _ in range(rng.randint(1, len(words) // 20)):
            copy[rng.randrange(len(copy))] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, copy))
        pairs.append((k, len(a & b) / len(a | b)))
    kept = {r.doc_id for r in p.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()}
    assert sum(s < 0.9 for _, s in pairs if s >= 0.8) > 10 and sum(s < 0.8 for _, s in pairs) > 5
    assert kept == {2 * k for k, _ in pairs} | {2 * k + 1 for k, s in pairs if s < 0.8}
    assert neardup.similarity(neardup.shingles("a b c d e f"), neardup.shingles("A b  c d e g")) == 1 / 3


def test_stages_keep_rows_of_null_and_repeated_ids_apart(spark):
    import corpus_pipeline as p

    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    texts = [text() for _ in range(30)]
    ids = [None] * 10 + [5] * 6 + list(range(100, 114))
    rows = [(i, t, "s") for i, t in zip(ids, texts, strict=True)] + [(None, t + " end", "s") for t in texts[:20]] + [(5, texts[10], "s"), (7, texts[3], "s"), (None, None, "s"), (None, "", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = p.near_dedup(spark, frame.repartition(3), DATA)
    sets = [frozenset(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in ((t or "").split() for _, t, _ in rows)]
    groups = []
    for k, s in enumerate(sets):
        mine = [g for g in groups if any(s == sets[j] or len(s & sets[j]) >= 0.8 * len(s | sets[j]) for j in g)]
        groups = [g for g in groups if g not in mine] + [sum(mine, [k])]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(groups) == len(got) == 31
    for g in groups:
        least = min((rows[j][0] is None, rows[j][0] or 0) for j in g)
        assert sum((d is None, d or 0) == least and (d, t) in {rows[j][:2] for j in g} for d, t in got) == 1
    mixed = p.mix_sources(spark, kept.where("text <> ''"), DATA).groupBy("doc_id", "text").count().collect()
    assert len(mixed) == 30 and all(r["count"] == 1 for r in mixed)


def test_html_shows_formulas_drawings_and_forms():
    say = htmltext.text_of
    assert say("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds</p>") == "so x=2 holds"
    assert say("<p>a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style/><style>no</style><text>one</text><g><text>t<tspan>wo</tspan></text></g></svg></p>") == "a one two"
    assert say("<textarea>\na &amp; <b>\n  c</textarea>") == "a & <b>\n  c"
    assert say("<select><option>no<option selected>yes<option>no</select>") == "yes"
    assert say("<select><optgroup label=g><option>first<option>no</select> <select multiple><option>a<option>b</select>") == "first a b"
    assert say("<input value=v> <input type=text value='w x'><input type=password value=no><input type=checkbox value=no><input type=hidden value=no>") == "v w x"
