"""Secret scans by grammar inference.

Credentials that the base patterns label are learnt as probabilistic automata:
their prefix tree's states are merged where a Hoeffding test finds the outgoing
frequencies compatible (state merging after Carrasco and Oncina). Every further
token of a text is a candidate, scored by the likelihood of its format under the
automata against that under an automaton of ordinary long tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Base kinds in the listed order (fixed values): pattern, least length, the group whose length counts.
KINDS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.ASCII | re.IGNORECASE),
    "access": (r"AKIA[A-Z0-9]+", 18, 0, re.ASCII),
    "hex": (r"[0-9a-f]+", 16, 0, re.ASCII),
}
#: Runs shorter than the least length fail anyway, so the last two need only look for long ones: a run of their
#: characters is matched once, from its first possible start, and a later start within it is shorter.
_SCAN = {
    "assign": re.compile(KINDS["assign"][0], KINDS["assign"][3]),
    "access": re.compile(r"AKIA[A-Z0-9]{14,}", re.ASCII),
    "hex": re.compile(r"[0-9a-f]{16,}", re.ASCII),
}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
GRAMMAR = "grammar"
END = ""

#: The bounded samples the automata are fitted on: distinct labelled credentials a kind, distinct ordinary tokens.
MAX_LABELLED, MAX_ORDINARY = 500, 3000
#: Longer strings aren't learnt from; seed of the sample's hash.
LONGEST, SEED = 256, 7
#: Hoeffding confidence of the merge test, least labelled strings for an automaton, least bits a character over the ordinary automaton.
ALPHA, MIN_LABELLED, MIN_BITS = 0.05, 20, 3.0


_KEYS = ("password", "passwd", "secret", "token", "api")
LEAST = 16


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end), sorted: leftmost matches per kind that are long enough.

    A pattern is only tried where a text has what it needs: one of the keys, or a
    word of 16 characters.
    """
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, "assign", m.end()) for m in _SCAN["assign"].finditer(text) if len(m[2]) >= 12]
    if has_long_word(text):
        found += [(m.start(), 1, "access", m.end()) for m in _SCAN["access"].finditer(text)]
        found += [(m.start(), 2, "hex", m.end()) for m in _SCAN["hex"].finditer(text)]
    return sorted(found)


def has_long_word(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= LEAST


def candidates(text: str, base: list) -> Iterator[tuple[int, int]]:
    """Long tokens that no base span touches."""
    if not has_long_word(text):
        return
    spans = sorted((s, e) for s, _, _, e in base)
    k, reach = 0, 0  # reach: the furthest end of a span that begins before the token's end
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(spans) and spans[k][0] < e:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= s:
            yield s, e


@dataclass
class Automaton:
    """states[i]: symbol -> (log2 probability, next state); END has no next state. floor: log2 of what was never seen."""

    states: list[dict[str, tuple[float, int]]]
    floor: float

    def bits(self, word: str) -> float:
        """log2 likelihood of the word, its end included; an unseen symbol costs the floor and stays in its state."""
        at, total = 0, 0.0
        for c in word:
            p, nxt = self.states[at].get(c, (self.floor, at))
            total += p
            at = nxt
        return total + self.states[at].get(END, (self.floor, at))[0]


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """Merges compatible states of the prefix tree of words, in breadth-first order of the tree."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    count, ends, kids = [0], [0], [{}]  # of a state: arrivals, words that end there, next states
    for w in words:
        at = 0
        count[0] += 1
        for c in w:
            nxt = kids[at].get(c)
            if nxt is None:
                nxt = kids[at][c] = len(count)
                count.append(0)
                ends.append(0)
                kids.append({})
            at = nxt
            count[at] += 1
        ends[at] += 1

    # How often each transition is taken. Once states are shared, a next state's arrivals come from several of them.
    flow = [{c: count[k] for c, k in kid.items()} for kid in kids]

    def alike(a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            x, y = pair = stack.pop()
            if x == y or pair in seen:
                continue
            seen.add(pair)
            n, m = count[x], count[y]
            if not n or not m:
                continue
            if _differ(ends[x], n, ends[y], m, bound):
                return False
            for c in kids[x].keys() | kids[y].keys():
                if _differ(flow[x].get(c, 0), n, flow[y].get(c, 0), m, bound):
                    return False
                if c in kids[x] and c in kids[y]:
                    stack.append((kids[x][c], kids[y][c]))
        return True

    def fold(red: int, blue: int) -> None:
        """Adds the tree below blue to red."""
        stack = [(red, blue)]
        while stack:
            r, b = stack.pop()
            count[r] += count[b]
            ends[r] += ends[b]
            for c, k in kids[b].items():
                flow[r][c] = flow[r].get(c, 0) + flow[b][c]
                if c in kids[r]:
                    stack.append((kids[r][c], k))
                else:
                    kids[r][c] = k

    red, place = [0], 0
    blue = [(0, c) for c in sorted(kids[0])]
    while place < len(blue):
        parent, c = blue[place]
        place += 1
        state = kids[parent][c]
        if state in red:
            continue
        into = next((r for r in red if alike(r, state)), None)
        if into is None:
            red.append(state)
            blue += [(state, x) for x in sorted(kids[state])]
        else:
            kids[parent][c] = into
            known = {r: set(kids[r]) for r in red}
            fold(into, state)
            blue += [(r, x) for r in red for x in sorted(kids[r]) if x not in known[r]]
    index = {s: i for i, s in enumerate(red)}
    symbols = len({c for w in words for c in w}) + 1
    states = []
    for s in red:
        total = ends[s] + sum(flow[s].values()) + 0.5 * (symbols + 1)
        row = {c: (math.log2((flow[s][c] + 0.5) / total), index[kids[s][c]]) for c in kids[s] if kids[s][c] in index}
        row[END] = (math.log2((ends[s] + 0.5) / total), index[s])
        states.append(row)
    return Automaton(states, math.log2(0.5 / (count[0] + 64)))


@dataclass
class Model:
    kinds: dict[str, Automaton]
    ordinary: Automaton | None

    def score(self, word: str) -> float:
        """Bits a character by which the best credential format is likelier than an ordinary token; -inf without a model."""
        if not self.kinds or self.ordinary is None:
            return -math.inf
        return (max(a.bits(word) for a in self.kinds.values()) - self.ordinary.bits(word)) / len(word)


class Least:
    """The n distinct words of least hash, whatever is added."""

    def __init__(self, n: int) -> None:
        self.n, self.held, self.heap = n, set(), []

    def add(self, word: str) -> None:
        if self.n <= 0 or len(word) > LONGEST:
            return
        h = xxhash.xxh64_intdigest(word.encode(), SEED) >> 1
        if len(self.heap) >= self.n and (-h, word) <= self.heap[0]:
            return
        if word not in self.held:
            self.held.add(word)
            heapq.heappush(self.heap, (-h, word))
            if len(self.heap) > self.n:
                self.held.discard(heapq.heappop(self.heap)[1])


def _values(limits: dict[str, int]):
    """A task's sample: of each kind the distinct values of least hash, limits[kind] at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {kind: Least(n) for kind, n in limits.items()}
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                for text in part.column(0).to_pylist():
                    if not text:
                        continue
                    base = base_spans(text)
                    for s, _, kind, e in base:
                        least[kind].add(_SCAN["assign"].match(text, s)[2] if kind == "assign" else text[s:e])
                    for s, e in candidates(text, base):
                        least[""].add(text[s:e])
        rows = [(kind, -h, word) for kind, x in least.items() for h, word in x.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], ["kind", "h", "word"])

    return run


def samples(docs: DataFrame, limits: dict[str, int]) -> dict[str, list[str]]:
    """kind -> the limits[kind] distinct values of least hash over all documents ("" for ordinary tokens).

    A task sends its own least values, which hold all of the whole sample that it
    has; they are ranked within salted parts of a kind, and the first of those are
    taken. Only the samples reach the driver.
    """
    found = docs.select(F.col("text").cast("string")).mapInArrow(_values(limits), "kind string, h long, word string").distinct()
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("kind")]

    salted = Window.partitionBy("kind", F.pmod(F.xxhash64("word"), F.lit(32))).orderBy("h", "word")
    few = found.withColumn("turn", F.row_number().over(salted)).where((F.col("turn") <= max(limits.values())) & (F.col("turn") <= limit))
    few = materialize(few.select("kind", "h", "word"), "secret-samples")
    return {kind: [r["word"] for r in few.where(F.col("kind") == kind).orderBy("h", "word").limit(n).collect()] for kind, n in limits.items()}


def learn(docs: DataFrame, max_labelled: int = MAX_LABELLED, max_ordinary: int = MAX_ORDINARY) -> Model:
    """Fits the automata on bounded samples of values (see `samples`), drawn from all documents.

    Strings over LONGEST characters aren't learnt from. A kind with under
    MIN_LABELLED values gets no automaton; without any, or without ordinary tokens,
    nothing is added later.
    """
    got = samples(docs, {**dict.fromkeys(KINDS, max_labelled), "": max_ordinary})
    ordinary = got.pop("")
    return Model({k: infer(v) for k, v in got.items() if len(v) >= MIN_LABELLED}, infer(ordinary) if len(ordinary) >= MIN_LABELLED else None)


def spans_of(text: str, model: Model, min_bits: float = MIN_BITS) -> list[tuple[int, int, str, int]]:
    base = base_spans(text)
    added = [(s, 3, GRAMMAR, e) for s, e in candidates(text, base) if model.score(text[s:e]) >= min_bits]
    return sorted([*base, *added])


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> counts and spans of every row; null or empty texts have none, repeated rows stay."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                out: list[list] = [part.column(0).to_pylist(), [], [], [], [], []]
                for text in part.column(1).to_pylist():
                    spans = spans_of(text or "", model)
                    base = [x for x in spans if x[2] != GRAMMAR]
                    for k in range(3):
                        out[1 + k].append(sum(x[1] == k for x in base))
                    out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    out[5].append(joined(spans))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """Replaces every span in `text` by MASK (overlapping spans: one); all columns and rows stay, n_chars is counted anew.

    Texts without a span come out as they went in, null included.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                texts = part.column(at).to_pylist()
                for k, text in enumerate(texts):
                    spans = spans_of(text, model) if text else []
                    if spans:
                        out, done = [], 0
                        for s, _, _, e in spans:
                            if s >= done:
                                out += [text[done:s], MASK]
                            done = max(done, e)
                        texts[k] = "".join([*out, text[done:]])
                columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    done = docs.mapInArrow(run, schema)
    return done.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))
