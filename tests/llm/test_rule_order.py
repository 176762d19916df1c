"""The cascade's order follows what the rules cost and reject where they run: after the base, and after each other."""

import itertools

from spanlight.llm import quality as q


def test_each_next_rule_rejects_most_per_cost_of_what_is_left():
    names = list(q.RULES)
    a, b, c = 0, 1, 2
    counts = {1 << a | 1 << b: 40, 1 << c: 10, 0: 50}  # b rejects only what a does
    cost = {a: 10, b: 11, c: 12}
    rows = [(said, i, n, n * cost.get(i, 1000)) for said, n in counts.items() for i in range(len(names))]
    order = q.best_order(rows)
    assert order[:2] == [names[a], names[c]] and sorted(order) == sorted(names)

    def paid(first):
        return sum(n * sum(cost[x] for x in itertools.takewhile(lambda y: not any(said >> z & 1 for z in first[: first.index(y)]), first)) for said, n in counts.items())

    assert paid([a, c, b]) == min(paid(list(p)) for p in itertools.permutations([a, b, c]))
    assert q.best_order([]) == sorted(names)


def test_only_documents_that_pass_the_base_are_measured(spark):
    good = [" ".join(f"word{i * 31 + j}" for j in range(40)) for i in range(30)]
    df = spark.createDataFrame([(t,) for t in [*good, None, "", "short", "same word " * 50]], "text string")
    rows = df.mapInArrow(q._measure, "said long, rule long, n long, ns long").collect()
    assert sum(r.n for r in rows if r.rule == 0) == 30 and {r.rule for r in rows} == set(range(len(q.RULES)))
    assert all(r.ns > 0 for r in rows)
    doc = q.Doc(good[0])
    assert not doc.base_failed and "words" in doc.__dict__ and "kinds" not in doc.__dict__
