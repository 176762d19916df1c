"""Tags that never close, visibility that is inherited and turned on again, and rows with columns of every type."""

import time

from pyspark.sql import functions as F

from spanlight.llm import common, htmltext

say = htmltext.text_of


def test_broken_tags_are_read_once():
    for bad in ('<a "' * 20000, "<a " * 40000, "<!" * 40000, "<a<a" * 40000, "<a '\"" * 20000, '<p>x<a "b</a>' * 5000):
        began = time.process_time()
        say(bad)
        assert time.process_time() - began < 1.5
    assert say('x <a "b') == 'x <a "b' and say("a < b <!-- c") == "a < b" and say('<p title="a>b">c</p>') == "c"
    assert say('<i "<b>one</b>two') == '<i "onetwo'


def test_tags_close_where_a_plain_scan_says():
    """Against a scan of each tag on its own."""
    import random

    def ends(html, i):
        m = htmltext._NAME.match(html, i)
        at = m.end() if m else len(html)
        while at < len(html) and html[at] != ">":
            if html[at] in "\"'":
                at = html.find(html[at], at + 1)
                if at < 0:
                    return None
            at += 1
        return at + 1 if at < len(html) else None

    r = random.Random(5)
    for _ in range(3000):
        html = "".join(r.choice(["<a", "<b ", ">", '"', "'", " ", "x", "</a", "/"]) for _ in range(r.randrange(1, 25)))
        want, at = [], 0
        while (i := html.find("<", at)) >= 0:
            at = i + 1
            if (end := ends(html, i)) is not None:
                want.append((i, end))
                at = end
        got, tokens, at = [], htmltext.Tokens(html), 0
        while m := tokens.next(at):
            got.append(m[:2])
            at = m[1]
        assert got == want, html


def test_visibility_is_inherited_and_display_is_not_undone():
    assert say('<div style="visibility:hidden">a<span style="visibility:visible">b</span></div>') == "b"
    assert say("<style>.h{visibility:hidden} .s{visibility:visible}</style><div class=h>a<p>c<p class=s>b<textarea>t</textarea></div>d") == "b\n\nt\n\nd".replace("\n\nt\n\n", "t\n\n")
    assert say('<div style="display:none">a<b style="display:block">b</b></div>c') == "c"
    assert say("<style>p{display:none !important} #k{display:block}</style><p id=k>no</p>yes") == "yes"
    assert say("<style>p{display:none}</style><p style='display:block'>one</p><p style='display:block !important'>two</p>").split() == ["one", "two"]
    assert say('<table><tr><td>a<td style="visibility:hidden">b<td>c<tr><td>dd<td>ee<td>f<tr style="visibility:collapse"><td>g</table>') == "a       c\ndd  ee  f"
    assert say("<details><summary>s</summary>body</details><details open><summary>t</summary>body</details>").split() == ["s", "t", "body"]
    assert say("<ol reversed><li>a<li>b</ol>") == "2. a\n1. b" and say("<ol><li value=7>a<li>b</ol>") == "7. a\n8. b"


def test_rows_with_maps_and_variants_have_keys(spark):
    sql = "SELECT id, map('a', id, 'b', map_size) AS m, array(map(id, 'x')) AS ms, parse_json('{\"k\": ' || id || '}') AS v, named_struct('m', map('z', id)) AS s, CAST(NULL AS MAP<STRING, INT>) AS n FROM (SELECT id, 1L AS map_size FROM range(50))"
    rows = spark.sql(sql).withColumn("a.b", F.lit(1))
    keys = common.keyed(rows.unionByName(rows)).groupBy("row_a", "row_b").count().collect()
    assert len(keys) == 50 and all(k["count"] == 2 for k in keys)
    a = spark.sql("SELECT 1 AS id, map('a', 1, 'b', 2) AS m UNION ALL SELECT 1, map('b', 2, 'a', 1)")
    assert common.keyed(a).select("row_a", "row_b").distinct().count() == 1
