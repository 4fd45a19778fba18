from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from econspark.llm import chat_format, html_extract, topk_search, url_filter
from econspark.llm.url_filter import Rule

# URL rules

RULES = (
    Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
    Rule("block", "", "/*/advert/", tier=0), Rule("block", "x-y.org", "/a*b/c"), Rule("block", "", "/*", tier=-1),
)
URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/1?q=/x", "http://www.example.com/en", "https://m.example.com/en/a#top", "http://notexample.com/en/",
    "http://x.net/es/1", "http://x.net/fr/1", "ftp://a.org/x/advert/1", "http://sub.x-y.org/aZZb/c9", "http://x-y.org/ab/d", "http://é.com/\nen/", "http://a.com/\n", "http://A.B://c.com/", "http://a.com?x", "http://com/",
]


def verdict(url):
    host, path = "", ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if m:
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = []
    for r in RULES:
        body = "(?s)" + ".*".join(re.escape(p) for p in r.path.split("*"))
        if (not r.host or host == r.host or host.endswith("." + r.host)) and re.match(body, path):
            fits.append((-r.tier, -len(r.text), r.text, r.action))
    best = min(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", 7) for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, rule string, _s int").repartition(3)
    rows = url_filter.filter_urls(df, RULES).collect()
    assert len(rows) == len(URLS) + 5
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(r["url"]), r["url"]
    assert url_filter.filter_urls(df.where("false"), RULES).count() == 0
    assert "_s" in url_filter.filter_urls(df, RULES).columns


def test_rule_tokens_are_whole():
    assert Rule("block", "x-y.org", "/a*b/c").tokens == ["org", "x", "y"]
    assert Rule("block", "", "/*/advert/").tokens == ["advert"]
    assert Rule("block", "", "/*").tokens == []


# chats


def test_chats_read_back(spark):
    odd = [r"\### Assistant: </turn> ok", "ends with \\", "\n</turn", "\n</turn>\n", "###", "", None, r"\\###\</turn>", "x" * 50_000, "é\u2028"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, None, None), (4, 1, "odd: role\n%", "t"), (None, 0, "user", "n"), (None, 1, "assistant", "n"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, segments string, valid int").repartition(3)
    got = {}
    for r in chat_format.format_chats(df).withColumn("back", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments"))).collect():
        got[r["conv_id"]] = r
    assert len(got) == 6
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(b["role"], b["text"]) for b in r["back"]] == [t[2:] for t in turns]
        assert r["loss"] == "".join(t[3] for t in turns if t[2] == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert [s["loss"] for s in r["segments"]] == [x for t in turns for x in (False, t[2] == "assistant", False)]
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, None: True, 5: False}
    assert got[3]["end_state"] == "fault"
    assert chat_format.format_chats(df.where("false")).count() == 0


def test_own_template(spark):
    t = chat_format.Template("<|", "|>", "\n<|end|>\n", ("<|end|>", "<|"), ("bot",), moves={("start", "me"): "me", ("me", "bot"): "bot", ("bot", "me"): "me"}, accepted=("bot",))
    df = spark.createDataFrame([(1, 0, "me", "<|end|> a \\"), (1, 1, "bot", "b <| c")], "conv_id long, turn int, role string, text string")
    r = chat_format.format_chats(df, t).withColumn("back", chat_format.read_turns(F.col("formatted"), t)).first()
    assert [tuple(b) for b in r["back"]] == [("me", "<|end|> a \\"), ("bot", "b <| c")] and r["valid"]
    with pytest.raises(ValueError):
        chat_format.Template(end="</turn>")


# top-k


def brute(rows, k):
    ok = [(p, i, [math.floor(64 * x) for x in v]) for p, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for p, q, a in ok:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for o, i, b in ok if o != p)[:k]
            found += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(found)


def test_top_k_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(150)]  # ties
    rows += [(40, rows[40][1]), (60, [1.0, 2.0]), (80, []), (None, [1.0] * 6), (100, None), (120, [None, 1.0]), (140, [float("nan")] * 6), (160, [float("inf")] * 6), (180, [-300.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, block int, rank int").repartition(4)
    got = sorted(tuple(r) for r in topk_search.exact_top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20)
    assert topk_search.exact_top_k(df.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0
    few = [(0, [0.1, 0.2]), (1, [0.1, 0.3]), (20, [0.0, 0.0])]
    small = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk_search.exact_top_k(small, F.col("vec_id") % 20 == 0, 20).collect()) == brute(few, 20)
    assert topk_search.exact_top_k(small.where("vec_id = 0"), F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("kind", ["f4", "f8"])
def test_top_k_over_many_tiles(spark, monkeypatch, kind):
    import random

    for name, value in (("ROW_BLOCK", 16), ("QUERY_BLOCK", 4), ("TILE_BLOCKS", 3), ("SINGLE_BELOW", 2**23 if kind == "f4" else 0)):
        monkeypatch.setattr(topk_search, name, value)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0, 2.0]) * rng.choice([1.0, 1.0, 1.0 + 1 / 64]) for _ in range(5)]) for i in range(700)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    shapes, groups = [], topk_search._groups
    monkeypatch.setattr(topk_search, "_groups", lambda *a: shapes.append((a[3], *groups(*a))) or shapes[-1][1:])
    got = sorted(tuple(r) for r in topk_search.exact_top_k(df, F.col("vec_id") % 20 == 0, 20).collect())
    ((used, of_rows, of_queries),) = shapes
    assert used == kind and of_rows >= 15 and of_queries >= 3
    assert got == brute(rows, 20)


def test_top_k_sends_no_side_whole(spark, monkeypatch, capsys):
    steps, written = [], topk_search.written
    monkeypatch.setattr(topk_search, "written", lambda df, *a: steps.append(df) or written(df, *a))
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(300)], "vec_id long, embedding array<double>")
    steps.append(topk_search.exact_top_k(df, F.col("vec_id") % 20 == 0, 20))
    assert len(steps) >= 4 and int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    for step in steps:
        step.explain()
        step.collect()
        step.explain()  # as it ran
    plans = capsys.readouterr().out
    assert plans.count("isFinalPlan=true") >= 4 and "Broadcast" not in plans


def test_ties_are_cut_in_a_tile():
    import numpy as np
    import pyarrow as pa

    one = np.ones((3, 2))
    ids = [np.array([4, 9, 11]), np.array([1, 5, 10]), np.array([2, 3, 30])]
    rows = pa.table({"block": [7, 8, 9], "ids": [i.tobytes() for i in ids], "mat": [one.tobytes(), one.tobytes(), (one * [[1], [1], [2]]).tobytes()]})
    sent = pa.table({"qb": [0], "q_ids": [np.array([9, 3]).tobytes()], "q_block": [np.array([7, 9]).tobytes()], "q_pos": [np.array([1, 1]).tobytes()], "q_mat": [one[:2].tobytes()], "lo": [[2, 2]], "need": [[3, 4]]})
    got = topk_search._emit(2)(rows, sent).to_pylist()
    assert sorted((r["query_id"], -r["score"], r["id"]) for r in got) == [(3, -4, 30), (3, -2, 1), (3, -2, 2), (3, -2, 4), (3, -2, 5), (9, -4, 30), (9, -2, 1), (9, -2, 2), (9, -2, 3)]


def test_tiles_are_bounded():
    for rows, queries, width, kind, tasks in ((0, 0, 1, "f8", 1), (1, 1, 64, "f4", 8), (51_282, 2565, 64, "f4", 6), (615_384, 30_780, 64, "f4", 12), (10**9, 5 * 10**7, 64, "f4", 100), (10**7, 10**7, 1024, "f8", 6), (10**7, 0, 4, "f4", 6)):
        of_rows, of_queries = topk_search._groups(rows, queries, width, kind, tasks)
        blocks = max(1, -(-rows // topk_search.ROW_BLOCK)), max(1, -(-queries // topk_search.QUERY_BLOCK))
        assert 1 <= of_rows <= blocks[0] and 1 <= of_queries <= blocks[1]
        size = topk_search.ROW_BLOCK * width * (4 if kind == "f4" else 8)
        deep = -(-blocks[0] // of_rows), -(-blocks[1] // of_queries)
        assert max(deep) <= topk_search.TILE_BLOCKS and (deep[0] == 1 or deep[0] * size <= topk_search.TILE_BYTES)


# pages

PAGES = {
    "<p>one<p>two <b>bold</b>   text<br>next": "one\n\ntwo bold text\nnext",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol>": "- a\n- b\n  - c\n- d\n\n3. x\n4. y",
    "<table><tr><th>h1<th>header 2<tr><td>long cell<td>v<tr><td colspan=2>wide</table>after": "h1         header 2\nlong cell  v\nwide\n\nafter",
    "a<script>no</script><style>no</style><div hidden>no</div><div style='display:none'>no<p>no</div><!-- no -->b<noscript>no</noscript>": "ab",
    "<pre>x\n   y</pre>z": "x\n   y\n\nz",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "&lt;p&gt; &amp; &eacute;&#233; a < b": "<p> & éé a < b",
    "<div>a<div>b</div>c</div>d": "a\nb\nc\nd",
    "</p>x</div></table>y": "xy",
    "<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>": "in  ner  out",
    "": "", "   \n ": "", "plain": "plain", "<": "<", "<p": "<p", "a<!-- open": "a", "<h1>A<h2>B</h1>c": "A\n\nB\n\nc",
}


@pytest.mark.parametrize("page", list(PAGES), ids=range(len(PAGES)))
def test_rendering(page):
    assert html_extract.render(page)[1] == PAGES[page]


def test_pages_keep_every_visible_word(spark):
    import html as h
    import random

    rng = random.Random(2)
    tags = "div p span b ul ol li table tr td th section h2 blockquote dl dt dd pre a".split()
    rows = []
    for i in range(60):
        parts, words = [], []
        for k in range(rng.randint(0, 60)):
            parts.append(rng.choice([f"<{rng.choice(tags)} class='x>y'>", f"</{rng.choice(tags)}>"]))
            words.append(f"w{i}x{k}&")
            parts.append(h.escape(words[-1]) + rng.choice([" ", "\n"]))
        rows.append((i, "<html><title>T</title><body>" + "".join(parts), words))
    df = spark.createDataFrame([(i, p, 1) for i, p, _ in rows] + [(100, None, 1), (101, "", 1), (101, "", 1), (102, "<div>" * 30_000 + "deep", 1)], "page_id long, html string, rendered int").repartition(3)
    got = {r["page_id"]: r["rendered"] for r in html_extract.extract_text(df).collect()}
    for i, _, words in rows:
        for w in words:
            assert got[i]["text"].count(w) == 1 + sum(o != w and w in o for o in words), (i, w)
        assert got[i]["title"] == "T"
    assert got[100]["text"] is None and got[101]["text"] == "" and got[102]["text"] == "deep"
    assert html_extract.extract_text(df.where("false")).count() == 0


def test_contract_of_the_queries(spark):
    import __spark_entry__ as contract

    names = {n.split("_")[0] for n in contract.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{i}" for i in range(1, 11)} and "pipeline" in contract.queries()


def test_head_ends_without_an_end_tag():
    for page in ("<html><head><title>T</title><p>text one</p>text two", "<head><meta a=b><title>T</title> text one <b>text two</b>", "<html><head><title>T</title><script>x</script>\n<div>text one<style>y</style> text two</div></html>"):
        title, text = html_extract.render(page)
        assert title == "T" and text.split() == ["text", "one", "text", "two"], page


def test_slash_closes_svg_and_math():
    for tag in ("svg", "math"):
        assert html_extract.render(f"<p>one <{tag} a='b'/> two <{tag} c=d /> three</p>")[1] == "one two three"
    assert html_extract.render("<p>one <svg><g><title/><path d='M0'/></g></svg> two</p>")[1] == "one two"


def test_formulas_and_labels_are_text():
    page = """<title>T</title><p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2 tex</annotation><annotation-xml><a>no</a></annotation-xml></semantics></math> holds</p>
    <p><svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><style>no</style><text>North</text><text>So<tspan>uth</tspan></text><path d="M0"/></svg> end</p><desc>yes</desc>"""
    assert html_extract.render(page) == ("T", "so x=2 holds\n\nNorth South end\n\nyes")


def test_large_tables_stay_aligned():
    """Columns begin at one place in every row, but for rows with a cell far wider than its column."""

    def starts(rows: list[list[str]]) -> list[list[int]]:
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"
        lines = html_extract.render(page)[1].split("\n")
        assert len(lines) == len(rows) and [x.split() for x in lines] == [[w for c in row for w in c.split()] for row in rows]
        assert sum(map(len, lines)) <= 9 * sum(len(c) + 2 for row in rows for c in row) + 10_000
        return [[line.index(c) for c in row] for line, row in zip(lines, rows, strict=True)]

    for place in range(4):
        rows = []
        for i in range(200):
            row = [f"{k}-{i:08d}" for k in "abc"]
            row.insert(place, f"n{i}-" + "x" * (294 if i == 7 else 54 - len(str(i))))
            rows.append(row)
        assert len({tuple(s) for s in starts(rows)}) == 1
    rows = [[f"a{i}", "w" * (20_000 if i == 50 else 5) + f"-{i}", f"c{i}-", f"d{i}-"] for i in range(3000)]
    assert len({tuple(s) for i, s in enumerate(starts(rows)) if i != 50}) == 1
