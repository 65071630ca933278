import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from fichero.llm import classifier, html_text, licences, tool_calls
from fichero.llm.queries import ORACLE_SQL, QUERIES


def test_sql(compare):
    for name in ("op2_tool_links", "op7_licence_scan"):
        compare(QUERIES[name], ORACLE_SQL[name], f"{DATA}/sf0.001")


def test_licences(spark):
    mit = licences.KNOWN["MIT"][0]
    changed = "Copyright (c) 2020 Jane Doe\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,\n") + "\nAll rights reserved."
    rows = [(1, changed), (2, mit + " extra"), (3, "Some text.\nreleased under the  MIT licence!\nLicensed under CC-BY-NC 4.0"), (4, None), (5, ""), (6, "...\n!!"), (7, "Released under the MIT License.")]
    got = {r[0]: (r["licence"], r["notices"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", []), 2: (None, []), 3: (None, ["CC-BY-NC-4.0", "MIT"]), 4: (None, []), 5: (None, []), 6: (None, []), 7: ("MIT", ["MIT"])}


def test_tool_calls(spark):
    tools = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "number"}}}}
    call = lambda i, name="add", args=None, after=(): {"id": i, "name": name, "arguments": {"b": 2.0, "a": 1} if args is None else args, "after": list(after)}
    calls = lambda *c: json.dumps({"content": None, "tool_calls": list(c)})
    result = lambda i, content="r": json.dumps({"tool_call_id": i, "content": content})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", calls(call("x"), call("y", after=["x"]), call("z", after=["y", "x"]))), (1, 2, "tool", result("y")), (1, 3, "tool", result("x")), (1, 4, "tool", result("x")), (1, 5, "tool", result("q"))]
    rows += [(1, 6, "assistant", calls(call("x"), call("p", "mul"), call("w", args={"a": 1.5, "b": 1}), call("v", args="{bad"), call("c1", after=["c2"]), call("c2", after=["c1"]), call("u", after=["nope"]), {})), (None, 1, "user", None), (2, None, "tool", result("x")), (3, 1, None, '{"tool_call_id": "\\ud800"}')]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.link(frame, tools).collect()
    at = {(r["conv_id"], r["turn"], r["part"]): r for r in got}
    assert at[1, 1, 1]["json"] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","type":"call"}'
    assert [(at[k]["at"], at[k]["level"], at[k]["linked"]) for k in ((1, 1, 1), (1, 3, 0), (1, 1, 2), (1, 2, 0), (1, 1, 3))] == [(1, 0, True), (3, 1, True), (3, 2, True), (3, 3, True), (3, 4, False)]
    problems = {k: r["problem"] for k, r in at.items() if r["problem"]}
    assert problems == {(1, 1, 3): "no_result", (1, 4, 0): "extra_result", (1, 5, 0): "no_call", (1, 6, 1): "duplicate_id", (1, 6, 2): "unknown_tool", (1, 6, 3): "invalid:$.a", (1, 6, 4): "bad_arguments", (1, 6, 5): "circle", (1, 6, 6): "circle", (1, 6, 7): "unknown_after", (1, 6, 8): "no_id", (2, None, 0): "no_id", (3, 1, 0): "no_call"}
    assert tool_calls.link(frame.limit(0), tools).count() == 0


def test_tool_calls_in_long_chains(spark):
    import inspect

    call = lambda i: {"id": f"c{i}", "name": "f", "arguments": {}, "after": [f"c{i - 1}"] if i else []}
    frame = spark.createDataFrame([(1, 0, "assistant", json.dumps({"content": None, "tool_calls": [call(i) for i in range(5)]}))], "conv_id long, turn long, role string, text string")
    assert [r["level"] for r in sorted(tool_calls.link(frame).collect(), key=lambda r: r["part"]) if r["kind"] == "call"] == [0, 2, 4, 6, 8]
    assert tool_calls.link(frame, most=4).filter("problem = 'circle'").isEmpty()
    with pytest.raises(RuntimeError):
        tool_calls.link(frame, most=2)
    assert inspect.signature(tool_calls.link).parameters["most"].default is None


def test_classifier(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None), (-2, "", None, None, None)], docs.schema))
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = classifier.fit(docs, labels)
    scored = classifier.score(docs, model).withColumn("held_out", classifier.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == docs.count()
    kept = classifier.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.filter(f"score >= {classifier.THRESHOLD}").count()
    none = classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(docs.limit(0), model).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Other news of the day</p></div>
<div class="page"><div class="post"><h1>A &amp; B</h1><p>First&nbsp;paragraph with <a href="x">a link</a> and <b>bold
text.<br>After a break<p>Second one &lt;here&gt;, unclosed<ul><li>Item one<li>Item two</ul><form><input><p>Mail us</p></form><table><tr><td>x<td>y</table></div>
<section class="comments"><p>Nice post, long comment, many words, more words than the article has, really very many words in here.</p></section></div>
<div class="ad">Buy!</div><footer>&copy; us</footer></body></html>"""


def test_html_threshold():
    words = lambda n: " ".join(["word"] * n)
    text = "".join(f"<p>{words(n)}</p>" for n in (60, 70, 50))
    body = "\n\n".join(words(n) for n in (60, 70, 50))
    few = "<div>All content is owned by the city.</div><div><p>Read what others wrote.</p><a href=x>More</a></div>"
    assert html_text.extract(f"<body><h1>Title</h1> <div>{text}</div>{few}</body>") == f"Title\n\n{body}"
    assert html_text.extract(f"<body><div>{few}<div>{text}</div></div>some <b>small</b> print</body>") == body
    # beside the path, a part as dense stays
    also = f"<div>Short note.</div><div><p>{words(80)}</p></div>"
    assert html_text.extract(f"<body><div>{text}{text}</div>{also}</body>") == f"{body}\n\n{body}\n\n{words(80)}"


def test_html(spark):
    want = "A & B\n\nFirst paragraph with a link and bold text. After a break\n\nSecond one <here>, unclosed\n\nItem one\n\nItem two\n\nx\n\ny"
    assert html_text.extract(PAGE) == want
    for odd in (None, "", " ", "<", "<p", "</p></div>", "<!--", "<script>x", "&#xd800;", "<b><i></b>", "<div " * 3000, "<div>" * 3000 + "x"):
        html_text.extract(odd).encode("utf-8")
    assert html_text.extract("just text") == "just text"
    assert html_text.extract("<article><p>a</p></article><article class='comment'><p>longer text than that</p></article>") == "a"
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.extract_pages(frame).collect()}
    assert got == {1: ("u", want, len(want)), 2: (None, "", 0), None: ("u", "", 0)}
    assert html_text.extract_pages(frame.limit(0)).count() == 0
