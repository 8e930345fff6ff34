"""Transports, validation, whole jobs, streams and the command line."""

import http.server
import io
import json
import threading
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossaflow import cli
from glossaflow.functions import usage, validation
from glossaflow.operators import responses
from glossaflow.operators.models import Registry
from glossaflow.plans import reports
from glossaflow.plans.translate import Job, translate
from glossaflow.sources import documents, transport
from glossaflow.streaming import stream


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def rows(df):
    return sorted(df.collect(), key=lambda r: r.doc_id)


# --- validation ---------------------------------------------------------------


@pytest.mark.parametrize("text", ["1", '"a"', "null", "[]", "{}", " [1.5, true] ", '{"a":1,"a":2}', "[" * 512 + "]" * 512, '"\\ud83d\\ude00"', '"\\\\ud83d"', "1" * 6000, "-0"])
def test_json(text):
    assert validation.json_error(text) is None


@pytest.mark.parametrize("text", ["", "{", "[1,]", "NaN", "[Infinity]", "{'a':1}", '{"a":1} x', "[" * 600 + "]" * 600, "[" * 513 + "]" * 513, '{"a":' * 513 + "1" + "}" * 513, "[" * 100_000, '{"\\udc00": 1}', '[["\\ud83dx"]]', '"\\ud83d"', '"\n"'])
def test_no_json(text):
    assert validation.json_error(text)


def test_signatures():
    s = validation.signature
    assert s('{"b":1,"a":[1.5,"x",null,true]}') == '{"b":integer,"a":[double,string,NULL,boolean]}'
    assert s('{"a":1,"b":2}') != s('{"b":2,"a":1}') and s("{}") == s("[]") and s('{"0":1,"1":2}') == s("[1,2]") != s('{"1":1,"0":2}')
    assert s("[1]") != s("[1,2]") and s("9223372036854775807") == "integer" and s("9223372036854775808") == "double" and s('{"a":1,"b":2,"a":"x"}') == '{"a":string,"b":integer}' and s("x") is None


def test_integers_by_their_digits():
    for text in ("0", "-1", "9223372036854775807", "-9223372036854775808", "922337203685477580", "1000000000000000000"):
        assert validation.signature(text) == "integer", text
    for text in ("-0", "9223372036854775808", "-9223372036854775809", "1" * 5000, "1e3", "1.0", "-9" + "0" * 19):
        assert validation.signature(text) == "double", text


def by_a_tree(text):
    """Structure by decoding the whole text and walking the tree."""

    def of(x):
        if isinstance(x, dict):
            if list(x) == [str(i) for i in range(len(x))]:
                return of(list(x.values()))
            return "{" + ",".join(json.dumps(k) + ":" + of(v) for k, v in x.items()) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(of, x)) + "]"
        return {bool: "boolean", int: "integer", float: "double", str: "string", type(None): "NULL"}[type(x)]

    return of(json.loads(text))


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3) | st.sampled_from(["0", "1", "2"]), x, max_size=4), max_leaves=20), st.booleans())
def test_signature_of_any_tree(value, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    if "\\ud" not in text and "\\uD" not in text:
        assert validation.json_checked_text(text) == (None, by_a_tree(text))


def test_json_is_scanned_once_before_and_once_after(spark):
    df = translate(frame(spark, ['{"a": 1}', None, "{"]), Job("deepl:free", "json"), transport.Echo("deepl"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("MapInArrow") == 1
    assert [(r.result, r.error and r.error.code) for r in rows(df)] == [('{"a": 1}', None), (None, "no_text"), (None, "invalid_json")]


def test_html():
    good = ["<p>a<p>b", "<!DOCTYPE html><html><body><section>x</section></body></html>", "a<br>b<img src=x>", "<script>if (a < b) {}</script>", "", "<ul><li>a<li>b</ul>", "&amp; &copy;"]
    bad = ['<p class="x"\n<b>y</b></p>', "<b>x", "<b><i>x</b></i>", "</i>x", "a < b", '<a x="1" x="2">y</a>', "<p"]
    for text in good:
        assert validation.html_errors(text) == [], text
    for text in bad:
        assert validation.html_errors(text), text


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("<table><tr><td>a</td></tr>x</table>", ["text", "table"]),
        ("<table><b>a</b><tr><td>b</table>", ["b", "table"]),
        ("<table><tr>&amp;<td>b</table>", ["text", "tr"]),
        ("<b><i>x</b>y</i>", ["comes before that of i"]),
        ("<p>a<div>b</div></p>", ["end tag p closes nothing"]),
        ("<p a='1' A='2'>x", ["given twice"]),
        ("<p a\"b=1>x", ["has a name that is none"]),
        ("<i id=x></i><b id=x></b>", ["id x"]),
        ("a & b", ["begins no reference"]),
        ("<a href='?a=1&b=2'>x</a>", ["&b is not ended"]),
        ("&copy x", ["&copy is not ended"]),
        ("&nosuch;", ["&nosuch; is not known"]),
        ("&#xZZ;", ["reference"]),
        ("<section/>x</section>", ["end tag section closes nothing"]),
    ],
)
def test_html_errors_by_kind(text, words):
    errors = validation.html_errors(text)
    assert any(all(w in e for w in words) for e in errors), errors


@pytest.mark.parametrize(
    "text",
    [
        "<table><caption>c</caption><thead><tr><th>a<th>b<tbody><tr><td><b>x</b>y<td>z</table>",
        "<table>\n<tr>\n<td>a</td>\n</tr>\n</table>",
        "<my-element><xyz a=1>x</xyz></my-element>",
        "<script>if (a && b) x('&nosuch;')</script><!-- & &x; --><style>a > b & c</style>",
        "&amp; &#169; &#xA9; &NotEqualTilde;",
        "<p>a<ul><li>b<li>c</ul><dl><dt>d<dd>e<dt>f</dl><select><option>g<option>h</select>",
        "<p>a<p>b</p><p a='1' b=\"2\" c=3 d>",
        "<!-- <b> -->",
    ],
)
def test_html_without_errors(text):
    assert validation.html_errors(text) == []


def test_html_errors_take_linear_time():
    for text in ("<p>" * 50_000, "<table><tr>" * 30_000, "&" * 200_000, "<!--" * 50_000, "<b>x</b>" * 30_000):
        began = time.monotonic()
        validation.html_errors(text)
        assert time.monotonic() - began < 10, text[:8]


def test_usage(spark):
    cases = {'"3.7"': 3, "true": 0, "null": 0, '"1e3"': 1000, '" 12 "': 12, '"1d"': 0, '"NaN"': 0, "9007199254740993": 9007199254740993, '{"x":1}': 0, '"x"': 0, "-2.9": -2, '""': 0}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, n long")
    got = df.select("t", "n", usage.number_at(F.try_parse_json(F.concat(F.lit('{"a":'), "t", F.lit("}"))), "a").alias("g")).collect()
    assert [r.g for r in got] == [r.n for r in got]
    row = spark.range(1).select(usage.consumed(F.lit(None).cast("variant"), {"tokens": {"total": "t"}}).alias("a"), usage.consumed(F.parse_json(F.lit("{}")), {}).alias("b"), usage.consumed(F.parse_json(F.lit('{"t":3}')), {"tokens": {"total": "t"}}).alias("c")).first()
    assert row.a == row.b == {} and row.c["tokens"].total == 3 and row.c["tokens"].breakdown == {}


# --- transports -----------------------------------------------------------------


class Service(http.server.BaseHTTPRequestHandler):
    seen: list = []
    fail = 0

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        Service.seen.append((self.path, dict(self.headers), body))
        self.send_response(503 if Service.fail > 0 else 200)
        Service.fail -= 1
        self.send_header("X-A", "1")
        self.send_header("X-A", "2")
        self.end_headers()
        self.wfile.write(b"answer")

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    Service.seen, Service.fail = [], 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/x"
    server.shutdown()


def test_http(service, monkeypatch):
    monkeypatch.setattr(transport.time, "sleep", lambda _: None)
    monkeypatch.setenv("KEY", "s3cret")
    Service.fail = 1
    got = transport.Http(transport.Auth("header", "Authorization", "Bearer", "KEY")).send(transport.Request(service, ["Content-Type: a/b"], "body"))
    assert got.status == 200 and got.body == "answer" and got.headers["X-A"] == ["1", "2"] and len(Service.seen) == 2
    assert Service.seen[0][1]["Authorization"] == "Bearer s3cret" and Service.seen[0][2] == "body"
    transport.Http(transport.Auth("form", "k y", key="a&b")).send(transport.Request(service, [], "x=1"))
    assert Service.seen[-1][2] == "x=1&k+y=a%26b"
    transport.Http(transport.Auth("query", "k", key="a b")).send(transport.Request(service + "?q=1", [], ""))
    assert Service.seen[-1][0] == "/x?q=1&k=a+b"
    Service.fail = 9
    assert transport.Http(retries=1).send(transport.Request(service, [], "")).status == 503
    with pytest.raises(ConnectionError):
        transport.Http(retries=0).send(transport.Request("http://127.0.0.1:9/", [], ""))
    with pytest.raises(ValueError, match="kind"):
        transport.Auth("odd", "k", key="x").attach(transport.Request("u", [], ""))
    with pytest.raises(ValueError, match="NO_SUCH"):
        transport.Auth("form", "k", env="NO_SUCH").secret()
    assert "s3cret" not in repr(transport.Auth("form", "k", key="s3cret"))


def test_proxy(monkeypatch):
    monkeypatch.delenv("GLOSSAFLOW_PROXY", raising=False)
    assert transport.proxy_from(None) is None and transport.proxy_from("a") == "a"
    monkeypatch.setenv("GLOSSAFLOW_PROXY", "b")
    assert transport.proxy_from(None) == "b" and transport.proxy_from("a") == "a"


def test_answers_are_kept(spark, tmp_path):
    docs = frame(spark, ["a", "b"])
    job, store = Job("openai:gpt-4o"), str(tmp_path / "store")
    first = rows(translate(docs, job, transport.Echo("openai"), store))
    again = rows(translate(docs, job, transport.Static(transport.Response(500, "not asked")), store))
    assert [r.result for r in first] == [r.result for r in again] == ["a", "b"]
    more = rows(translate(frame(spark, ["a", "c"]), job, transport.Static(transport.Response(500, "asked")), store))
    assert more[0].result == "a" and more[1].error.code == "http_error"


def test_a_failing_call_is_one_documents_error(spark):
    class Broken:
        def send(self, request):
            raise OSError("no line")

    (row,) = rows(translate(frame(spark, ["a"]), Job("openai:gpt-4o"), Broken()))
    assert row.error.stage == "call" and "no line" in row.error.message and row.result is None


# --- whole jobs --------------------------------------------------------------------


@pytest.mark.parametrize("model", ["anthropic:claude-opus-4", "deepl:pro", "google:gemini-2.5-pro", "openai:gpt-5", "yandex:llama", "xai:grok-3"])
def test_every_vendor(spark, model):
    vendor = model.split(":")[0]
    texts = ["Text with http://a.b/c and {end} marks", "", None, "<a href=1>x</a> y"]
    job = Job(model, filters=["url", "html_a"], variables={"folder_id": "f"}, context="a {source} b", source_lang="en", target_lang="DE", verbose=True)
    got = rows(translate(frame(spark, texts), job, transport.Echo(vendor)))
    assert [r.result for r in got] == [texts[0], "" if vendor == "deepl" else None or "", None, texts[3]]
    assert got[2].error.code == "no_text" and all(r.error is None for i, r in enumerate(got) if i != 2)
    assert [tuple(s) for s in got[0].filter_stats] == [("url", 1), ("html_a", 0)]
    assert got[0].lengths.original == len(texts[0]) and got[0].lengths.translated == len(texts[0])
    assert got[0].consumed.get("tokens") is None if vendor == "deepl" else got[0].consumed["tokens"].total > 0
    assert "POST " in got[0].debug_request and got[0].http_status == 200 and got[0].debug_response.startswith("response 200\n")


def test_errors_of_each_step(spark):
    docs = frame(spark, ["a"])
    code = lambda job, sender: rows(translate(docs, job, sender))[0].error.code
    assert code(Job("openai:gpt-4o"), transport.Echo("openai", "truncate")) == "truncated"
    assert code(Job("xai:grok-4"), transport.Echo("xai", "marks")) == "no_marks"
    assert code(Job("openai:gpt-4o"), transport.Echo("openai", "http")) == "http_error"
    assert code(Job("anthropic:claude-opus-4"), transport.Echo("anthropic", "http")) == "invalid_json"
    assert code(Job("openai:gpt-4o", "json"), transport.Echo("openai")) == "invalid_json"
    assert code(Job("openai:gpt-4o", "html", validate=True), transport.Static(transport.Response(200, json.dumps({"choices": [{"message": {"content": "‹‹TRANSLATION››<b>x‹‹END››"}}]})))) == "invalid_html"
    changed = transport.Static(transport.Response(200, json.dumps({"choices": [{"message": {"content": '‹‹TRANSLATION››{"b":1}‹‹END››'}}]})))
    (row,) = rows(translate(frame(spark, ['{"a":1}']), Job("openai:gpt-4o", "json"), changed))
    assert (row.error.stage, row.error.code) == ("revalidate", "structure")
    (row,) = rows(translate(frame(spark, ['{"a":1}']), Job("openai:gpt-4o", "json", validate=False), changed))
    assert row.result == '{"b":1}'
    with pytest.raises(Exception, match="truncated"):
        translate(docs, Job("openai:gpt-4o", strict=True), transport.Echo("openai", "truncate")).collect()
    registry = Registry()
    registry.models["openai:gpt-4o"]["limits"] = {"estimated_max_chars": 2003}
    got = rows(translate(frame(spark, ["abc", "abcd"]), Job("openai:gpt-4o", registry=registry), transport.Echo("openai")))
    assert got[0].error is None and got[1].error.code == "too_long" and "1 characters" in got[1].error.message


def test_dry_run_sends_nothing(spark):
    class Never:
        def send(self, request):
            raise AssertionError

    texts = ["x http://a.b y", "plain"]
    got = rows(translate(frame(spark, texts), Job("yandex:llama", filters=["url"], dry_run=True, variables={"folder_id": "f"}), Never()))
    assert [(r.prepared, r.result, r.http_status, r.raw_response) for r in got] == [("x @@0@@ y", texts[0], 0, "[dry-run]"), ("plain", "plain", 0, "[dry-run]")]
    assert "not sent" in got[0].debug_request


def test_logs(spark):
    sender = transport.Static(transport.Response(200, json.dumps({"choices": [{"message": {"content": '‹‹TRANSLATION››{"a":2}‹‹END››'}}]}), {"X-A": ["1", "key"], "Y": ["z"]}))
    (row,) = rows(translate(frame(spark, ['{"a":1}']), Job("openai:gpt-4o", "json", verbose=True), sender))
    assert row.debug_request.startswith("json checked before\n") and "  X-A: 1\n  X-A: key\n  Y: z\n" in row.debug_response and row.debug_response.endswith("json checked after\n")
    (row,) = rows(translate(frame(spark, ['{"a":1}']), Job("openai:gpt-4o", "json"), sender))
    assert row.debug_request == row.debug_response == ""
    r = F.struct(F.lit(201).alias("status"), F.create_map(F.lit("A"), F.array(F.lit("x key y"))).alias("headers"), F.lit("key").alias("body"))
    assert spark.range(1).select(responses.preview(r, ["key"])).first()[0] == "response 201\nHeaders:\n  A: x *** y\n\nBody:\n***\n"


def test_reports(spark):
    got = translate(frame(spark, ["http://a", "b"]), Job("openai:gpt-4o", filters=["url"]), transport.Echo("openai"))
    assert [tuple(r) for r in reports.filter_totals(got).collect()] == [("url", 1, 1)]
    assert reports.error_totals(got).count() == 0
    assert {(r.category, r.part) for r in reports.usage_totals(got).collect()} == {("tokens", p) for p in ("", "prompt", "completion", "reasoning")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text(" \n")
    docs = documents.from_files(spark, str(tmp_path))
    full, blank = documents.split_blank(docs)
    assert [r.text for r in full.collect()] == ["one\ntwo\n"] and blank.count() == 1
    with pytest.raises(ValueError, match="format"):
        documents.from_text(spark, "x", "pdf")
    assert documents.from_stdin(spark, "html", io.StringIO("<p>")).first().text == "<p>"
    documents.write(full.select(F.col("text").alias("result")), str(tmp_path / "out"), "text")
    assert "one" in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_stream(spark, tmp_path):
    frame(spark, ["a http://b", "c"]).write.parquet(str(tmp_path / "in"))
    pages = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    job = Job("openai:gpt-4o", filters=["url"])
    for sender in (transport.Echo("openai"), transport.Static(transport.Response(500, "asked again"))):
        stream.start(pages, job, sender, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert [r.result for r in got] == ["a http://b", "c"]


# --- command line -----------------------------------------------------------------


def test_cli(spark, tmp_path, capsys, monkeypatch):
    source, out = tmp_path / "in.txt", tmp_path / "out.txt"
    source.write_text("see http://a.b now")
    base = ["--model=openai:gpt-4o", "--format=text", f"--source={source}", "--filters=url"]
    assert cli.run([*base, f"--translated={out}", "--verbose"], spark, transport.Echo("openai")) == 0
    assert out.read_text() == "see http://a.b now" and "url: 1" in capsys.readouterr().err
    assert cli.run([*base, "--dry-run"], spark) == 0 and (tmp_path / "in.txt.prepared").read_text() == "see @@0@@ now"
    assert cli.run(["--model=openai:gpt-4o", "--format=text"], spark, transport.Echo("openai"), io.StringIO("piped")) == 0
    assert capsys.readouterr().out == "piped"
    assert cli.run(["--list-models"]) == 0 and "openai:gpt-5-nano" in capsys.readouterr().out
    assert cli.run(["--list-prompts"]) == 0 and "translator (text, html, json)" in capsys.readouterr().out
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    monkeypatch.delenv("YANDEX_FOLDER_ID", raising=False)
    for argv in (["--format=text"], ["--model=foo:bar", "--format=text"], ["--model=openai:gpt-4o", "--format=pdf"], base, [*base, "--variables=a"], ["--model=openai:gpt-4o", "--format=text", "--source=/none"], ["--model=yandex:llama", "--format=text", f"--source={source}"]):
        assert cli.run(argv, spark) == 1 and capsys.readouterr().err.startswith("error: ")
    assert cli.run(["--model=openai:gpt-4o", "--format=text"], spark, transport.Echo("openai"), io.StringIO(" \n")) == 1
    assert cli.run(["--model=yandex:llama", "--format=text", f"--source={source}", "--variables=folder_id=f, x = y"], spark, transport.Echo("yandex")) == 0
    assert cli.run([*base], spark, transport.Echo("openai", "truncate")) == 1
    assert cli.parse_variables("a=1=2, b =") == {"a": "1=2", "b": ""}


# --- answers by row, and what a store keeps ------------------------------------------


class Counting:
    """Says how often it was asked, by a file for each call."""

    def __init__(self, folder, status=200):
        self.folder, self.status = str(folder), status

    def send(self, request):
        import pathlib
        import uuid

        pathlib.Path(self.folder, uuid.uuid4().hex).write_text(request.body)
        return transport.Response(self.status, "busy") if self.status >= 400 else transport.Echo("openai").send(request)


def test_failures_are_asked_again(spark, tmp_path):
    docs, job, store = frame(spark, ["a", "b"]), Job("openai:gpt-4o"), str(tmp_path / "store")
    for status in (503, 429, 401):
        got = rows(translate(docs, job, transport.Static(transport.Response(status, "busy")), store))
        assert [(r.error.code, r.http_status) for r in got] == [("http_error", status)] * 2 and "busy" in got[0].error.message
    assert [r.result for r in rows(translate(docs, job, transport.Echo("openai"), store))] == ["a", "b"]
    assert [r.result for r in rows(translate(docs, job, transport.Static(transport.Response(500, "not asked")), store))] == ["a", "b"]


def test_reasons_with_a_store(spark, tmp_path):
    class Broken:
        def send(self, request):
            raise AttributeError("no such part")

    for store in (None, str(tmp_path / "store")):
        (row,) = rows(translate(frame(spark, ["a"]), Job("openai:gpt-4o"), Broken(), store))
        assert (row.error.stage, row.error.code, row.error.message) == ("call", "network", "AttributeError: no such part")
    assert rows(translate(frame(spark, ["a"]), Job("openai:gpt-4o"), transport.Echo("openai"), store))[0].result == "a"


@pytest.mark.parametrize("stored", [False, True])
def test_rows_keep_their_own_answer(spark, tmp_path, stored):
    docs = spark.createDataFrame([(2, "a", "x"), (2, "b", "y"), (None, "c", "z"), (None, "a", "w"), (3, None, "v")], "doc_id long, text string, k string")
    (tmp_path / "calls").mkdir()
    out = translate(docs, Job("openai:gpt-4o"), Counting(tmp_path / "calls"), str(tmp_path / "store") if stored else None, carry=["k"]).collect()
    assert sorted((r.k, r.doc_id, r.result, r.error and r.error.code) for r in out) == [("v", 3, None, "no_text"), ("w", None, "a", None), ("x", 2, "a", None), ("y", 2, "b", None), ("z", None, "c", None)]
    if stored:
        # equal requests are one
        assert len(list((tmp_path / "calls").iterdir())) == 3
        assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_pending")]


def test_with_a_store_an_answer_is_read_once_for_all_its_documents(spark, tmp_path):
    """Equal prepared texts share what is made of their answer; what a filter took is each document's own."""
    (tmp_path / "calls").mkdir()
    docs, job = frame(spark, ["a http://b", "c", "a http://d", None, "c"]), Job("openai:gpt-4o", filters=["url"], verbose=True)
    out = translate(docs, job, Counting(tmp_path / "calls"), str(tmp_path / "store"), work=str(tmp_path / "work"))
    # what is done for each row of the result decodes no answer
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "variant" not in plan and "parse" not in plan
    got = rows(out)
    assert [r.result for r in got] == ["a http://b", "c", "a http://d", None, "c"] and len(list((tmp_path / "calls").iterdir())) == 2
    assert spark.read.parquet(str(tmp_path / "work" / "answers")).count() == 2
    # the same rows as without a store
    assert got == rows(translate(docs, job, transport.Echo("openai")))
    assert got[3].error.code == "no_text" and got[3].consumed == {} and got[0].consumed


def test_batches_are_committed_one_by_one(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    docs, store = frame(spark, [f"t{i}" for i in range(120)]), str(tmp_path / "store")
    asked = docs.select("doc_id", F.struct(F.lit("u").alias("url"), F.array().cast("array<string>").alias("headers"), F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("messages"))).alias("body")).alias("request"))
    out = transport.call_once(asked, Counting(tmp_path / "calls"), store, callers=2, rows_a_caller=10).collect()
    assert len(out) == 120 and all(r.response.status == 200 and r.failure is None for r in out)
    assert len(list((tmp_path / "calls").iterdir())) == 120
    assert len({p.name.split("-")[2] for p in (tmp_path / "store").glob("prefix=*/part-*")}) >= 2 and spark.read.parquet(store).where("good").count() == 120


def test_other_proxies_are_refused():
    with pytest.raises(ValueError, match="socks5"):
        transport.Http(proxy="socks5://127.0.0.1:1").send(transport.Request("http://127.0.0.1:9/", [], ""))


def test_validators_can_be_added(spark, monkeypatch):
    short = lambda text: F.struct((F.length(text) < 4).alias("valid"), F.when(F.length(text) < 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("long"))).alias("errors"))
    monkeypatch.setitem(validation.VALIDATORS, "note", short)
    got = frame(spark, ["abc", "abcd"]).select(validation.container_result(F.col("text"), "note").alias("r")).collect()
    assert [r.r.valid for r in got] == [True, False]


def test_one_pass_for_each_filter(spark):
    from glossaflow.plans import catalog

    plan = catalog.filter_stats_by_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # the kinds of pieces are cut too, but they are no text
    assert plan.count("regexp_extract_all(") <= 3 and plan.count("split(") - plan.count("split(regexp_replace(") <= 3


def test_cli_of_a_folder(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, text in (("a", "see http://a.b now"), ("b", " \n"), ("c", "plain")):
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    base = ["--model=openai:gpt-4o", "--format=text", f"--source={tmp_path / 'in'}", "--filters=url"]
    assert cli.run([*base, "--dry-run"], spark) == 0
    assert sorted(r.prepared for r in spark.read.json(str(tmp_path / "in.prepared")).collect()) == ["plain", "see @@0@@ now"]
    assert cli.run([*base, f"--translated={tmp_path / 'out'}"], spark, transport.Echo("openai")) == 0
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.result) for r in got) == [("a.txt", "see http://a.b now"), ("c.txt", "plain")]
    assert cli.run(base, spark, transport.Echo("openai")) == 1 and "--translated" in capsys.readouterr().err
    assert cli.run([*base, f"--translated={tmp_path / 'bad'}"], spark, transport.Echo("openai", "truncate")) == 1 and "2 documents" in capsys.readouterr().err


def test_models_are_listed_with_notes(capsys):
    registry = Registry()
    assert all(registry.notes(k) and registry.get(k)["name"] for k in registry.keys())
    assert cli.run(["--list-models"]) == 0
    out = capsys.readouterr().out
    assert all(registry.notes(k) in out for k in registry.keys())


# --- the store's folders, and requests in flight -----------------------------------


def asking(spark, texts):
    """Rows with a request each, as the echo answers it."""
    body = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("messages")))
    return frame(spark, texts).select("doc_id", F.struct(F.lit("u").alias("url"), F.array().cast("array<string>").alias("headers"), body.alias("body")).alias("request"))


def test_a_run_opens_its_own_prefixes_only(spark, tmp_path):
    store = tmp_path / "store"
    transport.call_once(asking(spark, [f"t{i}" for i in range(60)]), transport.Echo("openai"), str(store)).collect()
    new = asking(spark, ["new"])
    prefix = new.select(F.substring(transport.request_hash(), 1, 2)).first()[0]
    others = [p for p in store.glob("prefix=*/part-*") if p.parent.name != f"prefix={prefix}"]
    assert len({p.parent for p in others}) > 30
    for p in others:
        p.write_bytes(b"no such format")
    for _ in range(2):
        (row,) = transport.call_once(new, transport.Echo("openai"), str(store)).collect()
        assert row.response.status == 200
    # what has been asked is looked up by hash alone
    plan = transport.stored(spark, str(store), {prefix}).where("good").select("request_hash")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<request_hash:string,good:boolean>" in plan


def test_columns_of_ones_own(spark, tmp_path):
    """Names that the store uses too stay what they are."""
    df = asking(spark, ["a", "b"]).withColumns({c: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for c in ("prefix", "request_hash", "good", "run")})
    for _ in range(2):
        got = transport.call_once(df, transport.Echo("openai"), str(tmp_path / "store"))
        assert got.columns == [*df.columns, "response", "failure"]
        assert all(r.response.status == 200 and {r.prefix, r.request_hash, r.good, r.run} == {f"own {r.doc_id}"} for r in got.collect())


def test_compaction(spark, tmp_path):
    store = str(tmp_path / "store")
    texts = [f"t{i}" for i in range(40)]
    transport.call_once(asking(spark, texts), transport.Static(transport.Response(500, "busy")), store).collect()
    for i in range(3):
        transport.call_once(asking(spark, texts[: 20 * (i + 1)]), transport.Echo("openai"), store).collect()
    before = {p.parent.name for p in (tmp_path / "store").glob("prefix=*/part-*")}
    assert transport.compact(spark, store, 1) > 5 and transport.compact(spark, store, 1) == 0
    files = list((tmp_path / "store").glob("prefix=*/part-*"))
    assert len(files) == len(before) == len({p.parent for p in files})
    held = spark.read.parquet(store)
    assert held.where("good").count() == held.select("request_hash").distinct().count() == 40
    got = transport.call_once(asking(spark, [*texts, "new"]), transport.Static(transport.Response(500, "asked")), store).collect()
    assert sorted((r.response.status, r.response.body == "asked") for r in got) == [(200, False)] * 40 + [(500, True)]
    for p in files:
        hashes = [r.request_hash for r in spark.read.parquet(str(p)).collect()]
        assert hashes == sorted(hashes)


class Slow(http.server.BaseHTTPRequestHandler):
    """Answers after a fifth of a second, and notes how many it has open."""

    lock, open, most, refuse = threading.Lock(), 0, 0, 0

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        with Slow.lock:
            Slow.open += 1
            Slow.most = max(Slow.most, Slow.open)
            Slow.refuse -= 1
            refused = Slow.refuse >= 0
        time.sleep(0.2)
        with Slow.lock:
            Slow.open -= 1
        self.send_response(429 if refused else 200)
        if refused:
            self.send_header("Retry-After", "0.1")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def slow():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Slow)
    Slow.open = Slow.most = Slow.refuse = 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_so_many_requests_are_open_and_never_more(spark, slow):
    request = F.struct(F.lit(slow).alias("url"), F.array().cast("array<string>").alias("headers"), F.col("text").alias("body")).alias("request")
    asked = frame(spark, [f"t{i}" for i in range(60)]).select("doc_id", F.when(F.col("doc_id") % 6 > 0, request).alias("request"))
    for n in (1, 7):
        Slow.most, began = 0, time.monotonic()
        got = transport.call(asked.where(F.col("doc_id") < 12 * n).coalesce(1), transport.Http(), in_flight=n, at_once=4).collect()
        assert Slow.most == n and time.monotonic() - began < 0.2 * 10 * 3 + 5
        assert all(r.failure is None and (r.response.body == f"t{r.doc_id}" if r.doc_id % 6 else r.response is None) for r in got)


def test_tasks_share_a_rate_that_falls(slow, monkeypatch):
    now = [100.0]
    monkeypatch.setattr(transport.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(transport.time, "sleep", lambda s: now.__setitem__(0, now[0] + s))
    pace = transport.Pace(10.0)
    for _ in range(11):
        pace.wait()
    assert abs(now[0] - 101.0) < 1e-6
    pace.busy(5.0)
    pace.wait()
    pace.wait()
    assert pace.rate == 5.0 and now[0] >= 106.2 - 1e-6
    for _ in range(50):
        pace.fine()
    assert pace.rate == 10.0
    for _ in range(30):
        pace.busy()
    assert pace.rate == pace.least
    Slow.refuse = 2
    sender = transport.Http(rate=40.0, tasks=4)
    assert sender.send(transport.Request(slow, [], "x")).status == 200
    host = slow.split("/")[2]
    assert transport._pace(host, 10.0).full == 10.0 and transport._pace(host, 10.0).rate == 3.0
    assert [transport._seconds(x) for x in (None, "2", "-1", "Wed, 21 Oct", "9999")] == [None, 2.0, 0.0, None, 300.0]


def test_answers_are_decoded_once(spark):
    """Whatever looks at a decoded answer, and a report of errors runs each check once."""
    docs = spark.createDataFrame([(1, '{"a": 1}'), (2, "{")], "doc_id long, text string")
    for vendor, model in (("openai", "openai:gpt-4o"), ("google", "google:gemini-2.5-pro"), ("yandex", "yandex:gpt-32k"), ("deepl", "deepl:free")):
        plan = translate(docs, Job(model, "json", variables={"folder_id": "f"}), transport.Echo(vendor))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") + plan.count("parse_json") == 1, vendor
    totals = reports.error_totals(translate(docs, Job("openai:gpt-4o", "json"), transport.Echo("openai", "marks")))
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("parseJson") + plan.count("parse_json") == 1
    assert {(r.stage, r.code, r.n_docs) for r in totals.collect()} == {("validate", "invalid_json", 1), ("parse", "no_marks", 1)}


def test_quick_answers_keep_their_rows(spark):
    """Handed on together where answers come quickly, by at_once rows where they are long or slow; each row keeps its own answer."""
    request = F.struct(F.lit("http://x").alias("url"), F.array().cast("array<string>").alias("headers"), F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("t"), "id").alias("content"))).alias("messages"))).alias("body"))
    asked = spark.range(3000, numPartitions=1).select("id", F.when(F.col("id") % 5 > 0, request).alias("request"))
    for limits in ({}, {"most_chars": 0}, {"most_seconds": 0.0, "at_once": 1}):
        for n in (1, 3):
            rows = transport.call(asked, transport.Echo("openai"), in_flight=n, **limits).collect()
            assert len(rows) == 3000 and all((f'"content": "t{r.id}"' in r.response.body) if r.id % 5 else r.response is None for r in rows)
