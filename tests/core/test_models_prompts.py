"""The registry, limits and prompts."""

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import limits
from glossaflow.functions import text as tx
from glossaflow.operators import models, requests, responses
from glossaflow.operators.models import Registry
from glossaflow.operators.prompts import Prompts
from glossaflow.plans.catalog import model_table
from glossaflow.plans.translate import Job, limit_of

NET = {
    "anthropic:claude-haiku-3.5": 398000, "anthropic:claude-opus-4": 798000, "deepl:pro": 28000, "google:gemini-2.5-flash": 417432, "google:gemini-2.5-pro": 836864,
    "openai:gpt-5": 1086000, "openai:gpt-4o": 444464, "openai:gpt-4": 24216, "openai:gpt-4-turbo": 407600, "yandex:gpt-lite": 24216, "yandex:gpt-32k": 100400, "xai:grok-4": 817200, "xai:grok-3": 417432,
}


def test_limits(spark):
    got = {r.model_key: r.net_limit for r in model_table(spark).collect()}
    assert len(got) == 24 and {k: got[k] for k in NET} == NET
    registry = Registry()
    assert all(limit_of(registry.get(k)) == n for k, n in got.items())


@pytest.mark.parametrize(("chars", "tokens", "answer", "net"), [(None, None, None, 0), (1500, None, None, 0), (None, 1000, None, 1200), (None, 1000, 1200, 0), (2100, 1000, 1, 100), (None, 1, None, 0), (0, 0, 9, 0)])
def test_odd_limits(spark, chars, tokens, answer, net):
    lit = lambda x: F.lit(x).cast("long")
    assert spark.range(1).select(limits.net_limit(limits.gross_limit(lit(chars), lit(tokens), lit(answer)))).first()[0] == net
    assert limit_of({"limits": {"estimated_max_chars": chars, "max_tokens": tokens, "max_output_tokens": answer}}) == net


def test_accessors():
    r = Registry()
    assert r.has("openai:gpt-4o") and not r.has("foo:bar") and r.get("google:gemini-1.5-pro") is None
    assert r.auth_env("deepl:free") == "DEEPL_FREE_API_KEY" and r.auth_env("deepl:pro") == "DEEPL_PRO_API_KEY" and r.auth_env("foo:bar") is None
    assert r.variables("yandex:gpt-lite") == {"folder_id": "YANDEX_FOLDER_ID"} and r.variables("openai:gpt-4") == {} and r.variables("foo:bar") == {}
    assert all(r.endpoint(k) and r.help_url(k) and r.auth_env(k) and limit_of(r.get(k)) > 0 for k in r.keys())
    assert r.endpoint("deepl:free") != r.endpoint("deepl:pro")
    assert list(r.by_vendor()) == ["anthropic", "deepl", "google", "openai", "yandex", "xai"]
    assert r.most_chars("deepl:free") == 30000 and r.format("deepl:free") == "text|html" and r.notes("foo:bar") is None


def test_registry_files(tmp_path):
    path = tmp_path / "models.yaml"
    path.write_text("foo: {vendor: v, endpoint: e}\nw:\n  endpoint: base\n  format: text\n  defaults: {a: 1, b: 2}\n  limits: {list: [1, 2, 3]}\n  models:\n    m1: {defaults: {b: null, c: 3}}\n    m2: {endpoint: own, limits: {list: [9]}}\n    m3:\n")
    r = Registry(str(path))
    assert r.keys() == ["foo", "w:m1", "w:m2", "w:m3"]
    assert r.get("foo") == {"vendor": "v", "endpoint": "e"}
    assert r.get("w:m1")["defaults"] == {"a": 1, "b": None, "c": 3} and r.endpoint("w:m1") == "base" and r.vendor("w:m1") == "w"
    assert r.endpoint("w:m2") == "own" and r.get("w:m2")["limits"]["list"] == [9, 2, 3]
    assert set(r.by_vendor()) == {"v", "w"}
    with pytest.raises(FileNotFoundError):
        Registry(str(tmp_path / "none.yaml"))


def test_drivers_of_vendors():
    assert set(requests.BUILDERS) == set(responses.PARSERS) == set(models.builtin())
    with pytest.raises(KeyError):
        requests.builder("nobody")
    with pytest.raises(KeyError):
        responses.parse(None, {"vendor": "nobody"})


def test_prompts(spark, tmp_path):
    path = tmp_path / "prompts.yaml"
    path.write_text("translator:\n  notes: n\n  text: 'Translate from {source} to {target}: {text}{more}'\n")
    p = Prompts(str(path))
    values = {"source": F.lit("en"), "target": F.lit("fr"), "text": F.lit("Hello {source}")}
    assert spark.range(1).select(p.render("translator", "text", values)).first()[0] == "Translate from en to fr: Hello {source}{more}"
    assert p.list() == {"translator": {"formats": ["text"], "notes": "n"}}
    with pytest.raises(KeyError, match=r"unknown\.json"):
        p.render("unknown", "json", {})
    with pytest.raises(FileNotFoundError):
        Prompts(str(tmp_path / "none.yaml"))
    assert set(Prompts().list()["translator"]["formats"]) == {"text", "html", "json"}
    for f in ("text", "html", "json"):
        assert all("{" + v + "}" in Prompts().template("translator", f) for v in ("source", "target", "start", "end", "context"))


def test_job_settings():
    job = Job("xai:grok-4", target_lang="DE", context="c", variables={"format": "html", "a": "1"})
    assert job.settings()["defaults"]["target_lang"] == "DE" and job.settings()["defaults"]["source_lang"] == "auto"
    assert job.options()["format"] == "html" and job.options()["context"] == "c" and job.options()["a"] == "1"
    with pytest.raises(KeyError):
        Job("foo:bar").settings()
    with pytest.raises(ValueError, match="format"):
        Job("xai:grok-4", "markdown").settings()


def test_text_functions(spark):
    df = spark.createDataFrame([(" \t\n\r\0\x0ba b*~é&=",)], "t string")
    row = df.select(tx.trimmed(F.col("t")).alias("a"), tx.form_body([("x y", F.col("t")), ("z", F.lit(None).cast("string"))]).alias("b"), tx.is_blank(F.lit("\0 \x0b")).alias("c"), tx.is_blank(F.lit(" ")).alias("d")).first()
    assert row.a == "a b*~é&=" and row.b == "x y=+%09%0A%0D%00%0Ba+b%2A%7E%C3%A9%26%3D" and row.c and not row.d
