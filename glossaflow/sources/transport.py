"""The call itself, behind an interface: in tests an echo, in production HTTP.

Rows with a request go through the call whole, so an answer needs no join to
find its row. A task keeps a bounded number of requests open at a time, and all
tasks together keep to a rate, which falls where the service is too busy.

A call costs money and Spark may run a task again, so answers can be kept by the
hash of their request: equal requests are asked once, in batches that are
committed one by one, and what has a good answer is not asked again. A task that
is lost asks again at most what its batch held. The store is a folder for each
of 256 prefixes of the hash, with sorted files that are never changed; a run
lists and opens only the prefixes of its own requests, and of those only hashes
until it needs answers. ``compact`` makes one sorted file of many.

Keys never are in a column: the transport reads them where it runs and adds them
to the request; logs show *** for them.
"""

from __future__ import annotations

import dataclasses
import json
import os
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

RESPONSE_TYPE = "struct<status: int, headers: map<string, array<string>>, body: string>"
REQUEST_TYPE = "struct<url: string, headers: array<string>, body: string>"


@dataclass
class Request:
    url: str
    headers: list[str]
    body: str
    method: str = "POST"


@dataclass
class Response:
    status: int
    body: str
    headers: dict[str, list[str]] = field(default_factory=dict)


class Transport(Protocol):
    """Pickled to the executors; send() runs there, in several threads where several requests are open at a time."""

    def send(self, request: Request) -> Response: ...


@dataclass
class DryRun:
    """Sends nothing."""

    def send(self, request: Request) -> Response:
        return Response(0, "[dry-run]")


@dataclass
class Static:
    """The same answer to every request."""

    response: Response

    def send(self, request: Request) -> Response:
        return self.response


@dataclass
class Echo:
    """Answers as the vendor would whose translation is the text itself. fault: how it goes wrong, for tests."""

    vendor: str
    fault: str = ""

    def send(self, request: Request) -> Response:
        if self.fault == "http":
            return Response(503, "busy")
        usage = {"prompt": len(request.body), "answer": len(request.body) // 2}
        if self.vendor == "deepl":
            text = dict(urllib.parse.parse_qsl(request.body, keep_blank_values=True))["text"]
            return Response(200, json.dumps({"translations": [{"text": text}]}))
        body = json.loads(request.body)
        if self.vendor == "google":
            said = body["contents"][0]["parts"][0]["text"]
        else:
            said = body["messages"][-1]["text" if self.vendor == "yandex" else "content"]
        if self.fault == "marks":
            said = said.split("\n", 1)[1]
        stop = {"truncate": "length"}.get(self.fault, "stop")
        total = usage["prompt"] + usage["answer"]
        if self.vendor == "google":
            out = {"candidates": [{"content": {"parts": [{"text": said}]}, "finishReason": "MAX_TOKENS" if self.fault == "truncate" else "STOP"}], "usageMetadata": {"totalTokenCount": total, "promptTokenCount": usage["prompt"], "candidatesTokenCount": usage["answer"]}}
        elif self.vendor == "yandex":
            out = {"result": {"alternatives": [{"message": {"text": said}}], "usage": {"totalTokens": str(total), "inputTextTokens": str(usage["prompt"]), "completionTokens": str(usage["answer"])}}}
        else:
            out = {"choices": [{"message": {"content": said}, "finish_reason": stop}], "usage": {"total_tokens": total, "prompt_tokens": usage["prompt"], "completion_tokens": usage["answer"]}}
        return Response(200, json.dumps(out, ensure_ascii=False))


@dataclass
class Auth:
    """How a key goes into a request: as a header, a form field or a query parameter. The key is read from env where the request is sent, unless it is given."""

    kind: str = "form"
    key_name: str = ""
    prefix: str = ""
    env: str = ""
    key: str = field(default="", repr=False)

    @classmethod
    def of(cls, settings: dict, key: str = "") -> Auth | None:
        auth = (settings.get("requirements") or {}).get("auth")
        return auth and cls(auth.get("type") or "form", auth["key_name"], auth.get("prefix") or "", auth.get("env") or "", key)

    def secret(self) -> str:
        key = self.key or os.environ.get(self.env, "")
        if not key:
            raise ValueError(f"no API key: set {self.env or 'one'}")
        return key

    def attach(self, request: Request) -> Request:
        key = self.secret()
        if self.kind == "header":
            return Request(request.url, [*request.headers, f"{self.key_name}: {self.prefix + ' ' if self.prefix else ''}{key}"], request.body, request.method)
        if self.kind == "form":
            return Request(request.url, request.headers, f"{request.body}&{urllib.parse.quote_plus(self.key_name)}={urllib.parse.quote_plus(key)}", request.method)
        if self.kind == "query":
            return Request(request.url + ("&" if "?" in request.url else "?") + urllib.parse.urlencode({self.key_name: key}), request.headers, request.body, request.method)
        raise ValueError(f"unknown kind of authentication: {self.kind}")


class Pace:
    """At most so many requests a second, from all threads of a process. A busy service halves that; each good answer gives back a twentieth of what was allowed at first."""

    def __init__(self, rate: float, least: float = 0.05):
        self.full = self.rate = rate
        self.least, self.next, self.lock = min(least, rate), 0.0, threading.Lock()

    def wait(self) -> None:
        """Until it is one's turn."""
        with self.lock:
            turn = max(time.monotonic(), self.next)
            self.next = turn + 1 / self.rate
        time.sleep(max(0.0, turn - time.monotonic()))

    def busy(self, seconds: float = 0.0) -> None:
        """The service has had too much; it may say for how long."""
        with self.lock:
            self.rate = max(self.least, self.rate / 2)
            self.next = max(self.next, time.monotonic() + seconds)

    def fine(self) -> None:
        with self.lock:
            self.rate = min(self.full, self.rate + self.full / 20)


@cache
def _pace(host: str, rate: float) -> Pace:
    """One for each service in a process: the tasks that a worker runs one after another go on at the rate that was found."""
    return Pace(rate)


@dataclass
class Http:
    """HTTP with a time limit, a few retries where the service is busy, a pause between requests, and an optional proxy. rate: requests a second of all tasks together, each of which keeps to its part and lowers it on 429."""

    auth: Auth | None = None
    proxy: str | None = None
    timeout: float = 120.0
    retries: int = 3
    pause: float = 0.0
    rate: float | None = None
    tasks: int = 1

    def send(self, request: Request) -> Response:
        if self.proxy and not self.proxy.lower().startswith(("http://", "https://")) and "://" in self.proxy:
            raise ValueError(f"proxies are spoken to by HTTP only, not by {self.proxy.split('://')[0]}")
        pace = _pace(urllib.parse.urlsplit(request.url).netloc, self.rate / self.tasks) if self.rate else None
        request = self.auth.attach(request) if self.auth else request
        handlers = [urllib.request.ProxyHandler({"http": self.proxy, "https": self.proxy})] if self.proxy else []
        opener = urllib.request.build_opener(*handlers)
        made = urllib.request.Request(request.url, request.body.encode() if request.method != "GET" else None, method=request.method)
        for line in request.headers:
            name, _, value = line.partition(":")
            made.add_header(name.strip(), value.strip())
        for attempt in range(self.retries + 1):
            time.sleep(self.pause)
            if pace:
                pace.wait()
            asked_to_wait = None
            try:
                with opener.open(made, timeout=self.timeout) as got:
                    if pace:
                        pace.fine()
                    return _response(got.status, got)
            except urllib.error.HTTPError as e:
                asked_to_wait = _seconds(e.headers.get("Retry-After"))
                if pace and e.code == 429:
                    pace.busy(asked_to_wait or 0.0)
                if attempt == self.retries or e.code != 429 and e.code < 500:
                    return _response(e.code, e)
            except urllib.error.URLError as e:
                if attempt == self.retries:
                    raise ConnectionError(f"network error: {e.reason}") from e
            time.sleep(2**attempt if asked_to_wait is None else asked_to_wait)
        raise AssertionError("unreachable")


def _seconds(header: str | None, most: float = 300.0) -> float | None:
    """How long a service asks to wait, where it says so in seconds."""
    try:
        return min(most, max(0.0, float(header))) if header else None
    except ValueError:
        return None


def _response(status: int, got) -> Response:
    headers: dict[str, list[str]] = {}
    for name, value in got.headers.items():
        headers.setdefault(name, []).append(value.strip())
    return Response(status, got.read().decode("utf-8", "replace"), headers)


def proxy_from(flag: str | None) -> str | None:
    """The flag, else the environment, else none."""
    return flag or os.environ.get("GLOSSAFLOW_PROXY") or None


def in_order(transport: Transport, requests: Iterator[dict | None], pool: ThreadPoolExecutor, ahead: int) -> Iterator[tuple[dict | None, str | None]]:
    """The answers in order of the requests; at most ahead of them have been handed to the pool and not been taken."""
    held: deque = deque()
    for r in requests:
        held.append(pool.submit(_sent, transport, r))
        if len(held) >= ahead:
            yield held.popleft().result()
    while held:
        yield held.popleft().result()


def call(df: DataFrame, transport: Transport, callers: int | None = None, at_once: int = 32, in_flight: int = 1, most_chars: int = 1_000_000, most_seconds: float = 0.2) -> DataFrame:
    """df with response and failure, which says why a request has no response; rows without a request have neither. callers: how many tasks ask at once; in_flight: how many requests a task has open at a time. A task hands on its answers by at_once rows, or by more as long as they come quickly and are short (most_seconds, most_chars)."""
    if isinstance(transport, Http) and transport.rate:
        transport = dataclasses.replace(transport, tasks=callers or df.sparkSession.sparkContext.defaultParallelism)

    def sent(batches: Iterator):
        import pyarrow as pa

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                # requests as objects by portions, and without threads where one request is open at a time
                asked = (r for at in range(0, len(batch), 256) for r in batch.column("request").slice(at, 256).to_pylist())
                answers = in_order(transport, asked, pool, in_flight + at_once) if in_flight > 1 else (_sent(transport, r) for r in asked)
                rows, size, begun, at = [], 0, time.monotonic(), 0
                for n in range(1, len(batch) + 1):
                    rows.append(next(answers))
                    size += len(rows[-1][0]["body"]) if rows[-1][0] else 0
                    if n == len(batch) or len(rows) >= at_once and (size > most_chars or time.monotonic() - begun > most_seconds):
                        part = batch.slice(at, n - at)
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r for r, _ in rows], _RESPONSE), pa.array([f for _, f in rows], pa.string())], [*part.schema.names, "response", "failure"])
                        rows, size, begun, at = [], 0, time.monotonic(), n

    import pyarrow as pa

    _RESPONSE = pa.struct([("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("body", pa.string())])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return (df.repartition(callers) if callers else df).mapInArrow(sent, f"{kinds}, response {RESPONSE_TYPE}, failure string")


def _sent(transport: Transport, r: dict | None) -> tuple[dict | None, str | None]:
    """(response, why there is none) of a request."""
    if r is None:
        return None, None
    try:
        got = transport.send(Request(r["url"], list(r["headers"]), r["body"]))
        return {"status": got.status, "headers": list(got.headers.items()), "body": got.body}, None
    except Exception as e:  # noqa: BLE001  one document must not end the job
        return None, f"{type(e).__name__}: {e}"


def request_hash() -> Column:
    return F.when(F.col("request").isNotNull(), F.sha2(F.to_json("request"), 256))


#: The store's folders are named by so many characters of the hash.
_PREFIX = 2
_STORE_TYPE = f"request_hash string, response {RESPONSE_TYPE}, failure string, good boolean, run string, prefix string"


def stored(spark: SparkSession, store: str, prefixes: set[str] | None = None) -> DataFrame | None:
    """The answers under these prefixes (None: all), or None where there are none. Other folders of the store are neither listed nor opened."""
    there = [x for x in scratch.listed(spark, store) if (name := x.rsplit("/", 1)[-1]).startswith("prefix=") and (prefixes is None or name.removeprefix("prefix=") in prefixes)]
    return spark.read.schema(_STORE_TYPE).option("basePath", store).parquet(*sorted(there)) if there else None


def _kept(answers: DataFrame, store: str) -> None:
    """Adds answers to the store: a sorted file for each prefix and task."""
    made = answers.select("request_hash", "response", "failure", "good", "run", "prefix").sortWithinPartitions("prefix", "request_hash")
    made.write.mode("append").partitionBy("prefix").parquet(store)


def call_once(df: DataFrame, transport: Transport, store: str, callers: int | None = None, rows_a_caller: int = 1_000, in_flight: int = 1, work: str | None = None) -> DataFrame:
    """As call(), with answers kept in the folder store: a request that has an answer of a status below 400 there is not sent again. All else that came back is in the store too, for this run alone. df is computed once, into a table in work (a new folder that goes when this process ends), from which the result is read."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    work = work or scratch.temporary(spark, "requests")
    columns = df.columns
    of_hash = df.withColumn("_request_hash", request_hash()).withColumn("_prefix", F.substring("_request_hash", 1, _PREFIX))
    of_hash.write.parquet(f"{work}/asked")
    asked = spark.read.schema(of_hash.schema).parquet(f"{work}/asked")
    wanted = {r[0] for r in asked.where("_prefix is not null").select("_prefix").distinct().collect()}
    fresh = asked.where("request is not null").groupBy(F.col("_prefix").alias("prefix"), F.col("_request_hash").alias("request_hash")).agg(F.first("request").alias("request"))
    known = stored(spark, store, wanted)
    if known is not None:
        fresh = fresh.join(known.where("good").select("request_hash"), "request_hash", "left_anti").select("prefix", "request_hash", "request")
    # what is to be asked is written once, each prefix in one file or few
    fresh.hint("rebalance", "prefix").sortWithinPartitions("prefix", "request_hash").write.parquet(f"{work}/fresh")
    fresh = spark.read.schema(f"request_hash string, request {REQUEST_TYPE}, prefix string").parquet(f"{work}/fresh")
    # a batch keeps all callers busy for a while, and has whole prefixes
    n, tasks = fresh.count(), callers or spark.sparkContext.defaultParallelism
    order = sorted(wanted)
    each = max(1, len(order) * rows_a_caller * tasks // max(n, 1))
    for i in range(0, len(order) if n else 0, each):
        part = fresh.where(F.col("prefix").isin(order[i : i + each]))
        # by ranges of hashes, so that a task writes few files
        part = part.repartitionByRange(callers, "request_hash") if callers else part.repartitionByRange("request_hash")
        got = call(part, transport, None, in_flight=in_flight)
        good = F.coalesce(F.col("failure").isNull() & (F.col("response.status") < 400), F.lit(False))
        _kept(got.withColumns({"good": good, "run": F.lit(run)}), store)
    scratch.remove(spark, f"{work}/fresh")
    answers = stored(spark, store, wanted)
    if answers is None:
        return asked.select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast(RESPONSE_TYPE).alias("response"), F.lit(None).cast("string").alias("failure"))
    mine = answers.where(F.col("good") | (F.col("run") == run)).groupBy("request_hash").agg(F.max_by(F.struct("response", "failure"), F.struct("good", "run")).alias("_answer"))
    out = asked.join(mine.withColumnRenamed("request_hash", "_request_hash"), "_request_hash", "left")
    lost = F.when(F.col("request").isNotNull() & F.col("_answer").isNull(), F.lit("no answer"))
    return out.select(*[F.col(f"`{c}`") for c in columns], F.col("_answer.response").alias("response"), F.coalesce("_answer.failure", lost).alias("failure"))


def compact(spark: SparkSession, store: str, most_files: int = 8) -> int:
    """Writes the good answers of each prefix that has more than so many files anew, sorted, one of each request, and then deletes the files that held them; the number of prefixes. While nothing else uses the store; when it is broken off, answers are there twice, which changes nothing."""
    held = {}
    for path in scratch.listed(spark, store):
        files = [x for x in scratch.listed(spark, path) if x.rsplit("/", 1)[-1].startswith("part-")]
        if len(files) > most_files:
            held[path.rsplit("prefix=", 1)[-1]] = files
    if not held:
        return 0
    best = F.max_by(F.struct("response", "failure", "good", "run"), F.col("run"))
    made = stored(spark, store, set(held)).where("good").groupBy("prefix", "request_hash").agg(best.alias("best"))
    # a file for each prefix, or more where the rows are many
    _kept(made.select("prefix", "request_hash", "best.*").repartitionByRange("prefix", "request_hash"), store)
    scratch.remove(spark, *[x for files in held.values() for x in files])
    return len(held)
