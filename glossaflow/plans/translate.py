"""The translation of a collection of documents, one row a document.

validate → protect spans → check the length → build requests → call → parse →
normalise usage → put spans back → validate again and compare structures.

Everything but the call and the two validations is native. A document that
fails a step goes on with its error and is asked nothing; strict jobs raise at
the first error instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import limits, spans, usage, validation
from ..operators import requests, responses
from ..operators.models import Registry
from ..operators.prompts import Prompts
from ..sources import scratch
from ..sources import transport as tp
from ..sources.documents import check_format

ERROR_TYPE = "struct<stage: string, code: string, message: string>"


@dataclass
class Job:
    """What is common to all documents of a run."""

    model: str
    format: str = "text"
    filters: list[str] = field(default_factory=list)
    source_lang: str | None = None
    target_lang: str | None = None
    context: str | None = None
    prompt_key: str = "translator"
    variables: dict[str, str] = field(default_factory=dict)
    validate: bool = True
    dry_run: bool = False
    verbose: bool = False
    strict: bool = False
    registry: Registry = field(default_factory=Registry)
    prompts: Prompts = field(default_factory=Prompts)

    def settings(self) -> dict:
        """The model's settings with the job's languages and context on top; raises where something is missing."""
        check_format(self.format)
        if not self.registry.has(self.model):
            raise KeyError(f"no model {self.model} in the registry")
        if not self.registry.endpoint(self.model):
            raise ValueError(f"model {self.model} has no endpoint")
        held = dict(self.registry.get(self.model))
        over = {k: v for k, v in (("target_lang", self.target_lang), ("source_lang", self.source_lang), ("context", self.context)) if v is not None}
        return {**held, "defaults": {**(held.get("defaults") or {}), **over}}

    def options(self) -> dict:
        """Options of a request: the job's, variables on top, the context last."""
        out = {"format": self.format, "promptKey": self.prompt_key, "dryRun": self.dry_run, "verbose": self.verbose, **self.variables}
        return out | ({"context": self.context} if self.context is not None else {})


def problem(stage: str, code: Column, message: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), code.alias("code"), message.alias("message"))


def _add(error: Column, condition: Column, made: Column) -> Column:
    """The first error of a document stays."""
    return F.coalesce(error, F.when(condition, made).cast(ERROR_TYPE))


def limit_of(settings: dict) -> int:
    """The net limit of a model as a number: the expression over the table of models, evaluated."""
    return SparkSession.builder.getOrCreate().range(1).select(limits.of_settings(settings)).first()[0]


def _checked(df: DataFrame, job: Job, column: str) -> DataFrame:
    """df with _checked, the container's result, and _signature. JSON is scanned once for both, unless an own validator is set."""
    if not job.validate or job.format not in ("json", "html"):
        return df.withColumn("_signature", F.lit(None).cast("string"))
    text = F.col(column)
    if job.format == "json":
        df = df.withColumn("_scan", validation.json_scan(text))
        own = validation.VALIDATORS.get("json") is not validation.json_result
        result = validation.container_result(text, "json") if own else validation.scan_result(text, F.col("_scan"))
        return df.withColumns({"_checked": result, "_signature": F.col("_scan.signature")}).drop("_scan")
    return df.withColumns({"_checked": validation.container_result(text, job.format), "_signature": F.lit(None).cast("string")})


def _protected(docs: DataFrame, job: Job) -> DataFrame:
    """docs (doc_id, text, …) with prepared, spans, signature and error."""
    settings, filters = job.settings(), spans.resolve(job.filters)
    df = docs.withColumn("error", F.lit(None).cast(ERROR_TYPE))
    df = _checked(df, job, "text")
    if job.validate and job.format in ("json", "html"):
        df = df.withColumn("error", _add(F.col("error"), ~F.col("_checked.valid"), problem("validate", F.lit(f"invalid_{job.format}"), F.array_join("_checked.errors", "; "))))
    df = df.withColumn("signature", F.col("_signature")).drop("_checked", "_signature")
    df = spans.protect(df, "text", filters)
    limit = limits.of_settings(settings)
    too_long = F.concat(F.lit("the text is too long by "), limits.excess(F.col("prepared"), limit).cast("string"), F.lit(" characters"))
    df = df.withColumn("error", _add(F.col("error"), ~limits.fits(F.col("prepared"), limit), problem("length", F.lit("too_long"), too_long)))
    return df.withColumn("error", _add(F.col("error"), F.col("text").isNull(), problem("input", F.lit("no_text"), F.lit("there is no text"))))


def _with_request(df: DataFrame, job: Job) -> DataFrame:
    """df (prepared, error, …) with request, null where there is an error."""
    return df.withColumn("request", F.when(F.col("error").isNull(), requests.build(job.settings(), F.col("prepared"), job.options(), job.prompts)))


def prepare(docs: DataFrame, job: Job) -> DataFrame:
    """docs (doc_id, text, …) with prepared, spans, signature, error and request (null where there is an error)."""
    return _with_request(_protected(docs, job), job)


def _read(df: DataFrame, settings: dict) -> DataFrame:
    """df (response, failure, error, …) with http_status, raw_response, _text and consumed; what went wrong with the call or its answer is added to error."""
    df = df.withColumns({"http_status": F.col("response.status"), "raw_response": F.col("response.body")})
    df = df.withColumn("error", _add(F.col("error"), F.col("failure").isNotNull(), problem("call", F.lit("network"), F.col("failure"))))
    refused = responses.http_error(F.col("http_status"), F.col("raw_response"), settings)
    df = df.withColumn("error", _add(F.col("error"), refused.isNotNull(), problem("call", refused["code"], refused["message"])))
    df = df.withColumn("_parsed", F.when(F.col("error").isNull(), responses.parse(F.col("raw_response"), settings)))
    df = df.withColumn("error", _add(F.col("error"), F.col("_parsed.error").isNotNull(), problem("parse", F.col("_parsed.error.code"), F.col("_parsed.error.message"))))
    return df.withColumns({"_text": F.col("_parsed.text"), "consumed": usage.consumed(F.col("_parsed.usage"), settings.get("usage") or {})})


def _read_once(df: DataFrame, job: Job, transport: tp.Transport, store: str, callers: int | None, in_flight: int, work: str | None) -> DataFrame:
    """As _read() over what _protected() made, with the request. Documents of one prepared text have one request: it is built, looked up and asked once, and its answer is read once. df and the answers are computed once, into tables in work."""
    spark = df.sparkSession
    work = work or scratch.temporary(spark, "requests")
    df.write.parquet(f"{work}/documents")
    docs = spark.read.schema(df.schema).parquet(f"{work}/documents")
    texts = docs.where("error is null").select("prepared").distinct().withColumn("error", F.lit(None).cast(ERROR_TYPE))
    answers = _read(tp.call_once(_with_request(texts, job), transport, store, callers, in_flight=in_flight, work=work), job.settings())
    answers = answers.select(F.col("prepared").alias("_asked"), F.col("error").alias("_error"), "response", "http_status", "raw_response", "_text", "consumed")
    answers.write.parquet(f"{work}/answers")
    answers = spark.read.schema(answers.schema).parquet(f"{work}/answers")
    out = _with_request(docs, job).join(answers, F.when(F.col("error").isNull(), F.col("prepared")) == F.col("_asked"), "left")
    lost = F.when(F.col("error").isNull() & F.col("_asked").isNull(), problem("call", F.lit("network"), F.lit("no answer"))).cast(ERROR_TYPE)
    return out.withColumns({"error": F.coalesce("error", "_error", lost), "consumed": F.coalesce("consumed", F.create_map().cast(usage.USAGE_TYPE))})


def translate(docs: DataFrame, job: Job, transport: tp.Transport, store: str | None = None, callers: int | None = None, carry: Sequence[str] = (), in_flight: int = 1, work: str | None = None) -> DataFrame:
    """docs (doc_id, text) to: doc_id, original, prepared, result, http_status, debug_request, debug_response, raw_response, consumed, lengths, filter_stats, error, and the columns of docs to carry. Each row is answered by itself: ids may repeat or be null. store, callers, in_flight and work: as in transport.call_once()."""
    settings, n = job.settings(), len(spans.resolve(job.filters))
    df = _protected(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("_carried")), job)
    if job.dry_run:
        df = _with_request(df, job)
        df = df.withColumns({"http_status": F.lit(0), "raw_response": F.lit("[dry-run]"), "_text": F.when(F.col("error").isNull(), F.col("prepared")), "response": F.lit(None).cast(tp.RESPONSE_TYPE)})
        df = df.withColumn("consumed", usage.consumed(F.lit(None).cast("variant"), settings.get("usage") or {}))
    elif store:
        df = _read_once(df, job, transport, store, callers, in_flight, work)
    else:
        df = _read(tp.call(_with_request(df, job), transport, callers, in_flight=in_flight), settings)
    df = df.withColumn("result", spans.restore(F.col("_text"), F.col("spans"), n))
    df = _checked(df, job, "result")
    if job.validate and job.format in ("json", "html"):
        df = df.withColumn("error", _add(F.col("error"), F.coalesce(~F.col("_checked.valid"), F.lit(False)), problem("revalidate", F.lit(f"invalid_{job.format}"), F.array_join("_checked.errors", "; "))))
    if job.validate and job.format == "json":
        same = validation.same_structure(F.col("signature"), F.col("_signature"))
        df = df.withColumn("_same", same).withColumn("error", _add(F.col("error"), F.col("result").isNotNull() & ~F.col("_same.valid"), problem("revalidate", F.lit("structure"), F.array_join("_same.errors", "; "))))
    debug = requests.preview(F.col("request"), [], sent=not job.dry_run) if job.verbose or job.dry_run else F.lit("")
    answer = F.coalesce(responses.preview(F.col("response"), []), F.lit("")) if job.verbose else F.lit("")
    if job.verbose and job.validate and job.format in ("json", "html"):
        # what the checks before and after had to say
        debug = F.concat(F.when(F.col("error.stage") == "validate", F.lit("")).otherwise(F.lit(f"{job.format} checked before\n")), F.coalesce(debug, F.lit("")))
        answer = F.concat(answer, F.when(F.col("error").isNull(), F.lit(f"{job.format} checked after\n")).otherwise(F.lit("")))
    lengths = F.struct(*[F.length(c).cast("bigint").alias(name) for c, name in (("text", "original"), ("prepared", "prepared"), ("result", "translated"))])
    if job.strict:
        df = df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("error.stage"), F.col("error.code"), F.col("error.message"))).cast(ERROR_TYPE)))
    return df.select("doc_id", F.col("text").alias("original"), "prepared", F.when(F.col("error").isNull(), F.col("result")).alias("result"), "http_status", debug.alias("debug_request"), answer.alias("debug_response"), "raw_response", "consumed", lengths.alias("lengths"), spans.stats(F.col("spans")).alias("filter_stats"), "error", *[F.col(f"_carried.`{c}`").alias(c) for c in carry])
