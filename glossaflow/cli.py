"""Command line: translate a file, a folder or standard input; list models and prompts.

python -m glossaflow.cli --model=VENDOR:MODEL --format=text --source=in.txt --translated=out.txt
"""

from __future__ import annotations

import argparse
import os
import sys

from .functions import spans
from .operators.models import Registry
from .operators.prompts import Prompts
from .sources import documents, transport


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossaflow", description="Translate text, HTML or JSON documents, with spans that must not change hidden from the service.")
    p.add_argument("--model", help="VENDOR:MODEL of the registry")
    p.add_argument("--format", help="text, html or json")
    p.add_argument("--source", help="file to read, or folder with a document in each file; else standard input")
    p.add_argument("--translated", help="file to write, of a folder the folder of the results as JSON lines; else standard output")
    p.add_argument("--filters", default="", help="names of filters, separated by commas: url, html_TAG")
    p.add_argument("--source-lang")
    p.add_argument("--target-lang")
    p.add_argument("--context", help="a word to the service about the text")
    p.add_argument("--prompt-key", default="translator")
    p.add_argument("--variables", default="", help="name=value,name=value for the service")
    p.add_argument("--proxy", help="else GLOSSAFLOW_PROXY")
    p.add_argument("--no-validate", action="store_true", help="don't check the container before and after")
    p.add_argument("--dry-run", action="store_true", help="only hide spans; writes SOURCE.prepared")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--list-models", action="store_true")
    p.add_argument("--list-prompts", action="store_true")
    return p


def parse_variables(listed: str) -> dict[str, str]:
    """name=value pairs; a pair without = is an error."""
    out = {}
    for pair in listed.split(",") if listed else []:
        name, eq, value = pair.partition("=")
        if not eq:
            raise ValueError(f"not name=value: {pair}")
        out[name.strip()] = value.strip()
    return out


def models_text(registry: Registry) -> str:
    lines = ["Models:", ""]
    for vendor, held in registry.by_vendor().items():
        lines += [f"  {vendor}:", *[f"    {key:<32}{(held[key].get('notes') or '')}".rstrip() for key in held], ""]
    return "\n".join(lines)


def prompts_text(prompts: Prompts) -> str:
    return "\n".join(["Prompts:", "", *[f"  {f'{key} ({", ".join(x["formats"])})':<40}{x['notes'] or ''}".rstrip() for key, x in prompts.list().items()]])


def stats_text(row) -> str:
    """What a run reports about one document."""
    lines = ["Characters:", *[f"  {k + ':':<12}{row['lengths'][k]}" for k in ("original", "prepared", "translated")], "Spans:"]
    lines += [f"  {s['filter']}: {s['count']}" for s in row["filter_stats"]] or ["  no filters"]
    lines.append("Usage:")
    for category, used in (row["consumed"] or {}).items():
        lines += [f"  {category.capitalize()}:", f"    {'Total:':<12} {used['total'] or 0}", *[f"    {k.capitalize() + ':':<12} {v}" for k, v in (used["breakdown"] or {}).items()]]
    return "\n".join(lines if row["consumed"] else [*lines, "  not given"])


def run(argv: list[str] | None = None, spark=None, sender: transport.Transport | None = None, stdin=None) -> int:
    """0, or 1 after an error, which goes to standard error."""
    args, registry, prompts = parser().parse_args(argv), Registry(), Prompts()
    if args.list_models or args.list_prompts:
        print(models_text(registry) if args.list_models else prompts_text(prompts))
        return 0
    try:
        return _translate(args, registry, prompts, spark, sender, stdin or sys.stdin)
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e.args[0] if isinstance(e, KeyError) else e}", file=sys.stderr)
        return 1


def _translate(args, registry: Registry, prompts: Prompts, spark, sender, stdin) -> int:
    from pyspark.sql import SparkSession

    from .plans.translate import Job, translate

    if not args.model:
        raise ValueError("name a model with --model; --list-models shows them")
    job = Job(args.model, args.format or "", spans.parse_names(args.filters), args.source_lang, args.target_lang, args.context, args.prompt_key, validate=not args.no_validate, verbose=args.verbose, registry=registry, prompts=prompts)
    settings = job.settings()
    cli_variables = parse_variables(args.variables)
    if args.source and os.path.isdir(args.source):
        return _translate_folder(args, job, settings, cli_variables, spark or SparkSession.builder.master("local[2]").getOrCreate(), sender)
    if args.source:
        with open(args.source, encoding="utf-8") as f:
            text = f.read()
    else:
        if stdin.isatty():
            raise ValueError("nothing on standard input: name a file, or pipe a text into it")
        text = stdin.read()
    if not text.strip(" \t\n\r\0\x0b"):
        raise ValueError("the text is empty")
    spark = spark or SparkSession.builder.master("local[2]").getOrCreate()
    docs = documents.from_text(spark, text, job.format)
    if args.dry_run:
        prepared = spans.protect(docs, "text", spans.resolve(job.filters)).first()["prepared"]
        if args.source:
            with open(args.source + ".prepared", "w", encoding="utf-8") as f:
                f.write(prepared)
        else:
            print(prepared, end="")
        return 0
    sender = _ready(args, job, settings, cli_variables, sender)
    row = translate(docs, job, sender).first()
    if args.verbose:
        print(row["debug_request"], row["debug_response"], sep="\n", file=sys.stderr)
    if row["error"]:
        raise ValueError(f"{row['error']['stage']}: {row['error']['code']}: {row['error']['message']}")
    if (row["http_status"] or 0) >= 400:
        raise ValueError(f"HTTP {row['http_status']}: {row['raw_response']}")
    if args.translated:
        with open(args.translated, "w", encoding="utf-8") as f:
            f.write(row["result"])
    else:
        print(row["result"], end="")
    print(stats_text(row), file=sys.stderr)
    return 0


def _ready(args, job, settings: dict, cli_variables: dict, sender):
    """The job's variables set, and the transport; raises where something is missing."""
    for name, env in job.registry.variables(args.model).items():
        if name not in cli_variables and env not in os.environ:
            raise ValueError(f"{env} is not set, which {args.model} needs")
        job.variables[name] = os.environ.get(env, "")
    job.variables |= cli_variables
    if sender is None:
        auth = transport.Auth.of(settings)
        if auth:
            auth.secret()
        sender = transport.Http(auth, transport.proxy_from(args.proxy))
    return sender


def _translate_folder(args, job, settings: dict, cli_variables: dict, spark, sender) -> int:
    """A document for each file; blank ones are left out. Errors are in the results, and the exit code says whether there are any."""
    from .plans.translate import translate

    job.dry_run = args.dry_run
    docs, _ = documents.split_blank(documents.from_files(spark, args.source, job.format))
    if docs.isEmpty():
        raise ValueError("no file in the folder has a text")
    if args.dry_run:
        job.variables |= cli_variables
        documents.write_prepared(translate(docs, job, transport.DryRun(), carry=["path"]), args.source.rstrip("/") + ".prepared")
        return 0
    if not args.translated:
        raise ValueError("name a folder for the results with --translated")
    sender = _ready(args, job, settings, cli_variables, sender)
    out = translate(docs, job, sender, carry=["path"]).select("doc_id", "path", "result", "error", "lengths", "filter_stats", "consumed", "http_status")
    documents.write(out, args.translated, "json")
    failed = spark.read.schema("error struct<stage: string, code: string, message: string>").json(args.translated).where("error is not null").count()
    if failed:
        raise ValueError(f"{failed} documents have an error, which is in the results")
    return 0


if __name__ == "__main__":
    sys.exit(run())
