"""Command line: dump, mutate, audit, retrieval-audit, capabilities, preflight.

Exit codes: 0 done, 1 the severity gate was reached, 2 an input or usage error.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .functions.judges import ModelJudge
from .model import CAPABILITIES, DEFECT_CLASSES, PUBLIC_CHECKERS, SCOPE_DIMENSIONS, SEVERITIES
from .operators import checks as ck
from .operators import mutations as mu
from .plans import report, sinks
from .session import attach
from .sources import files, live, normalize


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mnemora", description="Normalise and audit stores of agent memory")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for flags, more in options:
            p.add_argument(*flags.split(), **more)
        return p

    path, need = {"type": Path}, {"type": Path, "required": True}
    adapters = {"choices": tuple(CAPABILITIES), "required": True}
    command(
        "dump", "export a store in normalised form", ("--adapter", adapters), ("--source", path), ("--output", path), ("--include-raw", {"action": "store_true"}), ("--user-id", {}), ("--agent-id", {}), ("--session-id", {}),
        ("--page-size", {"type": int, "default": 100}), ("--group-id", {"action": "append", "dest": "group_ids"}), ("--graphiti-group-scope", {"choices": SCOPE_DIMENSIONS}), ("--include-embeddings", {"action": "store_true"}),
        ("--client-factory", {"help": "module:function that makes a live service's client"}),
    )
    command(
        "mutate", "inject one labelled defect", ("--store", need), ("--transcripts", path), ("--defect", {"choices": DEFECT_CLASSES, "required": True}), ("--subtype", {}), ("--seed", {"type": int, "default": 0}), ("--target-id", {}),
        ("--replace-from", {}), ("--replace-to", {}), ("--conflict-relation", {"choices": ("exclusive_value",)}), ("--destination-user-id", {}), ("--destination-agent-id", {}), ("--query", {}), ("--distractor-family", {"choices": ("editor",)}),
        ("--distractor-count", {"type": int, "default": 3}), ("--base-store-status", {"choices": ("unknown", "curated_clean"), "default": "unknown"}), ("--output", need), ("--manifest", need),
    )
    gate = [("--fail-on", {"choices": SEVERITIES}), ("--sarif-output", path), ("--output", path)]
    model = [("--semantic-model-id", {}), ("--semantic-model-revision", {})]
    store = [("--store", need), ("--transcripts", path), ("--scope-policy", path)]
    command("audit", "run one check or all", *store, ("--checker", {"choices": (*PUBLIC_CHECKERS, "all"), "required": True}), *model, *gate)
    command("retrieval-audit", "check recorded retrievals", ("--observation", need), ("--policy", {"choices": tuple(ck.POLICIES.values()), "required": True}), *gate)
    command("capabilities", "what a source can tell", ("--adapter", adapters), ("--output", path))
    command("preflight", "what the checks can assess", *store, *model, ("--output", path))
    return top


def session() -> SparkSession:
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("mnemora").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return attach(spark)


def _semantic(args: argparse.Namespace) -> tuple[str, str] | None:
    given = args.semantic_model_id, args.semantic_model_revision
    if given == (None, None):
        return None
    if not all(x is not None and x.strip() for x in given):
        raise report.InputError("a semantic model needs both a non-blank --semantic-model-id and --semantic-model-revision")
    return given


def _inputs(args: argparse.Namespace) -> list[Path | None]:
    return [getattr(args, x, None) for x in ("store", "transcripts", "scope_policy", "observation", "source")]


def _check_outputs(args: argparse.Namespace) -> None:
    """Before any input is read: no output replaces an input or another output."""
    outputs = [getattr(args, x, None) for x in ("output", "sarif_output", "manifest")]
    seen = {p.resolve() for p in _inputs(args) if p is not None}
    for p in outputs:
        if p is not None:
            if p.resolve() in seen:
                raise report.InputError(f"an output must not overwrite an input or another output: {p}")
            seen.add(p.resolve())


def _emit(text: str, output: Path | None) -> None:
    if output is None:
        sys.stdout.write(text)
    else:
        output.write_text(text, encoding="utf-8")


def _records(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.graphiti_group_scope is not None and args.adapter != "graphiti":
        raise report.InputError("--graphiti-group-scope is for graphiti only")
    source = str(args.source) if args.source else None
    if args.adapter == "file":
        if source is None:
            raise report.InputError("--source is needed for files")
        return normalize.file_records(files.read_records(spark, source))
    scope = {k: v for k, v in (("user_id", args.user_id), ("agent_id", args.agent_id), ("session_id", args.session_id)) if v is not None}
    filters = {("run_id" if k == "session_id" else k): v for k, v in scope.items()}
    if source is not None:
        rows = files.read_export(spark, source, args.adapter)
    else:
        rows = _live(spark, args, filters)
    if args.adapter == "mem0":
        return normalize.mem0_records(rows, filters)
    if args.adapter == "graphiti":
        return normalize.graphiti_records(rows, scope, args.graphiti_group_scope)
    return normalize.letta_records(rows, scope)


def _live(spark: SparkSession, args: argparse.Namespace, filters: dict[str, str]) -> DataFrame:
    if args.adapter == "mem0":
        live.check_mem0(filters, args.page_size)
    if args.client_factory is None:
        raise report.InputError("a live scan needs --client-factory, or --source for an export")
    module, _, name = args.client_factory.partition(":")

    def connect():
        import importlib

        return getattr(importlib.import_module(module), name)()

    if args.adapter == "mem0":
        return live.live_records(spark, "mem0", connect, [{"filters": filters, "page_size": args.page_size}], live.mem0_pages)
    if args.adapter == "graphiti":
        scans = [{"group_ids": [g], "page_size": args.page_size, "embeddings": args.include_embeddings} for g in args.group_ids or []]
        if not scans:
            raise report.InputError("a live scan needs a --group-id")
        return live.live_records(spark, "graphiti", connect, scans, live.graph_pages)
    if not args.agent_id:
        raise report.InputError("a live scan needs --agent-id")
    return live.live_records(spark, "letta", connect, [{"agent_id": args.agent_id}], live.letta_pages)


def _load(spark: SparkSession, args: argparse.Namespace) -> tuple[report.Inputs, str]:
    semantic = _semantic(args)
    memories, adapter = files.load_store(spark, str(args.store))
    transcripts = files.load_transcripts(spark, str(args.transcripts)) if args.transcripts else None
    rules = files.load_policy(spark, str(args.scope_policy)) if args.scope_policy else None
    judge = ModelJudge(semantic[0], f"hf-nli:{semantic[0]}", semantic[1], revision=semantic[1]) if semantic else None  # loads nothing here
    return report.Inputs(memories, transcripts, rules, judge), adapter


def _finish(args: argparse.Namespace, results: list[ck.CheckResult], text: str, skipped: list[dict] | None = None) -> int:
    if args.sarif_output is not None:
        _emit(report.render(report.sarif(results, skipped)), args.sarif_output)
    _emit(text, args.output)
    return int(report.gate(results, args.fail_on))


def run(args: argparse.Namespace) -> int:
    _check_outputs(args)
    if args.command == "capabilities":
        value = {"schema_version": "0.1", "adapter": args.adapter, **CAPABILITIES[args.adapter]}
        _emit(report.render(value), args.output)
        return 0
    spark = session()
    if args.command == "dump":
        memories = _records(spark, args)
        files.constraints.require_valid_memories(memories)
        _emit("".join(sinks.store_lines(memories, args.adapter, include_raw=args.include_raw)), args.output)
        return 0
    if args.command == "mutate":
        memories, adapter = files.load_store(spark, str(args.store))
        transcripts = files.load_transcripts(spark, str(args.transcripts)) if args.transcripts else None
        names = ("subtype", "seed", "replace_from", "replace_to", "conflict_relation", "destination_user_id", "destination_agent_id", "query", "distractor_family", "distractor_count", "base_store_status")
        request = mu.Request(args.defect, target_memory_id=args.target_id, **{k: getattr(args, k) for k in names})
        done = mu.mutate(memories, request, transcripts, adapter)
        sinks.write_store(done.memories, adapter, str(args.output), include_raw=True, exported_at=files.store_envelope(spark, str(args.store))["exported_at"])
        _emit(report.render(done.manifest), args.manifest)
        return 0
    if args.command == "retrieval-audit":
        result = ck.retrieval_shadowing(files.load_observations(spark, str(args.observation)), args.policy)
        return _finish(args, [result], report.render(report.result_dict(result)))
    inputs, adapter = _load(spark, args)
    if args.command == "preflight":
        given = {"has_transcripts": inputs.transcripts is not None, "rules": inputs.rules, "has_judge": inputs.judge is not None}
        _emit(report.render(report.preflight_report(inputs.memories, adapter=adapter, **given)), args.output)
        return 0
    if args.checker == "all":
        found = report.audit(inputs.memories, transcripts=inputs.transcripts, rules=inputs.rules, judge=inputs.judge)
        return _finish(args, found.results, report.render(report.audit_dict(found)), found.skipped)
    result = report.run_check(args.checker, inputs)
    return _finish(args, [result], report.render(report.result_dict(result)))


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (ValueError, OSError, PySparkException) as error:
        print(f"mnemora: error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
