"""The command line: one JSON object on stdout, and an exit status by its error.

``python -m frameledger.cli --store PATH COMMAND ...``. Pictures never go to stdout; what a command prints has a bound in bytes.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid
from dataclasses import replace

from frameledger.errors import LedgerError
from frameledger.functions import tokens
from frameledger.functions.columns import PackLimits
from frameledger.functions.png import Limits

#: Version of the envelope, and bytes of it at most for single rows and for lists; fixed values.
ENVELOPE, ROW_BYTES, LIST_BYTES = 2, 8 << 10, 16 << 10
LISTS = ("list", "judgment list", "judgment search", "pack", "prune", "verify")
#: Bytes of an exported path as JSON at most; fixed value.
MOST_PATH = 3000
FIELDS = ("kind", "producer", "model", "schema_version", "value", "probability", "confidence", "metadata")


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise LedgerError("E_INVALID_ARGUMENT", message)


def arguments(argv: list[str]) -> argparse.Namespace:
    top = Parser(prog="frameledger")
    top.add_argument("--store", default=os.environ.get("FRAMELEDGER_ROOT", ".frameledger"))
    base = Limits()
    for name, value in (("source-bytes", base.source_bytes), ("edge", base.max_edge), ("pixels", base.pixels), ("inflated-bytes", base.inflated_bytes), ("memory-bytes", base.memory_bytes)):
        top.add_argument(f"--max-{name}", type=int, default=value)
    commands = top.add_subparsers(dest="command", required=True, parser_class=Parser)

    def add(name: str, *options: tuple, under=commands) -> None:
        one = under.add_parser(name)
        for option, *rest in options:
            one.add_argument(option, **(rest[0] if rest else {}))

    whole, flag, page = {"type": int}, {"action": "store_true"}, (("--limit", {"type": int, "default": 20}), ("--cursor",))
    add("init")
    add("put", ("--file", {"required": True}), ("--run",), ("--stream",), ("--label",), ("--note",), ("--tag", {"action": "append", "default": []}), ("--captured-at",), ("--keep-source", flag), ("--operation-id",), ("--compression-level", {"type": int, "default": 6, "choices": range(10)}))
    add("info", ("reference",))
    add("features", ("reference",))
    add("list", ("--run",), *page)
    add("get", ("reference",), ("--output",), ("--variant", {"choices": ("stored", "source"), "default": "stored"}))
    add("get-frame", ("--run", {"required": True}), ("--stream", {"default": "default"}), ("--frame", whole | {"required": True}), ("--output",), ("--variant", {"choices": ("stored", "source"), "default": "stored"}))
    add("verify", ("--report",))
    own = PackLimits()
    add("pack", ("--run", {"required": True}), ("--stream",), ("--segment-frames", whole | {"default": 32}), ("--dry-run", flag), ("--max-segment-bytes", whole | {"default": own.segment_bytes}), ("--max-segment-packets", whole | {"default": own.segment_packets}), ("--max-reconstruction-bytes", whole | {"default": own.descriptor_bytes}), ("--max-pack-images", whole | {"default": 10_000}), ("--max-encode-seconds", {"type": float, "default": own.encode_seconds}))
    add("prune", ("--dry-run", flag), ("--apply", flag), ("--max-prune-objects", whole | {"default": 10_000}))
    add("migrate", ("--to", whole | {"required": True}), ("--resume", flag), ("--restore", flag))
    judgment = commands.add_parser("judgment").add_subparsers(dest="what", required=True, parser_class=Parser)
    add("add", ("reference",), *((f"--{f.replace('_', '-')}",) for f in FIELDS), ("--json",), ("--stdin", flag), under=judgment)
    add("list", ("reference",), ("--kind",), ("--producer",), *page, under=judgment)
    add("search", ("--kind",), ("--producer",), ("--value",), ("--confidence-below", {"type": float}), *page, under=judgment)
    return top.parse_args(argv)


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark or SparkSession.builder.appName("frameledger").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def judgment_text(a: argparse.Namespace) -> str:
    """The JSON of a judgment, from a file, stdin, or options; only one of them."""
    inline = {f: getattr(a, f) for f in FIELDS if getattr(a, f) is not None}
    if (a.json is not None) + a.stdin + bool(inline) != 1:
        raise LedgerError("E_INVALID_ARGUMENT", "give options, --json or --stdin")
    if a.json is not None:
        with open(a.json, encoding="utf-8") as f:
            return f.read((64 << 10) + 1)
    if a.stdin:
        return sys.stdin.read((64 << 10) + 1)
    parts = [f"{json.dumps(f)}:{v if f in ('value', 'metadata', 'schema_version', 'probability', 'confidence') else json.dumps(v)}" for f, v in inline.items()]
    return "{" + ",".join(parts) + "}"


def export(store, image_id: str, content: bytes, output: str | None) -> dict:
    from frameledger.functions.png import sha
    from frameledger.sources import files

    if not output:
        os.makedirs(f"{store.root}/exports", exist_ok=True)
    path = os.path.abspath(output or f"{store.root}/exports/{image_id}-{uuid.uuid4()}.png")
    if len(json.dumps(path).encode()) > MOST_PATH:
        raise LedgerError("E_LIMIT_EXCEEDED", "path")
    files.export(content, path)
    return {"image_id": image_id, "path": path, "byte_length": len(content), "sha256": sha(content), "displayed": False}


def run(a: argparse.Namespace) -> tuple[dict, LedgerError | None]:
    """What a command gives, and the error that leaves a report behind, if any."""
    from frameledger.sources import files, migration
    from frameledger.sources.ledger import Ledger, pack_report

    spark, root = session(), os.path.abspath(a.store)
    limits = Limits(a.max_source_bytes, a.max_edge, a.max_pixels, a.max_inflated_bytes, a.max_memory_bytes)
    if a.command == "init":
        there = os.path.exists(f"{root}/ledger.json")
        return {"store_id": Ledger.init(spark, root).id, "format": 3, "already_initialized": there}, None
    if a.command == "migrate":
        return migration.migrate(spark, root, a.to, a.resume, a.restore), None
    store = Ledger.open(spark, root)
    known = lambda: tokens.parse_reference(a.reference, store.id)
    if a.command == "put":
        content = files.snapshot(a.file, limits.source_bytes)
        schema = "key string, content binary, run string, stream string, label string, note string, tags array<string>, captured_at string, operation_id string"
        if a.operation_id is not None and not 1 <= len(a.operation_id.encode()) <= 128:
            raise LedgerError("E_INVALID_ARGUMENT", "operation id")
        row = spark.createDataFrame([("0", content, a.run, a.stream, a.label, a.note, a.tag, a.captured_at, a.operation_id)], schema)
        got = store.put(row, a.compression_level, a.keep_source, limits).first()
        if got["error"]:
            raise LedgerError(got["error"], "put")
        return info(store, got["image_id"]) | {"reused": got["outcome"] == "reuse"}, None
    if a.command == "info":
        return info(store, known()), None
    if a.command == "features":
        return store.features(known()), None
    if a.command == "list":
        items, cursor = store.list(a.run, a.limit, a.cursor)
        return {"items": items, "next_cursor": cursor}, None
    if a.command == "get":
        return export(store, known(), store.get(known(), a.variant, limits), a.output), None
    if a.command == "get-frame":
        image_id, content = store.get_frame(a.run, a.frame, a.stream, limits)
        return export(store, image_id, content if a.variant == "stored" else store.get(image_id, a.variant), a.output) | {"run": a.run, "stream": a.stream, "frame_no": a.frame}, None
    if a.command == "verify":
        report = store.verify_report()
        if a.report:
            files.report(store.verify().unionAll(spark.createDataFrame([("summary", json.dumps(report | {"issues": []}))], "code string, key string")), a.report)
        return report, None if report["valid"] else LedgerError("E_INTEGRITY", "the ledger is not sound")
    if a.command == "pack":
        own = replace(PackLimits(), max_images=a.max_pack_images, segment_bytes=a.max_segment_bytes, segment_packets=a.max_segment_packets, descriptor_bytes=a.max_reconstruction_bytes, encode_seconds=a.max_encode_seconds, image=limits)
        rows = store.pack(a.run, a.stream, a.segment_frames, a.dry_run, own)
        failed = rows.where("status = 'failed'").first()
        return pack_report(rows, a.dry_run), LedgerError(failed["reason"], "a group failed") if failed else None
    if a.command == "prune":
        if a.dry_run == a.apply or a.max_prune_objects < 1:
            raise LedgerError("E_INVALID_ARGUMENT", "choose exactly one of --dry-run and --apply, and a positive limit")
        before = store.version
        rows = store.prune(a.apply, a.max_prune_objects)
        return {"dry_run": a.dry_run} | store.prune_report(rows, before), LedgerError("E_INTEGRITY", "replacements are not sound") if rows.where("status = 'failed'").limit(1).count() else None
    if a.what == "add":
        got = store.judge(spark.createDataFrame([("0", known(), judgment_text(a))], "key string, image_id string, json string")).first()
        if got["error"]:
            raise LedgerError(got["error"], "judgment")
        return {"judgment_id": got["judgment_id"], "image_id": known()}, None
    found = {"kind": a.kind, "producer": a.producer}
    found |= {"image_id": known()} if a.what == "list" else {"value": a.value, "confidence_below": a.confidence_below}
    items, cursor = store.search(a.limit, a.cursor, **{k: v for k, v in found.items() if v is not None})
    return {"items": items, "next_cursor": cursor}, None


def info(store, image_id: str) -> dict:
    from pyspark.sql import functions as F

    image = store.table("images").where(F.col("image_id") == image_id)
    own = image.first()
    if not own:
        raise LedgerError("E_NOT_FOUND", image_id)
    return own.asDict(True) | store.info_page(image).first().asDict(True)


def envelope(argv: list[str]) -> tuple[str, int]:
    """The line that a command prints, and its exit status."""
    data, error, most = None, None, ROW_BYTES
    try:
        a = arguments(argv)
        name = f"{a.command} {a.what}" if a.command == "judgment" else a.command
        most = LIST_BYTES if name in LISTS else ROW_BYTES
        data, error = run(a)
    except LedgerError as refused:
        error = refused
    except PermissionError as refused:
        error = LedgerError("E_PERMISSION", str(refused))
    except FileNotFoundError as refused:
        error = LedgerError("E_NOT_FOUND", str(refused))
    except OSError as refused:
        error = LedgerError("E_DISK_FULL" if refused.errno == 28 else "E_IO", str(refused))
    body = {"schema_version": ENVELOPE, "ok": error is None}
    body |= {"data": data} if data is not None else {}
    body |= {"error": {"code": error.code, "message": str(error)[:500], "retryable": error.retryable}} if error else {}
    text = json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    while data and "results" in data and data["results"] and len(text.encode()) + 1 > most:  # examples give way first
        data["results"].pop()
        text = json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    if len(text.encode()) + 1 > most:
        error = LedgerError("E_LIMIT_EXCEEDED", "response")
        text = json.dumps({"schema_version": ENVELOPE, "ok": False, "error": {"code": error.code, "message": str(error), "retryable": False}}, separators=(",", ":"))
    return text, error.exit if error else 0


def main() -> None:
    text, status = envelope(sys.argv[1:])
    print(text)
    sys.exit(status)


if __name__ == "__main__":
    main()
