"""python -m veilgraph anonymize | inspect | scrub | restore"""

from __future__ import annotations

import argparse
import json
import sys
import time


def report(values: dict) -> str:
    """Sections of names and counts as text; of long lists the first 50 rows, then how many are left."""
    lines = []
    for name, value in values.items():
        title = name.replace("_", " ")
        if isinstance(value, dict):
            wide = max((len(str(k)) for k in value), default=0)
            lines += [f"{title}:", *(f"  {k:<{wide}}  {v}" for k, v in value.items())] if value else [f"{title}: none"]
        elif isinstance(value, list):
            lines += [f"{title}: {len(value)}", *("  " + "  ".join(str(x) for x in (v.values() if isinstance(v, dict) else [v])) for v in value[:50])]
            lines += [f"  ... {len(value) - 50} more"] if len(value) > 50 else []
        else:
            lines.append(f"{title}: {value}")
    return "\n".join(lines)


def clock(seconds: float) -> str:
    """Minutes and seconds."""
    return f"{int(seconds) // 60}:{int(seconds) % 60:02}"


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the gate or inspection found something; 2: refused."""
    p = argparse.ArgumentParser("veilgraph")
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("anonymize")
    a.add_argument("--input", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--verbose-failures", action="store_true", help="print every finding")
    for flag in ("--map", "--reuse-map", "--salt"):
        a.add_argument(flag)
    i = verbs.add_parser("inspect")
    i.add_argument("--input", required=True)
    i.add_argument("--format", choices=("text", "json"), default="text")
    for v in (a, i):
        v.add_argument("--no-preserve-core", action="store_true")
        v.add_argument("--keep-undeclared-numbers", action="store_true")
        v.add_argument("--redact-os-strings", action="store_true")
        bar = v.add_mutually_exclusive_group()
        bar.add_argument("--progress", action="store_true", help="draw Spark's bars even where stderr is no terminal")
        bar.add_argument("--no-progress", action="store_true")
    s = verbs.add_parser("scrub")
    s.add_argument("--map", required=True)
    s.add_argument("--input")
    for v in (a, s):
        shown = v.add_mutually_exclusive_group()
        shown.add_argument("--summary", action="store_true")
        shown.add_argument("--no-summary", action="store_true")
    r = verbs.add_parser("restore")
    r.add_argument("--map", required=True)
    one = r.add_mutually_exclusive_group(required=True)
    for flag in ("--input", "--lookup", "--forward"):
        one.add_argument(flag)
    o = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from .operators import mapping
    from .plans import job
    from .plans.tables import Config
    from .sources import collection, publish

    bars = getattr(o, "progress", False) or sys.stderr.isatty() and not getattr(o, "no_progress", True)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", str(bars).lower()).getOrCreate()
    began = time.monotonic()
    try:
        if o.verb in ("anonymize", "inspect"):
            config = Config(preserve_core=not o.no_preserve_core, redact_undeclared_numbers=not o.keep_undeclared_numbers, preserve_os_strings=not o.redact_os_strings)
            got = job.anonymize(spark, o.input, o.out, o.map, o.reuse_map, o.salt, config) if o.verb == "anonymize" else job.inspect(spark, o.input, config)
            if bars:
                print(f"done in {clock(time.monotonic() - began)}", file=sys.stderr)
            as_json = o.no_summary if o.verb == "anonymize" else o.format == "json"
            print(json.dumps(got, separators=(",", ":")) if o.verb == "anonymize" and as_json else json.dumps(got, indent=2) if as_json else report(got))
            return int(bool(got.get("findings")))
        saved = publish.load_mapping(o.map)
        if o.verb == "restore" and (o.lookup or o.forward):
            name, ask = ("pseudonym", mapping.reverse) if o.lookup else ("real", mapping.forward)
            table = mapping.reversals(spark, saved) if o.lookup else mapping.from_map(spark, saved)
            for row in ask(table, spark.createDataFrame([(o.lookup or o.forward,)], f"{name} string")).collect():
                print(f"{row[1]}\t{row[2]}")
            return 0
        text = open(o.input, encoding="utf-8").read() if o.input else sys.stdin.read()
        frame = spark.createDataFrame([(text,)], "text string")
        done = (job.scrub if o.verb == "scrub" else job.restore)(spark, o.map, frame).first()
        print(done.text, end="")
        if o.verb == "scrub" and (o.summary or sys.stderr.isatty() and not o.no_summary):
            print(report({"replaced": dict(done.report.counts), "unresolved": done.report.unresolved}), file=sys.stderr)
        return 0
    except job.LeakError as e:
        print(e, file=sys.stderr)
        if e.findings is not None and o.verb == "anonymize" and o.verbose_failures:
            for row in e.findings.orderBy("gate", "member", "path", "code").toLocalIterator():
                print(f"{row.gate}: {row.member or '-'} {row.path or '-'} {row.code} {row.offender or '-'}", file=sys.stderr)
        return 1
    except (collection.CollectionError, publish.PublishError, mapping.MappingError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
