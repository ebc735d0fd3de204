"""The command line: run, validate, show, list, compare, export, baseline, cache, calibrate, init.

Exit codes: 0 passed; 1 the gate failed, the run is incomplete or evaluated
nothing; 2 the configuration or the call is wrong.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix import export, secrets, settings, spec, tools
from promptmatrix.errors import MatrixError
from promptmatrix.operators import results, scoring
from promptmatrix.plans import run as runs
from promptmatrix.sources import files
from promptmatrix.sources.store import Store

STARTER = """models:
  - {id: echo, provider: mock}
variants:
  - name: plain
    prompt:
      - {role: user, content: "{{ question }}"}
cases:
  - {id: hello, vars: {question: hello}, expected: hello}
scorecard:
  - {criterion: contains-answer, scorer: {type: contains}}
"""


def session() -> SparkSession:
    return SparkSession.builder.appName("promptmatrix").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="promptmatrix")
    p.add_argument("--config", "-c", default="eval.yaml")
    p.add_argument("--output-dir")
    p.add_argument("--cache-dir")
    p.add_argument("--concurrency", type=int)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="evaluate")
    for s in (run, sub.add_parser("validate", help="render everything, call nothing")):
        s.add_argument("--variant", action="append")
        s.add_argument("--model", action="append")
        s.add_argument("--case", action="append")
        s.add_argument("--sample", type=int)
        s.add_argument("--sample-seed", type=int)
    run.add_argument("--label")
    run.add_argument("--resume")
    run.add_argument("--max-cost", type=float)
    run.add_argument("--fail-fast", action="store_true")
    run.add_argument("--no-cache", action="store_true")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--estimate", action="store_true")
    run.add_argument("--json", action="store_true")
    run.add_argument("--progress", action="store_true", help="a line on standard error after each wave")
    run.add_argument("--request-log", help="a folder for a trace of the calls")
    show = sub.add_parser("show", help="a run")
    show.add_argument("ref", nargs="?", default="latest")
    show.add_argument("--failures", action="store_true")
    show.add_argument("--case")
    show.add_argument("--page", type=int)
    show.add_argument("--full", action="store_true", help="longer texts")
    listing = sub.add_parser("list", help="the newest runs")
    listing.add_argument("--limit", type=int, default=20)
    compare = sub.add_parser("compare", help="two runs")
    compare.add_argument("a")
    compare.add_argument("b")
    compare.add_argument("--html")
    out = sub.add_parser("export", help="write a run")
    out.add_argument("ref", nargs="?", default="latest")
    out.add_argument("--format", choices=("json", "csv", "md", "html"), default="json")
    out.add_argument("--output", "-o")
    base = sub.add_parser("baseline", help="pin or show the baseline")
    base.add_argument("ref", nargs="?")
    cache = sub.add_parser("cache", help="what the response cache holds")
    cache.add_argument("--older-than-days", type=float, help="delete what is older")
    cal = sub.add_parser("calibrate", help="make a project that measures a judge against labels")
    cal.add_argument("ref")
    cal.add_argument("labels")
    cal.add_argument("folder")
    doctor = sub.add_parser("doctor", help="what would stop a run")
    doctor.add_argument("--probe", action="store_true", help="call every model once")
    sub.add_parser("init", help="write a first configuration")
    return p


#: Lines and characters of a text on the terminal: usually, and with --full.
SHORT, FULL = (20, 2_000), (200, 20_000)


def plain(text: str) -> str:
    """Text that can not move the cursor or change colours: control characters are spelled out."""
    return "".join(c if c in "\n\t" or c.isprintable() else c.encode("unicode_escape").decode() for c in text)


def clipped(text: str, most: tuple[int, int] = SHORT) -> str:
    """The first lines and characters of a text, and how much is left out."""
    lines = plain(text).splitlines()
    kept = "\n".join(lines[: most[0]])[: most[1]]
    left = len("\n".join(lines)) - len(kept)
    return kept + (f"\n… {left} more characters" if left > 0 else "")


def progress(tally: runs.Tally) -> None:
    print(f"{tally.cells} cells, {tally.passed} passed, {tally.errors} errors, {tally.cached} cached, ${tally.spent:.4f}", file=sys.stderr, flush=True)


def show_case(rows: DataFrame, case_id: str, most: tuple[int, int]) -> None:
    for r in results.drill_down(rows, case_id).collect():
        print(f"{plain(r.variant)} / {plain(r.model)}: {'pass' if r.passed else 'FAIL'} {r.cell_score:.3f}")
        print("  " + clipped(r.error or r.output or "", most).replace("\n", "\n  "))
        for s in r.scores or []:
            print(f"  - {plain(s.criterion)}: {'pass' if s.passed else 'fail'} {plain(s.error or s.detail or '')[:200]}".rstrip())


def show_table(df: DataFrame) -> None:
    rows = [df.columns, *([("" if v is None else plain(str(v)).replace("\n", " ")[:60]) for v in r] for r in df.collect())]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    for r in rows:
        print("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return execute(args)
    except MatrixError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def execute(args: argparse.Namespace) -> int:
    if args.command == "init":
        path = Path(args.config)
        if path.exists():
            raise spec.ConfigError(f"{path} exists")
        path.write_text(STARTER, encoding="utf-8")
        return 0
    if args.command == "doctor":
        checks = tools.diagnose(args.config)
        if args.probe and all(c["ok"] for c in checks):
            checks += tools.probe(args.config)
        for c in checks:
            print(f"{'ok  ' if c['ok'] else 'FAIL'} {c['check']} {c['detail']}".rstrip())
        return 0 if all(c["ok"] for c in checks) else 1
    config = settings.resolve(spec.load(args.config), {"output_dir": args.output_dir, "cache_dir": args.cache_dir, "concurrency": args.concurrency})
    spark = session()
    store = Store(config.place(config.settings.output_dir))
    if args.command in ("run", "validate"):
        how = runs.Selection(args.variant, args.model, args.case, args.sample, args.sample_seed)
        if args.command == "validate" or args.dry_run:
            rows = runs.dry_run(spark, config, how)
            bad = rows.where(F.col("error").isNotNull())
            show_table(bad.limit(20))
            print(f"{rows.count()} cells, {bad.count()} with errors")
            return 2 if bad.count() else 0
        if args.estimate:
            print(json.dumps(runs.estimate(spark, config, how)))
            return 0
        how.max_cost, how.fail_fast = args.max_cost, args.fail_fast
        done = runs.run(spark, config, how, args.label, args.resume, False if args.no_cache else None, secrets.values(config.base), args.request_log, secrets.keys(config), progress if args.progress else None)
        print(json.dumps(done.meta, default=str) if args.json else export.markdown(done.meta, done.results))
        good = done.meta["status"] == "complete" and done.meta["aggregates"]["overall"]["cases"] > 0 and done.passed is not False
        return 0 if good else 1
    if args.command == "list":
        for m in reversed(store.runs(max(1, args.limit))):
            print(f"{m['id']}  {m['status']:10}  {m.get('label') or ''}")
        return 0
    if args.command == "baseline":
        print(store.set_baseline(args.ref) if args.ref else store.baseline() or "none")
        return 0
    if args.command == "cache":
        responses = runs.Responses(config.place(config.settings.cache_dir))
        if args.older_than_days is not None:
            print(f"deleted {responses.prune(time.time() - args.older_than_days * 86400)} files")
        show_table(responses.stats(spark))
        return 0
    if args.command == "compare":
        a, b = (store.meta(store.resolve(r)) for r in (args.a, args.b))
        matrices = [spark.createDataFrame([(m["variant"], m["model"], m["score"], m["pass_rate"]) for m in x["aggregates"]["matrix"]], "variant string, model string, score double, pass_rate double") for x in (a, b)]
        compared, note = scoring.compare(*matrices), runs.selection_note(a, b)
        if note:
            print(f"note: {note}")
        show_table(compared)
        if args.html:
            Path(args.html).write_text(export.html_compare(a, b, compared, note), encoding="utf-8")
        return 0
    run_id = store.resolve(args.ref)
    meta, rows = store.meta(run_id), scoring.judged(store.results(spark, run_id))
    if args.command == "show":
        brief = ["cell_ord", "variant", "model", "case_id", "passed", "cell_score", "error"]
        if args.case:
            show_case(rows, args.case, FULL if args.full else SHORT)
        elif args.failures:
            show_table(results.failures(rows, 20).select(brief))
        elif args.page:
            show_table(results.page(rows, args.page).select(brief))
        else:
            print(export.markdown(meta, rows))
        return 0
    if args.command == "calibrate":
        results.one_system(rows)
        labels = results.latest_labels(files.labels(spark, Path(args.labels)))
        folder = Path(args.folder)
        folder.mkdir(parents=True, exist_ok=False)
        for name, text in export.calibration_project(results.calibration(rows, labels)):
            (folder / name).write_text(text, encoding="utf-8")
        return 0
    if args.format == "csv":
        export.write_csv(rows, args.output or f"{run_id}.csv")
        return 0
    pieces = export.as_json(meta, rows) if args.format == "json" else [export.markdown(meta, rows) if args.format == "md" else export.html_report(meta, rows)]
    with open(args.output, "w", encoding="utf-8") if args.output else sys.stdout as f:
        for piece in pieces:
            f.write(piece)
    return 0


if __name__ == "__main__":
    sys.exit(main())
