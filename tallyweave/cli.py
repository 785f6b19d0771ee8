"""``python -m tallyweave.cli parse|match|mock|serve``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from .functions.money import format_cents
from .plans import service
from .plans.reconcile import Report, confirm_by_user
from .schemas import MatcherOptions
from .session import local_session
from .sources import synthetic
from .sources.invoices import load_invoices
from .sources.statements import ParseOptions, read_files


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallyweave")
    commands = parser.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="read a statement")
    parse.add_argument("file")
    match = commands.add_parser("match", help="match a statement to invoices")
    match.add_argument("-s", "--statement", required=True)
    match.add_argument("-i", "--invoices", required=True)
    match.add_argument("-d", "--date-tolerance", type=int, default=2)
    match.add_argument("--fee-tolerance", type=int, default=2500)
    match.add_argument("--fee-tolerance-percentage", type=float)
    match.add_argument("--yes", action="store_true")
    match.add_argument("--force", action="store_true")
    match.add_argument("--non-interactive", action="store_true")
    match.add_argument("-o", "--output")
    for p in (parse, match):
        p.add_argument("-f", "--format")
        p.add_argument("--map")
        p.add_argument("-c", "--currency")
        p.add_argument("--limit", type=int, default=25)
        p.add_argument("--json", action="store_true")
        p.add_argument("--pretty", action="store_true")
    mock = commands.add_parser("mock", help="make a synthetic statement")
    mock.add_argument("-f", "--format", default="revolut")
    mock.add_argument("-n", "--count", type=int, default=10)
    mock.add_argument("--noise", type=float, default=0.1)
    mock.add_argument("-c", "--currency", default="EUR")
    mock.add_argument("-o", "--output")
    serve = commands.add_parser("serve", help="answer over HTTP")
    serve.add_argument("-p", "--port", type=int, default=3000)
    serve.add_argument("--strict-port", action="store_true")
    return parser.parse_args(argv)


def _statement(spark, path: str, args: argparse.Namespace):
    content = read_files(spark, path).first()["content"]
    return service.parse_text(spark, content, ParseOptions(args.format, service.parse_mapping(args.map), args.currency))


def review(report: Report, ask=input, say=print) -> Report:
    """Ask for each match under review, in order, whether to accept it (y), it and the rest (a), or to stop (q)."""
    waiting = report.matches.where("status = 'REVIEW_NEEDED'").orderBy("match_no")
    shown = waiting.select(F.col("transaction.id").alias("tx_id"), "transaction.booking_date", format_cents(F.col("transaction.amount_cents"), F.col("transaction.currency")).alias("paid"), "transaction.reference", "invoice.invoice_number", "invoice.customer_name", F.array_join("discrepancies", "; ").alias("why"), "confidence")
    accepted, every = [], False
    for r in shown.toLocalIterator():
        if not every:
            say(f"{r.paid} on {r.booking_date}: {r.reference or ''}\n  {r.invoice_number} for {r.customer_name}\n  {r.why} ({r.confidence:.0%})")
            answer = ask("Accept this match? [y/N/a(all)/q(quit)]: ").strip().lower()
            if answer in ("q", "quit"):
                break
            every = answer in ("a", "all")
            if not every and answer not in ("y", "yes"):
                continue
        accepted.append((r.tx_id,))
    if not accepted:
        return report
    return replace(report, matches=confirm_by_user(report.matches, report.matches.sparkSession.createDataFrame(accepted, "tx_id string")))


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    spark = local_session()
    if args.command == "serve":
        from .server import serve

        return serve(spark, args.port, args.strict_port)
    if args.command == "mock":
        text = synthetic.statement(synthetic.generate(spark, args.count, args.noise, args.currency), args.format, args.currency)
        Path(args.output).write_text(text) if args.output else print(text)
        return 0
    if args.command == "parse":
        name, found = _statement(spark, args.file, args)
        if args.json:
            print(service.dumps(service.parsed_report(name, found, False), args.pretty))
            return 0
        shown = found.transactions.orderBy("position").select("booking_date", "direction", format_cents(F.col("amount_cents"), F.col("currency")).alias("amount"), "counterparty_name", F.substring("reference", 1, 50).alias("reference"))
        shown.show(args.limit, False)
        service.inflow_outflow(found.transactions).show()
        return 0
    _, found = _statement(spark, args.statement, args)
    # Zero days fall back to the default, as an unset value does.
    options = MatcherOptions(args.date_tolerance or 2, args.fee_tolerance, args.fee_tolerance_percentage)
    report = service.match_statement(found, load_invoices(spark, args.invoices), options)
    if args.yes:
        report = report.confirmed(args.force)
    elif not (args.json or args.non_interactive) and sys.stdin.isatty():
        report = review(report)
    if args.json or args.output:
        text = service.dumps(service.full_report(report, Path(args.statement).name), args.pretty)
        Path(args.output).write_text(text) if args.output else print(text)
    else:
        report.matches.orderBy("match_no").select("status", "level", "confidence", "transaction.id", "invoice.invoice_number", F.array_join("discrepancies", "; ").alias("notes")).show(args.limit, 60)
        report.totals_by_currency().orderBy("currency").show()
        report.summary().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
