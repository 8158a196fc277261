"""Command line: plan a project, index pages into tables, look at them, begin a new project.

    python -m loglattice codegen <project> --out <folder>
    python -m loglattice start <project> --pages <path> --root <folder> [--stream]
    python -m loglattice start <project> --url <service> --from 0 [--to 9999] --root <folder> [--follow]
    python -m loglattice start <project> --portal <base> --dataset 1=ethereum-mainnet --follow
    python -m loglattice dev <project> ...      like start, with tables under <project>/.dev that begin anew
    python -m loglattice stop <project> --root <folder>
    python -m loglattice compact <project> --root <folder> --interval 7200 --head 20000000
    python -m loglattice ddl <project> --database <name>
    python -m loglattice sql <project> --root <folder> "SELECT ..."
    python -m loglattice init template <folder>
    python -m loglattice init contract-import local <abi.json> <folder> --name Token --address 0x...

A path alone is ``start``. An option that is not given is taken from the
environment, if that has LOGLATTICE_<OPTION>, for example LOGLATTICE_ROOT.
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys

from loglattice.functions.signature import event_table, events_of_abi, parse_event
from loglattice.plans import config as configs
from loglattice.plans.project import Project, StateSpec, apply_ddl

COMMANDS = ("codegen", "start", "dev", "stop", "compact", "ddl", "sql", "init", "help")
ENVIRONMENT = "LOGLATTICE_"
PROCESSOR = '''"""States, their folds, and callbacks of the project."""

from loglattice.functions import u256
from loglattice.operators.fold import state_fold
from loglattice.plans.project import state_spec

HOLDING = state_spec("HoldingSchema", [("account", "address"), ("amount", "uint256"), ("updated_at_block", "int64")], key=["account"])


def receive(state, event):
    """The state after one event; the position is stamped by the engine."""
    held = u256.unpack(state["amount"]) if state else 0
    return {"amount": u256.pack(held + u256.unpack(event["value"]))}


def noted(block, events):
    """A callback without state: after each batch, with its decoded events by table."""


STATES = [HOLDING]
PROCESSORS = {"HoldingSchema": state_fold(HOLDING, "{table}", {"account": "to"}, receive)}
CALLBACKS = [noted]
'''
TEMPLATE = """name: {name}
chains:
  - id: 1
    start_block: 0
    contracts:
      - name: {contract}
{address}        events:
{events}
"""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loglattice", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command")

    def add(name: str, **kinds) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        one.add_argument("project")
        common = {
            "root": {"default": "tables"}, "processor": {"help": "a Python file with STATES, PROCESSORS and CALLBACKS"}, "chain": {"help": "its number or name"},
            "start_block": {"type": int}, "end_block": {"type": int, "help": "0: no end"},
        }
        for option, kind in (common | kinds).items():
            given = os.environ.get(ENVIRONMENT + option.upper())
            if given is not None and kind.get("action") == "store_true":
                kind = kind | {"default": given.lower() in ("1", "true", "yes")}
            elif given is not None and "action" not in kind:
                kind = {k: v for k, v in kind.items() if k != "required"} | {"default": given}
            one.add_argument("--" + option.replace("_", "-"), **kind)
        return one

    add("codegen", out={"default": "."})
    flag = {"action": "store_true"}
    source = {
        "pages": {}, "url": {}, "portal": {"help": "base of a service with a dataset a chain"}, "dataset": {"action": "append", "help": "chain=dataset"}, "from": {"type": int, "default": 0}, "to": {"type": int},
        "stream": flag, "follow": flag, "poll": {"type": float, "default": 5.0}, "no_resume": flag, "restart": flag, "reindex_from": {"type": int},
    }
    add("start", **source)
    add("dev", **source)
    add("stop")
    add("ddl", database={})
    add("compact", interval={"type": int, "required": True}, head={"type": int, "required": True}, lower={"type": int, "default": 0})
    add("sql").add_argument("query")
    begin = commands.add_parser("init")
    begin.add_argument("what", choices=["template", "contract-import"])
    begin.add_argument("rest", nargs="+")
    begin.add_argument("--name", default="Token")
    begin.add_argument("--address")
    commands.add_parser("help")
    return top


def arguments(argv: list[str]) -> argparse.Namespace:
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["start", *argv]
    return parser().parse_args(argv)


def processors(path: str | None) -> tuple[list[StateSpec], dict, list]:
    """States, their processors and callbacks without state from a user's file."""
    if path is None:
        return [], {}, []
    spec = importlib.util.spec_from_file_location("loglattice_user_processor", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return list(getattr(module, "STATES", [])), dict(getattr(module, "PROCESSORS", {})), list(getattr(module, "CALLBACKS", []))


def planned(args: argparse.Namespace) -> tuple[Project, dict, list]:
    states, folds, callbacks = processors(args.processor)
    config = configs.override(configs.load(args.project), args.start_block, args.end_block, args.chain)
    if config.state and not states:
        raise configs.ConfigError("the project has state but no processor")
    return Project.plan(config, states), folds, callbacks


def codegen(args: argparse.Namespace) -> None:
    """Writes schema.sql, views.sql and manifest.json."""
    project, *_ = planned(args)
    os.makedirs(args.out, exist_ok=True)
    views = [f"CREATE OR REPLACE TEMPORARY VIEW {s.table}_view AS {project.view_sql(s)}" for s in project.events]
    for name, text in (("schema.sql", ";\n\n".join(project.ddl()) + ";\n"), ("views.sql", ";\n\n".join(views) + ";\n"), ("manifest.json", project.manifest() + "\n")):
        with open(os.path.join(args.out, name), "w", encoding="utf-8") as out:
            out.write(text)


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("loglattice").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()


def indexers(args: argparse.Namespace) -> list:
    from loglattice.streaming.indexer import Indexer

    project, folds, callbacks = planned(args)
    spark = session()
    return [Indexer(spark, project, chain.id, f"{args.root}/{chain.id}", folds, callbacks) for chain in project.config.chains]


def service(args: argparse.Namespace, chain_id: int) -> str | None:
    """The address of a chain's blocks: as given, or a dataset of the portal."""
    from loglattice.sources import http

    if args.url or not args.portal:
        return args.url
    datasets = {int(configs.CHAIN_ALIASES.get(k.lower(), k)): v for k, v in (d.split("=", 1) for d in args.dataset or [])}
    return http.endpoint(args.portal, datasets, chain_id, args.follow)


def start(args: argparse.Namespace) -> None:
    """Indexes each chain: goes on behind the checkpoint, unless asked to begin anew.

    Chains that are followed run side by side, each in a thread of its own.
    """
    from concurrent.futures import ThreadPoolExecutor

    if not (args.pages or args.url or args.portal):
        raise SystemExit("start needs --pages, --url or --portal")
    ready = indexers(args)
    if args.follow:
        with ThreadPoolExecutor(max(1, len(ready))) as pool:
            list(pool.map(lambda one: run(args, one), ready))
    else:
        for one in ready:
            run(args, one)


def run(args: argparse.Namespace, one) -> None:
    """One chain of ``start``."""
    from loglattice.sources import blocks, http

    if args.restart or args.no_resume:
        one.restart()
    elif args.reindex_from is not None:
        one.recover()
        one.reindex(args.reindex_from)
    last = one.recover()
    chain = next(c for c in one.project.config.chains if c.id == one.chain_id)
    first = max(chain.start_block, args.__dict__["from"], last.number + 1 if last else 0)
    ends = [e for e in (args.to, chain.end_block) if e is not None]
    url = service(args, one.chain_id)
    if url and args.follow:
        one.follow(url, first, min(ends, default=None), args.poll)
    elif url:
        if not ends:
            raise SystemExit("a range of a service needs --to, or --follow")
        one.spark.dataSource.register(http.BlockRanges)
        source = one.spark.read.format("block_ranges").option("url", url).option("from", first).option("to", min(ends))
        one.process(source.option("filters", json.dumps(one.project.source_filters(one.chain_id))).load())
    elif args.stream:
        one.stream(blocks.stream_pages(one.spark, args.pages).where(f"header.number >= {first}")).awaitTermination()
    else:
        one.process(blocks.read_pages(one.spark, args.pages).where(f"header.number >= {first}"))
    one.gauges.flush()


def dev(args: argparse.Namespace) -> None:
    """``start`` with tables of its own, which begin anew."""
    folder = args.project if os.path.isdir(args.project) else os.path.dirname(os.path.abspath(args.project))
    args.root, args.restart = os.path.join(folder, ".dev"), True
    start(args)


def stop(args: argparse.Namespace) -> None:
    """Asks what follows these tables to end after its micro-batch."""
    for one in indexers(args):
        one.request_stop()


def ddl(args: argparse.Namespace) -> None:
    """Creates the project's tables and views in the session's catalogue."""
    project, *_ = planned(args)
    apply_ddl(session(), ";\n".join(project.ddl()), args.database)


def compact(args: argparse.Namespace) -> None:
    for one in indexers(args):
        one.compact(args.interval, args.head, args.lower)


def sql(args: argparse.Namespace) -> None:
    for one in indexers(args):
        one.register_views()
        one.spark.sql(args.query).show(100, truncate=False)


def init(args: argparse.Namespace) -> None:
    """Writes a config.yaml, of a template or of the events of an ABI file, and the stub of a processor."""
    if args.what == "template":
        folder, events = args.rest[0], ["Transfer(address indexed from, address indexed to, uint256 value)"]
    else:
        source, abi, folder = args.rest
        if source != "local":
            raise SystemExit("contracts are imported from local files only")
        with open(abi, encoding="utf-8") as text:
            events = events_of_abi(text.read())
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "config.yaml")
    if os.path.exists(path):
        raise SystemExit(f"{path} is there already")
    with open(os.path.join(folder, "processor.py"), "w", encoding="utf-8") as out:
        out.write(PROCESSOR.replace("{table}", event_table(args.name, parse_event(events[0]).name, set()) if events else ""))
    address = f'        address: "{args.address}"\n' if args.address else ""
    with open(path, "w", encoding="utf-8") as out:
        out.write(TEMPLATE.format(name=os.path.basename(os.path.abspath(folder)), contract=args.name, address=address, events="\n".join(f"          - event: {e}" for e in events)))


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    command = {"codegen": codegen, "start": start, "dev": dev, "stop": stop, "compact": compact, "ddl": ddl, "sql": sql, "init": init}.get(args.command)
    if command is None:
        parser().print_help()
        return 0
    try:
        command(args)
    except (configs.ConfigError, OSError) as error:
        print(f"loglattice: {error}", file=sys.stderr)
        return 1
    return 0
