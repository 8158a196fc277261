"""A project at plan time: event specs, table schemas, DDL text, views and the manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions import abi, abi_nested, hexes, u256
from loglattice.functions.signature import Event, entity_tables, event_table, parse_event, quoted, text_literal
from loglattice.functions.types import ALWAYS, METADATA, ORDER, event_type, state_type
from loglattice.plans.config import Config, ConfigError, plain


@dataclass
class EventSpec:
    """One event of one contract of one chain, and the table it goes to."""

    chain_id: int
    contract: str
    label: str
    addresses: tuple[str, ...]
    event: Event
    omit: frozenset[str]
    table: str
    metadata: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [a.name for a in self.event.arguments if plain(a.name) not in self.omit]

    @property
    def schema(self) -> T.StructType:
        by_name = {a.name: a for a in self.event.arguments}
        kinds = [(n, METADATA[n]) for n in self.metadata]
        for name in self.columns:
            argument = by_name[name]
            kinds.append((name, T.BinaryType() if argument.indexed and argument.hashed else event_type(argument.kind)))
        return T.StructType([T.StructField(n, t, False) for n, t in kinds])

    @property
    def sort_key(self) -> list[str]:
        """The first two arguments, then block, transaction and log."""
        return [*self.columns[:2], *ORDER]

    @property
    def primary_key(self) -> list[str]:
        return self.columns[:2] or list(ORDER)

    def matches(self, topics: Column, address: Column) -> Column:
        """The event's topic, and one of its contracts where it names any."""
        ok = F.lower(F.get(topics, 0)) == self.event.topic
        if self.addresses:
            ok = ok & F.lower(address).isin(*[a.lower() for a in self.addresses])
        return ok


@dataclass
class StateField:
    name: str
    kind: str


@dataclass
class StateSpec:
    """A state entity: its key, its fields, and its history table and live view."""

    name: str
    fields: list[StateField]
    key: list[str]

    @property
    def tables(self) -> tuple[str, str]:
        return entity_tables(self.name)

    @property
    def schema(self) -> T.StructType:
        known = [(f.name, state_type(f.kind)) for f in self.fields]
        known += [(n, T.LongType()) for n in ORDER if n not in {x for x, _ in known}]
        return T.StructType([T.StructField(n, t) for n, t in known])


def state_spec(name: str, fields: list[tuple[str, str]], key: list[str] | None = None, comment_key: list[str] | None = None) -> StateSpec:
    """The key is the one the schema names, or the config's, or ``id``, or the first field that is no position."""
    known = [StateField(n, k) for n, k in fields]
    names = [f.name for f in known]
    chosen = comment_key or key or [n for n in names if n.lower() == "id"][:1] or [n for n in names if n not in ORDER][:1] or list(ORDER)
    if missing := [k for k in chosen if k not in [*names, *ORDER]]:
        raise ConfigError(f"{name}: key field {missing[0]} does not exist")
    return StateSpec(name, known, chosen)


@dataclass
class Project:
    config: Config
    events: list[EventSpec]
    states: list[StateSpec] = field(default_factory=list)

    @classmethod
    def plan(cls, config: Config, states: list[StateSpec] | None = None) -> Project:
        """Every event of every chain; equal table names are numbered."""
        taken: set[str] = set()
        specs = []
        metadata = tuple(n for n in METADATA if n in ALWAYS or config.includes(n))
        for chain in config.chains:
            for contract in chain.contracts:
                for given in contract.events:
                    event = parse_event(given.event)
                    label = given.name or event.name
                    omit = frozenset(map(plain, given.omit))
                    specs.append(EventSpec(chain.id, contract.name, label, tuple(contract.address), event, omit, event_table(contract.name, label, taken), metadata))
        return cls(config, specs, list(states or []))

    def source_filters(self, chain_id: int) -> list[dict]:
        """Filters for the source: of each address set, the topics it is asked for; equal ones once."""
        found: dict[tuple[str, ...], list[str]] = {}
        for spec in self.events:
            if spec.chain_id == chain_id:
                topics = found.setdefault(tuple(dedupe(spec.addresses)), [])
                if spec.event.topic not in topics:
                    topics.append(spec.event.topic)
        return [{"address": list(a), "topic0": t} if a else {"topic0": t} for a, t in found.items()]

    def route(self, address: str, topic: str) -> EventSpec | None:
        """The spec of an address and topic, else of the topic alone."""
        named = [s for s in self.events if s.event.topic == topic.lower()]
        own = [s for s in named if address.lower() in (a.lower() for a in s.addresses)]
        return (own or [s for s in named if not s.addresses] or [None])[0]

    def decode(self, logs: DataFrame, spec: EventSpec, diagnose: bool = False) -> DataFrame:
        """The typed rows of an event out of raw logs (see ``sources.blocks.logs_of``).

        Logs shorter than the event's head, or with fewer topics than indexed
        arguments, are left out; a value that is not valid is zero. The chain is
        always kept, as ``_chain_id``; ``diagnose`` adds ``_decode_ok``, whether
        every value was valid, which no table stores.
        """
        data = hexes.lenient_bytes(F.col("data"))
        values = abi.decoded(spec.event, F.col("topics"), F.col("_data"))
        meta = {
            "chain_id": F.col("chain_id"),
            "block_number": F.col("block_number"),
            "block_timestamp": F.col("block_timestamp"),
            "block_hash": F.col("block_hash"),
            "contract_address": hexes.right(hexes.lenient_bytes(F.col("address")), 20),
            "transaction_hash": hexes.right(hexes.lenient_bytes(F.col("transaction_hash")), 32),
            "transaction_index": F.col("transaction_index"),
            "log_index": F.col("log_index"),
        }
        chosen = logs.where((F.size("topics") > 0) & spec.matches(F.col("topics"), F.col("address")) & (F.col("chain_id") == spec.chain_id))
        chosen = chosen.withColumn("_data", data).where(abi.fits(spec.event, F.col("_data"), F.col("topics")))
        known = [abi.decodes(spec.event, F.col("topics"), F.col("_data")).alias("_decode_ok")] if diagnose else []
        return chosen.select(*[meta[n].alias(n) for n in spec.metadata], *[values[n].alias(n) for n in spec.columns], F.col("chain_id").alias("_chain_id"), *known)

    def params_json(self, logs: DataFrame, spec: EventSpec) -> DataFrame:
        """Logs with event_name, topic0 and params: JSON with sorted names, numbers quoted, bytes as 0x text."""
        def shown(argument, value: Column) -> Column:
            kind = argument.kind
            if argument.indexed and argument.hashed:
                return hexes.hex_text(value)
            if kind.nested:
                return abi_nested.shown(value, kind)
            base = (kind.element or kind).base
            if base in ("bool", "string"):
                return value
            if base.startswith(("uint", "int")):
                one, many = (u256.to_text, u256.texts) if base[0] == "u" else (u256.to_signed_text, u256.signed_texts)
                return many(value) if kind.element else one(value)
            return F.transform(value, hexes.hex_text) if kind.element else hexes.hex_text(value)

        chosen = logs.where((F.size("topics") > 0) & spec.matches(F.col("topics"), F.col("address")))
        chosen = chosen.withColumn("_data", hexes.lenient_bytes(F.col("data"))).where(abi.fits(spec.event, F.col("_data"), F.col("topics")))
        values = abi.decoded(spec.event, F.col("topics"), F.col("_data"))
        by_name = {a.name: a for a in spec.event.arguments}
        params = F.to_json(F.struct(*[shown(by_name[n], values[n]).alias(n) for n in sorted(values)])) if values else F.lit("{}")
        keep = ["chain_id", "block_number", "block_timestamp", "block_hash", "transaction_hash", "transaction_index", "log_index", "address"]
        return chosen.select(*keep, F.lit(spec.label).alias("event_name"), F.lower(F.get("topics", 0)).alias("topic0"), params.alias("params"))

    def typed_params(self, logs: DataFrame, spec: EventSpec) -> DataFrame:
        """The typed rows of an event out of logs with ``params``: what ``params_json`` shows, read back.

        An argument that the JSON lacks, or that is not of its type, is zero.
        """
        by_name = {a.name: a for a in spec.event.arguments}
        hashed = {n for n, a in by_name.items() if a.indexed and a.hashed}
        text = T.StructType([T.StructField(n, T.StringType() if n in hashed else abi_nested.shown_type(by_name[n].kind)) for n in spec.columns])

        def typed(name: str) -> Column:
            kind, given = by_name[name].kind, F.col("_given")[name]
            if name in hashed:
                return hexes.lenient_bytes(given)
            return F.coalesce(given if kind.base in ("bool", "string") and not kind.element and not kind.fields else abi_nested.read(given, kind), abi.zero(kind))

        chosen = logs.where(spec.matches(F.array("topic0"), F.col("address")) & (F.col("chain_id") == spec.chain_id)).withColumn("_given", F.from_json("params", text))
        meta = {"contract_address": hexes.right(hexes.lenient_bytes(F.col("address")), 20), "transaction_hash": hexes.right(hexes.lenient_bytes(F.col("transaction_hash")), 32)}
        return chosen.select(*[meta.get(n, F.col(n)).alias(n) for n in spec.metadata], *[typed(n).alias(n) for n in spec.columns])

    def view_sql(self, spec: EventSpec) -> str:
        """The event as a projection over ``logs``: arguments out of the JSON, missing ones empty."""
        by_name = {a.name: a for a in spec.event.arguments}
        columns = list(spec.metadata)
        for name in spec.columns:
            path = text_literal("$." + name)
            if by_name[name].type == "bool":
                columns.append(f"coalesce(get_json_object(params, {path}) = 'true', false) AS {quoted(name)}")
            else:
                columns.append(f"coalesce(get_json_object(params, {path}), '') AS {quoted(name)}")
        where = [f"chain_id = {spec.chain_id}", f"event_name = {text_literal(spec.label)}", f"lower(topic0) = '{spec.event.topic}'"]
        if spec.addresses:
            where.append(f"lower(address) IN ({', '.join(text_literal(a.lower()) for a in spec.addresses)})")
        named = {"contract_address": "address AS contract_address"}
        return f"SELECT {', '.join(named.get(c, c) for c in columns)} FROM logs WHERE {' AND '.join(where)}"

    def live_sql(self, state: StateSpec) -> str:
        """The latest row of each key of a state's history."""
        log, _ = state.tables
        names = [f.name for f in state.schema.fields]
        row = ", ".join(f"'{n}', {quoted(n)}" for n in names)
        order = ", ".join(ORDER)
        keys = ", ".join(map(quoted, state.key))
        return f"SELECT row.* FROM (SELECT max_by(named_struct({row}), struct({order})) AS row FROM {log} GROUP BY {keys})"

    def ddl(self) -> list[str]:
        """CREATE statements of all tables, then of the live views."""
        out = [create_table(n, s, o) for n, s, o in system_tables()]
        out += [create_table(spec.table, spec.schema, spec.sort_key) for spec in self.events]
        for state in self.states:
            log, live = state.tables
            out.append(create_table(log, state.schema, [*state.key, *ORDER]))
            out.append(f"CREATE OR REPLACE VIEW {live} AS {self.live_sql(state)}")
        return out

    def manifest(self) -> str:
        chains: dict[int, dict] = {}
        for spec in self.events:
            chain = chains.setdefault(spec.chain_id, {})
            chain.setdefault(spec.contract, {"addresses": list(spec.addresses), "events": []})["events"].append(
                {"event": spec.event.canonical, "name": spec.label, "table": spec.table, "topic0": spec.event.topic, "primary_key": spec.primary_key}
            )
        shown = [{"id": c, "contracts": [{"name": n, **v} for n, v in contracts.items()]} for c, contracts in chains.items()]
        return json.dumps({"name": self.config.name, "chains": shown}, indent=2)


def dedupe(values) -> list[str]:
    """The first spelling of each, whatever the case."""
    seen: dict[str, str] = {}
    for value in values:
        seen.setdefault(value.lower(), value)
    return list(seen.values())


def system_tables() -> list[tuple[str, T.StructType, list[str]]]:
    long, text, time = T.LongType(), T.StringType(), T.TimestampType()
    make = lambda **kinds: T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    return [
        ("blocks", make(chain_id=long, block_number=long, block_timestamp=time, block_hash=text), ["chain_id", "block_number"]),
        ("logs", make(chain_id=long, block_number=long, block_timestamp=time, block_hash=text, transaction_hash=text, transaction_index=long, log_index=long, address=text, event_name=text, topic0=text, params=text), ["chain_id", *ORDER]),
        ("sync_state", make(chain_id=long, last_block=long, last_hash=text, finalized_block=long, finalized_hash=text, rollback_chain=text, updated_at=time), ["chain_id", "updated_at"]),
    ]


def create_table(name: str, schema: T.StructType, order: list[str]) -> str:
    columns = ",\n".join(f"  {quoted(f.name)} {f.dataType.simpleString().upper()}" for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {name} (\n{columns}\n) USING parquet TBLPROPERTIES ('order' = {text_literal(', '.join(order))})"


def apply_ddl(spark, text: str, database: str | None = None) -> list[str]:
    """Runs the statements of a DDL text, in a database of its own if one is named; returns them."""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}")
        spark.catalog.setCurrentDatabase(database)
    statements = split_statements(text)
    for statement in statements:
        spark.sql(statement)
    return statements


def split_statements(text: str) -> list[str]:
    """Statements of a DDL text: comments dropped, semicolons within quotes kept."""
    out, now, quote, k = [], [], "", 0
    while k < len(text):
        c = text[k]
        if quote:
            now.append(c)
            if c == "\\" and quote != "`" and k + 1 < len(text):
                k += 1
                now.append(text[k])
            elif c == quote:
                quote = ""
        elif text.startswith("--", k):
            k = (text.find("\n", k) + 1 or len(text) + 1) - 2
        elif text.startswith("/*", k):
            k = (text.find("*/", k) + 1 or len(text)) if "*/" in text[k:] else len(text)
        elif c == ";":
            out.append("".join(now).strip())
            now = []
        else:
            quote = c if c in "'\"`" else ""
            now.append(c)
        k += 1
    out.append("".join(now).strip())
    return [s for s in out if s]
