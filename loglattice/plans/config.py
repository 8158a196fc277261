"""Project files: chains, contracts, events and state, read strictly from YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

import yaml

STATE_MODES = ("", "db_prefetch", "hotstate")
#: Names of chains on the command line.
CHAIN_ALIASES = {"ethereum": 1, "eth": 1, "mainnet": 1, "polygon": 137, "matic": 137}


class ConfigError(ValueError):
    """A project file that cannot be used, and where."""


@dataclass
class EventConfig:
    event: str = ""
    name: str | None = None
    omit: list[str] = field(default_factory=list)


@dataclass
class ContractConfig:
    name: str = ""
    address: list[str] = field(default_factory=list)
    events: list[EventConfig] = field(default_factory=list)


@dataclass
class SharedContract:
    """Read and kept, but not used: events are given by chain."""

    name: str = ""
    abi_file_path: str | None = None
    events: list[EventConfig] = field(default_factory=list)


@dataclass
class ChainConfig:
    id: int = 0
    start_block: int = 0
    end_block: int | None = None
    contracts: list[ContractConfig] = field(default_factory=list)


@dataclass
class StateConfig:
    name: str = ""
    source_table: str = ""
    key: list[str] = field(default_factory=list)
    mode: str = ""


@dataclass
class Config:
    name: str = ""
    description: str | None = None
    ecosystem: str | None = None
    fork: str = "default"
    contracts: list[SharedContract] = field(default_factory=list)
    chains: list[ChainConfig] = field(default_factory=list)
    rollback_on_reorg: bool | None = None
    raw_events: bool | None = None
    store_blocks: bool = False
    store_raw_logs: bool = False
    proto_mode: bool | None = None
    cold_cache: bool | None = None
    include_metadata: list[str] = field(default_factory=list)
    exclude_metadata: list[dict[str, str]] = field(default_factory=list)
    state: list[StateConfig] = field(default_factory=list)

    def includes(self, name: str) -> bool:
        """Whether optional metadata is asked for; case and underscores do not count."""
        return plain(name) in map(plain, self.include_metadata)


_NESTED = {
    (Config, "contracts"): SharedContract,
    (Config, "chains"): ChainConfig,
    (Config, "state"): StateConfig,
    (ChainConfig, "contracts"): ContractConfig,
    (ContractConfig, "events"): EventConfig,
    (SharedContract, "events"): EventConfig,
}


def plain(name: str) -> str:
    return name.replace("_", "").lower()


def _build(kind: type, raw: Any, where: str) -> Any:
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a mapping")
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(map(str, raw)) - known.keys()):
        raise ConfigError(f"{where}: unknown field {unknown[0]}")
    values = {}
    for key, value in raw.items():
        if value is None:
            continue
        path = f"{where}.{key}" if where else key
        if (kind, key) in _NESTED:
            if not isinstance(value, list):
                raise ConfigError(f"{path} must be a list")
            values[key] = [_build(_NESTED[kind, key], item, f"{path}[{i}]") for i, item in enumerate(value)]
        elif kind is ContractConfig and key == "address":
            values[key] = _addresses(value, path)
        else:
            values[key] = value
    return kind(**values)


def _addresses(value: Any, where: str) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return value
    raise ConfigError(f"{where} must be text or a list of texts")


class _Loader(yaml.SafeLoader):
    """Leaves 0x numbers as text: addresses are not numbers."""


_Loader.yaml_implicit_resolvers = {k: [(tag, p) for tag, p in v if tag != "tag:yaml.org,2002:int"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:int", __import__("re").compile(r"^[-+]?[0-9][0-9_]*$"), list("-+0123456789"))


def parse(text: str) -> Config:
    """The config of a YAML text, exclusions applied; unknown fields are errors."""
    config = _build(Config, yaml.load(text, _Loader) or {}, "")  # noqa: S506  (a SafeLoader)
    exclude(config)
    return config


def exclude(config: Config) -> None:
    """Adds the arguments that ``exclude_metadata`` names to what their events omit."""
    from loglattice.functions.signature import parse_event

    left_out: dict[str, list[str]] = {}
    for entry in config.exclude_metadata:
        for event, argument in entry.items():
            left_out.setdefault(event.lower(), []).append(argument)
    if not left_out:
        return
    for chain in config.chains:
        for contract in chain.contracts:
            for event in contract.events:
                for argument in left_out.get(parse_event(event.event).name.lower(), ()):
                    if argument.lower() not in (x.lower() for x in event.omit):
                        event.omit.append(argument)


def validate(config: Config) -> Config:
    """Raises ConfigError for the first thing that is wrong."""

    def need(ok: Any, message: str) -> None:
        if not ok:
            raise ConfigError(message)

    need(str(config.name).strip(), "name is required")
    need(str(config.fork or "default").strip().isalpha(), "fork must be the name of a mode")
    need(config.chains, "at least one chain is required")
    for i, chain in enumerate(config.chains):
        need(chain.id, f"chains[{i}].id is required")
        need(chain.end_block is None or chain.end_block >= chain.start_block, f"chains[{i}].end_block must be >= start_block")
        for j, contract in enumerate(chain.contracts):
            where = f"chains[{i}].contracts[{j}]"
            need(contract.name.strip(), f"{where}.name is required")
            need(contract.events, f"{where}.events is required")
            for k, event in enumerate(contract.events):
                need(event.event.strip(), f"{where}.events[{k}].event is required")
    for i, state in enumerate(config.state):
        need(state.name.strip(), f"state[{i}].name is required")
        need(state.mode.strip().lower() in STATE_MODES, f"state[{i}].mode must be db_prefetch or hotstate")
    return config


def load(path: str) -> Config:
    """The validated config of a file, or of config.yaml or config.yml in a folder."""
    if not str(path).strip():
        raise ConfigError("a project path is required")
    if os.path.isdir(path):
        found = [p for name in ("config.yaml", "config.yml") if os.path.exists(p := os.path.join(path, name))]
        if not found:
            raise ConfigError(f"there is no config.yaml or config.yml in {path}")
        path = found[0]
    with open(path, encoding="utf-8") as lines:
        return validate(parse(lines.read()))


def override(config: Config, start_block: int | None = None, end_block: int | None = None, chain: str | int | None = None) -> Config:
    """Command-line values over the file's; an end block of 0 means no end."""
    if chain is not None:
        number = CHAIN_ALIASES.get(str(chain).lower()) or int(chain)
        config.chains = [c for c in config.chains if c.id == number]
        if not config.chains:
            raise ConfigError(f"the project has no chain {chain}")
    for c in config.chains:
        if start_block is not None:
            c.start_block = start_block
        if end_block is not None:
            c.end_block = end_block or None
    return validate(config)


def as_dict(value: Any) -> Any:
    """Plain data of a config, for manifests."""
    if is_dataclass(value):
        return {f.name: as_dict(getattr(value, f.name)) for f in fields(value)}
    return [as_dict(x) for x in value] if isinstance(value, list) else value
