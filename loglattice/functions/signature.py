"""Event signatures, their canonical form and topic, and the names derived from them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from loglattice.functions.keccak import keccak256

_ELEMENTARY = re.compile(r"^(address|bool|string|bytes(?:[1-9]|[12]\d|3[0-2])?|u?int(?:\d+)?)$")


@dataclass(frozen=True)
class Kind:
    """A type: elementary, an array (``element``, and ``length`` if it is fixed), or a tuple (``fields``)."""

    base: str
    element: Kind | None = None
    length: int | None = None
    fields: tuple[tuple[str, Kind], ...] = ()

    @property
    def text(self) -> str:
        """The canonical form."""
        if self.element:
            return f"{self.element.text}[{'' if self.length is None else self.length}]"
        return f"({','.join(k.text for _, k in self.fields)})" if self.base == "tuple" else self.base

    @property
    def dynamic(self) -> bool:
        """Whether the value stands behind an offset."""
        if self.element:
            return self.length is None or self.element.dynamic
        return any(k.dynamic for _, k in self.fields) if self.base == "tuple" else self.base in ("string", "bytes")

    @property
    def words(self) -> int:
        """Words of the head."""
        if self.dynamic:
            return 1
        if self.element:
            return self.length * self.element.words
        return sum(k.words for _, k in self.fields) if self.base == "tuple" else 1

    @property
    def nested(self) -> bool:
        """A tuple, or an array of anything but elementary values of one word."""
        return self.base == "tuple" or self.element is not None and (self.element.element is not None or self.element.dynamic or self.element.nested)


@dataclass(frozen=True)
class Argument:
    name: str
    kind: Kind
    indexed: bool = False

    @property
    def type(self) -> str:
        return self.kind.text

    @property
    def is_array(self) -> bool:
        return self.kind.element is not None

    @property
    def dynamic(self) -> bool:
        return self.kind.dynamic

    @property
    def head_words(self) -> int:
        return self.kind.words

    @property
    def hashed(self) -> bool:
        """Whether, if indexed, its topic is a hash of the value."""
        return self.dynamic or self.is_array or self.kind.base == "tuple"


@dataclass(frozen=True)
class Event:
    name: str
    arguments: tuple[Argument, ...]
    topic: str = field(default="")

    @property
    def canonical(self) -> str:
        return f"{self.name}({','.join(a.type for a in self.arguments)})"

    @property
    def indexed(self) -> tuple[Argument, ...]:
        return tuple(a for a in self.arguments if a.indexed)

    @property
    def data(self) -> tuple[Argument, ...]:
        return tuple(a for a in self.arguments if not a.indexed)

    @property
    def head_words(self) -> int:
        return sum(a.head_words for a in self.data)


def full_type(kind: str) -> str:
    """``uint`` and ``int`` are 256 bits wide."""
    return re.sub(r"^(u?int)(?=\[|$)", r"\g<1>256", kind)


def split_list(text: str) -> list[str]:
    """The parts between commas that stand outside of parentheses; blanks alone are no part."""
    parts, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[start:k])
            start = k + 1
    return [*parts, text[start:]] if text.strip() else []


def parse_argument(text: str, unnamed: str) -> Argument:
    """``type [indexed] [name]``; a tuple is ``(type name, ...)``, with or without ``tuple`` before it."""
    bare = text.strip()
    if opened := re.match(r"(?:tuple\s*)?\(", bare):
        depth, at = 1, opened.end()
        while at < len(bare) and depth:
            depth += (bare[at] == "(") - (bare[at] == ")")
            at += 1
        if depth:
            raise ValueError(f"{text!r} is not closed")
        inner = [parse_argument(part, f"c{k}") for k, part in enumerate(split_list(bare[opened.end() : at - 1]))]
        if not inner:
            raise ValueError(f"{text!r} has no members")
        kind, rest = Kind("tuple", fields=tuple((a.name, a.kind) for a in inner)), bare[at:]
    else:
        first = re.match(r"[A-Za-z0-9]*", bare).group(0)
        if not _ELEMENTARY.match(first):
            raise ValueError(f"{text!r} has no known type")
        kind, rest = Kind(full_type(first)), bare[len(first) :]
    while array := re.match(r"\[(\d*)\]", rest):
        kind, rest = Kind("", kind, int(array.group(1)) if array.group(1) else None), rest[array.end() :]
    if rest and not rest[0].isspace():
        raise ValueError(f"{text!r} has no known type")
    words = rest.split()
    names = [w for w in words if w != "indexed"]
    if len(names) > 1:
        raise ValueError(f"{text!r} has two names")
    return Argument(names[0] if names else unnamed, kind, "indexed" in words)


def parse_event(text: str) -> Event:
    """``[event] Name(type [indexed] [name], ...)``; unnamed arguments are p0, p1, ..., members of tuples c0, c1, ..."""
    found = re.match(r"^\s*(?:event\s+)?([A-Za-z_$][\w$]*)\s*\((.*)\)\s*(?:anonymous\s*)?;?\s*$", text, re.S)
    if not found:
        raise ValueError(f"not an event signature: {text!r}")
    event = Event(found.group(1), tuple(parse_argument(part, f"p{k}") for k, part in enumerate(split_list(found.group(2)))))
    return Event(event.name, event.arguments, "0x" + keccak256(event.canonical.encode()).hex())


def _abi_argument(entry: dict) -> str:
    kind = entry["type"]
    if kind.startswith("tuple"):
        kind = f"({', '.join(map(_abi_argument, entry['components']))}){kind.removeprefix('tuple')}"
    return " ".join(x for x in (kind, "indexed" if entry.get("indexed") else "", entry.get("name", "")) if x)


def events_of_abi(text: str) -> list[str]:
    """Signatures of the events of an ABI in JSON (a list, or an object with ``abi``)."""
    entries = json.loads(text)
    if isinstance(entries, dict):
        entries = entries["abi"]
    return [f"{e['name']}({', '.join(map(_abi_argument, e.get('inputs', [])))})" for e in entries if e.get("type") == "event"]


def snake_case(name: str) -> str:
    """Splits where a lower-case letter or digit meets a capital, and at whatever is no letter or digit."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^A-Za-z0-9]+", "_", split).strip("_").lower()


def plural(name: str) -> str:
    if re.search(r"[^aeiou]y$", name):
        return name[:-1] + "ies"
    return name + ("es" if re.search(r"(s|x|z|ch|sh)$", name) else "s")


def event_table(contract: str, event: str, taken: set[str]) -> str:
    """The table of a contract's event; a name that is taken gets a number."""
    base = snake_case(f"{contract}_{event}") + "_events"
    name, n = base, 2
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    taken.add(name)
    return name


def entity_tables(schema: str) -> tuple[str, str]:
    """The history table and the latest-per-key view of a state entity."""
    bare = re.sub(r"Table$", "", re.sub(r"Schema$", "", schema)) or schema
    base = plural(snake_case(bare))
    return f"{base}_log", f"{base}_live"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
