"""ABI decoding as built-in expressions over 32-byte words.

A log's data is BINARY; a word is a substring of it. Decoding never fails a row:
a value whose offset, length or content is not valid becomes the zero of its
type, and ``decodes`` tells whether all were valid. A log whose data is shorter
than the event's head, or that has fewer topics than indexed arguments, is left
out (``fits``). Elementary values and arrays of them are built-in expressions;
tuples and arrays of dynamic values or of arrays are an Arrow function.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions import abi_nested, hexes
from loglattice.functions.signature import Argument, Event, Kind
from loglattice.functions.types import event_type

WORD_BYTES = 32


def word_at(data: Column, position: Column) -> Column:
    """The word that begins at a byte, null where the data ends before."""
    piece = F.substr(data, position.cast("int") + 1, F.lit(WORD_BYTES))
    return F.when((position >= 0) & (position + WORD_BYTES <= F.length(data)), piece)


def piece_at(data: Column, position: Column, n: Column) -> Column:
    """At most n bytes from a byte on; null where a place or a length is beyond what is read."""
    return F.substr(data, (position + 1).try_cast("int"), n.try_cast("int"))


def _digits(word: Column, pattern: str) -> Column:
    """The last eight hex digits as a long, if the word is 32 bytes and they are all but zeros before and fit.

    The word is named once: expressions within expressions would be evaluated
    again for every mention.
    """
    return F.conv(F.regexp_extract(F.hex(word), f"^0{{56}}({pattern})$", 1), 16, 10).cast("long")


def small_number(word: Column) -> Column:
    """A word as a long, null if it does not fit into 31 bits."""
    return _digits(word, "[0-7].{7}")


def offset_at(data: Column, head: int) -> Column:
    """The place a head word points to, a multiple of 32; what lies beyond the data has no length there."""
    return _digits(piece_at(data, F.lit(head * WORD_BYTES).cast("long"), F.lit(WORD_BYTES)), "[0-7].{5}[02468ACE]0")


def length_at(data: Column, place: Column) -> Column:
    """The length that stands at a place; null if the data ends before."""
    return small_number(piece_at(data, place, F.lit(WORD_BYTES)))


def bytes_at(data: Column, place: Column) -> Column:
    """Length-prefixed bytes; null if the data ends before."""
    n = length_at(data, place)
    raw = piece_at(data, place + WORD_BYTES, n)
    return F.when(F.length(raw) == n, raw)


def scalar(kind: str, word: Column) -> Column:
    """A word as a value of an elementary type; null if it is not one."""
    if kind == "address":
        return F.substring(word, 13, 20)
    if kind == "bool":
        return F.when(word == F.unhex(F.lit("00" * 31 + "01")), F.lit(True)).when(word == F.unhex(F.lit("00" * 32)), F.lit(False))
    if fixed := re.match(r"^bytes(\d+)$", kind):
        return F.substring(word, 1, int(fixed.group(1)))
    return word


def zero(kind: Kind) -> Column:
    """No elements, empty text, zero bytes, or a tuple of such."""
    if kind.element:
        return F.array().cast(event_type(kind))
    if kind.fields:
        return F.struct(*[zero(own).alias(name) for name, own in kind.fields])
    if kind.base == "bool":
        return F.lit(False)
    if kind.base == "string":
        return F.lit("")
    if kind.base == "bytes":
        return F.unhex(F.lit(""))
    n = 20 if kind.base == "address" else int(m.group(1)) if (m := re.match(r"^bytes(\d+)$", kind.base)) else 32
    return F.unhex(F.lit("00" * n))


def words_at(data: Column, place: Column, n: Column, kind: str) -> Column:
    """n values one behind the other; null if the data ends before or one is not valid."""
    size = n * WORD_BYTES
    region = piece_at(data, place, size)
    words = F.regexp_extract_all(F.hex(F.when(F.length(region) == size, region)), F.lit(".{64}"), F.lit(0))
    values = F.transform(words, lambda word: scalar(kind, F.unhex(word)))
    return F.when(~F.exists(values, lambda v: v.isNull()), values) if kind == "bool" else values


def data_argument(data: Column, argument: Argument, head: int) -> Column:
    """The value of a data argument whose head begins at a word; null if it is not valid."""
    kind = argument.kind
    if kind.nested:
        return abi_nested.nested_at(data, kind, head)
    if kind.element:
        if kind.dynamic:
            place = offset_at(data, head)
            return words_at(data, place + WORD_BYTES, length_at(data, place), kind.element.base)
        return words_at(data, F.lit(head * WORD_BYTES).cast("long"), F.lit(argument.head_words).cast("long"), kind.element.base)
    if kind.dynamic:
        raw = bytes_at(data, offset_at(data, head))
        return raw.cast("string") if kind.base == "string" else raw
    return scalar(kind.base, word_at(data, F.lit(head * WORD_BYTES)))


def topic_argument(topic: Column, argument: Argument) -> Column:
    """The value of an indexed argument; of a dynamic type, its hash."""
    if argument.hashed:
        return hexes.word(topic)
    if argument.type == "address":
        return hexes.topic_address(topic)
    if argument.type == "bool":
        return hexes.topic_bool(topic)
    if fixed := re.match(r"^bytes(\d+)$", argument.type):
        return hexes.topic_fixed(topic, int(fixed.group(1)))
    return hexes.word(topic)


def fits(event: Event, data: Column, topics: Column | None = None) -> Column:
    """Whether the data has the event's head, and there is a topic for each indexed argument."""
    long_enough = F.length(data) >= event.head_words * WORD_BYTES
    return long_enough if topics is None else long_enough & (F.size(topics) > len(event.indexed))


def values_of(event: Event, topics: Column, data: Column) -> dict[str, Column]:
    """A column for each argument in the order of the signature; not valid ones are null."""
    out, head, nth = {}, 0, 1
    for argument in event.arguments:
        if argument.indexed:
            out[argument.name] = topic_argument(F.coalesce(F.get(topics, nth), F.lit("")), argument)
            nth += 1
        else:
            out[argument.name] = data_argument(data, argument, head)
            head += argument.head_words
    return out


def decoded(event: Event, topics: Column, data: Column) -> dict[str, Column]:
    """The same; not valid ones are zero."""
    kinds = {a.name: a for a in event.arguments}
    return {name: value if kinds[name].indexed else F.coalesce(value, zero(kinds[name].kind)) for name, value in values_of(event, topics, data).items()}


def decodes(event: Event, topics: Column, data: Column) -> Column:
    """Whether there are topics for all indexed arguments and every data value is valid."""
    values, ok = values_of(event, topics, data), F.size(topics) >= 1 + len(event.indexed)
    for argument in event.data:
        ok = ok & values[argument.name].isNotNull()
    return ok


def array_text(values: Column, kind: str) -> Column:
    """An array as ``[a b c]``: numbers in decimal, flags as words, bytes as 0x text."""
    from loglattice.functions import u256

    element = re.sub(r"\[\d*\]$", "", kind)
    if element.startswith("uint"):
        shown = u256.texts(values)
    elif element.startswith("int"):
        shown = u256.signed_texts(values)
    elif element == "bool":
        shown = F.transform(values, lambda v: v.cast("string"))
    elif element == "string":
        shown = values
    else:
        shown = F.transform(values, hexes.hex_text)
    return F.concat(F.lit("["), F.array_join(shown, " "), F.lit("]"))
