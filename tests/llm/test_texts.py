"""Tokenizing, packing, media, URL rules, licences and sharding against libraries and brute force."""

import hashlib
import itertools
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglattice.llm import bpe, kd_shard, license_scan, packing, queries, url_rules, webp
from tests.llm.conftest import TEXTS

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abzABZ éÉßÑñä.,;:!?'sdt1234<|>end-_\n\t  İıΣςŁÿ日本\u0301 \u0085\0\x1c😀"


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def samples(n=3000, most=60):
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, " ", "\n\n\n", "don't we'll"]


def test_bpe_equals_the_library():
    own, theirs = bpe.encoder(RANKS, public_tokenizers.PATTERN), tiktoken_encoding()
    texts = samples() + [t for _, t, _ in TEXTS]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(text or "") and own.decode(ids.tolist()) == (text or "").encode()


@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=12))
@settings(max_examples=200, deadline=None)
def test_replay_under_any_ranks(words, merges):
    """Ranks in any order, even such that a merge opens one of a lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {m.encode(): 256 + k for k, m in enumerate(merges)}

    def slow(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    pieces = [w.encode() for w in words]
    assert bpe.MergeReplay(ranks).encode(pieces) == [slow(p) for p in pieces]


def test_bpe_query(spark, odd_docs, no_docs):
    theirs = tiktoken_encoding()
    found = bpe.bpe_round_trip(odd_docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = Counter()
    for doc_id, text, _ in TEXTS:
        ids = theirs.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == want and all(len(r.ids) == r.n_tokens for r in found)
    assert bpe.bpe_round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_chunks_equal_the_tokenizer():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(WORDS)
    texts = samples()
    for text, ids in zip(texts, packing.tokenizer(WORDS).encode(texts), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def fewest(lengths, capacity):
    """Exact, by trying every bin for every piece."""
    best = [len(lengths)]

    def go(k, gaps):
        if len(gaps) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(gaps)
            return
        for i in {g: i for i, g in enumerate(gaps) if g >= lengths[k]}.values():
            gaps[i] -= lengths[k]
            go(k + 1, gaps)
            gaps[i] += lengths[k]
        go(k + 1, [*gaps, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_bin_completion_is_exact_when_small(lengths):
    found, proven = packing.bin_completion(np.array(lengths), 20)
    assert sorted(x for f in found for x in f) == sorted(lengths) and max(map(sum, found)) <= 20
    least = fewest(lengths, 20)
    assert proven and len(found) == least and packing.waste_bound(np.bincount(lengths, minlength=21), 20) <= least


def dealt(small, big):
    """Whether the pieces of one filling can be dealt onto those of another so that none is exceeded."""
    def go(k, gaps):
        return k == len(small) or any(gaps[i] >= small[k] and go(k + 1, [g - (small[k] if i == j else 0) for j, g in enumerate(gaps)]) for i in range(len(gaps)))

    return go(0, list(big))


@given(st.lists(st.integers(1, 12), min_size=1, max_size=8), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_fillings_are_the_undominated_ones(lengths, room):
    sizes = packing._Sizes(np.array(lengths), 20)
    found = [tuple(sorted(f, reverse=True)) for f in packing.undominated(sizes, room, packing.Budget(10**7))]
    assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True) and len(set(found)) == len(found)
    every = {tuple(sorted((lengths[i] for i in range(len(lengths)) if mask >> i & 1), reverse=True)) for mask in range(1 << len(lengths))}
    every = {f for f in every if sum(f) <= room}
    # Every filling is dominated by one that was found, and none that was found by a different one.
    assert set(found) <= every and all(any(dealt(f, g) for g in found) for f in every)
    assert not any(dealt(f, g) for f in found for g in found if f != g)


def test_bin_completion_beats_best_fit():
    """Best fit needs one sequence more than there has to be on many small instances; the search proves the least."""
    rng, better = np.random.default_rng(0), 0
    for _ in range(60):
        lengths = rng.integers(150, 700, 30)
        plain, (found, proven) = packing.best_fit_decreasing(lengths, 1000), packing.bin_completion(lengths, 1000)
        assert len(found) <= len(plain) and max(map(sum, found)) <= 1000 and sum(map(sum, found)) == lengths.sum()
        assert not proven or len(found) >= packing.waste_bound(np.bincount(lengths, minlength=1001), 1000)
        better += len(found) < len(plain)
    assert better >= 5
    hard = rng.integers(500, 1100, 2000)
    found, proven = packing.bin_completion(hard, steps=2000)
    assert not proven and len(found) == len(packing.best_fit_decreasing(hard, 2048))
    sequence, offset, n, _ = packing.place(hard, 2048)
    check_sequences(sequence, offset, hard, 2048)
    assert n == len(set(sequence.tolist()))


def check_sequences(sequence, offset, length, capacity):
    by = defaultdict(list)
    for s, o, n in zip(sequence, offset, length, strict=True):
        by[int(s)].append((int(o), int(n)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_packing_query(spark, odd_docs, no_docs, docs):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(WORDS)
    for df, rows in ((odd_docs, [(i, t) for i, t, _ in TEXTS]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        found = packing.pack_documents(df, WORDS).toPandas()
        check_sequences(found.sequence_id, found.offset, found.length, 2048)
        want = Counter()
        for doc_id, text in rows:
            ids = np.array([*theirs.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            for k, a in enumerate(range(0, len(ids), 2048)):
                part = ids[a : a + 2048]
                want[doc_id, k, a, len(part), zlib.crc32(part.tobytes())] += 1
        got = Counter((None if i != i or i is None else int(i), p, s, n, c) for i, p, s, n, c in zip(found.doc_id, found.piece, found.start, found.length, found.ids_crc32, strict=True))
        if None not in {i for i, _ in rows}:
            assert got == want
        assert len(found) == sum(want.values()) and found.sequence_id.nunique() <= -(-found.length.sum() // 2048) + 8
    assert packing.pack_documents(no_docs, WORDS).count() == 0


# Media.


class Stream:
    """An encoder of images that use every feature, to test the decoder with."""

    def __init__(self, width, height):
        self.bits = webp.Writer()
        self.width, self.height = width, height
        for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.bits.put(value, n)

    def code(self, symbols, alphabet):
        """A prefix code over some symbols: simple, or normal with balanced lengths."""
        symbols = sorted(set(symbols))
        if len(symbols) <= 2 and max(symbols) < 256:
            self.bits.put(1, 1)
            self.bits.put(len(symbols) - 1, 1)
            self.bits.put(1, 1)
            for s in symbols:
                self.bits.put(s, 8)
            lengths = [0] * max(alphabet, 256)
            for s in symbols:
                lengths[s] = 1
        else:
            if len(symbols) == 1:
                symbols = [*symbols, next(s for s in range(alphabet) if s not in symbols)]
            n = (len(symbols) - 1).bit_length()
            short = (1 << n) - len(symbols)
            lengths = [0] * alphabet
            for k, s in enumerate(symbols):
                lengths[s] = n - 1 if k < short else n
            own = [0] * 19
            for v in range(16):
                own[v] = 4
            self.bits.put(0, 1)
            self.bits.put(15, 4)
            for s in webp.CODE_LENGTH_ORDER:
                self.bits.put(own[s], 3)
            self.bits.put(0, 1)
            small = dict(webp.canonical(tuple(own)))
            for v in lengths:
                self.bits.put(small[v], 4)
        table = dict(webp.canonical(tuple(lengths)))
        single = sum(1 for v in lengths if v) == 1
        return lambda s: self.bits.put(table[s], 0 if single else lengths[s])

    def number(self, write, value, base=0):
        """A length or distance: its prefix symbol, then its extra bits."""
        symbol = self.prefix(value)
        write(base + symbol)
        if symbol >= 4:
            extra = (symbol - 2) >> 1
            self.bits.put(value - 1 - ((2 + (symbol & 1)) << extra), extra)

    @staticmethod
    def prefix(value):
        if value <= 4:
            return value - 1
        top = (value - 1).bit_length() - 1
        return 2 * top + ((value - 1) >> (top - 1) & 1)

    def image(self, tokens, main, cache_bits=0, groups=None):
        """tokens: ('p', argb), ('r', length, distance code) or ('c', index); groups: (bits, block image, group of each token)."""
        self.bits.put(bool(cache_bits), 1)
        if cache_bits:
            self.bits.put(cache_bits, 4)
        which = [0] * len(tokens)
        if main:
            self.bits.put(groups is not None, 1)
            if groups:
                bits, blocks, which = groups
                self.bits.put(bits - 2, 3)
                self.image([("p", b << 8) for b in blocks], False)
        alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        writers = []
        for g in range(max(which, default=0) + 1):
            used = [set() for _ in range(5)]
            for t, w in zip(tokens, which, strict=True):
                if w == g and t[0] == "p":
                    for k, shift in enumerate((8, 16, 0, 24)):
                        used[k].add(t[1] >> shift & 255)
                elif w == g and t[0] == "r":
                    used[0].add(256 + self.prefix(t[1]))
                    used[4].add(self.prefix(t[2]))
                elif w == g:
                    used[0].add(280 + t[1])
            writers.append([self.code(u or {0}, n) for u, n in zip(used, alphabets, strict=True)])
        for t, w in zip(tokens, which, strict=True):
            write = writers[w]
            if t[0] == "p":
                for k, shift in enumerate((8, 16, 0, 24)):
                    write[k](t[1] >> shift & 255)
            elif t[0] == "r":
                self.number(write[0], t[1], 256)
                self.number(write[4], t[2])
            else:
                write[0](280 + t[1])

    def done(self):
        body = b"\x2f" + self.bits.done()
        body += bytes(len(body) & 1)
        return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def random_pixels(seed, n, colours=None):
    rng = random.Random(seed)
    some = [rng.getrandbits(32) for _ in range(colours)] if colours else None
    return [rng.choice(some) if some else rng.getrandbits(32) for _ in range(n)]


def test_webp_literals_and_groups():
    pixels = random_pixels(1, 9 * 7)
    one = Stream(9, 7)
    one.bits.put(0, 1)
    blocks = [k % 3 for k in range(3 * 2)]
    one.image([("p", p) for p in pixels], True, groups=(2, blocks, [blocks[(k // 9 >> 2) * 3 + (k % 9 >> 2)] for k in range(63)]))
    assert webp.decode(one.done()).ravel().tolist() == pixels


def test_webp_back_references_and_cache():
    width, height = 10, 8
    rng = random.Random(2)
    cache_bits, pixels, tokens, cache = 4, [], [], {}
    near = {code: webp.near_distance(code, width) for code in range(1, 121)}
    while len(pixels) < width * height:
        options = [c for c, d in near.items() if d <= len(pixels)]
        if pixels and rng.random() < 0.4:
            n = min(rng.randint(1, 9), width * height - len(pixels))
            code = rng.choice(options) if options and rng.random() < 0.7 else 120 + rng.randint(1, len(pixels))
            distance = webp.near_distance(code, width)
            tokens.append(("r", n, code))
            for _ in range(n):
                pixels.append(pixels[-distance])
        else:
            argb = rng.choice(random_pixels(3, 5))
            key = (argb * webp.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
            cache = {(p * webp.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits): p for p in pixels}
            tokens.append(("c", key) if cache.get(key) == argb else ("p", argb))
            pixels.append(argb)
    assert {t[0] for t in tokens} == {"p", "r", "c"}
    one = Stream(width, height)
    one.bits.put(0, 1)
    one.image(tokens, True, cache_bits)
    assert webp.decode(one.done()).ravel().tolist() == pixels


def minus(a, b):
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def test_webp_predictor_modes():
    width, height, bits = 16, 16, 2
    pixels = random_pixels(4, width * height)
    modes = [k % 14 for k in range(16)]
    residue = []
    for k, p in enumerate(pixels):
        y, x = divmod(k, width)
        if y == 0:
            guess = pixels[k - 1] if x else 0xFF000000
        elif x == 0:
            guess = pixels[k - width]
        else:
            guess = webp.predict(modes[(y >> bits) * 4 + (x >> bits)], pixels[k - 1], pixels[k - width], pixels[k - width + 1], pixels[k - width - 1])
        residue.append(minus(p, guess))
    one = Stream(width, height)
    for value, n in ((1, 1), (webp.PREDICTOR, 2), (bits - 2, 3)):
        one.bits.put(value, n)
    one.image([("p", m << 8) for m in modes], False)
    one.bits.put(0, 1)
    one.image([("p", r) for r in residue], True)
    assert webp.decode(one.done()).ravel().tolist() == pixels


def test_webp_predictions_by_hand():
    left, top, right, corner = 0x10203040, 0x50607080, 0x11223344, 0x30405060
    average = lambda a, b: sum(((a >> s & 255) + (b >> s & 255) >> 1) << s for s in (0, 8, 16, 24))
    assert [webp.predict(m, left, top, right, corner) for m in range(5)] == [0xFF000000, left, top, right, corner]
    assert webp.predict(10, left, top, right, corner) == average(average(left, corner), average(top, right))
    assert webp.predict(12, left, top, right, corner) == 0x30405060 and webp.predict(12, 0, 0, 0, 0xFFFFFFFF) == 0 and webp.predict(12, 0xFFFFFFFF, 0xFFFFFFFF, 0, 0) == 0xFFFFFFFF
    assert webp.predict(11, left, top, right, corner) in (left, top)
    assert webp.predict(13, left, top, right, corner) == 0x30405060


def test_webp_cross_colour_and_subtract_green():
    width, height, bits = 8, 4, 2
    pixels = random_pixels(5, width * height)
    blocks = random_pixels(6, 2)
    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    stored = []
    for k, p in enumerate(pixels):
        t = blocks[(k // width >> bits) * 2 + (k % width >> bits)]
        green, red, blue = p >> 8 & 255, p >> 16 & 255, p & 255
        new_red = red - (signed(t) * signed(green) >> 5) & 255
        new_blue = blue - (signed(t >> 8) * signed(green) >> 5) - (signed(t >> 16) * signed(red) >> 5) & 255
        stored.append((p & 0xFF00FF00 | (new_red - green & 255) << 16 | new_blue - green & 255))
    one = Stream(width, height)
    for value, n in ((1, 1), (webp.CROSS_COLOUR, 2), (bits - 2, 3)):
        one.bits.put(value, n)
    one.image([("p", b) for b in blocks], False)
    one.bits.put(1, 1)
    one.bits.put(webp.SUBTRACT_GREEN, 2)
    one.bits.put(0, 1)
    one.image([("p", s) for s in stored], True)
    assert webp.decode(one.done()).ravel().tolist() == pixels


@pytest.mark.parametrize("colours", [2, 4, 16, 40])
def test_webp_palettes(colours):
    width, height = 11, 5
    palette = random_pixels(7, colours)
    index = [random.Random(k).randrange(colours) for k in range(width * height)]
    bundle = webp.palette_bits(colours)
    across, each = -(-width >> bundle), 8 >> bundle
    packed = [0] * (across * height)
    for k, i in enumerate(index):
        y, x = divmod(k, width)
        packed[y * across + (x >> bundle)] |= i << each * (x & (1 << bundle) - 1)
    one = Stream(width, height)
    for value, n in ((1, 1), (webp.COLOUR_INDEXING, 2), (colours - 1, 8)):
        one.bits.put(value, n)
    one.image([("p", minus(c, palette[k - 1] if k else 0)) for k, c in enumerate(palette)], False)
    one.bits.put(0, 1)
    one.image([("p", 0xFF000000 | p << 8) for p in packed], True)
    assert webp.decode(one.done()).ravel().tolist() == [palette[i] for i in index]


def test_webp_damage():
    good = webp.encode(b"hello".ljust(64, b"\0"))
    for bad in (b"", good[:24], b"RIFX" + good[4:], good[:-8]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    with pytest.raises(ValueError):
        webp.encode(b"x")


@given(st.binary(min_size=1, max_size=700))
@settings(max_examples=80, deadline=None)
def test_media_round_trip(raw):
    payload = raw.ljust(-(-len(raw) // 64) * 64, b"\0")
    images = list(webp.decode_all(webp.encode(payload)))
    assert b"".join((i >> 8).astype(np.uint8).tobytes() for i in images) == payload
    assert all((i >> 24 == 255).all() and (i & 255 == i >> 8 & 255).all() for i in images)


def form_samples():
    rng = np.random.default_rng(2)
    prose = " ".join(rng.choice(["some", "words", "of", "prose,", "and", "more."], 4000)).encode()
    noise = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    return {
        "palette": [bytes(64), b"ab" * 320, b"0123456789\n " * 96, bytes(range(16)) * 20],
        "cache": [b"one short row of text, with more than sixteen letters: qzvjk!".ljust(64, b"\0"), noise[:64]],
        "predictor": [b"".join((b"a line as wide as the image, and its number; qzvjkx %08d" % k).ljust(63) + b"\n" for k in range(200))],
        "references": [(prose[:700] + noise[:37]) * 40],
        "cross": ["日本語のテキストと漢字、".encode() * 3 + "ñandú öäü".encode() * 2 + "мир и труд, слово".encode() * 5 + noise[:1500]],
        "plain": [prose[:6400] + b"QXZ@#%[]{}<>"],
    }


def test_every_form_of_an_image(monkeypatch):
    seen = set()
    for kind in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_colour_indexing", "near_distance", "read_run"):
        whole = getattr(webp, kind)
        monkeypatch.setattr(webp, kind, lambda *a, own=whole, kind=kind: (seen.add(kind), own(*a))[1])
    for kind, payloads in form_samples().items():
        for raw in payloads:
            payload = raw.ljust(-(-len(raw) // 64) * 64, b"\0")
            assert webp.form_of(np.frombuffer(payload, np.uint8)) == kind, kind
            media = webp.encode(payload)
            assert (webp.pixels_of(media) >> 8).astype(np.uint8).tobytes() == payload and media == webp.encode(payload)
            if kind in ("predictor", "references"):
                assert len(media) < len(payload) / 4
    assert len(seen) == 6


def test_repeats_are_whole():
    rng = random.Random(3)
    for _ in range(60):
        raw = b"".join(rng.choice([b"abc", b"abcabcabc" * rng.randint(1, 30), bytes([rng.randint(0, 255)]) * rng.randint(1, 50)]) for _ in range(rng.randint(1, 60)))
        out = bytearray()
        for token in webp.repeats(raw):
            if isinstance(token, int):
                out.append(token)
            else:
                for _ in range(token[0]):
                    out.append(out[-token[1]])
        assert bytes(out) == raw
    for value in (1, 2, 4, 5, 6, 7, 8, 9, 4096, (1 << 20) - 1):
        symbol, extra, rest = webp.stretch(value)
        bits = webp.Writer()
        bits.put(rest, extra)
        assert webp.read_run(webp.Bits(bits.done() + bytes(8)), symbol) == value


def test_pixel_column(spark):
    whole = webp.encode(b"0123456789" * 32)
    df = spark.createDataFrame([(1, whole), (2, None), (3, whole[:40]), (4, b"")], "k int, media binary")
    found = {r.k: r.p for r in df.select("k", webp.pixel_column(df, strict=False).alias("p")).collect()}
    assert (found[1].width, found[1].height) == (64, 5) and found[2] is found[3] is found[4] is None
    assert (np.frombuffer(found[1].argb, "<u4") >> 8 & 255).astype(np.uint8).tobytes() == b"0123456789" * 32
    with pytest.raises(Exception, match="not a lossless|too early"):
        df.where("k = 3").select(webp.pixel_column(df)).collect()


def test_media_query(odd_docs, no_docs):
    found = webp.media_column(odd_docs, with_media=True).collect()
    want = Counter()
    for doc_id, text, _ in TEXTS:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    for r in found:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert [int(x) for x in r.feature.split(":")[2].split(",")] and sum(int(x) for x in r.feature.split(":")[2].split(",")) == r.payload_bytes
    by_payload = defaultdict(set)
    for r in found:
        by_payload[r.payload_sha256, r.n_bytes].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())
    assert len(b"".join(webp.encode(bytes(64 * 20_000)) for _ in range(1))) and sum(1 for _ in webp.decode_all(webp.encode(bytes(64 * 20_000)))) == 2
    assert webp.media_column(no_docs).count() == 0


# URL rules.


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def judge(host, path, rules):
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return None, "allow"
    best = max(fit)[:2]
    same = [x for x in fit if x[:2] == best]
    return same[0][2], "block" if any(x[3] == "block" for x in same) else "allow"


@pytest.mark.parametrize("ranges", [1, 7])
def test_url_rules(spark, ranges):
    rng = random.Random(3)
    labels, parts = ["a", "b", "ab", "example", "com", "net"], ["", "/", "/e", "/en", "/en/", "/en/7", "/de/8"]
    rules = [(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(parts), rng.choice(["block", "allow"])) for _ in range(60)] + [("", "/e", "block"), ("com", "", "allow")]
    urls = [None, "", "nothing", "http://", "://COM/en", "http://x.com?a://b", "ftp://com#/en/", "http://ab.com/en/7?q#f", "http://notcom/en/"]
    urls += [f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}{rng.choice(parts)}{rng.choice(['', 'x', '?q', '#f'])}" for _ in range(400)] + ["http://a.com/en/7"] * 200
    pages = spark.createDataFrame([(k % 500, u, "h", "p", "v") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, verdict string").repartition(5)
    found = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, ranges=ranges).collect())
    want = Counter()
    for k, u in enumerate(urls):
        host, path = split_url(u)
        want[(k % 500, host, path, *judge(host, path, rules))] += 1
    assert found == want
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, []).collect()} == {"allow"}


# Licences.


def dice_of(text, dice=license_scan.DICE):
    lines = "".join(c if c.isalnum() else "\n" if c == "\n" else " " for c in (text or "").lower()).split("\n")
    units = [line.split() for line in lines] + ([" ".join(lines).split()] if len([x for x in "\n".join(lines).strip(" \n").split("\n")]) > 1 else [])
    hits = []
    for words in units:
        own = Counter(f"{a} {b}" for a, b in itertools.pairwise(words))
        scores = [(2.0 * sum((own & Counter(dict(b))).values()) / (n + own.total()), name) for name, n, b in license_scan.template_rows(license_scan.TEMPLATES)]
        best = max(scores)
        if best[0] >= dice:
            hits.append(best)
    return (max(hits)[1], max(hits)[0], len(hits)) if hits else (None, 0.0, 0)


def test_licences(spark, odd_docs, no_docs):
    texts = [
        "Some prose first.\nLicensed under the Apache License, Version 2.0.\nMore.", "RELEASED under the MIT license!", "released under the mit licence of old",
        "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "Licensed", "the the the the", "MIT\nLicense", None, "\n\n",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without any restriction.",
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, licence string")
    found = {r.doc_id: (r.licence, r.dice, r.lines) for r in license_scan.scan_licences(df).collect()}
    for k, t in enumerate(texts):
        assert found[k][0] == dice_of(t)[0] and found[k][1] == pytest.approx(dice_of(t)[1]) and found[k][2] == dice_of(t)[2], t
    assert found[0][0] == "Apache-2.0" and found[1] == ("MIT", 1.0, 1) and found[3][2] == 3 and found[9][0] == "MIT"
    named = {r.doc_id: r.licences for r in license_scan.scan_licences(df).collect()}
    assert named[0] == "Apache-2.0" and named[3] == "GPL-3.0,MIT" and named[4] == ""
    odd = license_scan.scan_licences(odd_docs).collect()
    assert len(odd) == len(TEXTS) and all(r.licence is None for r in odd) and license_scan.scan_licences(no_docs).count() == 0
    plan = license_scan.scan_licences(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def best_span(text, templates, dice=license_scan.DICE):
    """(licence, dice) of the best run of words, by trying all of them."""
    words = license_scan.normalised(text)
    pairs = [f"{a} {b}" for a, b in itertools.pairwise(words)]
    hits = []
    for name, n, b in license_scan.template_rows(templates):
        for i in range(len(pairs)):
            for j in range(i + min(n, len(pairs)), min(len(pairs), i + 2 * n) + 1):
                hits.append((2.0 * sum((Counter(pairs[i:j]) & Counter(dict(b))).values()) / (n + j - i), name))
    best = max(hits, default=(0.0, None))
    return best[::-1] if best[0] >= dice else (None, 0.0)


def test_licence_notices_within_texts(spark):
    """Wrapped notices and notices within a paragraph, which no line and no whole text is near enough to."""
    gpl, bsd = license_scan.TEMPLATES["GPL-3.0"][1], license_scan.TEMPLATES["BSD-3-Clause"][0]
    prose = "the quick brown fox jumps over the lazy dog every day "
    texts = [
        prose * 20 + "\n" + textwrap.fill(gpl, 60, initial_indent=" * ", subsequent_indent=" * "), textwrap.fill(bsd, 40) + ":\n" + prose * 9,
        "This project is great. Released under the MIT License. Thanks to all.", prose * 20, "This project was released under the old licence of MIT.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.licence, r.dice, r.lines) for r in license_scan.scan_licences(df).collect()}
    assert [dice_of(t)[0] for t in texts] == [None] * 5
    assert found == {0: ("GPL-3.0", 1.0, 0), 1: ("BSD-3-Clause", 1.0, 0), 2: ("MIT", 1.0, 0), 3: (None, 0.0, 0), 4: (None, 0.0, 0)}


def test_whole_licences(spark):
    """Notices and licence texts as published, wrapped or in one line, alone and within prose."""
    whole, prose = license_scan.published(), "the quick brown fox jumps over the lazy dog every day "
    assert whole.keys() == {"Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT", "MPL-2.0"} and min(len(whole[k]) for k in whole.keys() - {"BSD-3-Clause"}) == 2
    texts = [(k, t) for k in sorted(whole) for text in whole[k] for t in (" ".join(text.split()), prose * 30 + "\n" + textwrap.fill(text, 70) + "\n" + prose * 30)]
    assert all(dice_of(t)[0] is None for k, t in texts if k == "MIT" and "\n" not in t)
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (r.licence, r.dice) for r in license_scan.scan_licences(df).collect()}
    assert [found[k][0] for k in range(len(texts))] == [k for k, _ in texts]
    assert all(found[k][1] > 0.99 for k, (_, t) in enumerate(texts) if dice_of(t)[0] is None)  # else that of the unit
    without = " ".join(license_scan.published()["Apache-2.0"][1].split()[600:])
    assert license_scan.scan_licences(spark.createDataFrame([(1, without)], "doc_id long, text string")).first().licence is None


def test_licence_spans_equal_brute_force(spark):
    rng = random.Random(5)
    templates = {"A": ["a b a b c d", "license of a b"], "B": ["b a b a b a c d a b", "software c d"]}
    texts = [" ".join(rng.choice(["a", "b", "a b", "c d", "license of", "software", "x"]) for _ in range(rng.randint(0, 25))) + " y" * 30 for _ in range(300)]  # too long for a unit
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dice in (0.8, 0.6):
        found = {r.doc_id: (r.licence, r.dice) for r in license_scan.scan_licences(df, templates, dice).collect()}
        wanted = {k: best_span(t, templates, dice) for k, t in enumerate(texts)}
        assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in wanted.items()} and len({v[0] for v in wanted.values()}) == 3
        assert all(v[1] == pytest.approx(wanted[k][1]) for k, v in found.items())


# Sharding.


def check_shards(found, shards):
    assert found["shard"].between(0, shards - 1).all()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_shards(spark, docs, odd_docs, no_docs):
    found = kd_shard.kd_shards(docs, shards=10).toPandas()
    check_shards(found, 10)
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {i: (s, c) for i, s, c in zip(found.doc_id, found["size"], found.text_crc32, strict=True)} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows.items()}
    by = found.groupby("shard")["size"].sum()
    assert len(by) == 10 and (by - by.mean()).abs().max() <= found["size"].max()
    odd = kd_shard.kd_shards(odd_docs, shards=4).toPandas()
    check_shards(odd, 4)
    assert len(odd) == len(TEXTS) and set(odd.law) == {"bytes"} and odd.grown_shard.isna().all()
    assert kd_shard.kd_shards(no_docs, shards=40).count() == 0
    assert kd_shard.kd_shards(docs, target_bytes=100_000).select("shard").distinct().count() in (5, 6)


def test_shards_split_a_large_group_and_keep_small_ones(spark):
    rows = [(k, "same text over and over " * 5) for k in range(1500)] + [(k, f"text {k % 900} " * (3 + k % 40)) for k in range(1500, 4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = kd_shard.kd_shards(df, shards=8).toPandas()
    check_shards(found, 8)
    by = found.groupby("shard")["size"].sum()
    assert by.max() / by.mean() < 1.06 and by.min() / by.mean() > 0.94
    spread = found.groupby("text_crc32").shard.nunique()
    assert (spread > 1).sum() == 1  # the group that is larger than a shard
    plan = kd_shard.kd_shards(df, shards=8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_tree(points, first, leaves):
    """[(row, shard)] of a k-d tree over (row, size, keys), each node sorted whole."""
    if leaves == 1 or not points:
        return [(row, first) for row, _, _ in points]
    bits = kd_shard.CHECK + kd_shard.WITHIN
    spans = [(max(p[2][k] for p in points) >> bits) - (min(p[2][k] for p in points) >> bits) for k in range(len(points[0][2]))]
    dim, half = spans.index(max(spans)), leaves // 2
    want, by_key = sum(p[1] for p in points) * half / leaves, defaultdict(list)
    for p in points:
        by_key[p[2][dim]].append(p)
    left, right, before = [], [], 0
    for key in sorted(by_key):
        weight = sum(p[1] for p in by_key[key])
        (left if 2 * before + weight <= 2 * want else right).extend(by_key[key])
        before += weight
    return slow_tree(left, first, half) + slow_tree(right, first + half, leaves - half)


@pytest.mark.parametrize("most,bins", [(1 << 16, 2048), (150, 2048), (20, 2), (3, 64)])
def test_shards_equal_a_tree_by_brute_force(spark, monkeypatch, most, bins):
    """Whether all levels are windows, the upper ones are searched, or all are."""
    monkeypatch.setattr(kd_shard, "ROWS", most)
    monkeypatch.setattr(kd_shard, "BINS", bins)
    monkeypatch.setattr(kd_shard, "LEVELS", 2)
    rng = random.Random(8)
    rows = [(k, "copy of one text " * 9) for k in range(120)] + [(120 + k, "ä" * rng.randint(0, 40) + f"text {k % 300} " * rng.randint(1, 30)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, dims = kd_shard.points(docs, kd_shard.default_dimensions()), len(kd_shard.default_dimensions())
    bounds = found.agg(*[f(f"d{k}").alias(f"{f.__name__}{k}") for k in range(dims) for f in (F.min, F.max)]).first().asDict()
    total = found.agg(F.sum("size")).first()[0]
    keyed = kd_shard.keyed(found, dims, 13, bounds, total, kd_shard.HEAVY).collect()
    want = dict(slow_tree([(r.doc_id, r["size"], [r[f"k{k}"] for k in range(dims)]) for r in keyed], 0, 13))
    shards = kd_shard.kd_shards(docs, shards=13, near=0.0).toPandas()
    check_shards(shards, 13)
    assert dict(zip(shards.doc_id, shards.shard, strict=True)) == want


def test_many_leaves(spark, docs):
    total = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    found = kd_shard.kd_shards(docs, target_bytes=total // 100).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert len(found) > 60 and found.shard.max() <= 100


def test_memo_is_bounded():
    from loglattice.llm.common import BoundedMemo

    asked = []
    memo = BoundedMemo(100)
    for k in range(60):
        keys = [f"{k}-{i}" for i in range(10)] + ["always"] + ["long" * 500 + str(k)]
        memo.admit(keys, lambda new: asked.extend(new) or [len(x) for x in new])
        assert all(memo.young[x] == len(x) for x in keys)
        assert len(memo.young) <= 110 and sum(map(len, [*memo.young, *memo.old])) < 20_000
    assert asked.count("always") == 1


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
