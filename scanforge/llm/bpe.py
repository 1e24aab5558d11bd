"""Op 6 - BPE encoding and decoding by forced-boundary splitting.

A merge can only join two neighbouring symbols into a vocabulary token that holds both, so a pair of neighbouring
symbols (bytes, the last one of a word marked as such) that occurs inside no token can never be bridged.  Such pairs
are certain cuts: the fragments between them are encoded independently, and their ids concatenated give the ids of the
whole.  Blanks are the most frequent case (no token holds one), so a text is first cut at blanks; the words are cut
further at the pairs found in the vocabulary.  Texts are taken in blocks: equal words of a block are encoded once, and
the merges of all its fragments run side by side in numpy arrays, each fragment in its own merge order.

The work is per text: no shuffle, memory bounded by one block or text, and a lost executor repeats only its own
input splits.  Defined results: a null text is encoded as the empty one (no ids); repeated rows are each encoded; all
other columns pass unchanged, but for input columns named like those the operator adds, which are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import byte_slices, lean, trim

#: The tokenizer's published word pattern.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> dict[int, str]:
    """Fixed values of byte-level vocabularies: the printable stand-in of each byte, itself where visible, else from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with the vocabulary and merges of a ``tokenizers`` JSON file (word-end BPE)."""

    def __init__(self, spec: str):
        said = json.loads(spec)
        model = said["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        stand = byte_symbols()
        #: Ids of the 256 bytes, then of the 256 bytes that end a word.
        self.single = np.array([self.vocab[stand[b] + end] for end in ("", self.end) for b in range(256)], np.int64)
        self.at_byte = {c + end: b + 256 * bool(end) for b, c in stand.items() for end in ("", self.end)}
        self.inside = self.pairs_inside()
        self.learn_merges([m.split(" ") if isinstance(m, str) else m for m in model["merges"]])

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def pairs_inside(self) -> np.ndarray:
        """True for neighbouring symbols that some vocabulary token holds; every other pair is a certain cut."""
        found = np.zeros((512, 512), bool)
        for token in self.vocab:
            at = [self.at_byte[x] for x in self.symbols(token)]
            found[at[:-1], at[1:]] = True
        return found

    def learn_merges(self, merges: list) -> None:
        """An open-addressed table from a pair of ids to the merge's rank, and by rank the id it makes."""
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.never = len(merges)
        key = left << 32 | right
        self.mask = (1 << int(4 * len(merges)).bit_length()) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, self.never, np.int64)
        left_over = np.arange(len(key))[::-1]  # the first merge of a pair counts, so it is written last
        step = 0
        while len(left_over):
            at = (self.spread(key[left_over]) + step) & self.mask
            free = (self.slot_key[at] == -1) | (self.slot_key[at] == key[left_over])
            self.slot_key[at[free]] = key[left_over[free]]
            self.slot_rank[at[free]] = left_over[free]
            left_over = left_over[self.slot_key[at] != key[left_over]]
            step += 1
        self.steps = step

    def spread(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = self.spread(key)
        out = np.full(len(key), self.never, np.int64)
        open_ = np.arange(len(key))
        for step in range(self.steps):
            slot = (at[open_] + step) & self.mask
            held = self.slot_key[slot]
            hit = held == key[open_]
            out[open_[hit]] = self.slot_rank[slot[hit]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
        return out

    def encode_bytes(self, raw: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words given as bytes end to end, and where each word's ids begin (one more entry than words)."""
        at = raw.astype(np.int64)
        at[stops - 1] += 256
        ids = self.single[at]
        # a fragment starts at each word and after each certain cut
        cut = np.zeros(len(at), bool)
        cut[stops[:-1]] = True
        cut[0] = True
        cut[1:] |= ~self.inside[at[:-1], at[1:]]
        frag = np.cumsum(cut) - 1
        where = np.arange(len(at))
        alive = np.ones(len(at), bool)
        now = np.arange(len(at))  # positions of symbols in fragments that can still merge
        f = frag
        rank = np.full(len(at), self.never, np.int64)
        same = f[:-1] == f[1:]
        rank[:-1][same] = self.ranks(ids[:-1][same], ids[1:][same])
        while len(now):
            starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            low = np.minimum.reduceat(rank, starts)
            long = np.diff(np.r_[starts, len(now)])
            low_each = np.repeat(low, long)
            go = low_each < self.never
            if not go.all():
                now, f, rank, low_each = now[go], f[go], rank[go], low_each[go]
                if not len(now):
                    break
            hit = rank == low_each
            # of overlapping hits (the pair of a symbol with itself) every second one counts, from the left
            first = hit & ~np.r_[False, hit[:-1]]
            run = np.flatnonzero(first)
            no = np.cumsum(first) - 1
            odd = hit & ((np.arange(len(hit)) - run[np.maximum(no, 0)]) % 2 == 1)
            hit &= ~odd
            at_hit = np.flatnonzero(hit)
            ids[now[at_hit]] = self.made[low_each[at_hit]]
            alive[now[at_hit + 1]] = False
            gone = np.zeros(len(now), bool)
            gone[at_hit + 1] = True
            stay = ~gone
            changed = hit.copy()
            changed[:-1] |= hit[1:]
            changed[:-2] |= hit[2:] & gone[1:-1]  # the symbol before, when a merged one lies between
            now, f, rank, changed = now[stay], f[stay], rank[stay], changed[stay]
            again = np.flatnonzero(changed | np.r_[changed[1:], False])
            inner = again[again + 1 < len(now)]
            inner = inner[f[inner] == f[inner + 1]]
            rank[again] = self.never
            rank[inner] = self.ranks(ids[now[inner]], ids[now[inner + 1]])
        begins = np.r_[0, np.cumsum(alive)][np.r_[0, stops]]
        return ids[where[alive]], begins

    def words_of(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the words of normalised code points, as WORD_PATTERN finds them."""
        kind = char_kinds()[cp]
        before = np.r_[np.uint8(BLANK), kind[:-1]]
        start = (kind != BLANK) & ((kind != before) | (kind == NUMBER))
        quote = np.flatnonzero((cp == ord("'")) & start)
        stops_more = np.zeros(len(cp) + 1, bool)
        if len(quote):
            pad = np.r_[cp, 0, 0]
            n1, n2 = pad[quote + 1], pad[quote + 2]
            one = np.isin(n1, [ord(c) for c in "stmd"])
            two = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (n1 == ord(a)) & (n2 == ord(b))
            for mask, n in ((one, 2), (two, 3)):
                q = quote[mask]
                start[q + 1] = False
                after = q + n
                stops_more[after] = True
                inside = after[after < len(cp)]
                start[inside[kind[inside] == LETTER]] = True
        after = np.r_[kind[1:], np.uint8(BLANK)]
        stop = np.flatnonzero((kind != BLANK) & ((after != kind) | (kind == NUMBER)))
        begin = np.flatnonzero(start)
        # a word ends before the next word, or before the blanks that follow it
        end = np.r_[begin[1:], len(cp)]
        last = stop[np.searchsorted(stop, begin)] + 1
        if len(quote):
            nxt = np.flatnonzero(stops_more[:-1])
            if len(nxt):
                at = np.searchsorted(nxt, begin, side="right")
                cut = np.where(at < len(nxt), nxt[np.minimum(at, len(nxt) - 1)], len(cp))
                is_quote = np.isin(begin, quote)
                last = np.where(is_quote, np.where(stops_more[np.minimum(begin + 2, len(cp))] | stops_more[np.minimum(begin + 3, len(cp))], cut, last), last)
        return begin, np.minimum(end, last)

    def stretches(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts without special tokens; equal words of the block are encoded once."""
        big = "\n".join(texts) + "\n"
        cp = np.frombuffer(big.encode("utf-32-le"), "<u4")
        raw = np.frombuffer(big.encode("utf-8"), np.uint8)
        begin, end = self.words_of(cp)
        if not len(begin):
            return [np.zeros(0, np.int64) for _ in texts]
        at_byte = np.r_[0, np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))]
        low, size = at_byte[begin], at_byte[end] - at_byte[begin]
        head = np.r_[0, np.cumsum(size)]
        place = np.arange(head[-1]) - np.repeat(head[:-1], size)
        where = place + np.repeat(low, size)
        got = raw[where]
        far = (place >> 10).astype(np.uint64) * PLACE_KEYS[0]
        mark = np.add.reduceat(BYTE_KEYS[got] * (PLACE_KEYS[place & 1023] + far), head[:-1])
        _, first, which = np.unique(mark ^ (size.astype(np.uint64) * PLACE_KEYS[7]), return_index=True, return_inverse=True)
        # a mark only proposes: a word that differs from the first of its mark is encoded on its own
        other = size != size[first][which]
        like = np.where(other, head[:-1], head[:-1][first][which])
        other |= np.add.reduceat(got != got[place + np.repeat(like, size)], head[:-1], dtype=np.int64) > 0
        alone = np.flatnonzero(other)
        which[alone] = len(first) + np.arange(len(alone))
        first = np.r_[first, alone]
        n = size[first]
        own = np.r_[0, np.cumsum(n)]
        ids, starts = self.encode_bytes(got[np.arange(own[-1]) - np.repeat(own[:-1], n) + np.repeat(head[:-1][first], n)], own[1:])
        count = np.diff(starts)[which]
        ends = np.cumsum(count)
        out = ids[np.arange(ends[-1]) + np.repeat(starts[:-1][which] - (ends - count), count)]
        text_end = np.cumsum([len(t) + 1 for t in texts])
        cut = np.r_[0, ends][np.searchsorted(begin, text_end)]
        return np.split(out, cut[:-1])

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text; long ones are taken piece by piece, cut at blanks, which no word holds."""
        pieces: list[str] = []
        plan: list[list[int]] = []  # of each text the pieces' numbers, special ids as negative ones
        for text in texts:
            parts = self.at_special.split(text) if self.at_special is not None and "<|" in text else [text]
            own: list[int] = []
            for i, part in enumerate(parts):
                if i % 2:
                    own.append(-1 - self.special[part])
                else:
                    for piece in cut_at_blanks(self.normal(part)):
                        own.append(len(pieces))
                        pieces.append(piece)
            plan.append(own)
        got = [ids for some in blocks(pieces, PIECE) for ids in self.stretches(some)]
        out = []
        for own in plan:
            ids = [got[i] if i >= 0 else np.array([-1 - i], np.int64) for i in own]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()

    def encode(self, text: str) -> np.ndarray:
        return self.block([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def cut_at_blanks(text: str) -> Iterator[str]:
    """Pieces of about PIECE characters of a normalised text, each but the last followed by a blank."""
    low = 0
    while len(text) - low > PIECE:
        at = AT_BLANK.search(text, low + PIECE)
        if at is None:
            break
        yield text[low : at.start()]
        low = at.start()
    yield text[low:] if low else text


#: Characters that are encoded side by side, at least one word; a block takes some 100 bytes of memory for each.
PIECE, AT_BLANK = 250_000, regex.compile(r"\s")
_keys = np.random.default_rng(23)
BYTE_KEYS = _keys.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_KEYS = _keys.integers(1, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
BLANK, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def char_kinds() -> np.ndarray:
    """The kind of every code point, by the classes of the word pattern."""
    out = np.full(0x110000, OTHER, np.uint8)
    for low in range(0, 0x110000, 0x800):  # the surrogates are one such stretch
        every = "" if low == 0xD800 else "".join(map(chr, range(low, low + 0x800)))
        for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


def blocks(texts: list[str | None], chars: int = PIECE) -> Iterator[list[str]]:
    """Runs of whole texts (null: empty) of about ``chars`` characters."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder for a vocabulary file's content; kept, with its tables, between tasks."""
    at = hashlib.sha256(spec.encode()).hexdigest()
    if at not in _encoders:
        _encoders[at] = Encoder(spec)
    return _encoders[at]


def forget() -> None:
    """Drop the worker's encoders; the next use makes them again."""
    if _encoders:
        _encoders.clear()
        trim()


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocab_path: str, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` without its text plus ``ids`` (array<int>), ``n_tokens``, and with_text ``decoded``."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))
    keep = [f for f in docs.schema.fields if f.name not in (text, "ids", "n_tokens", "decoded")]
    out = T.StructType([*keep, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *([T.StructField("decoded", T.StringType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in byte_slices(batches, text):
            ids, says = [], []
            for some in blocks(batch.column(text).to_pylist()):
                got = enc.block(some)
                ids += [x.astype(np.int32) for x in got]
                says += [enc.decode(x) for x in got] if with_text else []
            cols = [batch.column(f.name) for f in keep]
            cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(says, pa.string())] if with_text else []), names=out.names)

    return docs.mapInArrow(lean(run), out)


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: token count and the SHA-256 of ids and of the decoded text, made where the text is encoded."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))
    out = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in byte_slices(batches, "text"):
            n, a, b = [], [], []
            for some in blocks(batch.column("text").to_pylist()):
                for ids in enc.block(some):
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), out)
