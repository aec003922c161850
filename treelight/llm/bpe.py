"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse as an incremental state machine.

Encoding. Text streams through in slices cut where a piece of the pre-tokenizer must end (before white space that
follows a character that isn't). Pieces are encoded by the merge list. A piece of any length streams through
``StreamingEncoder``: it holds a window of bytes, and emits a token as soon as no later byte can change it.

Sufficient lookahead. Let A be the encoding of a string x and B that of a longer string, and take the last boundary
that both have. From there to the end of x no boundary is shared, so tokens of A and B overlap in a chain, each one
starting inside the one before and ending beyond it. A merge across a boundary of the other encoding can be missing
there only because, to its right, a merge of a lower rank came first; so the ranks at which the tokens of the chain
merge across the boundaries inside them fall strictly from left to right. ``sufficient_lookahead`` takes the longest
such chain that the vocabulary allows, by a pass over (token, position) in the order of those ranks. A token of a
window's encoding that ends that many bytes before the end of the window is final.

Decoding. Token ids become bytes, bytes go through an incremental UTF-8 decoder which keeps at most three bytes between
tokens; bytes that aren't UTF-8 become U+FFFD.

Memory: a slice's tokens, a window and a cache of bounded size for each task, besides the row itself. A slice ends at white space; one
that finds none within twice its length goes piece by piece, and a long piece window by window, so its tokens aren't held together.
Rows are encoded where they are; there's no shuffle.

Defined results: a null text counts as the empty text, which has no tokens (digests are those of empty strings); the
added token's string in a text is that token; repeated rows give equal rows; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelight.llm.common import text_of

SLICE_CHARS = 1 << 16
CACHE_PIECES = 500_000
#: Longer pieces (in characters) aren't cached but streamed.
CACHED_CHARS = 48


def _char_class(first: str) -> str:
    """The code points whose general category starts with `first`, as the inside of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: The code points with the property White_Space.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: English endings that the pre-tokenizer splits off.
ENDINGS = "s|t|re|ve|m|ll|d"


def piece_pattern() -> re.Pattern:
    """The pre-tokenizer: an ending, or letters, digits or other characters after at most one space, or white space."""
    letters, numbers, s = _char_class("L"), _char_class("N"), WHITE_SPACE
    return re.compile(f"'(?:{ENDINGS})| ?[{letters}]+| ?[{numbers}]+| ?[^{s}{letters}{numbers}]+|[{s}]+(?![^{s}])|[{s}]+")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself where it's printable in Latin-1, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """What a tokenizer file says: bytes of each id, ranks and results of merges, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        model = spec["model"]
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}  # of each pair of ids that merges
        self.results: list[int] = []  # by rank: the id that comes of it
        for rank, pair in enumerate(model["merges"]):
            left, right = map(to_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks.setdefault((self.ids[left], self.ids[right]), rank)
            self.results.append(self.ids[left + right])

    def encode(self, data: bytes) -> list[int]:
        """All merges, the lowest rank first and among equals the leftmost."""
        tokens = [self.byte_ids[b] for b in data]
        return self._merge_short(tokens) if len(tokens) <= 40 else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        get, results = self.ranks.get, self.results
        none = len(results)
        found = [get(pair, none) for pair in zip(tokens, tokens[1:], strict=False)]
        while found and (best := min(found)) < none:
            at, new = found.index(best), results[best]
            tokens[at : at + 2] = [new]
            del found[at]
            if at:
                found[at - 1] = get((tokens[at - 1], new), none)
            if at < len(found):
                found[at] = get((new, tokens[at + 1]), none)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        get, n = self.ranks.get, len(tokens)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j, new = after[i], self.results[rank]
            if tokens[i] != left or j < 0 or tokens[j] != right:
                continue
            tokens[i], tokens[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get((tokens[a], tokens[b]))) is not None:
                    heapq.heappush(heap, (r, a, tokens[a], tokens[b]))
        return [t for t in tokens if t >= 0]


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Bytes after the end of a token that settle it: the longest chain of overlapping tokens with falling ranks."""
    crossing: dict[bytes, list[int]] = {}  # of each token: the rank of the merge across each inner position
    for (left, right), rank in sorted(vocabulary.ranks.items(), key=lambda x: x[1]):
        a, b = vocabulary.bytes_of[left], vocabulary.bytes_of[right]
        crossing.setdefault(a + b, [*crossing.get(a, []), rank, *crossing.get(b, [])])
    by_rank: dict[int, list[tuple[bytes, int]]] = {}
    for token, ranks in crossing.items():
        for i, rank in enumerate(ranks):
            by_rank.setdefault(rank, []).append((token, i + 1))
    best: dict[bytes, int] = {}  # by what overlaps: bytes from the end of the overlap to the end of the chain
    longest = 0
    for rank in sorted(by_rank):
        reach = []
        for token, at in by_rank[rank]:
            further = max((best.get(token[-k:], 0) for k in range(1, len(token) - at + 1)), default=0)
            reach.append((token[:at], len(token) - at + further))
        for overlap, r in reach:
            if r > best.get(overlap, 0):
                best[overlap] = r
            longest = max(longest, r)
    return longest + max(map(len, crossing), default=1)


class StreamingEncoder:
    """Bytes of one piece in, final token ids out; holds at most `window` bytes."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int):
        self.vocabulary, self.lookahead, self.window = vocabulary, lookahead, max(4 * lookahead, 256)
        self.held = b""

    def feed(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.window):
            self.held += data[start : start + self.window]
            if len(self.held) > self.window:
                end, settled = 0, len(self.held) - self.lookahead
                for token in self.vocabulary.encode(self.held):
                    if end + len(self.vocabulary.bytes_of[token]) > settled:
                        break
                    end += len(self.vocabulary.bytes_of[token])
                    yield token
                self.held = self.held[end:]

    def finish(self) -> list[int]:
        out, self.held = self.vocabulary.encode(self.held), b""
        return out


class _Pieces(dict):
    """Token ids of pieces, computed when first asked for; emptied when full."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int):
        super().__init__()
        self.vocabulary, self.lookahead = vocabulary, lookahead

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(piece) > CACHED_CHARS:
            stream = StreamingEncoder(self.vocabulary, self.lookahead)
            return (*stream.feed(data), *stream.finish())
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = out = tuple(self.vocabulary.encode(data))
        return out


class Codec:
    """Encodes and decodes texts slice by slice."""

    def __init__(self, path: str, lookahead: int | None = None):
        self.vocabulary = Vocabulary(path)
        self.lookahead = sufficient_lookahead(self.vocabulary) if lookahead is None else lookahead
        self.pattern = piece_pattern()
        self.pieces = _Pieces(self.vocabulary, self.lookahead)
        self.cut = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True))) + ")") if self.vocabulary.added else None

    def slices(self, text: str) -> Iterator[str]:
        """Parts of text between which no piece stands."""
        start = 0
        while len(text) - start > SLICE_CHARS and (m := self.cut.search(text, start + SLICE_CHARS)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> Iterator[list[int]]:
        """Lists of token ids, in order."""
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                yield [self.vocabulary.added[part]]
                continue
            for piece in self.slices(part):
                if len(piece) > 2 * SLICE_CHARS:
                    yield from self.unbroken(piece)
                else:
                    yield list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(piece))))

    def unbroken(self, text: str) -> Iterator[list[int]]:
        """The lists of a slice that white space couldn't shorten: a short piece each, or what a window of a long one settles."""
        for m in self.pattern.finditer(text):
            start, end = m.span()
            if end - start <= CACHED_CHARS:
                yield list(self.pieces[m.group()])
                continue
            stream = StreamingEncoder(self.vocabulary, self.lookahead)
            for at in range(start, end, SLICE_CHARS):
                yield list(stream.feed(text[at : min(at + SLICE_CHARS, end)].encode()))
            yield stream.finish()

    def decode(self, ids: Iterator[list[int]]) -> Iterator[str]:
        """Text, as soon as its bytes are there."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        look = self.vocabulary.bytes_of.__getitem__
        for part in ids:
            yield state.decode(b"".join(map(look, part)))
        yield state.decode(b"", True)


@lru_cache(maxsize=1)
def codec_of(path: str, lookahead: int) -> Codec:
    """One codec for all tasks of a Python worker."""
    return Codec(path, lookahead)


def encode_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the array token_ids.

    tokenizer_path is read by each executor. The lookahead is computed once, here.
    """
    lookahead = sufficient_lookahead(Vocabulary(tokenizer_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path, lookahead)
        numerals = [str(i) for i in range(len(codec.vocabulary.bytes_of))]
        for batch in batches:
            counts, digests, decoded, all_ids = [], [], [], []
            for value in batch.column("text"):
                n, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []

                def encoded(text=value.as_py(), kept=kept, ids_hash=ids_hash):
                    nonlocal n
                    for part in codec.encode(text):
                        if part:
                            ids_hash.update(("," if n else "").encode() + ",".join(map(numerals.__getitem__, part)).encode())
                            n += len(part)
                            if with_ids:
                                kept += part
                            yield part

                for s in codec.decode(encoded()):
                    text_hash.update(s.encode())
                counts.append(n)
                digests.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
                all_ids.append(kept)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids)

    return rows.mapInArrow(run, schema)
