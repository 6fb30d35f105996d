"""Subword pieces of whole texts with the bytes of the text that each piece stands for.

A text is first normalised through the model's compiled character map, always by the longest entry that starts at a
place; every byte of the normalised text remembers the byte of the source it came from. Pieces are then merged pair
by pair, the best-scored pair first, and their borders are projected back through that alignment.

No piece of a vocabulary may cross certain places (before a word mark, around characters in no longer piece), so a
text falls into chunks that are merged on their own, and a worker remembers the chunks it has met. A text is one row
of one task from beginning to end; nothing is shuffled.

Null and empty texts have no pieces. Rows repeated under an id are encoded each on its own; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import kept, slices

MODEL = "piece_bpe_32k.model"
CACHED_CHUNKS = 500_000  # chunks a worker remembers, of at most LONGEST_CACHED characters
LONGEST_CACHED = 64
NEVER = float("inf")
MARK = "▁"  # stands for a space in pieces
BAD = "�"

# Fixed values of the model file: field numbers and enumerations of its public message format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MODEL_TYPE, BPE, SUFFIX_MARK, BYTE_FALLBACK = 3, 2, 24, 35
CHARACTER_MAP, DUMMY_PREFIX, SINGLE_SPACES, ESCAPE = 2, 3, 4, 5


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one serialized message: number and value, floats as their four bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """Source strings and what replaces them, as compiled into a model: a double array and its targets."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self._units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self._targets = compiled[4 + size :]
        self._starts: dict[str, bool] = {}

    def _child(self, node: int, byte: int) -> int:
        """The node reached by a byte, or 0."""
        unit = self._units[node]
        child = node ^ (unit >> 10 << ((unit & 0x200) >> 6)) ^ byte
        return child if child < len(self._units) and self._units[child] & 0x800000FF == byte else 0

    def _walk(self, node: int, character: str) -> int:
        for byte in character.encode():
            node = self._child(node, byte)
            if not node:
                return 0
        return node

    def starting(self, text: str) -> list[str]:
        """The characters of the text that entries begin with."""
        if not self._units:
            return []
        for c in set(text) - self._starts.keys():
            self._starts[c] = bool(self._walk(0, c))
        return [c for c in set(text) if self._starts[c]]

    def longest(self, text: str, at: int) -> tuple[int, bytes] | None:
        """Characters covered by the longest entry that starts here, and its target."""
        found, node, end = None, 0, at
        while end < len(text):
            node = self._walk(node, text[end])
            if not node:
                break
            end += 1
            unit = self._units[node]
            if unit >> 8 & 1:
                leaf = self._units[node ^ (unit >> 10 << ((unit & 0x200) >> 6))] & 0x7FFFFFFF
                found = end - at, self._targets[leaf : self._targets.index(0, leaf)]
        return found


class Normalizer:
    """Normalised bytes of a text, and for each of them (and the end) the byte of the text it came from."""

    def __init__(self, spec: bytes, suffix_mark: bool = False) -> None:
        fields = {DUMMY_PREFIX: 1, SINGLE_SPACES: 1, ESCAPE: 1, CHARACTER_MAP: b""} | dict(message(spec))
        self.map = CharacterMap(fields[CHARACTER_MAP])
        self.single, self.escape = bool(fields[SINGLE_SPACES]), bool(fields[ESCAPE])
        self.space = MARK.encode() if self.escape else b" "
        self.before = self.space if fields[DUMMY_PREFIX] and not suffix_mark else b""
        self.after = self.space if fields[DUMMY_PREFIX] and suffix_mark else b""

    def _mapped(self, text: str) -> tuple[bytes, np.ndarray, int]:
        """The text through the character map, the source of each byte, and where its leading spaces end."""
        starting = self.map.starting(text)
        if not starting:
            data = text.encode()
            return data, np.arange(len(data)), len(data) - len(data.lstrip(b" "))
        out, source, at, done, heading = [], [], 0, 0, True  # at: in bytes, done: in characters
        lead = 0

        def plain(end: int) -> None:
            nonlocal at, done, heading, lead
            if end > done:
                data = text[done:end].encode()
                out.append(data)
                source.append(np.arange(at, at + len(data)))
                if heading:
                    spaces = len(data) - len(data.lstrip(b" "))
                    lead, heading = at + spaces, spaces == len(data)
                at, done = at + len(data), end

        for match in re.finditer("[" + re.escape("".join(starting)) + "]", text):
            entry = self.map.longest(text, match.start()) if match.start() >= done else None
            if entry:
                plain(match.start())
                count, target = entry
                out.append(target)
                source.append(np.full(len(target), at))
                size = len(text[done : done + count].encode())
                heading = heading and target == b" "
                at, done = at + size, done + count
                lead = at if heading else lead
        plain(len(text))
        return b"".join(out), np.concatenate(source), lead

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        data, source, lead = self._mapped(text)
        end = total = len(text.encode())
        if self.single:
            if lead == total:
                return b"", np.zeros(1, np.int64)
            space = np.frombuffer(data, np.uint8) == 32
            kept = ~space
            kept[1:] |= ~space[:-1]
            data, source = np.frombuffer(data, np.uint8)[kept].tobytes(), source[kept]
        widths = np.where(np.frombuffer(data, np.uint8) == 32, len(self.space), 1)
        source = np.concatenate([np.full(len(self.before), lead if self.single else 0), np.repeat(source, widths)])
        data = self.before + data.replace(b" ", self.space)
        if self.single:
            while data.endswith(self.space):
                data = data[: -len(self.space)]
                end, source = int(source[len(data)]), source[: len(data)]
        return data + self.after, np.append(source, np.full(len(self.after) + 1, end))


class _Chunks(dict):
    """Remembered chunks: piece id and bytes passed, over and over, as 32-bit numbers."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        record = array("i", self._encode(chunk)).tobytes()
        if len(self) < CACHED_CHUNKS and len(chunk) <= LONGEST_CACHED:
            self[chunk] = record
        return record


class PieceEncoder:
    """Ids of a text with the first and the last byte (exclusive) of the text behind each."""

    def __init__(self, model: bytes) -> None:
        parts = list(message(model))
        trainer = dict(message(next((v for f, v in parts if f == TRAINER), b"")))
        pieces = [{PIECE_TEXT: b"", PIECE_SCORE: b"\0\0\0\0", PIECE_TYPE: NORMAL} | dict(message(v)) for f, v in parts if f == PIECE]
        kinds = {p[PIECE_TYPE] for p in pieces}
        if trainer.get(MODEL_TYPE, 1) != BPE or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only pair-merging models without user-defined and unused pieces can be read")
        self.normalize = Normalizer(next((v for f, v in parts if f == NORMALIZER), b""), bool(trainer.get(SUFFIX_MARK)))
        self._pieces = {p[PIECE_TEXT].decode(): i for i, p in enumerate(pieces) if p[PIECE_TYPE] == NORMAL}
        self._cost = {t: -struct.unpack("<f", pieces[i][PIECE_SCORE])[0] for t, i in self._pieces.items()}
        self._unknown = next(i for i, p in enumerate(pieces) if p[PIECE_TYPE] == UNKNOWN)
        self._bytes = [i for _, i in sorted((int(p[PIECE_TEXT][3:5], 16), i) for i, p in enumerate(pieces) if p[PIECE_TYPE] == BYTE)]
        self._fallback = bool(trainer.get(BYTE_FALLBACK)) and len(self._bytes) == 256
        self._chunk = re.compile(self._chunk_pattern(), re.DOTALL)
        self._known = _Chunks(self._merge)

    def _chunk_pattern(self) -> str:
        """Runs of characters that merges cannot leave: an odd character, or marks, others and letters in this order.

        Letters are closed under what follows a letter in some piece, so no piece crosses the end of such a run.
        """
        longer = [p for p in self._pieces if len(p) > 1]
        joining = set("".join(longer)) - {MARK}
        if any(MARK in p.lstrip(MARK) for p in longer):
            return "[" + re.escape("".join(joining | {MARK})) + "]+|."
        followers: dict[str, set[str]] = {}
        for piece in longer:
            for a, b in zip(piece.lstrip(MARK), piece.lstrip(MARK)[1:]):
                followers.setdefault(a, set()).add(b)
        letters = new = {c for c in joining if c.isalpha()}
        while new:
            new = set().union(*(followers.get(c, set()) for c in new)) - letters
            letters = letters | new
        none = "(?!)"  # an empty class is no pattern
        inside, before = ("[" + re.escape("".join(sorted(c))) + "]" if c else none for c in (letters, joining - letters))
        return f"{MARK}*(?:{before}*{inside}+|{before}+)|{MARK}+|."

    def _short(self, symbols: list[str]) -> list[str]:
        """Merged symbols of a short chunk: the best pair, of equals the leftmost, is sought anew each time."""
        cost = self._cost.get
        pairs = [cost(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = cost(symbols[i] + symbols[i + 1], NEVER)
            if i:
                pairs[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The same for chunks of any length: pairs wait in a heap, and outdated ones are passed over."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            cost = self._cost.get(symbols[left] + symbols[right])
            if cost is not None:
                heappush(heap, (cost, left, right, len(symbols[left]) + len(symbols[right])))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s in symbols if s]

    def _merge(self, chunk: str) -> list[int]:
        """Ids of a chunk and the bytes each passes; of a character in bytes only the last passes any."""
        pieces = self._pieces
        symbols = (self._short if len(chunk) <= LONGEST_CACHED else self._long)(list(chunk))
        out: list[int] = []
        for symbol in symbols:
            data, known = symbol.encode(), pieces.get(symbol)
            if known is not None or not self._fallback:
                out += self._unknown if known is None else known, len(data)
            else:
                for b in data[:-1]:
                    out += self._bytes[b], 0
                out += self._bytes[data[-1]], len(data)
        return out

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, source = self.normalize(text)
        records = b"".join(map(self._known.__getitem__, self._chunk.findall(data.decode())))
        ids, passed = np.frombuffer(records, np.int32).reshape(-1, 2).T
        ends = np.cumsum(passed)
        starts = ends - passed
        if not self._fallback and len(ids):  # unknown neighbours are one piece
            unknown = ids == self._unknown
            last = ~unknown | ~np.append(unknown[1:], False)
            first = ~unknown | ~np.append(False, unknown[:-1])
            ids, starts, ends = ids[first], starts[first], ends[last]
        return ids, source[starts], source[ends]


def read_model(model: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(model), "rb") as file:
        return file.read()


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int32()))


def encode_pieces(documents: DataFrame, model: str = MODEL, decoded: bool = False) -> DataFrame:
    """``doc_id, ids, starts, ends``: piece ids of every whole text, and the bytes of its UTF-8 that each stands for.

    Of a character that is spelled in byte pieces, the last one has the character's bytes and the others none.
    ``decoded`` adds the text that the ids stand for, from the same worker.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("encoders", model, lambda: PieceEncoder(read_model(model)))
        for batch in slices(batches, 128):
            found = [encoder(text.as_py() or "") for text in batch.column(1)]
            columns = {"doc_id": batch.column(0)} | {c: _lists([f[i] for f in found]) for i, c in enumerate(("ids", "starts", "ends"))}
            if decoded:
                columns["decoded"] = pa.array([decoder(model).decode(f[0].tolist()) for f in found], pa.string())
            yield pa.record_batch(columns)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
    return texts.mapInArrow(encode, shape + ", decoded string" * decoded)


def decoder(model: str):
    import sentencepiece

    return kept("decoders", model, lambda: sentencepiece.SentencePieceProcessor(model_proto=read_model(model)))


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text that the array ``ids`` stands for; null for null ids."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if row is None else decoder(model).decode(row) for row in ids.to_pylist()], pa.string())

    return encoded.withColumn("decoded", decode("ids"))


def piece_digests(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and ``n_bytes``, where the last piece ends."""
    pieces = encode_pieces(documents, model, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return pieces.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )
