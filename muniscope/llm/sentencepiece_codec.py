"""SentencePiece encoding and decoding with byte offsets into the original text.

The model's normaliser is re-run with alignment: at each position the longest prefix
found in the compiled character map (a double-array trie with a table of replacements)
is replaced, otherwise one character is copied; every normalised byte records the source
byte it came from. Ids come from the sentencepiece library; as the pieces spell the
normalised text, the running sum of their lengths, sent through the alignment, gives each
piece's span in the original UTF-8 bytes.

The model file is a parameter; without one the default is found by the worker itself, so the driver's
folders need not be the executors'.

Other columns of a table are not read and may have any name.

Defined results: null and empty texts give the end id alone and decode to the empty text; a byte
that is not part of valid UTF-8 is encoded as U+FFFD and spans that byte; repeated rows give repeated results; an empty table an empty result. Memory follows the
longest single text.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, record_batch, table, utf8

SPACE = "▁".encode()


def _fields(blob: bytes):
    """(number, value) of a protobuf message's fields; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(blob):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = blob[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = blob[at : at + n], at + n
        yield tag >> 3, value


class CharacterMap:
    """The compiled map: little-endian trie size, trie units, zero-ended replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
        self.replacements = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at`` and its replacement."""
        units, best = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if (unit & (1 << 31 | 255)) != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.replacements.index(b"\0", best[1])
        return best[0], self.replacements[best[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normaliser:
    def __init__(self, model: bytes):
        spec = next((v for k, v in _fields(model) if k == 3), b"")
        known = dict(_fields(spec))
        self.map = CharacterMap(known[2]) if known.get(2) else None
        self.dummy_prefix = bool(known.get(3, 1))
        self.squeeze = bool(known.get(4, 1))
        self.escape = bool(known.get(5, 1))

    def run(self, text: bytes) -> tuple[bytes | None, np.ndarray]:
        """Normalised bytes (None on the vector path, which needs only their alignment) and,
        for each of them and the end, the source byte."""
        if self.map is None and not self.squeeze and self.escape:
            return None, self._identity(text)
        return self._general(text)

    def _identity(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(text, dtype=np.uint8)
        at = np.repeat(np.arange(raw.size), np.where(raw == 32, len(SPACE), 1))
        head = np.zeros(len(SPACE) if self.dummy_prefix else 0, dtype=np.int64)
        return np.concatenate([head, at, [raw.size]])

    def _general(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE if self.escape else b" "
        out: list[tuple[bytes, int, int]] = []  # replacement, source begin, source end
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map else None
            if hit:
                n, new = hit
            else:
                lead = text[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = text[at : at + n]
            out.append((new, at, at + n))
            at += n
        flat = [(bytes([b]), begin, end) for new, begin, end in out for b in new]
        if self.squeeze:
            kept: list[tuple[bytes, int, int]] = []
            for item in flat:
                if item[0] != b" " or kept and kept[-1][0] != b" ":
                    kept.append(item)
            while kept and kept[-1][0] == b" ":
                kept.pop()
            flat = kept
        body, align = bytearray(), []
        if flat and self.dummy_prefix:
            body += space
            align += [flat[0][1]] * len(space)
        for byte, begin, _ in flat:
            new = space if byte == b" " else byte
            body += new
            align += [begin] * len(new)
        align.append(flat[-1][2] if flat else 0)
        return bytes(body), np.array(align, dtype=np.int64)


class Codec:
    """One model, loaded once in each worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        with open(model_file, "rb") as f:
            self.normaliser = Normaliser(f.read())
        n = self.sp.get_piece_size()
        self.length = np.array(
            [
                0 if self.sp.is_control(i) else 1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode())
                for i in range(n)
            ],
            dtype=np.int64,
        )
        self.unknown = self.sp.unk_id()
        self.decimal = [str(i) for i in range(n)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, add_eos=True, num_threads=1)

    def spans(self, raw: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every id in the original bytes; control ids are empty spans at the end."""
        fixed, origin = repaired(raw)
        text = raw if origin is None else fixed.encode()
        _, align = self.normaliser.run(text)
        ids_array = np.array(ids, dtype=np.int64)
        length = self.length[ids_array]
        unknown = np.flatnonzero(ids_array == self.unknown)
        if unknown.size:  # without byte fallback: the library tells what each unknown piece covers
            proto = self.sp.encode(fixed, return_type="proto")
            length[: len(proto.pieces)] = [len(p.piece.encode()) for p in proto.pieces]
        ends = np.cumsum(length)
        if ends.size and ends[-1] != align.size - 1:
            raise ValueError(f"pieces spell {ends[-1]} bytes, the normalised text has {align.size - 1}")
        if origin is not None:
            align = origin[align]
        return align[ends - length], align[ends]


_codecs: dict[str | None, Codec] = {}


def codec(model_file: str | None = None) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file or default_model())
    return _codecs[model_file]


def repaired(raw: bytes) -> tuple[str, np.ndarray | None]:
    """The text, and for each byte of its UTF-8 form and the end the byte of ``raw``; None: the same byte."""
    try:
        return raw.decode("utf-8"), None
    except UnicodeDecodeError:
        chars = raw.decode("utf-8", "surrogateescape")
    bad = [0xDC80 <= ord(c) <= 0xDCFF for c in chars]
    text = "".join("\ufffd" if b else c for c, b in zip(chars, bad))
    size = np.array([len(c.encode()) for c in text])
    source = np.where(bad, 1, size)
    begin = np.repeat(np.cumsum(source) - source, size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return text, np.append(begin + np.where(np.repeat(bad, size), 0, inside), len(raw))


TOKENS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("begins", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("decoded", pa.string()),
    ]
)
DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("spanned_bytes", pa.int64()),
    ]
)


def _parts(batch: pa.RecordBatch, most: int = 1 << 20):
    """Slices of a batch with at most ``most`` bytes of text, one row at least."""
    raw = batch.column(1).to_pylist()
    start = size = 0
    for i, text in enumerate(raw):
        if i > start and size + len(text) > most:
            yield batch.column(0)[start:i], raw[start:i]
            start, size = i, 0
        size += len(text)
    yield batch.column(0)[start:], raw[start:]


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): every piece with its span of original bytes."""

    def rows(batch):
        c = codec(model_file)
        for keys, raw in _parts(batch):
            ids = c.encode([repaired(t)[0] for t in raw])
            spans = [c.spans(t, i) for t, i in zip(raw, ids, strict=True)]
            yield record_batch(TOKENS, keys, ids, [s[0] for s in spans], [s[1] for s in spans], c.sp.decode(ids))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_b"))
    return map_rows(source, rows, "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string")


def encode_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """As encode_documents, with digests in place of ids and text; spanned_bytes is what the
    pieces' spans cover, the whole text if nothing was lost."""

    def rows(batch):
        c = codec(model_file)
        for keys, raw in _parts(batch):
            all_ids = c.encode([repaired(t)[0] for t in raw])
            decoded = c.sp.decode(all_ids)
            covered = []
            for text, ids in zip(raw, all_ids, strict=True):
                begins, ends = c.spans(text, ids)
                covered.append(int((ends - begins).sum()))
            names = c.decimal
            yield record_batch(
                DIGESTS,
                keys,
                [len(i) for i in all_ids],
                [hashlib.sha256(" ".join([names[k] for k in i]).encode()).hexdigest() for i in all_ids],
                [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
                covered,
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_b"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long"
    return map_rows(source, rows, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the digests of what the stages before kept."""
    return encode_digests(docs)
