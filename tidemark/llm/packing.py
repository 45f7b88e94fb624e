"""Pack tokenised documents into fixed-length sequences by bounded-space online best-fit."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

LENGTH = 2048
#: A shard of about so many tokens is packed by one task; its open bins are the only ones left partly filled.
SHARD_TOKENS = 8_000_000
OPEN_BINS = 128
#: Keys in a generation of the tokenizer's caches: some 200 MB a worker at most.
CACHE_WORDS = 300_000

# How the tokenizer file splits a normalised text, and the byte alphabet of its vocabulary.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Texts with characters beyond Latin and common punctuation, or with a special token, go through the tokenizer itself.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞€]|<\\|")


class _Cache(dict):
    """make(key), kept in two generations of at most `most` keys each: when the younger is full it becomes the elder,
    and keys that are asked for again move over. Common words thus stay however many rare ones pass."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.elder = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.elder.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.elder = dict(self)
            self.clear()
        self[key] = found
        return found


class WordTokenizer:
    """The ids of texts under a word BPE file, as little-endian 32-bit bytes.

    Words between blanks never share a token, so their ids are kept in a bounded cache and only new words are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model, split = self.whole.model, regex.compile(_PIECES).findall
        rest = [b for b in range(256) if b not in set(_PRINTABLE)]
        alphabet = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}

        def piece_ids(piece: str) -> bytes:
            spelt = piece.encode().decode("latin1").translate(alphabet)
            return array("I", [t.id for t in model.tokenize(spelt)]).tobytes()

        def word_ids(word: str) -> bytes:
            lowered = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
            return piece(lowered) if lowered.isalpha() else b"".join(map(piece, split(lowered)))

        piece = _Cache(piece_ids, CACHE_WORDS).__getitem__
        self.words = _Cache(word_ids, CACHE_WORDS)

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _forget_tokenizers() -> None:
    """For the end of a task. Workers outlive their tasks: the caches would else lie beside the memory of what runs next."""
    _loaded.clear()


def tokenized_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 and (if wanted) ids, the little-endian 32-bit ids of each piece.

    A document is its ids and then `end_id`; only longer ones are cut, after every `length` ids. A null or empty text
    is the end id alone. `row` tells apart rows of one doc_id.
    """
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(path)
        try:
            for batch in batches:
                out: list[list] = [[] for _ in range(6 + with_ids)]
                for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    ids = tokens.ids(text.as_py() or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        for column, value in zip(out, (doc, row, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names[: len(out)])
        finally:
            _forget_tokenizers()

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(cut, schema)


class OpenBins:
    """A fixed number of open bins. Bit f of `free` is set while a bin with f free places is open."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.count, self.free, self.made = length, most, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        bins = self.by_free[space]
        found = bins.pop()
        if not bins:
            self.free ^= 1 << space
        self.count -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset for a piece: the fullest bin that has room for it, or a new one."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.length, self.made
            self.made += 1
        left = space - size
        if left:
            if self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            self.by_free.setdefault(left, []).append(found)
            self.free |= 1 << left
            self.count += 1
        return found, self.length - space


def best_fit(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, row, piece, start, length, ids_crc32).

    Pieces are dealt by a hash of document and piece to shards of about `shard_tokens` tokens, each packed online, in
    the order of that hash, by one task that keeps `open_bins` bins and streams its rows. A lost task packs the same
    rows in the same order again.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, round(total / shard_tokens))
    columns = [c for c in pieces.columns if c != "ids"]
    key = F.xxhash64("doc_id", "piece", "row")
    dealt = pieces.withColumn("key", key).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "doc_id", "row", "piece")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, shard = None, None
        for batch in batches:
            sequence, offset = [], []
            for s, size in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist()):
                if s != shard:
                    bins, shard = OpenBins(length, open_bins), s
                found, at = bins.place(size)
                sequence.append((s << 40) + found)
                offset.append(at)
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return dealt.drop("ids").mapInArrow(pack, f"{schema}, sequence_id long, offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves, each put together from at most `length` ids."""
    joined = pieces.select("row", "piece", "ids").join(placed.select("row", "piece", "sequence_id", "offset"), ["row", "piece"])
    rows = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, b: F.concat(a, b["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """All pieces of all documents with their places; repeated rows are packed as often as they come."""
    return best_fit(staged(tokenized_pieces(docs, path, with_ids=False))).drop("row")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces of all documents.

    Null or empty text: the end id alone, one piece of length 1. Longer documents are cut into whole sequences and a
    rest. Repeated rows and null ids are packed as often as they come. Pieces of equal key follow by doc_id, row and
    piece; of equally full bins the last one filled takes the piece. Empty table: no rows. Further columns are not read.
    """
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
