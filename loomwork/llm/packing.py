"""Token ids in bit-packed blocks, written and read by Spark.

Every id takes the fewest bits that hold the vocabulary. The file format is a Parquet table of
blocks: the packed bytes of whole documents, the documents' ids and the offsets of their first
token inside the block. A block closes at `BLOCK_IDS` ids and never splits a document, so any
document is read by unpacking a bit range of one block with numpy (`read_ids`). Blocks carry the number of
their part (a range of document ids, in ascending order) and the part's tokens are summed into
global starts when files are read. Spark's committer writes the files, so a lost task leaves
nothing behind.

Defined cases: null text is empty and holds the end id alone; null ids come first, equal ids are
ordered by the hash of their text; repeated rows are written each; an empty table writes no
blocks and reads back empty. Further columns are ignored.
"""

from __future__ import annotations

import contextlib
import string
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import vocab

#: a block closes when it holds this many ids
BLOCK_IDS = 1 << 16
#: bytes of text in a part of the sorted output
PART_BYTES = 32 << 20
END_ID = 1
#: stands between words that the library gets in one text
MARK = "\x01"
#: signs that may stand behind a word
SIGNS = string.punctuation
#: what has a lower case in Latin-1
CAPITALS = " ".join(c for c in map(chr, range(256)) if c.lower() != c)
_ID_TYPES = {"int": pa.int32(), "string": pa.string()}

BLOCKS = (
    "part int, block long, bits int, n_ids long, doc_ids array<{kind}>,"
    " offsets array<long>, packed binary"
)


def width(vocabulary: int) -> int:
    """Bits that hold ids below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit stream of the ids, `bits` each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """`count` ids from position `start` of a packed block; reads only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    stream = np.unpackbits(np.frombuffer(packed, np.uint8, last - first, first), bitorder="little")
    at = start * bits - first * 8
    planes = stream[at : at + count * bits].reshape(count, bits).astype(np.uint32)
    return (planes << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Ids of texts; words between white space are encoded once and looked up afterwards."""

    def __init__(self, content: bytes) -> None:
        self.tokenizer = vocab.tokenizer(content)
        self.special = vocab.added_tokens(self.tokenizer)
        self.bits = width(self.tokenizer.get_vocab_size())
        # ids that end a piece; the library cuts words into pieces, and a word of letters is one
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for token, number in self.tokenizer.get_vocab().items() if suffix else ():
            self.ends[number] = token.endswith(suffix)
        self.mark = self._text(MARK)
        self.parts = vocab.Memo(self.joined)
        self.memo = vocab.Memo(self.words if suffix and len(self.mark) == 1 else self.library)
        self.cut: dict[str, bool] = {}
        # where the library ignores case, words that differ in it are encoded once
        self.caseless = np.array_equal(self._text(CAPITALS), self._text(CAPITALS.lower()))

    def library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return vocab.flattened([e.ids for e in got])

    def _text(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, np.int32)

    def split(self, text: str) -> list[str]:
        """Words between white space, in lower case if the library makes the same of Latin-1 text."""
        if self.caseless:
            with contextlib.suppress(UnicodeEncodeError):
                text.encode("latin-1")
                return text.lower().split()
        return text.split()

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `library` for words without white space, which it gets joined to two texts.

        Words of letters are one piece each, so their ids show where they end; a mark ends each of
        the others. Where there are not as many ends or marks as words, they go one by one.
        """
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        plain = self._text(" ".join(compress(words, letters)))
        others = self._text("".join(f"{w} {MARK} " for w in compress(words, ~letters)))
        ends, marks = np.flatnonzero(self.ends[plain]), others == self.mark[0]
        if len(ends) != letters.sum() or marks.sum() != len(words) - len(ends):
            return self.library(words)
        lengths = np.zeros(len(words), np.int64)
        lengths[letters] = np.diff(ends, prepend=-1)
        lengths[~letters] = np.diff(np.flatnonzero(marks), prepend=-1) - 1
        ids, of_letters = np.zeros(int(lengths.sum()), np.int32), np.repeat(letters, lengths)
        ids[of_letters], ids[~of_letters] = plain, others[~marks]
        return ids, lengths

    def _tail(self, tail: str) -> bool:
        """Whether the library cuts these signs off a word of letters, in one piece."""
        if len(tail) > 4:
            return False
        if tail not in self.cut:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{tail}")
            self.cut[tail] = [span for _, span in pieces] == [(0, 1), (1, 1 + len(tail))]
        return self.cut[tail]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `joined`; words of letters with signs behind are looked up as these two parts."""
        parts, starts = [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            starts[i] = len(parts)
            stem = word if word.isalpha() else word.rstrip(SIGNS)
            if len(stem) < len(word) and stem.isalpha() and self._tail(word[len(stem) :]):
                parts += [stem, word[len(stem) :]]
            else:
                parts.append(word)
        ids, lengths = self.parts.encoded(parts)
        return ids, np.add.reduceat(lengths, starts) if words else lengths

    def encode(self, texts: list[str], end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with `end`, and the number of ids of each text.

        The words of all texts are looked up together, so new ones reach the library in one call.
        """
        whole = [i for i, t in enumerate(texts) if vocab.whole_only(t, self.special)]
        apart = set(whole)
        counts, flat, sizes, slots = np.zeros(len(texts), np.int64), [], [], []
        lists = [(i, self.split(t)) for i, t in enumerate(texts) if i not in apart]
        if lists:
            ids, lengths = self.memo.encoded([w for _, ws in lists for w in ws])
            ends = np.cumsum([len(ws) for _, ws in lists])
            upto = np.concatenate([[0], np.cumsum(lengths)])
            tokens = upto[ends] - upto[ends - np.array([len(ws) for _, ws in lists])]
            flat.append(ids)
            sizes.append(tokens)
            slots.extend(i for i, _ in lists)
        if whole:
            ids, tokens = self.library([texts[i] for i in whole])
            flat.append(ids)
            sizes.append(tokens)
            slots.extend(whole)
        if not texts:
            return np.zeros(0, np.int32), counts
        found, sizes = np.concatenate(flat), np.concatenate(sizes)
        counts[slots] = sizes + 1
        # texts go to their places: from where they were found to where they start
        starts = np.cumsum(counts) - counts
        out = np.full(int(counts.sum()), end, np.int32)
        shift = np.repeat(starts[slots] - (np.cumsum(sizes) - sizes), sizes)
        out[np.arange(len(found)) + shift] = found
        return out, counts


def sorted_parts(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id and text (null: empty) in ranges of ascending doc_id, ordered inside."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    parts = max(1, -(-total // part_bytes))
    return rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)


def write_packed(
    docs: DataFrame, path: str, file: str = "word_bpe_49k.json", part_bytes: int = PART_BYTES,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode and write `docs` under `path`."""
    shared = vocab.shipped(docs.sparkSession, file)
    kind = docs.schema["doc_id"].dataType.simpleString()
    field = _ID_TYPES.get(kind, pa.int64())

    def run(batches):
        encoder = vocab.once(shared, Encoder)
        part, number, ids, docs_in, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            counts = np.concatenate(sizes)
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int64()),
                    pa.array([encoder.bits], pa.int32()), pa.array([len(flat)], pa.int64()),
                    pa.array([docs_in], pa.list_(field)),
                    pa.array([(np.cumsum(counts) - counts).tolist()], pa.list_(pa.int64())),
                    pa.array([pack(flat, encoder.bits)], pa.binary()),
                ],
                ["part", "block", "bits", "n_ids", "doc_ids", "offsets", "packed"],
            )

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for start, end in vocab.steps(texts, 200_000):
                flat, counts = encoder.encode(texts[start:end])
                ids.append(flat)
                sizes.append(counts)
                docs_in.extend(keys[start:end])
                held += len(flat)
                if held >= block_ids:
                    yield block()
                    number, ids, docs_in, sizes, held = number + 1, [], [], [], 0
        if docs_in:
            yield block()

    blocks = sorted_parts(docs, part_bytes).mapInArrow(run, BLOCKS.format(kind=kind))
    blocks.write.mode("errorifexists").parquet(path)


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, start_in_block, ids) of the wanted documents in the files under `path`.

    `doc_ids` has a column doc_id; a null asks for the documents without an id, an id that several
    documents share gives each of them, and one that is not there gives none. Packed bytes are read
    from the blocks that hold a wanted document only, and of these only its bits are unpacked.
    """
    vocab.small_batches(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # where each document ends: where the next one starts
    ends = F.concat(F.slice("offsets", 2, F.size("offsets")), F.array("n_ids"))
    places = blocks.select(
        "part", "block", F.inline(F.arrays_zip("doc_ids", "offsets", ends.alias("ends")))
    ).toDF("part", "block", "doc_id", "offset", "end")
    wanted = doc_ids.select(F.col("doc_id").alias("_wanted")).distinct()
    found = places.join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    # a block has at most as many documents as ids
    found = found.groupBy("part", "block").agg(
        F.collect_list(F.struct("offset", "end", "doc_id")).alias("docs")
    )
    chosen = blocks.select("part", "block", "bits", "packed").join(found, ["part", "block"])

    def run(batches):
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                docs = row["docs"]
                for at in range(0, len(docs), 256):
                    some = docs[at : at + 256]
                    ids = [
                        unpack(row["packed"], row["bits"], d["offset"], d["end"] - d["offset"])
                        for d in some
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d["doc_id"] for d in some], _ID_TYPES.get(kind, pa.int64())),
                            pa.array([d["offset"] for d in some], pa.int64()),
                            pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                        ],
                        ["doc_id", "start_in_block", "ids"],
                    )

    return chosen.select("bits", "packed", "docs").mapInArrow(
        run, f"doc_id {kind}, start_in_block long, ids array<int>"
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under `path`."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flat = unpack(row["packed"], row["bits"], 0, row["n_ids"]).astype("<u4")
                starts = [*row["offsets"], row["n_ids"]]
                pairs = list(zip(starts, starts[1:], strict=False))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        "part": pa.array([row["part"]] * len(pairs), pa.int32()),
                        "block": pa.array([row["block"]] * len(pairs), pa.int64()),
                        "offset": pa.array([a for a, _ in pairs], pa.int64()),
                        "n_tokens": pa.array([b - a for a, b in pairs], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(flat[a:b]) for a, b in pairs], pa.int64()),
                    }
                )

    digests = blocks.mapInArrow(
        run, f"doc_id {kind}, part int, block long, offset long, n_tokens long, ids_crc32 long"
    )
    # a row for each block of about 65,536 ids: first summed by part, then inside each part
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.join(parts, "part").select(
        "part", "block",
        (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first"),
    )
    return digests.join(firsts, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
