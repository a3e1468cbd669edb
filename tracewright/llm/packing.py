"""Vector bin packing of token sequences.

Examples are vectors of (tokens, segments, loss-bearing tokens); a sequence
holds at most CAPACITY in each of them. Bins are filled one after the other,
each time with the example that fits and has the largest dot product with the
room that is left. Texts longer than a sequence are cut at multiples of its
length; rests longer than `max_rest` are cut again there, so that there are
small pieces to fill up with.

Defined cases: a null text is empty, and is one piece holding only the end id;
repeated rows (equal ids too) are packed each by itself; ties go to the longer
piece, then by document and start; an empty table gives no pieces; columns
other than the id and the text aren't read.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, slices

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
CAPACITY = (2048, 256, 2048)
#: Pieces that are packed together in one task; rests are cut at this length; bytes of chunks and ids that a worker remembers, and what an entry takes beside them.
GROUP, MAX_REST, REMEMBERED, ENTRY = 8192, 1024, 96 << 20, 170
END_ID = 1


def pack_vectors(items: np.ndarray, capacity: tuple[int, ...] = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """items: [n, dims] of whole numbers, each within capacity. The bin of each item and its position in it (0, 1, ..)."""
    n = len(items)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, places
    kinds, kind = np.unique(items, axis=0, return_inverse=True)
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    begins = np.searchsorted(kind[order], np.arange(len(kinds)))
    left = np.bincount(kind, minlength=len(kinds))
    taken, scale = np.zeros(len(kinds), np.int64), 1.0 / np.asarray(capacity, float)
    alive = np.arange(len(kinds))
    vectors, weights, done, b = kinds, kinds * scale, 0, 0
    while done < n:
        room, place = np.asarray(capacity, np.int64).copy(), 0
        while True:
            fits = (vectors <= room).all(1)
            if not fits.any():
                break
            gain = np.where(fits, weights @ (room * scale), -1.0)
            i = len(gain) - 1 - int(gain[::-1].argmax())
            k = alive[i]
            item = order[begins[k] + taken[k]]
            bins[item], places[item] = b, place
            room -= kinds[k]
            taken[k] += 1
            left[k] -= 1
            place += 1
            done += 1
            if not left[k]:
                alive = alive[left[alive] > 0]
                vectors, weights = kinds[alive], kinds[alive] * scale
                if not len(alive):
                    break
        if not place:
            raise ValueError("an item is larger than the capacity")
        b += 1
    return bins, places


class WordEncoder:
    """Ids of single lower-case words under a BPE with ends of words, by the rank-merging encoder of tiktoken.

    It merges bytes; the end of a word is a byte 255 of its own (UTF-8 has
    none), and pairs with it come first, so that the last byte is marked before
    any other merge, as the vocabulary has it.
    """

    def __init__(self, spec: dict):
        import tiktoken

        end = spec["model"]["end_of_word_suffix"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        byte = {c: b for b, c in shown.items()}
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(end)) + (b"\xff" if t.endswith(end) else b"")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for merge in spec["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(left + right), len(ranks) + 1)
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.raw = {rank: struct.pack("<I", i) for key, rank in ranks.items() if (i := ids.get(key)) is not None}
        self.encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __call__(self, word: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, self.encode(word + b"\xff")))


class Remembered:
    """Values by key in two generations: when the young one is as large as it may be it becomes the old one, and what is asked for again is young again. At most `most` bytes, and those of one turn()."""

    def __init__(self, most: int):
        self.young, self.old, self.most, self.held = {}, {}, most, 0

    def turn(self) -> None:
        if self.held > self.most // 2:
            self.young, self.old, self.held = {}, self.young, 0


def loaded() -> dict[str, tuple]:
    """Tokenizer, word encoder and remembered chunks by path, for as long as the process lives: in a module of its own, since this one reaches executors by value, anew with each task."""
    return sys.modules.setdefault("_tracewright_loaded", types.ModuleType("_tracewright_loaded")).__dict__.setdefault("chunks", {})


class ChunkTokenizer:
    """Token ids as little-endian 32-bit bytes.

    The tokenizer splits at white space before anything else, so a text's ids
    are those of its white-space chunks in a row. A chunk of letters, with
    signs of PUNCTUATION behind them or not, is a word and a run of signs; all
    other chunks go to the tokenizer itself. Ids of chunks and words are
    remembered for as long as the worker lives, up to REMEMBERED bytes, a
    quarter of them words (and what one text adds).
    """

    PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        known = loaded()
        if path not in known:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            words = spec["model"].get("end_of_word_suffix") == "</w>" and "[\\p{L}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\") and "Lowercase" in json.dumps(spec["normalizer"])
            known[path] = (tokenizers.Tokenizer.from_file(path), WordEncoder(spec) if words else None, Remembered(REMEMBERED // 4 * 3), Remembered(REMEMBERED // 4))
        self.tokenizer, self.encoder, self.seen, self.words = known[path]

    def _whole(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        body = chunk.rstrip(self.PUNCTUATION)
        if self.encoder is None or not body:
            return self._whole(chunk)
        if body.isalpha():
            word = body.lower()
        else:
            text = body.decode()
            low = text.lower()
            # a capital sigma is lowered by its place, some letters to two, and what isn't composed is composed first
            if not text.isalpha() or "\u03a3" in text or len(low) != len(text) or not unicodedata.is_normalized("NFC", text):
                return self._whole(chunk)
            word = low.encode()
        ids = self._word(word)
        return ids if len(body) == len(chunk) else ids + self._sign(chunk[len(body) :])

    def _word(self, word: bytes) -> bytes:
        words = self.words
        ids = words.young.get(word)
        if ids is None:
            ids = words.young[word] = words.old.get(word) or self.encoder(word)
            words.held += len(word) + len(ids) + ENTRY
        return ids

    def _sign(self, tail: bytes) -> bytes:
        ids = self.words.young.get(tail)
        if ids is None:
            ids = self.words.young[tail] = self._whole(tail)
            self.words.held += len(tail) + len(ids) + ENTRY
        return ids

    def ids(self, texts: list[bytes | None]) -> Iterator[bytes]:
        seen = self.seen
        for text in texts:
            chunks = (text or b"").split()
            if new := set(chunks).difference(seen.young):
                young, old, grown = seen.young, seen.old, 0
                for c in new:
                    ids = old.get(c)
                    if ids is None:
                        ids = self._chunk(c)
                    young[c] = ids
                    grown += len(c) + len(ids)
                seen.held += grown + ENTRY * len(new)
            yield b"".join(map(seen.young.__getitem__, chunks))
            seen.turn()
            self.words.turn()


def piece_bounds(n: int, length: int, max_rest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces that n ids are cut into."""
    at = [(i, length) for i in range(0, n - length + 1, length)]
    start = len(at) * length
    while start < n:
        size = min(n - start, max_rest)
        at.append((start, size))
        start += size
    return at


def pieces(docs: DataFrame, tokenizer: str, length: int = CAPACITY[0], max_rest: int = MAX_REST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and `slot`, a number of its own for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, slot = ChunkTokenizer(tokenizer), TaskContext.get().partitionId() << 34
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            ids = batch.column(0)
            rows, starts, lengths, sums, sizes = [], [], [], [], []
            for i, buf in enumerate(chunks.ids(batch.column(1).cast(pa.binary()).to_pylist())):
                buf += end
                n = len(buf) // 4
                for at, size in piece_bounds(n, length, max_rest):
                    rows.append(i)
                    starts.append(at)
                    lengths.append(size)
                    sums.append(zlib.crc32(memoryview(buf)[4 * at : 4 * (at + size)]))
                    sizes.append(n)
            slots = np.arange(slot, slot + len(rows))
            slot += len(rows)
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(long(rows)), long(starts), long(lengths), long(sums), long(sizes), pa.array(slots)], ["d", "start", "length", "ids_crc32", "doc_tokens", "slot"])

    source = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["d"].dataType.simpleString()
    return source.mapInArrow(run, f"d {kind}, start long, length long, ids_crc32 long, doc_tokens long, slot long")


def place(parts: DataFrame, capacity: tuple[int, int, int] = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows of (d, start, length, .., slot); `loss`, where there is such a column, else the length, counts as loss-bearing.

    Rows are dealt by a hash of slot into groups of about `group` rows, each
    packed by itself in one task with bounded memory.
    """
    n = max(1, -(-parts.count() // group))
    columns, losses = parts.columns, "loss" in parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        table = table.sort_by([("length", "descending"), ("slot", "ascending")])
        size = table["length"].to_numpy()
        loss = table["loss"].to_numpy() if losses else size
        bins, places = pack_vectors(np.stack([size, np.ones_like(size), loss], 1), capacity)
        order = np.lexsort((places, bins))
        ends = np.cumsum(size[order])
        firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty_like(ends)
        offset[order] = ends - size[order] - np.repeat((ends - size[order])[firsts], np.diff(firsts, append=len(order)))
        base = TaskContext.get().partitionId() << 34
        table = table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offset.astype(np.int64)))
        yield from table.to_batches(max_chunksize=50_000)

    dealt = parts.select(*columns).repartition(n, F.xxhash64("slot"))
    return dealt.mapInArrow(run, parts.schema.add("sequence_id", "long").add("offset", "long"))


def instruction_examples(turns: DataFrame, tokenizer: str | None = None, loss_roles: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """d, length, loss, turns and slot of each conversation: its tokens (each turn's ids and an end id), those of loss_roles, and its turns.

    Turns are tokenised where they lie, and only their counts are summed.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTokenizer(path)
        for batch in slices(batches):
            sizes = [len(b) // 4 + 1 for b in chunks.ids(batch.column(2).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["d", "r", "n"])

    source = turns.select(F.col(f"`{conv_id}`").alias("d"), F.col(f"`{role}`").alias("r"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["d"].dataType.simpleString()
    counted = source.mapInArrow(run, f"d {kind}, r string, n long")
    bears = F.coalesce(F.col("r").isin(*loss_roles), F.lit(False))
    sums = counted.groupBy("d").agg(F.sum("n").alias("length"), F.sum(F.when(bears, F.col("n")).otherwise(0)).alias("loss"), F.count("*").alias("turns"))
    return cut(sums.withColumn("slot", F.monotonically_increasing_id()), "examples")


def pack_instructions(turns: DataFrame, tokenizer: str | None = None, capacity: tuple[int, int, int] = CAPACITY, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Whole conversations placed under limits on tokens, segments and loss-bearing tokens; and those that no sequence can hold, which aren't placed."""
    examples = instruction_examples(turns, tokenizer)
    fits = (F.col("length") <= capacity[0]) & (F.col("loss") <= capacity[2])
    return place(examples.filter(fits), capacity, group).drop("slot"), examples.filter(~fits).drop("slot")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    if "public_tokenizers" not in sys.modules:
        import public_tokenizers  # noqa: F401
    return sys.modules["public_tokenizers"].path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: tuple[int, int, int] = CAPACITY, max_rest: int = MAX_REST, group: int = GROUP) -> DataFrame:
    """Every id of every document in exactly one piece of a sequence; pieces, not texts, are what is dealt out."""
    parts = cut(pieces(docs, tokenizer or tokenizer_path(), capacity[0], max_rest), "pieces")
    return place(parts, capacity, group).select(F.col("d").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
